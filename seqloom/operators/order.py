"""Ranks and running sums over a whole table without one task that sees all of it.

The table is dealt by ranges and written to the shared folder with its partition's number, so that a lost task can not
deal it otherwise; totals of partitions, a row each, are summed up and broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.session import free_names, materialize


def _dealt(df: DataFrame, order: list[Column | str], part: str) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(n, *order).withColumn(part, F.spark_partition_id()))


def _before(totals: DataFrame, part: str, total: str, base: str) -> DataFrame:
    """Rows (part, total) with the sum over earlier parts; there are as many rows as partitions."""
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(totals.select(part, F.coalesce(F.sum(total).over(earlier), F.lit(0)).alias(base)))


def running_sum(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` up to and including each row, in the order of ``order``, which must be unique."""
    part, total, base, within = free_names([*df.columns, name], "_part", "_total", "_base", "_sum")
    dealt = _dealt(df, order, part)
    before = _before(dealt.groupBy(part).agg(F.coalesce(F.sum(value), F.lit(0)).alias(total)), part, total, base)
    rows = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.withColumn(within, F.sum(value).over(rows)).join(before, part).withColumn(name, F.col(within) + F.col(base)).drop(within, base, part)


def global_rank(df: DataFrame, order: list[str], name: str, unique: bool = False) -> DataFrame:
    """``df`` with the number of rows that sort before each (equal rows have equal ranks), from 0; ``unique`` numbers
    equal rows one after another."""
    part, total, base, within = free_names([*df.columns, name], "_part", "_total", "_base", "_rank")
    dealt = _dealt(df, order, part)
    before = _before(dealt.groupBy(part).agg(F.count("*").alias(total)), part, total, base)
    rows = Window.partitionBy(part).orderBy(*order)
    rank = (F.row_number() if unique else F.rank()).over(rows)
    return dealt.withColumn(within, rank).join(before, part).withColumn(name, (F.col(within) - 1 + F.col(base)).cast("long")).drop(within, base, part)
