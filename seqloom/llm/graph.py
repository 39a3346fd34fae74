"""Connected components of an edge table, by alternating large and small stars.

Each star step takes the least neighbour of every node in two levels (node and salt, then node), so that a node with a
third of all edges is not one task.  Edges are written to the shared folder after each round; neither edges nor
components reach the driver, only a count and a checksum of a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import with_group
from seqloom.session import materialize, release


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with ``m``, the least of u's neighbours and u."""
    out = with_group(edges, ["u"], F.min("v"), F.min("part"), "m", ["v"])
    return out.withColumn("m", F.least("u", "m"))


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = materialize(_with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
    # all edges now lead to a smaller or equal node
    down = large.filter("v < u")
    small = _with_least(down)
    out = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
    out = materialize(out.filter("u <> v").distinct())
    release(large)
    return out


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root``: every node that has an edge to another, and the least node that it can reach, itself included.

    Edges may repeat, run either way or be loops; an edge with a null end is no edge.
    """
    first = edges.filter(F.col(a) != F.col(b))
    now = materialize(first.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        then = _round(now)
        release(now)
        now = then
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
