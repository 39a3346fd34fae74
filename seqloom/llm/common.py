"""What the operators share: table access, bounded slices of Arrow batches, bounded caches, salted joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.session import free_names, materialize, ship

#: A slice of a batch that a Python worker handles at once has at most so many UTF-8 bytes, or one row.
SLICE_BYTES = 4 << 20
SLICE_ROWS = 2048
#: Hot keys of a join are spread over so many tasks.
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a test-data folder; any path that Spark reads will do."""
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _one_scan(df: DataFrame) -> bool:
    """Whether a frame is one scan of files with nothing but projections and filters on it."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().apply(0)
    return plan.nodeName() == "LogicalRelation"


def placed(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with two columns, and their names, that tell its rows apart: a hash of the file's path and the row's
    place in the file.  They are the same in every scan, however files are dealt to tasks; a frame that is no plain scan
    of Parquet files is written to the shared folder first."""
    for again in (False, True):
        if again or not _one_scan(docs):
            docs = materialize(docs)
        try:
            meta = docs.metadataColumn("_metadata")
            file, at = free_names(docs.columns, "_file", "_at")
            return docs.select("*", F.xxhash64(meta["file_path"]).alias(file), meta["row_index"].alias(at)), file, at
        except AnalysisException:
            if again:
                raise
    raise AssertionError


def text_of(column: str = "text") -> Column:
    """The text, null counted as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows whose texts together have at most so many bytes, or of one row."""
    import numpy as np
    import pyarrow.compute as pc

    give_back()
    for batch in batches:
        sizes = pc.binary_length(batch.column(batch.schema.get_field_index(text))).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, base + most, side="right"))
            stop = min(max(stop, start + 1), start + max(SLICE_ROWS, most >> 11), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def texts(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    """Texts of a slice, null as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]


def give_back() -> None:
    """Return memory that a finished task does not need; workers live on, beside other tasks of their executor."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


class Recent:
    """A cache in two generations of ``limit`` entries each: what is still asked for moves to the new one."""

    def __init__(self, limit: int):
        self.limit, self.now, self.old = limit, {}, {}

    def missing(self, keys: set) -> list:
        """Those of the keys that are in neither generation; the others are in ``now`` afterwards."""
        if len(self.now) > self.limit:
            self.now, self.old = {}, self.now
        absent = keys - self.now.keys()
        again = absent & self.old.keys()
        self.now.update((k, self.old[k]) for k in again)
        return list(absent - again)


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of an id written as text."""
    return F.crc32(F.col(column).cast("string"))


def salted(*columns: str, salts: int = SALTS) -> Column:
    """A salt that depends on the row alone, the same when a lost task runs again."""
    return F.pmod(F.xxhash64(*[F.col(c) for c in columns]), F.lit(salts)).cast("int")


def with_group(rows: DataFrame, keys: list[str], partial: Column, final: Column, name: str, spread: list[str]) -> DataFrame:
    """``rows`` with ``name``, an aggregate over each row's group; rows are read twice, so they should be stored.

    ``partial`` aggregates ``rows`` into a column ``part``; ``final`` aggregates ``part``.  Groups are reduced by key
    and salt first and joined back by key and salt, so no task gets a whole hot group.  ``spread``: columns of the salt.  Neither side is broadcast: ``rows`` may
    be larger than Spark takes them to be, and hold far more than its files (repeated roots).
    """
    dealt = rows.withColumn("_salt", salted(*spread))
    parts = dealt.groupBy(*keys, "_salt").agg(partial.alias("part"))
    whole = parts.groupBy(*keys).agg(final.alias(name))
    return dealt.join(parts.select(*keys, "_salt").join(whole.hint("merge"), keys).hint("merge"), [*keys, "_salt"]).drop("_salt")
