"""Files of a Burrows-Wheeler transform: raw bytes, or runs as a file of heads and one of lengths (5 bytes each,
little-endian). Byte 0 is the terminator."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.sequence import TERMINATOR

#: Bytes of a run's length in a file of lengths.
LENGTH_BYTES = 5


def _characters(raw: bytes) -> list[str]:
    return [TERMINATOR if b == 0 else chr(b) for b in raw]


def read_transform(spark: SparkSession, path: str) -> DataFrame:
    """``row, c`` of a raw file; a file is one task."""

    def run(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                for low in range(0, len(raw), 1 << 20):
                    some = raw[low : low + (1 << 20)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(low, low + len(some))), pa.array(_characters(some))], ["row", "c"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "row long, c string")


def read_runs(spark: SparkSession, heads: str, lengths: str) -> DataFrame:
    """``run, c, n, p`` of the two files of a transform by runs; p is the run's first row."""
    pair = spark.read.format("binaryFile").load(heads).select(F.col("content").alias("heads"))
    pair = pair.crossJoin(spark.read.format("binaryFile").load(lengths).select(F.col("content").alias("lengths")))  # a row each

    def run(batches):
        for batch in batches:
            for raw, sizes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                digits = np.frombuffer(sizes, np.uint8).reshape(-1, LENGTH_BYTES).astype(np.int64)
                n = (digits << (8 * np.arange(LENGTH_BYTES))).sum(1)
                if len(n) != len(raw):
                    raise ValueError(f"{len(raw)} heads and {len(n)} lengths")
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(_characters(raw), pa.string()), pa.array(n), pa.array(np.cumsum(n) - n)], ["run", "c", "n", "p"])

    return pair.mapInArrow(run, "run long, c string, n long, p long")


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """``run, thr`` of a file with a threshold of 5 bytes for each run."""

    def run(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                if len(raw) % LENGTH_BYTES:
                    raise ValueError(f"{len(raw)} bytes are not a whole number of thresholds")
                values = (np.frombuffer(raw, np.uint8).reshape(-1, LENGTH_BYTES).astype(np.int64) << (8 * np.arange(LENGTH_BYTES))).sum(1)
                for low in range(0, len(values), 1 << 18):
                    some = values[low : low + (1 << 18)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(low, low + len(some))), pa.array(some)], ["run", "thr"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "run long, thr long")


def expand(runs: DataFrame) -> DataFrame:
    """``row, c`` of runs (c, n, p)."""
    rows = runs.filter("n > 0").select("c", F.explode(F.sequence("p", F.col("p") + F.col("n") - 1)).alias("row"))
    return rows.select("row", "c")


def pack_runs(runs: DataFrame) -> DataFrame:
    """``run, heads, lengths`` (binary): the bytes of each run for the two files, in the order of runs."""
    digits = [F.lpad(F.hex(F.shiftright("n", 8 * k).bitwiseAND(255)), 2, "0") for k in range(LENGTH_BYTES)]
    head = F.when(F.col("c") == TERMINATOR, F.unhex(F.lit("00"))).otherwise(F.col("c").cast("binary"))
    return runs.select("run", head.alias("heads"), F.unhex(F.concat(*digits)).alias("lengths"))


def write_runs(runs: DataFrame, heads: str, lengths: str) -> None:
    """Write the two files on the driver, run after run as they arrive in order."""
    with open(heads, "wb") as a, open(lengths, "wb") as b:
        for row in pack_runs(runs).orderBy("run").toLocalIterator():
            a.write(bytes(row["heads"]))
            b.write(bytes(row["lengths"]))
