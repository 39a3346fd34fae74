"""Streams of reads: stateless queries against a fixed index, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seqloom.operators import pml

READS = "read_id string, seq string"


def reads_stream(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """Reads from Parquet files that appear in a folder."""
    return spark.readStream.schema(READS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def profile_stream(reads: DataFrame, index: pml.Index) -> DataFrame:
    """Pseudo-matching lengths of a stream of reads; no state is kept, so any output mode but complete will do."""
    return pml.query(reads, index)


def run_batches(reads: DataFrame, query: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Start a stream that runs a relational query on every batch and appends its rows to Parquet; a batch that is run
    again after a failure overwrites its own folder."""

    def each(batch: DataFrame, number: int) -> None:
        query(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return reads.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
