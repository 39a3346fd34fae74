"""Files of taxa and documents: a taxon a document, ends of documents, a taxonomy, classes of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators.order import global_rank


def _numbered(spark: SparkSession, path: str, name: str) -> DataFrame:
    """``doc_id, name``: a number a line, documents from 1 on in the order of lines."""
    rows = spark.read.text(path).select(F.trim("value").alias("value"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    ranked = global_rank(rows.filter("value <> ''"), ["block", "at"], "doc_id", unique=True)
    return ranked.select((F.col("doc_id") + 1).alias("doc_id"), F.col("value").cast("long").alias(name))


def read_doc_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, taxon`` of a file with a taxon a line."""
    return _numbered(spark, path, "taxon")


def read_doc_offsets(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, end_off`` of a file with the end of a document a line."""
    return _numbered(spark, path, "end_off")


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """``child, parent`` of a taxonomy, tab-separated with bars between: the first and the third field."""
    cells = F.split("value", "\t")
    return spark.read.text(path).filter("value <> ''").select(F.trim(cells[0]).cast("long").alias("child"), F.trim(cells[2]).cast("long").alias("parent"))


def read_classes(spark: SparkSession, path: str) -> DataFrame:
    """``read_id, best, second`` of a file of classes; a lacking second is 0."""
    found = spark.read.schema("read_id string, best long, second long").csv(path)
    return found.select("read_id", "best", F.coalesce("second", F.lit(0).cast("long")).alias("second"))
