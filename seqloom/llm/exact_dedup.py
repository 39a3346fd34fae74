"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Main path: DataFrame functions only.  One scan makes a narrow table (row id, length, prefix hash and, if
asked for, the full digest); a row leaves as soon as its length, or its length and prefix hash, is its own.
Only the rows that are left are grouped by the full SHA-256; without ``digest`` only their texts are read again.
Groups are reduced in two levels (key and salt, then key), and their verdict is joined back by key and salt, so
a group that holds a third of all rows is spread over many tasks.

Defined results: null text is empty text and all empty texts are equal; of equal texts the one with the most code
points in the original stays, then the smallest doc_id (null last); of rows that repeat a doc_id and a text exactly one
stays, by the row's place in its file. An empty table gives an empty result. Further columns of the input are not read.

Rows are told apart by file and place in the file (``common.placed``), never by the order of a scan: a scan that is run
again, with other executors, may deal files otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import placed, salted, text_of
from seqloom.session import materialize, scratch

#: Characters that do not count when texts are compared: fixed values of the contract.
BLANK = " \t\n\x0b\x0c\r"
PREFIX = 256
#: Row ids of survivors are broadcast up to this many rows (24 bytes each), shuffled beyond.
BROADCAST_ROWS = 1_000_000


def normalised(text: str = "text") -> Column:
    return F.translate(text_of(text), BLANK, "")


def _members(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose ``keys`` occur at least twice; counts are taken per salt first."""
    parts = rows.groupBy(*keys, "salt").agg(F.count("*").alias("part"))
    shared = parts.groupBy(*keys).agg(F.sum("part").alias("n")).filter("n > 1")
    return rows.join(parts.join(shared, keys, "left_semi"), [*keys, "salt"], "left_semi")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per input row: ``row_id, <id_col>, keep_id, group_size, kept`` and, with ``digest``, ``text_sha256``.

    ``row_id`` is the row's file (as a hash) and its place there.
    """
    docs, file, at = placed(docs)
    norm = normalised(text_col)
    place = F.struct(F.col(file).alias("file"), F.col(at).alias("at"))
    source = docs.select(F.col(id_col).alias("doc"), F.col(text_col), place.alias("row_id"))
    narrow = source.select(
        "row_id",
        "doc",
        F.char_length(text_of(text_col)).alias("points"),
        F.char_length(norm).alias("norm_len"),
        F.xxhash64(F.substring(norm, 1, PREFIX)).alias("prefix"),
        *([F.sha2(norm.cast("binary"), 256).alias("full")] if digest else []),
    )
    rows = materialize(narrow).withColumn("salt", salted("row_id"))
    left = _members(rows, ["norm_len"])
    left = materialize(_members(left, ["norm_len", "prefix"]))
    if not digest:
        ids = left.select("row_id")
        few = left.count() <= BROADCAST_ROWS
        again = source.join(F.broadcast(ids) if few else ids, "row_id", "left_semi")
        left = left.join(again.select("row_id", F.sha2(norm.cast("binary"), 256).alias("full")), "row_id")
    key = ["norm_len", "prefix", "full"]
    # ~x reverses the order of integers without overflow
    rank = F.struct(
        "points",
        F.col("doc").isNotNull().alias("known"),
        F.bitwise_not("doc").alias("small"),
        F.bitwise_not("row_id.file").alias("first"),
        F.bitwise_not("row_id.at").alias("next"),
        F.col("doc").alias("keep_id"),
        F.col("row_id").alias("keep_row"),
    )
    parts = left.groupBy(*key, "salt").agg(F.max(rank).alias("best"), F.count("*").alias("part"))
    whole = parts.groupBy(*key).agg(F.max("best").alias("best"), F.sum("part").alias("group_size")).filter("group_size > 1")
    spread = parts.select(*key, "salt").join(whole, key)
    verdicts = left.join(spread, [*key, "salt"]).select("row_id", "best.keep_id", "best.keep_row", "group_size")
    out = rows.join(verdicts, "row_id", "left")
    grouped = F.col("group_size").isNotNull()
    return out.select(
        "row_id",
        F.col("doc").alias(id_col),
        F.when(grouped, F.col("keep_id")).otherwise(F.col("doc")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(grouped, F.col("keep_row") == F.col("row_id")).otherwise(F.lit(True)).alias("kept"),
        *([F.col("full").alias("text_sha256")] if digest else []),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input without the rows that :func:`exact_dedup` drops; all columns stay as they are."""
    docs, file, at = placed(docs)
    with scratch(docs.sparkSession) as keep:
        dropped = exact_dedup(docs.drop(file, at), id_col, text_col).filter(~F.col("kept"))
        dropped = keep(dropped.select(F.col("row_id.file").alias(file), F.col("row_id.at").alias(at)))
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    return docs.join(dropped, [file, at], "left_anti").drop(file, at)


def query(spark, sf_dir: str) -> DataFrame:
    from seqloom.llm.common import table

    return exact_dedup(table(spark, sf_dir, "documents"), digest=True).drop("row_id")


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
k AS (SELECT doc_id, length(t) AS points, sha256(norm) AS text_sha256 FROM d)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       first_value(doc_id) OVER w = doc_id AS kept,
       text_sha256
FROM k
WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
