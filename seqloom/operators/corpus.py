"""References: cleaned records, their strands, the text that is indexed and where documents end in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions.sequence import SEPARATOR, clean, revcomp
from seqloom.operators.order import running_sum

#: Positions of a sequence are unfolded from pieces of so many bases.
PIECE = 4096


def prepare(records: DataFrame, soft_mask: str = "upper") -> DataFrame:
    """``doc_id, seq`` with cleaned sequences; null is empty."""
    return records.select("doc_id", clean(F.coalesce("seq", F.lit("")), soft_mask).alias("seq"))


def strands(records: DataFrame, reverse: bool = True) -> DataFrame:
    """``doc_id, [part,] strand, seq``: each record as it is (0) and reverse complemented (1). ``part``: the record's number
    in a document of several, kept if ``records`` has it."""
    keys = ["doc_id", *(["part"] if "part" in records.columns else [])]
    forward = records.select(*keys, F.lit(0).alias("strand"), "seq")
    if not reverse:
        return forward
    return forward.unionByName(records.select(*keys, F.lit(1).alias("strand"), revcomp(F.col("seq")).alias("seq")))


def doc_offsets(records: DataFrame, separators: bool = True) -> DataFrame:
    """``doc_id, end_off``: where each document ends in the text, in the order of ids, both strands and separators
    included."""
    size = (2 * F.char_length("seq") + F.lit(2 * separators)).cast("long")
    each = records.groupBy("doc_id").agg(F.sum(size).alias("size")) if "part" in records.columns else records.select("doc_id", size.alias("size"))
    return running_sum(each, ["doc_id"], "size", "end_off").select("doc_id", "end_off")


def positions(segments: DataFrame, k: int, keys: list[str], name: str = "pos") -> DataFrame:
    """``keys, pos, kmer``: every k-mer of every sequence, from 0. Bytes are cut, so time grows as the length."""
    pieces = segments.withColumn("_bytes", F.col("seq").cast("binary")).filter(F.octet_length("_bytes") >= k)
    starts = F.sequence(F.lit(0).cast("long"), (F.octet_length("_bytes") - k).cast("long"), F.lit(PIECE).cast("long"))
    pieces = pieces.select(*keys, "_bytes", F.explode(starts).alias("_at"))
    pieces = pieces.select(*keys, "_at", F.substring("_bytes", F.col("_at").cast("int") + 1, F.lit(PIECE + k - 1)).alias("_piece"))
    inner = F.sequence(F.lit(0), F.octet_length("_piece") - k)
    rows = pieces.select(*keys, "_at", "_piece", F.explode(inner).alias("_i"))
    return rows.select(*keys, (F.col("_at") + F.col("_i")).alias(name), F.substring("_piece", F.col("_i") + 1, F.lit(k)).cast("string").alias("kmer"))


def text_pieces(segments: DataFrame, separators: bool = True) -> DataFrame:
    """``doc_id, strand, start, seq``: segments with their place in the text and, if wanted, their separators."""
    tail = F.lit(SEPARATOR if separators else "")
    marked = segments.withColumn("seq", F.concat("seq", tail)).withColumn("_size", F.char_length("seq").cast("long"))
    order = ["doc_id", *(["part"] if "part" in segments.columns else []), "strand"]
    placed = running_sum(marked, order, "_size", "_end")
    return placed.select("doc_id", "strand", (F.col("_end") - F.col("_size")).alias("start"), "seq")
