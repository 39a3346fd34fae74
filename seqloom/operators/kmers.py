"""The k-mer dictionary and its queries: membership, tokens, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.corpus import positions
from seqloom.session import materialize

#: Different k-mers of reads that are sent to all tasks, some 40 bytes each; more are joined by a shuffle.
BROADCAST_KMERS = 1_000_000


def kmer_table(segments: DataFrame, k: int) -> DataFrame:
    """``kmer, cnt``: occurrences of every k-mer. Counts are added map-side, so a frequent k-mer is a row a task."""
    return positions(segments, k, []).groupBy("kmer").agg(F.count("*").alias("cnt"))


def kmer_tables(segments: DataFrame, ks: list[int]) -> DataFrame:
    """``k, kmer, cnt`` for several k, for a dictionary partitioned by k."""
    tables = [kmer_table(segments, k).select(F.lit(k).alias("k"), "kmer", "cnt") for k in ks]
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def asked(table: DataFrame, reads: DataFrame, *also: str) -> DataFrame:
    """The rows of ``table`` (kmer, ...) whose k-mer is among those of ``reads`` (kmer): different k-mers of the reads go to all
    tasks if there are at most BROADCAST_KMERS of them, so that the large side is not shuffled before it is filtered."""
    some = materialize(reads.select("kmer").distinct())
    if some.count() <= BROADCAST_KMERS:
        some = F.broadcast(some)
    return table.join(some, "kmer", "left_semi")


def membership(reads: DataFrame, table: DataFrame, k: int) -> DataFrame:
    """``read_id, found, total``: how many of a read's k-mers the dictionary has."""
    total = reads.select("read_id", F.greatest(F.char_length("seq") - k + 1, F.lit(0)).cast("long").alias("total"))
    ours = positions(reads, k, ["read_id"])
    hits = ours.join(asked(table.select("kmer"), ours), "kmer", "left_semi")
    found = hits.groupBy("read_id").agg(F.count("*").alias("found"))
    return total.join(found, "read_id", "left").select("read_id", F.coalesce("found", F.lit(0).cast("long")).alias("found"), "total")


def count_total(reads: DataFrame, table: DataFrame, k: int) -> DataFrame:
    """One row ``found, occurrences``: k-mers of all reads that the dictionary has, and the sum of their counts."""
    ours = positions(reads, k, ["read_id"])
    hits = ours.join(asked(table, ours), "kmer")
    return hits.agg(F.count("*").alias("found"), F.coalesce(F.sum("cnt"), F.lit(0).cast("long")).alias("occurrences"))


def count_by_read(reads: DataFrame, table: DataFrame, k: int) -> DataFrame:
    """``read_id, found, occurrences``, reads without any included."""
    ours = positions(reads, k, ["read_id"])
    hits = ours.join(asked(table, ours), "kmer").groupBy("read_id")
    sums = hits.agg(F.count("*").alias("found"), F.sum("cnt").alias("occurrences"))
    zero = F.lit(0).cast("long")
    return reads.select("read_id").join(sums, "read_id", "left").select("read_id", F.coalesce("found", zero).alias("found"), F.coalesce("occurrences", zero).alias("occurrences"))


def tokens(reads: DataFrame, islands: DataFrame, k: int) -> DataFrame:
    """``read_id, found, total, tokens``: match runs ``start:k-mers``, from the right end of the read.

    From the right, the longest match that ends at a base is a token if it has k bases, and the walk goes on k - 2 bases
    right of its start; else one base to the left. ``islands``: exact matches of k bases or more.
    """
    ends = islands.select("read_id", "s", "e").distinct()
    ends = ends.select("read_id", "s", F.explode(F.sequence(F.col("s") + k - 1, F.col("e") - 1)).alias("end"))
    left = ends.groupBy("read_id", "end").agg(F.min("s").alias("s"))
    walk = F.array_sort(F.collect_list(F.struct((-F.col("end")).alias("minus"), "s")))
    step = F.aggregate(
        "walk",
        F.struct(F.lit(1 << 40).cast("long").alias("last"), F.array().cast("array<string>").alias("out"), F.lit(0).cast("long").alias("found")),
        lambda state, x: F.when(
            -x["minus"] <= state["last"],
            F.struct(
                (x["s"] + k - 2).cast("long").alias("last"),
                F.array_append(state["out"], F.concat_ws(":", x["s"].cast("string"), (-x["minus"] + 1 - x["s"] - k + 1).cast("string"))).alias("out"),
                (state["found"] + (-x["minus"] + 1 - x["s"] - k + 1)).cast("long").alias("found"),
            ),
        ).otherwise(state),
    )
    walked = left.groupBy("read_id").agg(walk.alias("walk")).select("read_id", step.alias("state"))
    total = reads.select("read_id", F.greatest(F.char_length("seq") - k + 1, F.lit(0)).cast("long").alias("total"))
    return total.join(walked, "read_id", "left").select(
        "read_id", F.coalesce("state.found", F.lit(0).cast("long")).alias("found"), "total", F.coalesce(F.array_join("state.out", " "), F.lit("")).alias("tokens")
    )
