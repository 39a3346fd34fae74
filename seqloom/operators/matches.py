"""Exact matches of reads in references: seeds, diagonal islands, and the queries that follow from them.

Positions of reads and references meet on a k-mer; hits of one read, reference and diagonal that follow one another
are an island, a maximal exact match of k bases or more. Matches shorter than k come from the set of all substrings
of fewer than k bases, which is small. Equal references are one row with a weight before positions are unfolded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.corpus import positions
from seqloom.operators.kmers import asked


def distinct_segments(segments: DataFrame) -> DataFrame:
    """``ref, seq, weight``: each different sequence once, with how many segments have it."""
    return segments.groupBy("seq").agg(F.count("*").alias("weight")).select(F.xxhash64("seq").alias("ref"), "seq", "weight")


def islands(reads: DataFrame, refs: DataFrame, k: int, keep: list[str]) -> DataFrame:
    """``read_id, keep, diag, s, e``: maximal exact matches [s, e) of k bases or more on each diagonal.

    ``keep``: columns that tell references apart.
    """
    ours = positions(reads, k, ["read_id"], "i")
    theirs = asked(positions(refs, k, keep, "j"), ours)
    hits = ours.join(theirs, "kmer").select("read_id", *keep, (F.col("j") - F.col("i")).alias("diag"), "i")
    line = Window.partitionBy("read_id", *keep, "diag").orderBy("i")
    run = hits.withColumn("run", F.col("i") - F.row_number().over(line))
    return run.groupBy("read_id", *keep, "diag", "run").agg(F.min("i").alias("s"), (F.max("i") + k).alias("e")).drop("run")


def short_words(refs: DataFrame, k: int) -> DataFrame:
    """``word``: the distinct substrings of fewer than k bases, at most 4 ** k of them."""
    kmers = positions(refs, k, []).select("kmer").distinct()
    starts = kmers.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(k - 1)), lambda n: F.substring("kmer", 1, n))).alias("word"))
    # the last k - 1 bases of a segment start no k-mer
    tail = refs.select(F.expr(f"right(seq, {k - 1})").alias("tail")).distinct().filter("tail <> ''")
    some = tail.select("tail", F.explode(F.sequence(F.lit(1), F.char_length("tail"))).alias("a"))
    some = some.select("tail", "a", F.explode(F.sequence(F.lit(1), F.char_length("tail") - F.col("a") + 1)).alias("n"))
    return starts.unionByName(some.select(F.substring("tail", F.col("a"), F.col("n")).alias("word"))).distinct()


def _short(reads: DataFrame, words: DataFrame, k: int, at_end: bool) -> DataFrame:
    """``read_id, pos, len``: the longest match of fewer than k bases from each position on, or up to it."""
    size = F.char_length("seq").cast("long")
    each = reads.withColumn("_bytes", F.col("seq").cast("binary")).filter("seq <> ''")
    each = each.select("read_id", "_bytes", F.explode(F.sequence(F.lit(0).cast("long"), size - 1)).alias("pos"), size.alias("m"))
    room = F.least(F.lit(k - 1).cast("long"), F.col("pos") + 1 if at_end else F.col("m") - F.col("pos"))
    each = each.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), room)))
    start = F.col("pos") - F.col("n") + 2 if at_end else F.col("pos") + 1
    each = each.select("read_id", "pos", "n", F.substring("_bytes", start.cast("int"), F.col("n").cast("int")).cast("string").alias("word"))
    return each.join(words, "word", "left_semi").groupBy("read_id", "pos").agg(F.max("n").alias("len"))


def _all_positions(reads: DataFrame) -> DataFrame:
    size = F.char_length("seq").cast("long")
    return reads.filter("seq <> ''").select("read_id", F.explode(F.sequence(F.lit(0).cast("long"), size - 1)).alias("pos"))


def matching_statistics(reads: DataFrame, found: DataFrame, words: DataFrame | None, k: int) -> DataFrame:
    """``read_id, pos, len``: the longest match that starts at each base, clamped to 65535; one row for each base.
    No words are needed if ``found`` has matches from one base on (k = 1)."""
    spans = found.select("read_id", "s", "e").distinct()
    long = spans.select("read_id", F.explode(F.sequence("s", F.col("e") - k)).alias("pos"), "e")
    long = long.groupBy("read_id", "pos").agg(F.max("e").alias("e"))
    out = _all_positions(reads).join(long, ["read_id", "pos"], "left")
    out = out.withColumn("len", F.lit(0).cast("long")) if words is None else out.join(_short(reads, words, k, False), ["read_id", "pos"], "left")
    length = F.coalesce(F.col("e") - F.col("pos"), F.col("len"), F.lit(0).cast("long"))
    return out.select("read_id", "pos", F.least(length, F.lit(65535).cast("long")).alias("len"))


def leftmost(reads: DataFrame, found: DataFrame, words: DataFrame | None, k: int) -> DataFrame:
    """``read_id, pos, len``: the longest match that ends at each base; one row for each base.  Words as above."""
    spans = found.select("read_id", "s", "e").distinct()
    long = spans.select("read_id", "s", F.explode(F.sequence(F.col("s") + k - 1, F.col("e") - 1)).alias("pos"))
    long = long.groupBy("read_id", "pos").agg(F.min("s").alias("s"))
    out = _all_positions(reads).join(long, ["read_id", "pos"], "left")
    out = out.withColumn("len", F.lit(0).cast("long")) if words is None else out.join(_short(reads, words, k, True), ["read_id", "pos"], "left")
    return out.select("read_id", "pos", F.coalesce(F.col("pos") - F.col("s") + 1, F.col("len"), F.lit(0).cast("long")).alias("len"))


def factors(left: DataFrame) -> DataFrame:
    """``read_id, s, e``: the greedy cut of each read, right to left, into longest matches [s, e); bases that occur
    nowhere are in no factor. ``left``: what :func:`leftmost` returns."""
    walk = F.array_sort(F.collect_list(F.struct((-F.col("pos")).alias("minus"), F.col("len"))))
    step = F.aggregate(
        "walk",
        F.struct(F.lit(1 << 40).cast("long").alias("last"), F.array().cast("array<struct<s: bigint, e: bigint>>").alias("out")),
        lambda state, x: F.when(
            (-x["minus"] <= state["last"]) & (x["len"] > 0),
            F.struct(
                (-x["minus"] - x["len"]).cast("long").alias("last"),
                F.array_append(state["out"], F.struct((-x["minus"] - x["len"] + 1).cast("long").alias("s"), (-x["minus"] + 1).cast("long").alias("e"))).alias("out"),
            ),
        ).otherwise(state),
    )
    return left.groupBy("read_id").agg(walk.alias("walk")).select("read_id", F.explode(step["out"]).alias("f")).select("read_id", "f.s", "f.e")


def zml(reads: DataFrame, cut: DataFrame) -> DataFrame:
    """``read_id, pos, len``: each base's distance to the end of its factor, 0 outside factors."""
    inside = cut.select("read_id", F.explode(F.sequence("s", F.col("e") - 1)).alias("pos"), "e")
    out = _all_positions(reads).join(inside, ["read_id", "pos"], "left")
    return out.select("read_id", "pos", F.least(F.coalesce(F.col("e") - 1 - F.col("pos"), F.lit(0).cast("long")), F.lit(65535).cast("long")).alias("len"))


def count_suffix(reads: DataFrame, refs: DataFrame, found: DataFrame, words: DataFrame, k: int, ref_key: list[str]) -> DataFrame:
    """``read_id, matched, total, occurrences``: the longest suffix of a read that occurs, and how often.

    ``refs`` has ``weight``; ``found`` are its islands.
    """
    sizes = reads.select("read_id", "seq", F.char_length("seq").cast("long").alias("total"))
    ends = found.join(sizes.select("read_id", "total"), "read_id").filter(F.col("e") == F.col("total"))
    best = ends.groupBy("read_id").agg(F.min("s").alias("best"))
    weighted = ends.join(best, "read_id").filter(F.col("s") == F.col("best")).join(refs.select(*ref_key, "weight"), ref_key)
    long = weighted.groupBy("read_id").agg(F.max(F.col("total") - F.col("s")).alias("long"), F.sum("weight").alias("n"))
    last = reads.filter("seq <> ''").select("read_id", F.expr(f"right(seq, {k - 1})").alias("seq"))
    tail = _short(last, words, k, True).join(last, "read_id").filter(F.col("pos") == F.char_length("seq") - 1)
    tail = tail.select("read_id", F.col("len").alias("short"), F.expr("right(seq, cast(len as int))").alias("word"))
    wanted = tail.join(long.select("read_id"), "read_id", "left_anti")
    # occurrences of short suffixes of all lengths, in one pass; places near a reference's end are filled up with a character
    # that no suffix has
    filled = refs.select(F.concat("seq", F.lit("$" * (k - 1))).alias("seq"), "weight")
    places = positions(filled, k - 1, ["weight"]).filter(~F.startswith("kmer", F.lit("$")))
    each = places.select("weight", F.explode(F.transform(F.sequence(F.lit(1), F.lit(k - 1)), lambda n: F.substring("kmer", F.lit(1), n))).alias("kmer"))
    counts = asked(each, wanted.select(F.col("word").alias("kmer"))).groupBy("kmer").agg(F.sum("weight").alias("n_short"))
    counts = wanted.join(counts, F.col("word") == F.col("kmer")).select("read_id", "short", "n_short")
    zero = F.lit(0).cast("long")
    out = sizes.join(long, "read_id", "left").join(counts, "read_id", "left")
    return out.select("read_id", F.coalesce("long", "short", zero).alias("matched"), "total", F.coalesce("n", "n_short", zero).alias("occurrences"))


def counted(found: DataFrame, refs: DataFrame, ref_key: list[str]) -> DataFrame:
    """``read_id, s, e, n``: islands of ``refs``, whose rows weigh ``weight`` occurrences, by their place in reads."""
    return found.join(refs.select(*ref_key, "weight"), ref_key).groupBy("read_id", "s", "e").agg(F.sum("weight").alias("n"))


def mems(found: DataFrame, least: int, wrap_u16: bool = False) -> DataFrame:
    """``read_id, s, e, cnt``: maximal exact matches of at least ``least`` bases and their occurrences.

    ``found``: read_id, s, e, n. ``wrap_u16`` keeps counts modulo 65536.
    """
    spans = found.filter(F.col("e") - F.col("s") >= least).withColumnRenamed("n", "weight")
    # a span is in no other if no span that starts before or with it ends after it, or with it if it starts before
    line = Window.partitionBy("read_id").orderBy("s", F.desc("e"))
    before = F.max("e").over(line.rowsBetween(Window.unboundedPreceding, -1))
    best = spans.withColumn("before", before).filter(F.col("before").isNull() | (F.col("before") < F.col("e"))).select("read_id", "s", "e")
    over = spans.select("read_id", F.col("s").alias("a"), F.col("e").alias("b"), "weight")
    cnt = F.sum("weight")
    counted = best.join(over, "read_id").filter((F.col("a") <= F.col("s")) & (F.col("b") >= F.col("e"))).groupBy("read_id", "s", "e").agg(cnt.alias("cnt"))
    return counted.withColumn("cnt", F.col("cnt") % 65536) if wrap_u16 else counted
