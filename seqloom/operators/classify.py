"""Classification of reads against an empirical null model of matching lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the reference semantics: the least threshold is one above this, and values count from this many on.
MIN_THRESHOLD = 3
NULL_REPEATS = 5
UNCLASSIFIED_MEAN = 0.4
SECOND_MARGIN = 0.05
BIN_WIDTH = 150
NULL_READS = 1000


def null_reads(refs: DataFrame, each: int = 100, length: int = 150, seed: int = 0, most: int = NULL_READS) -> DataFrame:
    """``read_id, seq``: at most ``most`` reversed (not complemented) pieces of references, at places drawn by hash, up to
    ``each`` of a reference, short ones whole; pieces with an ``N`` are left out.  Drawing by hash gives the same sample
    whenever it is drawn; references are drawn first, then pieces of these."""
    size = F.char_length("seq")
    refs = refs.filter(size > 0).orderBy(F.xxhash64("doc_id", F.xxhash64("seq"), F.lit(seed)), "doc_id").limit(most)
    drawn = F.sequence(F.lit(0), F.when(size > length, F.lit(each - 1)).otherwise(F.lit(0)))
    rows = refs.select("doc_id", "seq", F.explode(drawn).alias("i"))
    start = F.when(size > length, F.pmod(F.xxhash64("doc_id", "i", F.lit(seed)), (size - length + 1).cast("long"))).otherwise(F.lit(0)).cast("int")
    pieces = rows.select("doc_id", "i", F.substring("seq", start + 1, F.lit(length)).alias("seq")).filter(~F.contains("seq", F.lit("N")))
    pieces = pieces.orderBy(F.xxhash64("doc_id", "i", F.lit(seed + 1)), "doc_id", "i").limit(most)
    return pieces.select(F.concat_ws("_", F.col("doc_id").cast("string"), F.col("i").cast("string")).alias("read_id"), F.reverse("seq").alias("seq"))


def null_reversed(reads: DataFrame) -> DataFrame:
    """Whole reads reversed: a null sample without drawing."""
    return reads.select("read_id", F.reverse("seq").alias("seq"))


def null_statistics(lengths: DataFrame) -> DataFrame:
    """``num_values, mean, percentile``: percentile is the largest length that occurs NULL_REPEATS times, 0 if none."""
    counts = lengths.groupBy("len").agg(F.count("*").alias("cnt"))
    total = F.sum("cnt")
    often = F.max(F.when(F.col("cnt") >= NULL_REPEATS, F.col("len")))
    zero = F.lit(0).cast("long")
    return counts.agg(
        F.coalesce(total, zero).alias("num_values"),
        (F.sum(F.col("len") * F.col("cnt")) / total).alias("mean"),
        F.coalesce(often, zero).cast("long").alias("percentile"),
    )


def threshold(statistics: DataFrame) -> DataFrame:
    """One row ``thr``."""
    return statistics.select((F.greatest("percentile", F.lit(MIN_THRESHOLD).cast("long")) + 1).alias("thr"))


def bins(lengths: DataFrame, sizes: DataFrame, width: int = BIN_WIDTH) -> DataFrame:
    """``read_id, bin, top``: the largest length of each bin, counted from the read's right end; what is left over after
    the last whole bin belongs to it. ``sizes``: read_id, total."""
    place = F.floor((F.col("total") - 1 - F.col("pos")) / width)
    last = F.greatest(F.floor(F.col("total") / width), F.lit(1).cast("long")) - 1
    rows = lengths.join(sizes, "read_id").select("read_id", F.least(place, last).alias("bin"), "len")
    return rows.groupBy("read_id", "bin").agg(F.max("len").alias("top"))


def report(binned: DataFrame, thr: DataFrame) -> DataFrame:
    """``read_id, status, avg_max, above, below``: found if more than half of the bins reach the threshold."""
    rows = binned.join(F.broadcast(thr))
    above = F.count_if(F.col("top") >= F.col("thr"))
    out = rows.groupBy("read_id").agg(F.avg("top").alias("avg_max"), above.alias("above"), (F.count("*") - above).alias("below"))
    found = F.col("above") / (F.col("above") + F.col("below")) > 0.5
    return out.select("read_id", F.when(found, "FOUND").otherwise("NOT_PRESENT").alias("status"), "avg_max", "above", "below")


def filtered(reads: DataFrame, verdicts: DataFrame, invert: bool = False) -> DataFrame:
    """Reads that are found, or with ``invert`` those that are not; reads without a verdict are not found."""
    found = verdicts.filter(F.col("status") == "FOUND").select("read_id")
    return reads.join(found, "read_id", "left_anti" if invert else "left_semi")


def best_two(votes: DataFrame) -> DataFrame:
    """``read_id, best, best_cnt, second, second_cnt`` of votes (read_id, species, cnt[, step]); ties go to the species
    that reached its count first (``step``), if given, then to the smaller."""
    order: list[Column] = [F.desc("cnt"), *([F.asc("step")] if "step" in votes.columns else []), F.asc("species")]
    ranked = votes.withColumn("rank", F.row_number().over(Window.partitionBy("read_id").orderBy(*order))).filter("rank <= 2")
    pick = lambda rank, name: F.max(F.when(F.col("rank") == rank, F.col(name)))
    return ranked.groupBy("read_id").agg(pick(1, "species").alias("best"), pick(1, "cnt").alias("best_cnt"), pick(2, "species").alias("second"), pick(2, "cnt").alias("second_cnt"))


def best_of(votes: str) -> list[Column]:
    """The columns that :func:`best_two` returns, of an array of votes (species, cnt, step) a row."""
    ranked = F.array_sort(F.transform(votes, lambda v: F.struct((-v["cnt"]).alias("minus"), v["step"].alias("step"), v["species"].alias("species"))))
    pick = lambda rank, name: F.get(ranked, F.lit(rank - 1))[name]
    return [pick(1, "species").alias("best"), (-pick(1, "minus")).alias("best_cnt"), pick(2, "species").alias("second"), (-pick(2, "minus")).alias("second_cnt")]


def classes(two: DataFrame, means: DataFrame, margin: float = SECOND_MARGIN) -> DataFrame:
    """``read_id, best, second``: 0 and 0 for a read of a low mean length or without votes; the second is 0 unless it is
    close to the best. ``means``: read_id, mean, a row for each read."""
    return chosen(means.join(two, "read_id", "left"), margin)


def chosen(rows: DataFrame, margin: float = SECOND_MARGIN) -> DataFrame:
    """The same of rows (read_id, mean, best, best_cnt, second, second_cnt)."""
    known = F.col("best").isNotNull() & (F.col("mean") >= UNCLASSIFIED_MEAN)
    close = F.col("second").isNotNull() & (F.col("best_cnt") - F.col("second_cnt") < margin * F.col("best_cnt"))
    zero = F.lit(0).cast(rows.schema["best"].dataType)
    return rows.select("read_id", F.when(known, F.col("best")).otherwise(zero).alias("best"), F.when(known & close, F.col("second")).otherwise(zero).alias("second"))


def report_all(votes: DataFrame, fraction: float = 0.05) -> DataFrame:
    """``read_id, species, cnt``: the best and all whose distance from it is below a fraction of it."""
    top = F.max("cnt").over(Window.partitionBy("read_id"))
    return votes.withColumn("top", top).filter((F.col("cnt") == F.col("top")) | (F.col("top") - F.col("cnt") < fraction * F.col("top"))).select("read_id", "species", "cnt")


def min_score(votes: DataFrame, bases: DataFrame, fraction: float) -> DataFrame:
    """``read_id, classes``: species with votes of at least a fraction of the read's voting bases, comma-joined, ``0`` if
    none. ``bases``: read_id, voting, a row for each read."""
    good = votes.join(bases, "read_id").filter(F.col("cnt") >= fraction * F.col("voting"))
    named = good.groupBy("read_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("species")), lambda x: x.cast("string")), ",").alias("names"))
    return bases.select("read_id").join(named, "read_id", "left").select("read_id", F.coalesce("names", F.lit("0")).alias("classes"))


def pvalue_scores(lengths: DataFrame, sizes: DataFrame) -> DataFrame:
    """``read_id, species, score``: each vote counts min(1, len - log4(size of the species)), if that is not negative.
    ``lengths``: read_id, pos, len, species; ``sizes``: species, bases."""
    value = F.col("len") - F.log(F.col("bases").cast("double")) / F.log(F.lit(4.0))
    rows = lengths.join(sizes, "species").withColumn("value", value).filter("value >= 0")
    return rows.groupBy("read_id", "species").agg(F.sum(F.least("value", F.lit(1.0))).alias("score"))


def early_stop(lengths: DataFrame, every: int = 100) -> DataFrame:
    """``read_id, used``: bases, from the right, after which a read is given up for a running mean below the limit, tested
    every ``every`` bases in its left half; else all. ``lengths``: read_id, lens. Each length is added up once."""
    size = F.size("lens")
    blocks = F.when(size >= every, F.sequence(F.lit(1), F.floor(size / every).cast("int"))).otherwise(F.array().cast("array<int>"))
    zero = F.lit(0).cast("long")
    sums = F.transform(blocks, lambda i: F.aggregate(F.slice("lens", size - i * every + 1, F.lit(every)), zero, lambda a, x: a + x))
    start = F.struct(F.lit(0).alias("n"), zero.alias("sum"), F.lit(None).cast("int").alias("failed"))

    def step(state: Column, x: Column) -> Column:
        n, total = state["n"] + every, state["sum"] + x
        return F.struct(n.alias("n"), total.alias("sum"), F.coalesce(state["failed"], F.when((2 * n > size) & (total / n < UNCLASSIFIED_MEAN), n)).alias("failed"))

    failed = F.aggregate("sums", start, step)["failed"]
    return lengths.select("read_id", "lens", sums.alias("sums")).select("read_id", F.coalesce(failed, size).alias("used"))
