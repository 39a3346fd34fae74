"""Suffix order, Burrows-Wheeler transform, runs and move rows as DataFrames.

The suffix array comes from prefix doubling, from the first START characters on: in each round a position is ranked by its
own rank and that of the position ``h`` further on. Ranks are global by ranges, so no task sorts the whole text. A round is a join and a range sort; there
are as many as the logarithm of the longest repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.sequence import TERMINATOR
from seqloom.operators.corpus import PIECE, text_pieces
from seqloom.operators.order import global_rank, running_sum
from seqloom.session import materialize, release


#: Characters that the first order is by.
START = 24


def characters(segments: DataFrame, separators: bool = True) -> DataFrame:
    """``pos, c, doc_id``: the text, character by character, and its terminator, which belongs to no document."""
    placed = text_pieces(segments, separators).filter("seq <> ''")
    cut = placed.select("doc_id", "start", "seq", F.explode(F.sequence(F.lit(0), F.char_length("seq") - 1, F.lit(PIECE))).alias("at"))
    cut = cut.select("doc_id", (F.col("start") + F.col("at")).alias("start"), F.substring(F.col("seq").cast("binary"), F.col("at") + 1, F.lit(PIECE)).alias("piece"))
    rows = cut.select("doc_id", "start", "piece", F.explode(F.sequence(F.lit(0), F.octet_length("piece") - 1)).alias("i"))
    rows = rows.select((F.col("start") + F.col("i")).alias("pos"), F.substring("piece", F.col("i") + 1, F.lit(1)).cast("string").alias("c"), "doc_id")
    kind = segments.schema["doc_id"].dataType
    end = rows.agg(F.coalesce(F.max("pos") + 1, F.lit(0).cast("long")).alias("pos")).select("pos", F.lit(TERMINATOR).alias("c"), F.lit(None).cast(kind).alias("doc_id"))
    return rows.unionByName(end)


def beginnings(text: DataFrame, size: int = START) -> DataFrame:
    """``pos, key``: the first ``size`` characters from each position of ``text`` (pos, c), fewer at its end."""
    block = F.floor(F.col("pos") / PIECE).alias("block")
    order = F.array_sort(F.collect_list(F.struct("pos", "c")))
    blocks = text.groupBy(block).agg(F.min("pos").alias("start"), F.array_join(F.transform(order, lambda x: x["c"]), "").alias("piece"))
    blocks = materialize(blocks)
    heads = blocks.select((F.col("block") - 1).alias("block"), F.substring("piece", 1, size - 1).alias("more"))
    joined = blocks.join(heads, "block", "left").select("start", F.char_length("piece").alias("own"), F.concat("piece", F.coalesce("more", F.lit(""))).cast("binary").alias("piece"))
    rows = joined.select("start", "piece", F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("i"))
    return rows.select((F.col("start") + F.col("i")).alias("pos"), F.substring("piece", F.col("i") + 1, F.lit(size)).cast("string").alias("key"))


def suffix_array(text: DataFrame) -> DataFrame:
    """``row, pos`` of every suffix of ``text`` (pos, c), in byte order; the terminator is the least character."""
    n = text.count()
    now = materialize(global_rank(beginnings(text), ["key"], "rank").select("pos", "rank"))
    h = START
    while now.agg(F.count_distinct("rank")).first()[0] < n:
        ahead = now.select((F.col("pos") - h).alias("pos"), F.col("rank").alias("rank2"))
        pairs = now.join(ahead, "pos", "left").select("pos", "rank", F.coalesce("rank2", F.lit(-1).cast("long")).alias("rank2"))
        then = materialize(global_rank(pairs, ["rank", "rank2"], "new").select("pos", F.col("new").alias("rank")))
        release(now)
        now, h = then, 2 * h
    return now.select(F.col("rank").alias("row"), "pos")


def bwt(text: DataFrame, sa: DataFrame) -> DataFrame:
    """``row, pos, c, lf, doc_id``: the transform, the row of the suffix one character longer, the suffix's document."""
    size = F.lit(text.count()).cast("long")
    before = text.select(F.pmod(F.col("pos") + 1, size).alias("pos"), "c")
    longer = sa.select(F.pmod(F.col("pos") + 1, size).alias("pos"), F.col("row").alias("lf"))
    return sa.join(before, "pos").join(longer, "pos").join(text.select("pos", "doc_id"), "pos").select("row", "pos", "c", "lf", "doc_id")


def lf_of_transform(rows: DataFrame) -> DataFrame:
    """``row, c, lf`` of a transform (row, c) alone: the row's place when rows are sorted by character, ties by row."""
    keyed = rows.select("row", "c", F.when(F.col("c") == TERMINATOR, "").otherwise(F.col("c")).alias("_key"))
    return global_rank(keyed, ["_key", "row"], "lf", unique=True).select("row", "c", "lf")


def places_of_transform(rows: DataFrame) -> DataFrame:
    """``row, pos`` of a transform with ``lf``, from the terminator's row on: LF steps are doubled in each round, so rounds
    are the logarithm of the text's length."""
    # distance of each row, in steps of LF, to the row of the whole text, which the terminator marks
    now = rows.select("row", F.when(F.col("c") == TERMINATOR, F.col("row")).otherwise(F.col("lf")).alias("to"), F.when(F.col("c") == TERMINATOR, 0).otherwise(1).cast("long").alias("pos"))
    now, length, h = materialize(now), rows.count(), 1
    while h < length:
        ahead = now.select(F.col("row").alias("to"), F.col("to").alias("to2"), F.col("pos").alias("more"))
        then = materialize(now.join(ahead, "to").select("row", F.col("to2").alias("to"), (F.col("pos") + F.col("more")).alias("pos")))
        release(now)
        now, h = then, 2 * h
    return now.select("row", "pos")


def runs(rows: DataFrame, longest: int | None = None) -> DataFrame:
    """``rows`` (row, c, ...) with ``run``, from 0; runs over ``longest`` rows are split."""
    previous = rows.select((F.col("row") + 1).alias("row"), F.col("c").alias("_last"))
    marked = rows.join(previous, "row", "left").withColumn("_new", (F.col("_last").isNull() | (F.col("_last") != F.col("c"))).cast("long"))
    out = running_sum(marked.drop("_last"), ["row"], "_new", "_run")
    if longest:
        heads = out.groupBy("_run").agg(F.min("row").alias("_head"))
        out = out.join(heads, "_run").withColumn("_new", (F.pmod(F.col("row") - F.col("_head"), F.lit(longest)) == 0).cast("long")).drop("_run", "_head")
        out = running_sum(out, ["row"], "_new", "_run")
    return out.withColumn("run", F.col("_run") - 1).drop("_run", "_new")


def move_rows(rows: DataFrame) -> DataFrame:
    """``run, c, p, n, id, off``: a run's first row and length, and the run and offset that its head's LF step leads to."""
    heads = rows.groupBy("run").agg(F.min_by("c", "row").alias("c"), F.min("row").alias("p"), F.count("*").alias("n"), F.min_by("lf", "row").alias("lf"))
    goal = rows.select(F.col("row").alias("lf"), F.col("run").alias("id"))
    starts = heads.select(F.col("run").alias("id"), F.col("p").alias("_p"))
    return heads.join(goal, "lf").join(starts, "id").select("run", "c", "p", "n", "id", (F.col("lf") - F.col("_p")).alias("off"))


def alphabet(text: DataFrame) -> DataFrame:
    """``code, c, cnt``: characters in byte order with their counts, without the terminator."""
    counts = text.filter(F.col("c") != TERMINATOR).groupBy("c").agg(F.count("*").alias("cnt"))
    # a row a character
    return counts.select((F.row_number().over(Window.orderBy("c")) - 1).cast("int").alias("code"), "c", "cnt")


def first_last(text: DataFrame, rows: DataFrame) -> DataFrame:
    """``c, first_row, last_row, first_run, last_run``: each character's rows in sorted order, and their runs."""
    counts = text.groupBy("c").agg(F.count("*").alias("cnt"))
    order = Window.orderBy(F.when(F.col("c") == TERMINATOR, "").otherwise(F.col("c"))).rowsBetween(Window.unboundedPreceding, 0)
    ends = counts.withColumn("stop", F.sum("cnt").over(order)).filter(F.col("c") != TERMINATOR)
    ends = ends.select("c", (F.col("stop") - F.col("cnt")).alias("first_row"), (F.col("stop") - 1).alias("last_row"))
    at = rows.select("row", "run")
    first, last = at.toDF("first_row", "first_run"), at.toDF("last_row", "last_run")
    return F.broadcast(ends).join(first, "first_row").join(last, "last_row").select("c", "first_row", "last_row", "first_run", "last_run")


def neighbours(moves: DataFrame, alphabet_: str = "ACGT") -> DataFrame:
    """``run, c, up, down``: the distance in runs to the nearest run with character c above and below; null where there
    is none, no row for the run's own character."""
    ranked = materialize(global_rank(moves.select("c", "run"), ["c", "run"], "k", unique=True))
    nxt = ranked.select("c", (F.col("k") - 1).alias("k"), F.col("run").alias("next"))
    first = ranked.groupBy("c").agg(F.min("run").alias("next")).select("c", F.lit(-1).cast("long").alias("run"), "next")
    total = moves.agg(F.count("*").alias("total"))
    gaps = ranked.join(nxt, ["c", "k"], "left").select("c", "run", "next").unionByName(first).join(F.broadcast(total))
    stop = F.coalesce("next", "total") - 1
    gaps = gaps.filter(stop > F.col("run"))
    out = gaps.select("c", F.col("run").alias("above"), F.col("next").alias("below"), F.explode(F.sequence(F.col("run") + 1, stop)).alias("run"))
    out = out.filter(F.col("c").isin(*alphabet_))
    return out.select("run", "c", F.when(F.col("above") >= 0, F.col("run") - F.col("above")).alias("up"), (F.col("below") - F.col("run")).alias("down"))


def sampled(sa: DataFrame, rate: int = 100) -> DataFrame:
    """``row, pos`` of every ``rate``-th row."""
    return sa.filter(F.pmod("row", F.lit(rate)) == 0)


def locate(rows: DataFrame, samples: DataFrame, wanted: DataFrame) -> DataFrame:
    """``row, pos`` for ``wanted`` rows, by steps of LF to a sampled row. All rows walk at once and double their steps in
    each round, so rounds are the logarithm of the longest walk."""
    size = F.lit(rows.count()).cast("long")
    known = samples.select("row", F.lit(True).alias("hit"))
    now = rows.select("row", "lf").join(known, "row", "left")
    now = materialize(now.select("row", F.when(F.col("hit"), F.col("row")).otherwise(F.col("lf")).alias("to"), F.when(F.col("hit"), 0).otherwise(1).cast("long").alias("steps")))
    while not now.select("to").join(known, now["to"] == known["row"], "left_anti").isEmpty():
        ahead = now.select(F.col("row").alias("to"), F.col("to").alias("to2"), F.col("steps").alias("more"))
        then = materialize(now.join(ahead, "to").select("row", F.col("to2").alias("to"), (F.col("steps") + F.col("more")).alias("steps")))
        release(now)
        now = then
    found = now.join(wanted.select("row"), "row").join(samples.select(F.col("row").alias("to"), "pos"), "to")
    return found.select("row", F.pmod(F.col("pos") + F.col("steps"), size).alias("pos"))


def verify(rows: DataFrame) -> DataFrame:
    """``n, distinct_lf, ok``: LF is a permutation, and a step of it goes one character to the left."""
    back = rows.select(F.col("row").alias("lf"), F.col("pos").alias("lf_pos"))
    n = F.count("*")
    joined = rows.join(back, "lf")
    wrong = F.count_if(F.col("lf_pos") != F.pmod(F.col("pos") - 1, F.lit(rows.count())))
    return joined.agg(n.alias("n"), F.count_distinct("lf").alias("distinct_lf"), wrong.alias("wrong")).select("n", "distinct_lf", ((F.col("n") == F.col("distinct_lf")) & (F.col("wrong") == 0)).alias("ok"))


def inspect(rows: DataFrame) -> DataFrame:
    """``n, r, ratio, end_row``: rows, runs, rows a run and the terminator's row."""
    return rows.agg(F.count("*").alias("n"), F.count_distinct("run").alias("r"), F.max(F.when(F.col("c") == TERMINATOR, F.col("row"))).alias("end_row")).select("n", "r", (F.col("n") / F.col("r")).alias("ratio"), "end_row")


def row_histogram(moves: DataFrame, powers: int = 16) -> DataFrame:
    """``power, at_least``: how many runs have at least 2 ** power rows."""
    counts = moves.agg(*[F.count_if(F.col("n") >= 2**j).alias(str(j)) for j in range(powers)])
    pairs = ", ".join(f"{j}, `{j}`" for j in range(powers))
    return counts.selectExpr(f"stack({powers}, {pairs}) as (power, at_least)")


def reconstruct(rows: DataFrame) -> DataFrame:
    """``pos, c``: the text read off the transform alone (row, c), by a walk along its LF steps."""
    steps = materialize(lf_of_transform(rows.select("row", "c")))
    placed = places_of_transform(steps).join(steps.select("row", "c"), "row")
    return placed.select(F.pmod(F.col("pos") - 1, F.lit(steps.count())).alias("pos"), "c")


def run_lcs(rows: DataFrame, text: DataFrame, most: int = 33) -> DataFrame:
    """``run, lcs``: how many characters before the suffixes of a run's first and last row are equal, up to ``most``."""
    ends = rows.groupBy("run").agg(F.min_by("pos", "row").alias("a"), F.max_by("pos", "row").alias("b"))
    steps = ends.select("run", "a", "b", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("d"))
    left, right = text.select(F.col("pos").alias("at"), F.col("c").alias("x")), text.select(F.col("pos").alias("to"), F.col("c").alias("y"))
    steps = steps.select("run", "d", (F.col("a") - F.col("d")).alias("at"), (F.col("b") - F.col("d")).alias("to"))
    pairs = steps.join(left, "at", "left").join(right, "to", "left")
    differ = F.min(F.when(F.coalesce(F.col("x") != F.col("y"), F.lit(True)), F.col("d")))
    return pairs.groupBy("run").agg((F.coalesce(differ, F.lit(most + 1)) - 1).cast("int").alias("lcs"))


def documents(rows: DataFrame, species: DataFrame) -> DataFrame:
    """``row, run, species``: the species of the suffix of every row but the terminator's."""
    return rows.filter("doc_id is not null").select("row", "run", "doc_id").join(species.select("doc_id", "species"), "doc_id").select("row", "run", "species")


__all__ = ["alphabet", "bwt", "characters", "documents", "first_last", "inspect", "lf_of_transform", "locate", "move_rows", "neighbours", "places_of_transform", "reconstruct", "row_histogram", "run_lcs", "runs", "sampled", "suffix_array", "verify"]
