"""Document sets of runs (colors), and votes of matching bases for documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.order import global_rank, running_sum

#: Most frequent sets that are kept by compression.
KEPT_SETS = 65_536


def species(docs: DataFrame, taxon: str = "taxon") -> DataFrame:
    """``doc_id, species, taxon``: dense numbers of sorted distinct taxa, from 0; a document without a taxon is left out."""
    taxa = docs.select(F.col(taxon).alias("taxon")).filter("taxon is not null").distinct()
    ranks = global_rank(taxa, ["taxon"], "species", unique=True).select("taxon", F.col("species").cast("int"))
    return docs.select("doc_id", F.col(taxon).alias("taxon")).join(ranks, "taxon").select("doc_id", "species", "taxon")


def color_sets(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``run, color_id`` and ``color_id, docs, freq``: the sorted species of each run, numbered by first appearance.
    ``rows``: run, species."""
    sets = rows.groupBy("run").agg(F.array_sort(F.collect_set("species")).alias("docs"))
    unique = sets.groupBy("docs").agg(F.min("run").alias("first"), F.count("*").alias("freq"))
    numbered = global_rank(unique, ["first"], "color_id").select("color_id", "docs", "freq")
    return sets.join(numbered.select("docs", "color_id"), "docs").select("run", "color_id"), numbered


def flat_colors(colors: DataFrame) -> DataFrame:
    """``color_id, flat_off, size``: where each set starts in the flat layout [size, docs...]*."""
    each = colors.select("color_id", F.size("docs").alias("size"), (F.size("docs") + 1).cast("long").alias("_room"))
    return running_sum(each, ["color_id"], "_room", "_end").select("color_id", (F.col("_end") - F.col("_room")).alias("flat_off"), "size")


def frequent(colors: DataFrame, most: int = KEPT_SETS) -> DataFrame:
    """The sets that compression keeps: singletons first, then by frequency, then by number, from the highest."""
    return colors.orderBy(F.desc(F.size("docs") == 1), F.desc("freq"), F.desc("color_id")).limit(most)


def similarity(colors: DataFrame) -> DataFrame:
    """``a, b, together``: in how many runs two species (a < b) are in one set."""
    left = colors.select("color_id", "freq", "docs", F.posexplode("docs").alias("at", "a"))
    pairs = left.select("freq", "a", F.explode(F.slice("docs", F.col("at") + 2, F.size("docs"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.sum("freq").alias("together"))


def clusters(pairs: DataFrame, species_count: int, runs: int) -> list[tuple[int, int, float]]:
    """Average-linkage merges (left, right, distance) of species on 1 - together / runs, on the driver: the matrix has
    as many cells as pairs of species. Nodes are numbered from ``species_count`` on, in the order of merges."""
    near = {(r["a"], r["b"]): r["together"] for r in pairs.collect()}
    size = {i: 1 for i in range(species_count)}
    dist = {(i, j): 1 - near.get((i, j), 0) / max(runs, 1) for i in range(species_count) for j in range(i + 1, species_count)}
    merges, node = [], species_count
    while len(size) > 1:
        (i, j), d = min(dist.items(), key=lambda x: (x[1], x[0]))
        merges.append((i, j, d))
        for k in size:
            if k not in (i, j):
                a, b = dist.pop((min(i, k), max(i, k))), dist.pop((min(j, k), max(j, k)))
                dist[k, node] = (size[i] * a + size[j] * b) / (size[i] + size[j])
        del dist[i, j]
        size[node] = size.pop(i) + size.pop(j)
        node += 1
    return merges


def tree_compress(colors: DataFrame, merges: list[tuple[int, int, float]], species_count: int) -> DataFrame:
    """``color_id, docs``: each set replaced by the leaves of the least tree node that holds it."""
    leaves = {i: frozenset([i]) for i in range(species_count)}
    for n, (i, j, _) in enumerate(merges):
        leaves[species_count + n] = leaves[i] | leaves[j]
    nodes = [(len(s), sorted(s)) for s in leaves.values()]
    tree = colors.sparkSession.createDataFrame(nodes, "size int, leaves array<int>")  # two rows a species
    joined = colors.join(F.broadcast(tree), F.size(F.array_except("docs", "leaves")) == 0)
    return joined.groupBy("color_id").agg(F.min_by("leaves", "size").alias("docs"))


def votes(matches: DataFrame, run_species: DataFrame, least: int = 1) -> DataFrame:
    """``read_id, species, cnt, step``: each base of a length of at least ``least`` votes for all species of its run; the
    step is the base, from the right, at which the count was reached. ``matches``: read_id, step, len, run."""
    rows = matches.filter(F.col("len") >= least).join(run_species.select("run", "species").distinct(), "run")
    return rows.groupBy("read_id", "species").agg(F.count("*").alias("cnt"), F.max("step").alias("step"))


def factor_votes(cut: DataFrame, spans: DataFrame, least: int) -> DataFrame:
    """``read_id, species, cnt``: each factor [s, e) of at least ``least`` bases adds its length for every occurrence.
    ``spans``: read_id, species, s, e, n of matches at least as long."""
    long = cut.filter(F.col("e") - F.col("s") >= least).select("read_id", F.col("s").alias("a"), F.col("e").alias("b"))
    rows = spans.join(long, "read_id").filter((F.col("s") <= F.col("a")) & (F.col("e") >= F.col("b")))
    return rows.groupBy("read_id", "species").agg(F.sum((F.col("b") - F.col("a")) * F.col("n")).alias("cnt"))
