"""Approximate nearest neighbours by an inverted multi-index.

Two codebooks quantise the two halves of a vector; a pair of centroids is a cell.  A query goes through pairs of
centroids by summed distance, nearest first, with a heap (the multi-sequence walk), until the cells that it has taken
hold a share of all distinct vectors; all entries of these cells are reranked by the exact inner product.  The share is
measured, at every size alike: for some vectors of the sample, how much of the sample their nearest neighbours in it take;
TARGET of all neighbours must be reached.  Vectors without structure take half of all, clustered ones some hundredths.

Codebooks are fitted by k-means on a sample by hash of about SAMPLE vectors, every vector is indexed.  Equal vectors are
one entry with their smallest ids, ``k`` + 1 of them, which is all that can ever be asked for: equal products tie to the
smaller id.  Cells are cut into blocks of about BLOCK entries, so that a frequent cell is many tasks; a block returns
the ``k`` best of each of its queries and the best of all blocks are taken in two steps.

Nearness: the largest inner product in double precision; with unit vectors that is also the least distance.  For vectors
of other lengths halves are compared after scaling to unit length when cells are chosen, never when entries are ranked.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, and neither do those
of a length other than the most frequent one; a null id takes no part; of rows that repeat an id and a vector one takes
part; with fewer than ``k`` candidates all are returned; without queries or vectors the result is empty.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import salted, table
from seqloom.session import materialize

SAMPLE = 20_000
#: Centroids of each half, a power of two that grows as the root of the vectors; cells are their pairs.
LEAST_CENTROIDS, MOST_CENTROIDS = 4, 1_024
ROUNDS = 12
#: Share of the neighbours that the measured share of vectors must reach, and vectors of the sample that measure it.
TARGET = 0.95
MEASURED = 400
BLOCK = 4_096
#: Queries of a group, on average over all cells that they go to.
QUERIES = 65_536
K = 20


def kmeans(points: np.ndarray, count: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """Centroids by Lloyd's rounds from distinct points of a seeded draw; fewer if there are fewer points."""
    if not points.shape[1]:  # half of a vector of one component
        return np.zeros((1, 0))
    distinct = np.unique(points, axis=0)
    rng = np.random.default_rng(seed)
    centres = distinct[rng.permutation(len(distinct))[:count]]
    for _ in range(rounds):
        near = nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        sizes = np.bincount(near, minlength=len(centres))
        filled = sizes > 0
        centres[filled] = sums[filled] / sizes[filled, None]
    return centres


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return (points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)[None, :]


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return distances(points, centres).argmin(1)


def unit(points: np.ndarray) -> np.ndarray:
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def walk(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, want: int) -> list[tuple[int, int]]:
    """Pairs of centroids by summed distance until their cells hold ``want`` entries; sizes: entries of each cell."""
    a, b = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    heap, seen, found, total = [(left[a[0]] + right[b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and total < want:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]), int(b[j])
        if sizes[cell]:
            found.append(cell)
            total += int(sizes[cell])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (left[a[x]] + right[b[y]], x, y))
    return found


def needed(vectors: np.ndarray, books: tuple[np.ndarray, np.ndarray], k: int, target: float = TARGET, queries: int = MEASURED, seed: int = 2) -> float:
    """The share of the vectors in the first cells of a walk that holds ``target`` of the ``k`` nearest of some of them."""
    points = unit(vectors)
    half, wide = points.shape[1] // 2, len(books[1])
    left, right = distances(points[:, :half], books[0]), distances(points[:, half:], books[1])
    cell = left.argmin(1) * wide + right.argmin(1)
    filled, at = np.unique(cell, return_inverse=True)
    sizes = np.bincount(at)
    chosen = np.random.default_rng(seed).permutation(len(points))[:queries]
    taken = []
    for q in chosen.tolist():
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        nearest_ = np.argsort(-scores, kind="stable")[: min(k, len(points) - 1)]
        sums = left[q, filled // wide] + right[q, filled % wide]
        order = np.argsort(sums, kind="stable")
        upto = np.empty(len(filled), np.int64)
        upto[order] = np.cumsum(sizes[order])
        taken += (upto[at[nearest_]] / len(points)).tolist()
    return float(np.quantile(taken, target, method="higher")) if taken else 1.0


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = K,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    centroids: int | None = None,
    share: float | None = None,
    sample: int = SAMPLE,
) -> DataFrame:
    """``query_id, rank`` (int, from 1), ``<id_col>, score``: the ``k`` nearest of ``vectors`` to each of ``queries``, two
    frames with ``id_col`` and ``vector_col``, without the query's own id. ``share``: of the distinct vectors, that a query's
    cells hold at least; measured if not given."""
    spark = vectors.sparkSession
    out = f"query_id long, rank int, {id_col} long, score double"

    def usable(frame: DataFrame) -> DataFrame:
        rows = frame.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))

    good = usable(vectors)
    lengths = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], out)
    dim, rows = lengths[0]
    good, asked = good.filter(F.size("v") == dim), usable(queries).filter(F.size("v") == dim).dropDuplicates()
    half = dim // 2
    if centroids is None:
        centroids = min(MOST_CENTROIDS, max(LEAST_CENTROIDS, 2 ** round(math.log2(math.sqrt(rows) / 3))))
    drawn = good.filter(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(min(1.0, sample / rows) * (1 << 30))).select("v").dropDuplicates()
    points = np.array([r["v"] for r in drawn.limit(2 * sample).collect()], np.float64).reshape(-1, dim)
    if not len(points):
        points = np.array([r["v"] for r in good.select("v").limit(sample).collect()], np.float64).reshape(-1, dim)
    raw, points = points, unit(points)
    books = spark.sparkContext.broadcast((kmeans(points[:, :half], centroids), kmeans(points[:, half:], centroids)))
    wide = len(books.value[1])
    share = needed(raw, books.value, k) if share is None else share

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = unit(_matrix(batch.column(1), dim))
                cell = nearest(at[:, :half], books.value[0]) * wide + nearest(at[:, half:], books.value[1])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], ["id", "v", "cell"])

    placed = good.mapInArrow(assign, "id long, v array<double>, cell int")
    # equal vectors: their k + 1 smallest ids, by salt first; -0.0 and 0.0 are one
    same = placed.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumn("salt", salted("id"))
    least = F.slice(F.array_sort(F.array_distinct(F.collect_set("id"))), 1, k + 1)
    firsts = Window.partitionBy("cell", "v", "salt").orderBy("id")
    few = same.dropDuplicates(["cell", "v", "id"]).withColumn("n", F.row_number().over(firsts)).filter(F.col("n") <= k + 1)
    entries = few.groupBy("cell", "v").agg(least.alias("ids"))
    entries = materialize(entries.withColumn("hash", F.xxhash64("v")))
    sizes = {r["cell"]: r["n"] for r in entries.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most centroids squared
    held = np.zeros((len(books.value[0]), wide), np.int64)
    for cell, n in sizes.items():
        held[cell // wide, cell % wide] = n
    enough = max(k + 1, math.ceil(share * held.sum()))
    cells = spark.sparkContext.broadcast(held)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = unit(_matrix(batch.column(1), dim))
            left, right = distances(at[:, :half], books.value[0]), distances(at[:, half:], books.value[1])
            row, first, seconds, block = [], [], [], []
            for i in range(batch.num_rows):
                taken: dict[int, list[int]] = {}
                for x, y in walk(left[i], right[i], cells.value, enough):
                    taken.setdefault(x, []).append(y)
                for x, ys in taken.items():
                    for part in range(-(-int(cells.value[x].sum()) // BLOCK)):
                        row.append(i)
                        first.append(x)
                        seconds.append(ys)
                        block.append(part)
            some = pa.array(row, pa.int64())
            columns = [batch.column(0).take(some), batch.column(1).take(some), pa.array(first, pa.int32()), pa.array(seconds, pa.list_(pa.int32())), pa.array(block, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "q", "first", "seconds", "block"])

    # cells of one first centroid lie together: a query goes there once, with the second centroids that it has taken
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), asked.count() // 512)
    routed = asked.repartition(tasks, "id").mapInArrow(route, "query_id long, q array<double>, first int, seconds array<int>, block int")
    parts = [(x, -(-int(n) // BLOCK)) for x, n in enumerate(held.sum(1)) if n]
    parts = spark.createDataFrame(parts, "first int, blocks int")  # a row a centroid
    dealt = entries.withColumn("first", F.floor(F.col("cell") / wide).cast("int")).withColumn("second", F.col("cell") % wide)
    dealt = dealt.join(F.broadcast(parts), "first").withColumn("block", F.pmod("hash", "blocks").cast("int"))
    # queries of a block in groups of a bounded size too, each with all of its entries
    groups = max(1, asked.count() // QUERIES)
    routed = routed.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))
    dealt = dealt.select("first", "second", "block", "v", "ids", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, float]] = []
        if len(left) and len(right):
            vs, ids, second = np.stack(right["v"].to_numpy()), right["ids"].to_list(), right["second"].to_numpy()
            keep = min(k + 1, len(vs))
            for low in range(0, len(left), 256):
                names = left["query_id"].to_numpy()[low : low + 256]
                asks = np.stack(left["q"].to_numpy()[low : low + 256])
                taken = np.zeros((len(names), wide), bool)
                for mark, some in zip(taken, left["seconds"].to_numpy()[low : low + 256]):
                    mark[some] = True
                scores = np.where(taken[:, second], asks @ vs.T, -np.inf)
                least = -np.partition(-scores, keep - 1, axis=1)[:, keep - 1]
                for name, ask, row, last in zip(names.tolist(), asks, scores, least):
                    at = np.flatnonzero((row >= last - 1e-9 * max(1.0, abs(last))) & (row > -np.inf) if last > -np.inf else row > -np.inf)
                    # summed row by row, so that a score does not depend on the block that it is in
                    mine = (vs[at] * ask).sum(1).tolist()
                    best = heapq.nsmallest(k, ((-s, x) for s, j in zip(mine, at.tolist()) for x in ids[j] if x != name))
                    found += [(name, x, -s) for s, x in best]
        return pd.DataFrame(found, columns=["query_id", id_col, "score"]).astype({"query_id": "int64", id_col: "int64", "score": "float64"})

    key = ["first", "block", "part"]
    ranked = routed.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInPandas(rank, f"query_id long, {id_col} long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return ranked.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), id_col, "score")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.filter(F.col("vec_id") % 20 == 0))
