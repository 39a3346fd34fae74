"""SimHash near-dedup: an inverted index over byte positions with count filtering.

A fingerprint of 64 bits is eight bytes.  Two fingerprints that differ in at most four bits share at least four bytes at
their positions.  Pairs are tallied: those with fewer shared positional bytes than that are out, those that are left are
verified by their bits.  A plain posting (position, byte) would hold 1/256 of all fingerprints, so postings are
composed: sets of three positions, chosen such that any four positions hold one of the sets, and the bytes there.
A posting with more than a tile of members is split by each fourth position and the byte there, which every link in it
also shares.  Postings that only one fingerprint has are dropped; the others are tallied and verified in blocks.

Distinct fingerprints alone are compared.  What is still a large posting after its split is cut into tiles: no task gets a
whole posting.  Tiles are looked at on their own, twice, dealt otherwise the second time; that joins most of what a
dense posting has.  Then each pair of tiles is a block of a bounded size, but for pairs within the largest group of the
posting, which are joined already (:func:`_joined`).  A block returns links between groups that are not joined yet, by a
star to the least of them, never all pairs.  Components follow from these (``graph.components``).

:func:`keep_one`, the filter, links documents whose sets of five-word shingles have a Jaccard similarity of at least 0.8;
every link is verified on both whole sets.  The index only groups documents: (1) SimHash fingerprints that link as above
are a group.  (2) SimHash loses similar documents, short ones above all, so a second index of the same kind has
signatures of POSITIONS bytes, each the low byte of the least hash of the set under one function; two sets share a byte
with at least their similarity as probability, whatever their size.  Postings are BANDS disjoint sets of BAND positions;
members of a posting whose tally of shared bytes reaches the least one that a similar pair has are in one group.  A pair
at 0.8 misses all postings with a probability of (1 - 0.8 ** BAND) ** BANDS, about 1e-7, and the tally with 1e-8.  Postings
whose members are in one group already are left out.  (3) Within a group all pairs are verified but those that verified
links have joined already, in the same steps of tiles and pairs of tiles.

Defined results: null text is empty text; a text without words has fingerprint zero and links like any other; equal
texts have equal fingerprints and so one component; an empty table gives an empty result; only id and text are read.
Rows that are dropped are told by file and place (``common.placed``), so they are the same in any scan.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import placed, slices, table, texts, with_group
from seqloom.llm.graph import components
from seqloom.session import materialize, scratch

SEED = 42
BITS = 4
WORDS = 4
#: Members of a tile, on average; a block holds two.
TILE = 512
#: The guaranteed number of shared positional bytes, of eight, at BITS differing bits.
SHARED = 8 - BITS
#: For the filter: words of a shingle, the similarity that links documents, and the signature's postings.
NEAR_WORDS = 5
SIMILARITY = 0.8
BAND = 5
BANDS = 40
POSITIONS = BAND * BANDS
#: Standard deviations by which a similar pair's tally may stay behind its mean.
BEHIND = 5.5
#: Members of a tile of a signature's posting or of a group, and the shingles of a group's tile, on average.
NEAR_TILE = 256
TILE_SHINGLES = 1 << 18
#: Row ids that are dropped are broadcast up to this many rows (24 bytes each), shuffled beyond.
BROADCAST_ROWS = 1_000_000
#: Shingles whose hashes are worked on at once.
CHUNK = 1 << 16


def triples() -> list[tuple[int, int, int]]:
    """Sets of three of the eight byte positions such that any four positions hold one (20 sets, after Turan)."""
    parts = [(0, 1, 2), (3, 4, 5), (6, 7)]
    found = [p for part in parts for p in combinations(part, 3)]
    for k, part in enumerate(parts):
        found += [(*pair, one) for pair in combinations(part, 2) for one in parts[(k + 1) % 3]]
    return [tuple(sorted(t)) for t in found]


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """The SimHash of a text over shingles of ``words`` words, as an unsigned integer."""
    import xxhash

    hashed = xxhash.xxh64_intdigest
    parts = text.encode().lower().split()  # bytes: A-Z alone are lower-cased, ASCII white space alone splits
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(words, len(parts))
    count = len(parts) - width + 1
    ones = np.zeros(64, np.int64)
    for low in range(0, count, CHUNK):
        high = min(low + CHUNK, count)
        found = [hashed(joined[a:b], seed) for a, b in zip(starts[low:high].tolist(), ends[low + width - 1 : high + width - 1].tolist())]
        bits = np.unpackbits(np.array(found, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``doc, fp``: fp is the fingerprint's 64 bits as a long."""
    chosen = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = np.array([fingerprint(t, words) for t in texts(part)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], ["doc", "fp"])

    return chosen.mapInArrow(run, f"doc {chosen.schema['doc'].dataType.simpleString()}, fp long")


_LOW = np.uint64(0x7F7F7F7F7F7F7F7F)


def tallied(a: np.ndarray, b: np.ndarray, shared: int = SHARED) -> np.ndarray:
    """Whether fingerprints (uint64) share at least so many bytes at their positions."""
    x = a ^ b
    differing = np.bitwise_count(((x & _LOW) + _LOW | x) & ~_LOW)  # the top bit of every byte that is not zero
    return differing <= 8 - shared


def linked(a: np.ndarray, b: np.ndarray, shared: int = SHARED, bits: int = BITS) -> np.ndarray:
    """Whether fingerprints (uint64) link: pairs that the tally retains are verified by their bits."""
    out = tallied(a, b, shared)
    where = np.nonzero(out)
    a, b = np.broadcast_to(a, out.shape), np.broadcast_to(b, out.shape)
    out[where] = np.bitwise_count(a[where] ^ b[where]) <= bits
    return out


def _forest(near: np.ndarray, labels: np.ndarray) -> list[tuple[int, int]]:
    """What a block's links (a matrix) join: from each label to the least one of those that meet, where they differ."""
    left, edges = np.ones(len(near), bool), []
    for first in range(len(near)):
        if not left[first]:
            continue
        work, met = [first], [first]
        left[first] = False
        while work:
            found = np.flatnonzero(near[work.pop()] & left)
            left[found] = False
            work += found.tolist()
            met += found.tolist()
        if len(met) > 1:
            least, *others = np.unique(labels[met]).tolist()
            edges += [(a, least) for a in others]
    return edges


def _edges(edges) -> pa.RecordBatch:
    both = np.array(sorted(edges), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def links(nodes: DataFrame, bits: int = BITS, tile: int = TILE) -> DataFrame:
    """``a, b``: pairs of nodes (columns node, distinct, and fp; stored) that make the same components as all pairs
    within ``bits`` differing bits."""
    roots = _by_fingerprint(nodes, bits, tile)
    return nodes.sparkSession.createDataFrame([], "a long, b long") if roots is None else roots.toDF("a", "b").filter("a <> b")


def _by_fingerprint(nodes: DataFrame, bits: int = BITS, tile: int = TILE) -> DataFrame | None:
    """``node, root``: components of the nodes by links within ``bits`` differing bits; None if there is no link."""
    if bits > 4:
        raise ValueError("sets of three positions are sure to meet up to four differing bits only")
    shared = 8 - bits
    byte = lambda q: F.expr(f"shiftright(fp, 8 * {q}) & 255")
    places = F.array(*[F.struct(F.lit(n).cast("long").alias("n"), *[F.lit(q).alias(c) for c, q in zip("xyz", t)]) for n, t in enumerate(triples())])
    rows = nodes.select("node", "fp", F.explode(places).alias("p"))
    key = F.shiftleft("p.n", 24) + F.shiftleft(byte("p.x"), 16) + F.shiftleft(byte("p.y"), 8) + byte("p.z")
    postings = rows.select("node", "fp", F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("p.z").alias("z"), key.alias("key"))
    several = postings.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    # Spark takes no account of rows that an explode or a worker adds and would broadcast either side, so these joins are told
    held = materialize(postings.join(several.hint("merge"), "key"))
    # a frequent posting is split by a fourth position, of the other five, and its byte
    fourth = F.explode(F.array_except(F.array(*map(F.lit, range(8))), F.array("x", "y", "z")))
    split = held.filter(F.col("n") > tile).select("node", "fp", "key", fourth.alias("q"))
    split = split.select("node", "fp", (F.shiftleft("key", 12) + F.shiftleft((F.col("q") + 1).cast("long"), 8) + byte("q")).alias("key"))
    again = split.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    frequent = split.join(again.hint("merge"), "key").withColumn("tiles", F.ceil(F.col("n") / tile).cast("int"))
    rare = held.filter(F.col("n") <= tile).select(F.shiftleft("key", 12).alias("key"), "node", "fp", F.lit(1).alias("tiles"))
    members = rare.unionByName(frequent.select("key", "node", "fp", "tiles"))

    def found(block: pa.Table) -> pa.RecordBatch:
        starts, ends = _runs(block)
        labels, fps = block["label"].to_numpy(), block["fp"].to_numpy().view(np.uint64)
        twos = starts[ends - starts == 2]
        twos = twos[linked(fps[twos], fps[twos + 1], shared, bits) & (labels[twos] != labels[twos + 1])]
        edges = set(zip(np.maximum(labels[twos], labels[twos + 1]).tolist(), np.minimum(labels[twos], labels[twos + 1]).tolist()))
        for s, e in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist()):
            if (labels[s:e] != labels[s]).any():
                edges.update(_forest(linked(fps[s:e, None], fps[None, s:e], shared, bits), labels[s:e]))
        return _edges(edges)

    return _joined(members, lambda some: some, ["fp"], found)


def _joined(members: DataFrame, fetch: Callable, columns: list[str], found: Callable, roots: DataFrame | None = None) -> DataFrame | None:
    """``node, root``: components of all links within keys, and of ``roots``, what is joined already; None if there is no link.

    ``members``: key, node and tiles (of the key); ``fetch`` adds the columns that ``found`` needs to make ``a, b`` of whole
    blocks, between labels.  A label is the root of a node in the steps before, so a step adds no more edges than
    it takes to join what is apart.  The first two steps send each member to one tile, the second by another hash; keys of one tile
    are done after the first.  The last compares all pairs of tiles, but for members of the key's most frequent label with each other.
    """
    for step in ("tiles", "other tiles", "pairs"):
        now = members
        if step != "tiles":
            now = members.filter("tiles > 1")
            if now.isEmpty():
                break
        if roots is None:
            now = now.withColumn("label", F.col("node"))
        else:
            now = now.join(roots.withColumnRenamed("root", "label").hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
        dealt = F.xxhash64("node", F.lit(step))
        if step == "pairs":
            parts = now.groupBy("key", "label").agg(F.count("*").alias("n"))
            sizes = parts.groupBy("key").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("all")).filter("most.n < all")
            now = now.join(sizes.hint("merge"), "key").withColumn("rest", F.col("label") != F.col("most.label"))
            now = now.withColumn("few", F.ceil(F.expr("tiles * (all - most.n) / all")).cast("int")).withColumn("many", F.ceil(F.expr("tiles * most.n / all")).cast("int"))
            now = now.withColumn("tile", F.when(F.col("rest"), F.pmod(dealt, F.col("few"))).otherwise(F.col("few") + F.pmod(dealt, F.col("many"))).cast("int"))
            other = F.explode(F.expr("if(rest, filter(sequence(0, few + many - 1), x -> x <> tile), sequence(0, few - 1))"))
            rows = fetch(now.drop("most", "all", "tiles")).withColumn("other", other)
            rows = rows.select("key", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "label", *columns)
        else:
            if roots is not None:
                apart = now.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
                now = now.join(apart.select("key").hint("merge"), "key", "left_semi")
            rows = fetch(now.withColumn("low", F.pmod(dealt, F.col("tiles")).cast("int")).drop("tiles")).select("key", "low", F.col("low").alias("high"), "label", *columns)
        edges = materialize(_in_blocks(rows, found).distinct())
        if not edges.isEmpty():
            if roots is not None:
                edges = edges.unionByName(roots.toDF("a", "b"))
            roots = materialize(components(edges, "a", "b"))
    return roots


def _in_blocks(rows: DataFrame, found: Callable) -> DataFrame:
    """``a, b``: what ``found`` makes of whole blocks, which key, low and high tell apart."""
    rows = rows.repartition(F.col("key"), F.col("low"), F.col("high")).sortWithinPartitions("key", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            last = _runs(held)[0][-1]
            if last:  # the last block may go on in the next batch
                yield found(held.slice(0, last).combine_chunks())
                held = held.slice(last)
        if held is not None:
            yield found(held.combine_chunks())

    return rows.mapInArrow(run, "a long, b long")


def _runs(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Where blocks start and end."""
    key = np.stack([rows[c].to_numpy().astype(np.int64) for c in ("key", "low", "high")], 1)
    cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
    return np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bits: int = BITS) -> DataFrame:
    """``<id_col>, fp`` (long) and ``component_id``, the smallest id that links reach, one row per input row."""
    marked = materialize(fingerprints(docs, id_col, text_col, words))
    with scratch(docs.sparkSession) as keep:
        nodes = materialize(marked.groupBy("fp").agg(F.min("doc").alias("least")))
        joined = _by_fingerprint(nodes.select(F.col("fp").alias("node"), "fp"), bits)
        if joined is None:
            rooted = nodes.withColumn("root", F.col("fp"))
        else:
            rooted = materialize(nodes.join(joined.hint("merge"), nodes.fp == joined.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
        classes = with_group(rooted, ["root"], F.min("least"), F.min("part"), "component_id", ["fp"])
        classes = keep(classes.select("fp", "component_id"))
    return _back(marked, classes).withColumnRenamed("doc", id_col)


def _back(marked: DataFrame, classes: DataFrame) -> DataFrame:
    """Documents with their fingerprint's class; a fingerprint that many share is joined by salt."""
    from seqloom.llm.common import salted

    dealt = marked.withColumn("_salt", salted("doc"))
    spread = dealt.select("fp", "_salt").distinct().join(classes.hint("merge"), "fp")
    return dealt.join(spread.hint("merge"), ["fp", "_salt"]).select("doc", "fp", "component_id")


def shingles(text: str, words: int = NEAR_WORDS) -> np.ndarray:
    """Hashes of a text's set of shingles, sorted; a text of fewer words is one shingle."""
    import xxhash

    hashed = xxhash.xxh64_intdigest
    parts = text.encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    width = min(words, len(parts))
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.unique(np.fromiter((hashed(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())), np.uint64))


def of_set(found: np.ndarray) -> int:
    """The SimHash of a set of shingles, as a signed integer."""
    ones = np.zeros(64, np.int64)
    for low in range(0, len(found), CHUNK):
        ones += np.unpackbits(found[low : low + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(found), bitorder="little").view("<i8")[0])


#: Odd factors of the signature's hash functions, from a seeded draw.
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 31, POSITIONS, np.uint32) * np.uint32(2) + np.uint32(1)


def signature(found: np.ndarray) -> bytes:
    """For each of POSITIONS functions the low byte of the least hash of a set of shingles; zeros for an empty set."""
    least = np.full(POSITIONS, 0xFFFFFFFF, np.uint32)
    some = (found >> np.uint64(32)).astype(np.uint32)
    for low in range(0, len(some), 2048):
        np.minimum(least, np.multiply.outer(FACTORS, some[low : low + 2048]).min(1), out=least)
    return (least & 0xFF).astype(np.uint8).tobytes() if len(found) else bytes(POSITIONS)


def least_tally(similarity: float = SIMILARITY) -> int:
    """The shared positional bytes that a similar pair has at least, but for BEHIND standard deviations."""
    return int(POSITIONS * similarity - BEHIND * math.sqrt(POSITIONS * similarity * (1 - similarity)))


def _bands(signatures: np.ndarray) -> np.ndarray:
    """Keys of the postings of signatures (uint8, rows x POSITIONS): the band's number over its bytes."""
    parts = signatures.reshape(-1, BANDS, BAND).astype(np.int64)
    return (parts << (8 * np.arange(BAND))).sum(2) + (np.arange(BANDS, dtype=np.int64) << (8 * BAND))


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, POSITIONS)


def _alike(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which pairs of sets (sorted, unique) have the similarity, as a matrix."""
    sizes = np.array([len(x) for x in sets], np.float64)
    if len(sets) <= 8:
        shared = np.zeros((len(sets), len(sets)))
        for i, j in combinations(range(len(sets)), 2):
            if min(sizes[i], sizes[j]) >= similarity * max(sizes[i], sizes[j]):
                shared[i, j] = shared[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
        _, at, count = np.unique(flat, return_inverse=True, return_counts=True)
        several = count[at] > 1  # a shingle that one set has is shared by none
        names, at = np.unique(at[several], return_inverse=True)
        owner = owner[several]
        order = np.argsort(at, kind="stable")
        at, owner = at[order], owner[order]
        shared = np.zeros((len(sets), len(sets)), np.float64)
        for low in range(0, len(names), 4096):
            a, b = np.searchsorted(at, [low, low + 4096])
            has = np.zeros((len(sets), min(4096, len(names) - low)), np.float32)
            has[owner[a:b], at[a:b] - low] = 1
            shared += has @ has.T
    either = sizes[:, None] + sizes[None, :] - shared
    return (shared >= similarity * either - 1e-9) & (shared > 0)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = NEAR_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, the one with the smallest id; all columns stay as
    they are.

    Documents link if their sets of shingles have a Jaccard similarity of at least ``similarity``, or are equal.
    """
    docs, file, at = placed(docs)
    with scratch(docs.sparkSession) as keep:
        dropped = keep(_dropped(docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"), F.col(file).alias("file"), F.col(at).alias("at")), words, similarity))
    dropped = dropped.toDF(file, at)
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    return docs.join(dropped, [file, at], "left_anti").drop(file, at)


def _dropped(rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """``file, at`` of the rows that go. ``rows``: doc, text, file, at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for part in slices(batches):
            sets = [shingles(t, words) for t in texts(part)]
            whole = pa.array([xxhash.xxh3_128_digest(x) for x in sets], pa.binary())
            sizes = pa.array([len(x) for x in sets], pa.int32())
            fps, marks = pa.array(map(of_set, sets), pa.int64()), pa.array(map(signature, sets), pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), whole, sizes, fps, marks], ["doc", "file", "at", "whole", "size", "fp", "signature"])

    kind = rows.schema["doc"].dataType.simpleString()
    marked = rows.mapInArrow(run, f"doc {kind}, file long, at long, whole binary, size int, fp long, signature binary")
    first = F.struct(F.col("doc").isNull().alias("unknown"), "doc", "file", "at")
    least = F.min(F.struct(first.alias("first"), "size", "fp", "signature")).alias("least")
    nodes = materialize(marked.groupBy("whole").agg(least).select("least.*", F.monotonically_increasing_id().alias("node")))
    groups = _grouped(nodes, similarity)
    if groups is not None:
        sizes = groups.join(nodes.select("node", "size"), "node").groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("all"))
        tiles = F.ceil(F.greatest(F.col("n") / NEAR_TILE, F.col("all") / TILE_SHINGLES)).cast("int")
        members = groups.join(sizes.select("root", F.greatest(tiles, F.lit(1)).alias("tiles")).hint("merge"), "root")
        members = members.hint("merge").join(nodes.select("node", F.col("first.file").alias("file"), F.col("first.at").alias("at")), "node")
        wanted = rows.select("file", "at", "text").join(members.hint("merge"), ["file", "at"])

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                found = [shingles(t, words).view(np.int64) for t in texts(part)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(found, pa.list_(pa.int64()))], ["key", "tiles", "node", "found"])

        members = wanted.select(F.col("root").alias("key"), "tiles", "node", "text").mapInArrow(read, "key long, tiles int, node long, found array<long>")
        members = materialize(members)  # texts are read once for all steps

        def found(block: pa.Table) -> pa.RecordBatch:
            labels, edges = block["label"].to_numpy(), set()
            lists = block["found"].combine_chunks()
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            for s, e in zip(*(x.tolist() for x in _runs(block))):
                if (labels[s:e] != labels[s]).any():
                    sets = [flat[at[k] : at[k + 1]] for k in range(s, e)]
                    edges.update(_forest(_alike(sets, similarity), labels[s:e]))
            return _edges(edges)

        roots = _joined(members, lambda some: some, ["found"], found)
    else:
        roots = None
    joined = nodes.select("node", "first").hint("merge")
    joined = joined.withColumn("root", F.col("node")) if roots is None else joined.join(roots, "node", "left")
    stay = joined.groupBy(F.coalesce("root", "node")).agg(F.min("first").alias("first")).select("first.file", "first.at")
    return rows.select("file", "at").join(stay, ["file", "at"], "left_anti")


def _grouped(nodes: DataFrame, similarity: float) -> DataFrame | None:
    """``node, root``: groups of nodes (node, size, fp, signature; stored) that hold all links; None if there is none."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = _bands(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(keys.ravel())], ["node", "key"])

    postings = nodes.select("node", "signature").mapInArrow(spread, "node long, key long")
    several = postings.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    tiles = F.ceil(F.col("n") / NEAR_TILE).cast("int")
    held = materialize(postings.join(several.select("key", tiles.alias("tiles")).hint("merge"), "key"))
    enough = least_tally(similarity)

    def found(block: pa.Table) -> pa.RecordBatch:
        labels, sizes, marks, edges = block["label"].to_numpy(), block["size"].to_numpy(), _matrix(block["signature"]), set()
        for s, e in zip(*(x.tolist() for x in _runs(block))):
            if (labels[s:e] != labels[s]).any():
                some, size = marks[s:e], sizes[s:e]
                near = np.minimum(size[:, None], size) >= similarity * np.maximum(size[:, None], size) - 1e-9
                for row, mark in zip(near, some):
                    row &= (some == mark).sum(1) >= enough
                edges.update(_forest(near, labels[s:e]))
        return _edges(edges)

    fetch = lambda some: some.join(nodes.select("node", "size", "signature").hint("merge"), "node")
    return _joined(held, fetch, ["size", "signature"], found, _by_fingerprint(nodes.select("node", "fp")))


def query(spark, sf_dir: str) -> DataFrame:
    out = near_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
