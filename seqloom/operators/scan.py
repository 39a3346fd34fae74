"""Matches of few reads in many references, in one pass over the references that shuffles none of them.

Reads of at most MOST_BASES bases are sent to all tasks as 2-bit codes of WIDTH bases, sorted.  A task cuts its references into
such codes, both strands, and looks them up in arrays; what it gives back is reduced to the reads' side: a length for
each base, spans with their number, counts of words.  So what is shuffled depends on the reads and the number of tasks,
not on how often a common word occurs.  Larger reads, or reads with other characters than bases, are joined (``matches``).

References that have bases alone are cut once: what a read has in their other strand, its own other strand has in them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions.sequence import BASES
from seqloom.session import materialize

#: Bases of reads that are sent to all tasks, some 40 bytes each.
MOST_BASES = 1_000_000
#: Bases of a code.
WIDTH = 31
#: Bases of references that are worked on at once, or one reference; pairs of places that are, or those of one reference.
TOGETHER = 1 << 20
PAIRS = 1 << 22
#: Words of up to so many bases are counted in an array of all words.
DENSE = 10
#: Words of so many bases are marked in an array of all words: those that references have, and those that reads have.
MARKED = 12

_OTHER = 4
_CODE = np.full(256, _OTHER, np.uint8)
_CODE[np.frombuffer(BASES.encode(), np.uint8)] = range(4)
#: Of the other strand: characters but ``#`` that are no base are ``A`` there (``sequence.revcomp``).
_BACK = np.zeros(256, np.uint8)
_BACK[np.frombuffer(BASES.encode(), np.uint8)] = [3, 2, 1, 0]
_BACK[ord("#")] = _OTHER


def codes(digits: np.ndarray) -> np.ndarray:
    """The code of the WIDTH bases from each place on, the first base highest; what follows the end is ``A``."""
    n = len(digits)
    out = np.zeros(n + 2 * WIDTH + 1, np.int64)
    out[:n] = digits & 3
    for h in (1, 2, 4, 8):
        out = (out[:-h] << (2 * h)) | out[h:]
    return ((out[:-16] << 30) | (out[16:] >> 2))[:n]


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bases two codes begin with alike."""
    x = a ^ b
    x &= ~(x >> 1)  # the second bit goes, so that no rounding reaches the next power of two
    return (62 - np.frexp(x.astype(np.float64))[1]) >> 1


def turned(some: np.ndarray, k: int) -> np.ndarray:
    """Codes of k bases of the other strand."""
    out = np.zeros_like(some)
    for i in range(k):
        out |= (3 - ((some >> (2 * i)) & 3)) << (2 * (k - 1 - i))
    return out


def words_of(found: np.ndarray, k: int) -> pa.Array:
    """Codes of k bases as text."""
    letters = np.frombuffer(BASES.encode(), np.uint8)[(found[:, None] >> (2 * np.arange(k - 1, -1, -1))) & 3]
    return pa.array(np.ascontiguousarray(letters).view(f"S{k}").ravel().astype(f"U{k}").tolist(), pa.string())


@dataclass
class Reads:
    """Reads one after another: ids, where each starts (and the last ends), and of each base its code and what is left of its read."""

    ids: pa.Array
    starts: np.ndarray
    code: np.ndarray
    room: np.ndarray

    def kmers(self, k: int) -> np.ndarray:
        """The different codes of k bases."""
        return np.unique(self.code[self.room >= k] >> (2 * (WIDTH - k)))

    def both(self) -> Reads:
        """These, and then the other strand of all bases; an end [s, e) of that half is [2 n - e, 2 n - s) of n bases."""
        digits = self.code >> (2 * (WIDTH - 1))
        sizes = np.diff(self.starts)
        starts = np.concatenate([[0], np.cumsum(np.concatenate([sizes, sizes[::-1]]))]).astype(np.int64)
        back = np.repeat(starts[1:], np.diff(starts)) - np.arange(2 * len(digits))
        return Reads(self.ids, starts, np.concatenate([self.code, codes(3 - digits[::-1])]), back)

    def forward(self, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans of these bases of spans of :meth:`both`."""
        n = len(self.code)
        return np.where(s < n, s, 2 * n - e), np.where(s < n, e, 2 * n - s)

    def spans(self, s: np.ndarray, e: np.ndarray) -> list[pa.Array]:
        """Ids, starts and ends within reads of spans of all reads' bases."""
        read = np.searchsorted(self.starts, s, side="right") - 1
        return [self.ids.take(pa.array(read)), pa.array(s - self.starts[read]), pa.array(e - self.starts[read])]


def collected(reads: DataFrame) -> Reads | None:
    """Reads (read_id, seq) on the driver, if they are few enough and have bases alone."""
    seq = F.coalesce(F.col("seq").cast("string"), F.lit(""))
    size = reads.agg(F.sum(F.char_length(seq).cast("long") + 1).alias("n"), F.count_if(seq.rlike(f"[^{BASES}]")).alias("other")).first()
    if (size["n"] or 0) > MOST_BASES or size["other"]:
        return None
    rows = reads.select("read_id", seq.alias("seq")).toArrow().combine_chunks()
    text = [s.encode() for s in rows["seq"].to_pylist()]
    sizes = np.fromiter(map(len, text), np.int64, len(text))
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    digits = _CODE[np.frombuffer(b"".join(text), np.uint8)]
    ids = rows["read_id"].combine_chunks()
    return Reads(ids, starts, codes(digits), np.repeat(starts[1:], sizes) - np.arange(len(digits)))


@dataclass
class Piece:
    """References of one strand, one after another: codes, what is left of the reference before its end or another character, and rows.
    ``both``: it stands for the other strand too, so both strands of reads are looked for."""

    code: np.ndarray
    room: np.ndarray
    row: np.ndarray
    both: bool = False


def _pieces(batch: pa.RecordBatch, strands: bool, once: bool = False) -> Iterator[Piece]:
    """The references (last column) of a batch, some at once; ``once``: those that have bases alone in one piece for both strands."""
    column = batch.column(batch.num_columns - 1)
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + TOGETHER, side="right")))
        size, joined = _bytes(column.slice(first, last - first))
        rows = np.arange(first, last)
        digits = _CODE[joined]
        both = once and strands and not (digits == _OTHER).any()
        yield _piece(digits, size, rows, both)
        if strands and not both:
            yield _piece(_BACK[joined[::-1]], size[::-1], rows[::-1])
        first = last


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of texts and their characters one after another, a byte each."""
    if not pc.all(pc.string_is_ascii(column)).as_py():
        text = [s.encode("ascii", "replace") for s in column.to_pylist()]
        return np.fromiter(map(len, text), np.int64, len(text)), np.frombuffer(b"".join(text), np.uint8)
    _, offsets, data = column.buffers()
    stops = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.diff(stops), np.frombuffer(data, np.uint8)[stops[0] : stops[-1]] if data else np.zeros(0, np.uint8)


def _piece(digits: np.ndarray, size: np.ndarray, rows: np.ndarray, both: bool = False) -> Piece:
    stop = np.repeat(np.cumsum(size), size)
    place = np.arange(len(digits))
    other = np.flatnonzero(digits == _OTHER)
    if len(other):
        nearest = np.append(other, len(digits))[np.searchsorted(other, place)]
        stop = np.minimum(stop, nearest)
    return Piece(codes(digits), stop - place, np.repeat(rows, size), both)


def _filter(known: np.ndarray) -> tuple[np.ndarray, np.uint64]:
    """A table that tells most codes that are not among the known ones at once, and its shift."""
    bits = min(22, max(10, int(np.ceil(np.log2(len(known) + 1))) + 4))
    shift = np.uint64(64 - bits)
    table = np.zeros(1 << bits, bool)
    table[_slot(known, shift)] = True
    return table, shift


def _slot(some: np.ndarray, shift: np.uint64) -> np.ndarray:
    return (some.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> shift


def _hits(piece: Piece, k: int, known: np.ndarray, table: np.ndarray, shift: np.uint64, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of a piece (``among``: of these) whose k bases are among the known codes, and the number of the code."""
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code, room = (piece.code, piece.room) if among is None else (piece.code[among], piece.room[among])
    some = code >> (2 * (WIDTH - k))
    place = np.flatnonzero(table[_slot(some, shift)])
    place = place[room[place] >= k]
    some = some[place]
    place = place if among is None else among[place]
    at = np.minimum(np.searchsorted(known, some), len(known) - 1)
    same = known[at] == some
    return place[same], at[same]


@dataclass
class _Seeds:
    """The k-mers of reads, and where each is."""

    k: int
    known: np.ndarray
    table: np.ndarray
    shift: np.uint64
    begin: np.ndarray
    place: np.ndarray
    bases: int

    @classmethod
    def of(cls, held: Reads, k: int) -> _Seeds:
        place = np.flatnonzero(held.room >= k)
        some = held.code[place] >> (2 * (WIDTH - k))
        order = np.argsort(some, kind="stable")
        known, begin = np.unique(some[order], return_index=True)
        return cls(k, known, *_filter(known), np.append(begin, len(place)), place[order], len(held.code))

    def islands(self, piece: Piece, among: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Starts and ends of maximal matches in the reads, and the reference's row; ``among``: as of :func:`_hits`."""
        where, at = _hits(piece, self.k, self.known, self.table, self.shift, among)
        pairs = np.cumsum(self.begin[at + 1] - self.begin[at])
        rows = np.flatnonzero(np.append(piece.row[where[1:]] != piece.row[where[:-1]], True)) + 1 if len(where) else []
        first = 0
        for last in self._parts(pairs, rows):
            j, u = where[first:last], at[first:last]
            count = self.begin[u + 1] - self.begin[u]
            ends = np.cumsum(count)
            inner = np.arange(ends[-1]) - np.repeat(ends - count, count)
            i = self.place[np.repeat(self.begin[u], count) + inner]
            # matches of one diagonal follow one another; a stride more than the reads have bases parts diagonals
            key = np.sort((np.repeat(j, count) - i + self.bases) * (self.bases + 1) + i)
            cut = np.flatnonzero(np.diff(key) != 1) + 1
            low, high = key[np.concatenate([[0], cut])], key[np.concatenate([cut, [len(key)]]) - 1]
            s, e = low % (self.bases + 1), high % (self.bases + 1) + self.k
            yield s, e, piece.row[low // (self.bases + 1) - self.bases + s]
            first = last

    @staticmethod
    def _parts(pairs: np.ndarray, rows) -> Iterator[int]:
        """Where to stop such that no reference is cut and there are PAIRS pairs at most, or those of one reference."""
        done = held = 0
        for last in map(int, rows):
            if held and pairs[last - 1] - (pairs[done - 1] if done else 0) > PAIRS:
                yield held
                done = held
            held = last
        if held > done:
            yield held


def spans(held: Reads, refs: DataFrame, k: int, keep: list[str] | None = None, strands: bool = True) -> DataFrame:
    """``read_id, keep, s, e, n``: matches [s, e) of k bases or more that can not be prolonged, and how many there are in
    references (seq) that are alike in ``keep``; ``strands``: of both strands."""
    keep = keep or []
    chosen = refs.select(*keep, F.col("seq").cast("string").alias("seq"))
    shared = refs.sparkSession.sparkContext.broadcast((held, _Seeds.of(held, k), _Seeds.of(held.both(), k)))
    names = ["read_id", "s", "e", *keep, "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reads, seeds, seeds_of_both = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.zeros(batch.num_rows, np.int64)
            kept, some = [], []
            if keep:
                alike = pa.Table.from_batches([batch.select(keep)]).append_column("_row", pa.array(np.arange(batch.num_rows)))
                firsts = alike.group_by(keep, use_threads=False).aggregate([("_row", "min"), ("_row", "list")])
                lists = firsts["_row_list"].combine_chunks()
                group[lists.flatten().to_numpy()] = np.repeat(np.arange(len(firsts)), np.diff(lists.offsets.to_numpy()))
                kept = firsts["_row_min"].to_numpy()
            for piece in _pieces(batch, strands, once=True):
                for s, e, row in (seeds_of_both if piece.both else seeds).islands(piece):
                    s, e = reads.forward(s, e)
                    some.append(np.stack([group[row], s, e, np.ones(len(s), np.int64)]))
                    if sum(x.shape[1] for x in some) > PAIRS:
                        some = [_counted(some)]
            if not some:
                continue
            g, s, e, n = _counted(some)
            values = [batch.column(i).take(pa.array(kept[g])) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*reads.spans(s, e), *values, pa.array(n)], names)

    kinds = [f"read_id {_kind(held)}", "s long", "e long", *[f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in keep], "n long"]
    found = chosen.mapInArrow(run, ", ".join(kinds))
    return found.groupBy("read_id", *keep, "s", "e").agg(F.sum("n").alias("n"))


def _counted(some: list[np.ndarray]) -> np.ndarray:
    """Different columns (group, start, end, number), with the sum of their numbers."""
    all_ = np.concatenate(some, 1)
    all_ = all_[:, np.lexsort(all_[2::-1])]
    first = np.flatnonzero(np.append(True, (np.diff(all_[:3]) != 0).any(0)))[: all_.shape[1]]
    return np.concatenate([all_[:3, first], np.add.reduceat(all_[3], first)[None]]) if len(first) else all_


def _kind(held: Reads) -> str:
    from pyspark.sql.pandas.types import from_arrow_type

    return from_arrow_type(held.ids.type).simpleString()


@dataclass
class _Reached:
    """What reads are looked up by, for :func:`reach`: sorted different codes and each base's, long seeds, and marks of their words."""

    reads: Reads
    seeds: _Seeds
    known: np.ndarray
    number: np.ndarray
    marked: np.ndarray

    @classmethod
    def of(cls, held: Reads) -> _Reached:
        known, number = np.unique(held.code, return_inverse=True)
        return cls(held, _Seeds.of(held, WIDTH), known, number, held.kmers(MARKED))

    def begun(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        """Marks of the reads' words; what references add to: marks of their words and of shorter ones at their ends, lengths of
        codes, ends of long matches.  The last mark is of no word."""
        ours = np.zeros(4**MARKED + 1, bool)
        ours[self.marked] = True
        shorter = [np.zeros(4**n, bool) for n in range(MARKED)]
        return ours, np.zeros(4**MARKED + 1, bool), shorter, np.zeros(len(self.known), np.int64), np.arange(len(self.reads.code))

    def add(self, piece: Piece, found: tuple) -> None:
        ours, theirs, shorter, best, ends = found
        word = piece.code >> (2 * (WIDTH - MARKED))
        few = np.flatnonzero(piece.room < MARKED)
        for n in range(1, MARKED):
            shorter[n][word[few[piece.room[few] == n]] >> (2 * (MARKED - n))] = True
        word[few] = 4**MARKED
        theirs[word] = True
        place = np.flatnonzero(ours[word])
        code, room, n = piece.code[place], piece.room[place], len(self.known)
        at = np.searchsorted(self.known, code)
        for near in (np.maximum(at - 1, 0), np.minimum(at, n - 1)):
            np.maximum.at(best, near, np.minimum(common(self.known[near], code), room))
        for s, e, _ in self.seeds.islands(piece, place):
            np.maximum.at(ends, s, e)

    def spans(self, found: tuple) -> tuple[np.ndarray, np.ndarray]:
        """The matches that start at bases and are in none that starts before."""
        _, theirs, shorter, best, ends = found
        alike, values = common(self.known[:-1], self.known[1:]).tolist(), best.tolist()
        for i in range(1, len(values)):
            values[i] = max(values[i], min(values[i - 1], alike[i - 1]))
        for i in range(len(values) - 2, -1, -1):
            values[i] = max(values[i], min(values[i + 1], alike[i]))
        size, mark = np.zeros(len(self.known), np.int64), theirs[:-1]
        for n in range(MARKED, 0, -1):
            size += mark[self.known >> (2 * (WIDTH - n))]  # what begins a word is one
            mark = mark.reshape(-1, 4).any(1) | shorter[n - 1]
        size = np.maximum(size, np.array(values, np.int64))
        place = np.arange(len(ends))
        ends = np.maximum.accumulate(np.maximum(ends, place + np.minimum(size[self.number], self.reads.room)))
        new = np.flatnonzero((ends > place) & (ends > np.concatenate([[0], ends[:-1]])))
        return new, ends[new]


def reach(held: Reads, refs: DataFrame, strands: bool = True) -> DataFrame:
    """``read_id, s, e``: the matches [s, e) of any length that are in no other: a part of a read occurs if it is in one of them.

    Up to MARKED bases: words of references are marked in an array of all.  Up to WIDTH bases: a place of the references that
    begins like a read by MARKED bases meets its two neighbours among the reads' sorted codes, which begin like it as far as
    any do; the others follow from these and from how codes begin alike.  Longer ones are prolonged."""
    chosen = refs.select(F.col("seq").cast("string").alias("seq"))
    shared = refs.sparkSession.sparkContext.broadcast((held, [_Reached.of(x) for x in ([held, held.both()] if strands else [held])]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reads, sides = shared.value
        if not len(reads.code):
            return
        found = [side.begun() for side in sides]
        for batch in batches:
            for piece in _pieces(batch, strands, once=True):
                sides[piece.both].add(piece, found[piece.both])
        spans_ = [np.stack(reads.forward(*side.spans(each))) for side, each in zip(sides, found)]
        ends = np.arange(len(reads.code))
        for s, e in spans_:
            np.maximum.at(ends, s, e)
        place = np.arange(len(ends))
        ends = np.maximum.accumulate(ends)
        new = np.flatnonzero((ends > place) & (ends > np.concatenate([[0], ends[:-1]])))
        yield pa.RecordBatch.from_arrays(reads.spans(new, ends[new]), ["read_id", "s", "e"])

    found = chosen.mapInArrow(run, f"read_id {_kind(held)}, s long, e long").groupBy("read_id", "s").agg(F.max("e").alias("e"))
    before = F.max("e").over(Window.partitionBy("read_id").orderBy("s").rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn("_before", before).filter("_before is null or _before < e").drop("_before")


def counts(spark: SparkSession, words: dict[int, np.ndarray], refs: DataFrame, strands: bool = True) -> DataFrame:
    """``kmer, cnt``: how often words occur in references (seq), those that do.  ``words``: sorted different codes, by their bases."""
    chosen = refs.select(F.col("seq").cast("string").alias("seq"))
    wanted = {}
    for k, x in words.items():
        if len(x):
            back = turned(x, k) if strands else x
            known = np.union1d(x, back)
            wanted[k] = (x, np.searchsorted(known, x), np.searchsorted(known, back), (known, *_filter(known)))
    shared = spark.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {k: np.zeros((2, len(table[0])), np.int64) for k, (*_, table) in shared.value.items()}
        for batch in batches:
            for piece in _pieces(batch, strands, once=True):
                for k, (*_, table) in shared.value.items():
                    found[k][int(piece.both)] += np.bincount(_hits(piece, k, *table)[1], minlength=len(table[0]))
        for k, (asked, ahead, back, _) in shared.value.items():
            sums = found[k].sum(0)[ahead] + found[k][1][back]
            some = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([words_of(asked[some], k), pa.array(sums[some])], ["kmer", "cnt"])

    return chosen.mapInArrow(run, "kmer string, cnt long").groupBy("kmer").agg(F.sum("cnt").alias("cnt"))


def all_counts(refs: DataFrame, k: int, strands: bool = True) -> DataFrame:
    """``kmer, cnt``: occurrences of every k-mer of up to DENSE bases, counted in an array of all."""
    if not 0 < k <= DENSE:
        raise ValueError(f"words of {k} bases are too many for an array")
    chosen = refs.select(F.col("seq").cast("string").alias("seq"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last of each is of places too near to an end
        each = np.zeros((2, 4**k + 1), np.int64)
        for batch in batches:
            for piece in _pieces(batch, strands, once=True):
                word = piece.code >> (2 * (WIDTH - k))
                word[np.flatnonzero(piece.room < k)] = 4**k
                each[int(piece.both)] += np.bincount(word, minlength=4**k + 1)
        found = each[:, :-1].sum(0) + each[1][turned(np.arange(4**k), k)]
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([words_of(some, k), pa.array(found[some])], ["kmer", "cnt"])

    return chosen.mapInArrow(run, "kmer string, cnt long").groupBy("kmer").agg(F.sum("cnt").alias("cnt"))


def count_suffix(reads: DataFrame, held: Reads, refs: DataFrame, reached: DataFrame) -> DataFrame:
    """``read_id, matched, total, occurrences``: the longest suffix of a read that occurs, and how often.  ``reached``: what
    :func:`reach` returns."""
    spark = refs.sparkSession
    sizes = reads.select("read_id", "seq", F.char_length("seq").cast("long").alias("total"))
    ends = sizes.join(reached, (sizes.read_id == reached.read_id) & (F.col("total") == F.col("e"))).groupBy(sizes.read_id, "seq", "total").agg(F.min("s").alias("s"))
    suffixes = materialize(ends.select("read_id", (F.col("total") - F.col("s")).alias("matched"), F.expr("substring(seq, cast(s as int) + 1)").alias("kmer")))
    short = suffixes.filter(F.col("matched") <= WIDTH).select("kmer").distinct().toArrow()["kmer"].to_pylist()
    wanted = {}
    for k in sorted(set(map(len, short))):
        digits = _CODE[np.frombuffer("".join(w for w in short if len(w) == k).encode(), np.uint8)].reshape(-1, k).astype(np.int64)
        wanted[k] = np.sort((digits << (2 * np.arange(k - 1, -1, -1))).sum(1))
    found = materialize(counts(spark, wanted, refs))
    if long := collected(suffixes.filter(F.col("matched") > WIDTH).select(F.col("kmer").alias("read_id"), F.col("kmer").alias("seq")).distinct()):
        if len(long.code):
            whole = spans(long, refs, WIDTH).filter((F.col("s") == 0) & (F.col("e") == F.char_length("read_id")))
            found = found.unionByName(whole.select(F.col("read_id").alias("kmer"), F.col("n").alias("cnt")))
    counted = suffixes.join(found, "kmer").select("read_id", "matched", F.col("cnt").alias("occurrences"))
    zero = F.lit(0).cast("long")
    out = sizes.select("read_id", "total").join(counted, "read_id", "left")
    return out.select("read_id", F.coalesce("matched", zero).alias("matched"), "total", F.coalesce("occurrences", zero).alias("occurrences"))
