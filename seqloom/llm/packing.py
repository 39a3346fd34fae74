"""Best-fit packing by linear grouping, over the histogram of lengths.

Lengths are whole numbers up to the capacity, so the histogram has at most ``capacity`` rows however many documents
there are; the plan is made from it on the driver and is a bounded table of runs, "the documents of this length with
these ranks go to these sequences at this offset".  The plan: (1) lengths over ``small`` are sorted and cut into
``groups`` groups of equal cardinality, each rounded up to its largest length; (2) configurations of these few sizes
are optimised as a cutting-stock linear program by column generation, rounded down; (3) the actual documents take the
slots of their groups, which frees what rounding up had added; (4) what is left, large ones of the rounded-down
remainder and then all small ones, goes best-fit, longest first, into the tightest gap or a new sequence.

Ranks within a length are numbered in two levels (salt, then prefix sums over salts), so that a length that a third
of all documents share is not sorted in one task.

Defined results: null text is empty text, which still has its end id; a document longer than the capacity is cut into
pieces of the capacity, the last may be shorter; repeated rows are packed each on its own; an empty table gives an empty
result. Only the id and text columns are read by :func:`tokenize_documents`; :func:`pack` keeps all other columns.
"""

from __future__ import annotations

import bisect
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import SALTS, Recent, slices, table
from seqloom.session import free_names, materialize

CAPACITY = 4096
END_ID = 1
#: Lengths up to this share of the capacity count as small.
SMALL = 1 / 3
GROUPS = 256
#: Steps of the linear program; fewer steps give a fuller remainder, never a wrong plan.
STEPS = 1500
CACHE = 180_000
#: Marks at the end of a word, which the tokenizer parts from letters.
MARKS = ".,!?;:%&#*$)"
#: Lower-case letters of ASCII and Latin-1, in UTF-8.
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
#: Stems that the marks are parted from: letters of ASCII and Latin-1, which are one letter in lower case too.
LETTERS = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
#: Bytes from 0x80 on as byte-level vocabularies write them: printable Latin-1 stays, others follow from U+0100 + 33 + 1 on.
WRITTEN = {b: 0x100 + 34 + b - 0x80 for b in range(0x80, 0xA1)} | {0xAD: 0x100 + 34 + 33}
#: Words whose ids are put in place at once.
GATHER = 1 << 17
#: Different words that are looked up at once.
DISTINCT = 1 << 17
#: UTF-8 bytes of texts whose words are numbered together.
SLICE = 8 << 20
#: New words that are encoded as one text.
WORDS = 1_000


class Tokens:
    """Ids of texts by a tokenizer that lower-cases and splits at white space and between letters and other characters.

    A column is split and its words are numbered in Arrow; distinct words lose the marks at their end, and the ids of
    what is left, and of the marks, are kept, up to twice ``cache`` of them.
    """

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model, self.known = self.tokenizer.model, Recent(cache)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column, one after another, and how many each text has; null texts are empty."""
        import pyarrow.compute as pc

        column = pc.fill_null(column, "")
        # ASCII letters are the same in lower case before and after normalisation if nothing else is there
        column = pc.if_else(pc.string_is_ascii(column), pc.ascii_lower(column), column)
        split = pc.ascii_split_whitespace(column)  # white space that the tokenizer drops
        del column  # what is done with goes before the next is made
        upto = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
        split = split.flatten()
        coded = split.dictionary_encode()
        del split
        pa.default_memory_pool().release_unused()
        words = coded.dictionary
        ids = [x for low in range(0, len(words), DISTINCT) for x in self._distinct(words.slice(low, DISTINCT))]
        at = coded.indices.to_numpy(zero_copy_only=False)
        sizes = (np.fromiter(map(len, ids), np.int64, len(ids)) // 4).astype(np.int32)
        starts, packed = np.cumsum(sizes, dtype=np.int64) - sizes, np.frombuffer(b"".join(ids), "<u4")
        del ids
        ends = np.zeros(len(at) + 1, np.int64)
        np.cumsum(sizes[at], out=ends[1:])
        out = np.empty(ends[-1], "<u4")
        for low in range(0, len(at), GATHER):
            some = at[low : low + GATHER]
            first, last = ends[low], ends[low + len(some)]
            out[first:last] = packed[np.repeat(starts[some] - (ends[low : low + len(some)] - first), sizes[some]) + np.arange(last - first)]
        return out, np.diff(ends[np.concatenate([[0], upto])])

    def _distinct(self, words: pa.Array) -> list[bytes]:
        """Packed ids of each word."""
        import pyarrow.compute as pc

        stems = pc.ascii_rtrim(words, characters=MARKS)
        # letters and then marks are two pre-tokens; other letters may become several characters in lower case, not all of them letters
        stems = pc.if_else(pc.match_substring_regex(stems, LETTERS), stems, words)
        coded = stems.dictionary_encode()
        ids = self._packed(coded.dictionary.cast(pa.binary()).to_pylist())
        out = [ids[k] for k in coded.indices.to_pylist()]
        where = pc.indices_nonzero(pc.not_equal(pc.binary_length(stems), pc.binary_length(words)))
        ends = [w[n:] for w, n in zip(words.take(where).cast(pa.binary()).to_pylist(), pc.binary_length(stems.take(where)).to_pylist())]
        some = list(set(ends))
        marks = dict(zip(some, self._packed(some)))
        for k, end in zip(where.to_pylist(), ends):
            out[k] += marks[end]
        return out

    def _packed(self, words: list[bytes]) -> list[bytes]:
        rest, tokenize = [], self.model.tokenize
        for word in self.known.missing(set(words)):
            if PLAIN(word):
                # one pre-token that normalisation leaves as it is: the model alone, on bytes as it writes them
                text = word.decode() if word.isascii() else word.decode("latin-1").translate(WRITTEN)
                self.known.now[word] = array("I", [t.id for t in tokenize(text)]).tobytes()
            else:
                rest.append(word)
        for low in range(0, len(rest), WORDS):
            self.known.now.update(zip(rest[low : low + WORDS], self._words(rest[low : low + WORDS])))
        return list(map(self.known.now.__getitem__, words))

    def _words(self, words: list[bytes]) -> list[bytes]:
        """Ids of some words, encoded as one text; a token's place tells its word."""
        plain = [w.decode() for w in words]
        found = self.tokenizer.encode(" ".join(plain), add_special_tokens=False)
        begins = np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain)) + 1)
        ids = np.array(found.ids, "<u4").tobytes()
        place = np.fromiter((a for a, _ in found.offsets), np.int64, len(found.offsets))
        ends = (4 * np.searchsorted(place, begins)).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]


_TOKENS: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    """One tokenizer a worker process."""
    if path not in _TOKENS:
        _TOKENS.clear()
        _TOKENS[path] = Tokens(path)
    return _TOKENS[path]


def tokenize_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, piece, start, length, ids`` (binary, little-endian unsigned 32-bit): each document's ids and then
    ``end_id``, cut at the capacity.  ``path``: a tokenizer file that every executor has at this place."""
    chosen = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens(path).encode
        for part in slices(batches, most=SLICE):
            ids, counts = encode(part.column(1))
            ids = np.insert(ids, np.cumsum(counts), end_id)
            sizes = counts + 1
            pieces = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(capacity, sizes[row] - start)
            offsets = np.concatenate([[0], 4 * np.cumsum(length)]).astype(np.int32)
            cut = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
            columns = [part.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), cut]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "piece", "start", "length", "ids"])
            del ids, row, piece, start, length, offsets, cut, columns
            pa.default_memory_pool().release_unused()

    kind = chosen.schema["doc"].dataType.simpleString()
    return chosen.mapInArrow(run, f"doc {kind}, piece int, start long, length long, ids binary").withColumnRenamed("doc", id_col)


def _best_pattern(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """The configuration of at most the capacity with the highest price (unbounded knapsack)."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes, kind="stable")
    ordered, paid = sizes[order], prices[order]
    fits = np.searchsorted(ordered, np.arange(capacity + 1), side="right")
    for room in range(int(ordered[0]), capacity + 1):
        n = fits[room]
        value = best[room - ordered[:n]] + paid[:n]
        at = int(value.argmax())
        if value[at] > best[room - 1] + 1e-12:
            best[room], choice[room] = value[at], at
        else:
            best[room] = best[room - 1]
    pattern, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            pattern[order[choice[room]]] += 1
            room -= int(ordered[choice[room]])
    return pattern


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, steps: int = STEPS) -> list[tuple[np.ndarray, int]]:
    """Cutting stock by column generation: configurations of the sizes and how many sequences take each, rounded down."""
    n = len(sizes)
    if not n:
        return []
    columns = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1 / np.diag(columns))
    amount = inverse @ demand.astype(float)
    for _ in range(steps):
        prices = inverse.sum(0)
        new = _best_pattern(sizes, np.maximum(prices, 0), capacity)
        if new @ prices <= 1 + 1e-4:
            break
        step = inverse @ new
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        least = ratio[out]
        amount = np.maximum(amount - least * step, 0)
        amount[out] = least
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        columns[:, out] = new
    found = [(columns[:, i].astype(np.int64), int(amount[i] + 1e-6)) for i in range(n)]
    used = np.zeros(n, np.int64)
    checked = []
    for pattern, times in found:  # numerical error must not use more than there is
        taken = np.flatnonzero(pattern)
        times = int(min(times, min((demand[taken] - used[taken]) // pattern[taken], default=0)))
        if times > 0:
            used += times * pattern
            checked.append((pattern, times))
    return checked


class _Bins:
    """Sequences by what is left in them: classes of equally filled sequences, each a list of runs
    ``[length, first rank, number a sequence]``."""

    def __init__(self, capacity: int):
        self.capacity, self.rooms, self.by_room = capacity, [], defaultdict(list)

    def add(self, room: int, count: int, runs: list) -> None:
        if count:
            if not self.by_room[room]:
                bisect.insort(self.rooms, room)
            self.by_room[room].append((count, runs))

    @staticmethod
    def split(runs: list, first: int) -> tuple[list, list]:
        return [list(r) for r in runs], [[length, rank + first * per, per] for length, rank, per in runs]

    def best_fit(self, length: int, rank: int, count: int) -> None:
        """Put ``count`` documents of a length, from this rank on, one after another into the tightest gap."""
        while count:
            at = bisect.bisect_left(self.rooms, length)
            if at < len(self.rooms):
                room = self.rooms[at]
                bins, runs = self.by_room[room].pop()
                if not self.by_room[room]:
                    self.rooms.pop(at)
            else:
                room, bins, runs = self.capacity, -(-count // (self.capacity // length)), []
            per = room // length
            whole = min(bins, count // per)
            if not whole:  # the last ones share one sequence
                per, whole = count, 1
            head, rest = self.split(runs, whole)
            self.add(room, bins - whole, rest)
            self.add(room - per * length, whole, [*head, [length, rank, per]])
            rank += per * whole
            count -= per * whole

    def all(self) -> list[tuple[int, list]]:
        return [x for room in sorted(self.by_room) for x in self.by_room[room]]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, small: float = SMALL, groups: int = GROUPS, steps: int = STEPS) -> np.ndarray:
    """Rows ``length, first rank, first sequence, number a sequence, offset``: where the documents of each length go.

    Ranks count the documents of a length from 0; sequences are numbered from 0 without gaps.
    """
    bins, next_rank = _Bins(capacity), defaultdict(int)
    large = sorted((n for n in histogram if small * capacity < n and histogram[n] > 0), reverse=True)
    total = sum(histogram[n] for n in large)
    size = max(1, -(-total // groups))
    # groups of equal cardinality: runs of [length, count], longest first; equal rounded sizes are one group
    parts: list[tuple[int, list]] = []
    room = 0
    for length in large:
        count = histogram[length]
        while count:
            if not room:
                if not parts or parts[-1][0] != length:
                    parts.append((length, []))
                room = size
            some = min(room, count)
            parts[-1][1].append([length, some])
            room -= some
            count -= some
    sizes = np.array([p[0] for p in parts], np.int64)
    demand = np.array([sum(c for _, c in p[1]) for p in parts], np.int64)
    # parts are taken shortest group first for the remainder, longest document first within a group
    for pattern, times in configurations(sizes, demand, capacity, steps):
        slots = [g for g in np.flatnonzero(pattern).tolist() for _ in range(int(pattern[g]))]
        while times:
            # as many sequences as get the same lengths in all slots
            need: dict[tuple[int, int], int] = defaultdict(int)
            filled, heads = [], {g: [list(r) for r in parts[g][1]] for g in set(slots)}
            alike = times
            for g in slots:
                while not heads[g][0][1]:
                    heads[g].pop(0)
                length, there = heads[g][0]
                need[g, length] += 1
                filled.append(length)
                alike = min(alike, max(1, histogram_share(parts[g][1], length) // need[g, length]))
                heads[g][0][1] -= 1
            taken: dict[int, int] = defaultdict(int)
            for (g, length), per in need.items():
                take(parts[g][1], length, per * alike)
                taken[length] += per
            runs = []
            for length, per in taken.items():
                runs.append([length, next_rank[length], per])
                next_rank[length] += per * alike
            bins.add(capacity - sum(filled), alike, runs)
            times -= alike
    for length in sorted((n for n in histogram if histogram[n] > 0), reverse=True):
        bins.best_fit(length, next_rank[length], histogram[length] - next_rank[length])
    out, sequence = [], 0
    for count, runs in bins.all():
        offset = 0
        for length, rank, per in runs:
            out.append((length, rank, sequence, per, offset))
            offset += per * length
        sequence += count
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def histogram_share(runs: list, length: int) -> int:
    return sum(count for n, count in runs if n == length)


def take(runs: list, length: int, count: int) -> None:
    """Remove documents of a length from a group's runs."""
    for run in runs:
        if run[0] == length and count:
            some = min(run[1], count)
            run[1] -= some
            count -= some
    runs[:] = [r for r in runs if r[1]]


def pack(pieces: DataFrame, capacity: int = CAPACITY, order: list[str] | None = None, length_col: str = "length") -> DataFrame:
    """``pieces``, a stored table, with ``sequence_id`` and ``offset`` (long), in place of columns of these names if it has
    such; ``order``: columns that tell its rows apart.

    Lengths must be from 1 to the capacity.
    """
    pieces = pieces.drop("sequence_id", "offset")
    order = order or [c for c in pieces.columns if c != length_col]
    counted = {r[0]: r[1] for r in pieces.groupBy(length_col).count().collect()}  # at most ``capacity`` rows
    if any(n is None or not 1 <= n <= capacity for n in counted):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    salts = max(SALTS, -(-sum(counted.values()) // 500_000))
    runs = plan(counted, capacity)
    starts = runs[:, 0] * (1 << 44) + runs[:, 1]
    salt, count, base, place = free_names(pieces.columns, "_salt", "_n", "_base", "_rank")
    dealt = pieces.withColumn(salt, F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    key = [length_col, salt]
    per_salt = dealt.groupBy(*key).agg(F.count("*").alias(count))
    before = Window.partitionBy(length_col).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    earlier = per_salt.select(*key, F.coalesce(F.sum(count).over(before), F.lit(0)).alias(base))
    within = Window.partitionBy(*key).orderBy(*order)
    ranked = dealt.withColumn(place, F.row_number().over(within)).join(earlier, key)
    ranked = ranked.withColumn(place, F.col(place) - 1 + F.col(base)).select(*pieces.columns, place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(batch.schema.get_field_index(length_col)).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(batch.schema.get_field_index(place)).to_numpy(zero_copy_only=False)
            at = np.searchsorted(starts, length * (1 << 44) + rank, side="right") - 1
            _, first, sequence, per, offset = runs[at].T
            k = rank - first
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence + k // per), pa.array(offset + k % per * length)], [*batch.schema.names[:-1], "sequence_id", "offset"]
            )

    schema = pieces.select(*pieces.columns).schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Each piece's place: ``<id_col>, piece, start, length, ids_crc32, sequence_id, offset`` and, with ``with_ids``, ``ids``."""
    cut = tokenize_documents(docs, path, capacity, id_col=id_col, text_col=text_col)
    kept = [id_col, "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), *(["ids"] if with_ids else [])]
    return pack(materialize(cut.select(*kept)), capacity, [id_col, "piece", "start", "ids_crc32"])


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
