"""Byte-level BPE over a rank file: each merge is a logarithmic update of a segment tree of pair ranks.

The text is split by a pattern; each match is encoded on its own.  A tree over the byte positions of a match stores
the leftmost minimum of the ranks of live neighbours.  The root gives the next merge; the merge changes the leaf of
the position itself, of the one before it and of the one that is swallowed, and each change walks to the root.
Matches of up to 32 bytes that a worker has not met are encoded together, one numpy operation over all their trees;
longer ones one by one.  A bounded cache keeps the ids of matches.

Defined results: null text is empty and has no ids; a repeated row gives a repeated result; ids of texts of any length
are whole.  Only the id and text columns of the input are read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import slices, table, texts

#: No rank: larger than any rank, so that leftmost minimum passes over it.
NONE = np.int64(1) << 40
CACHE = 400_000
SHORT = 32


class Ranks:
    """A vocabulary of ranked byte strings and the ranks of the pairs that merge into them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.words = [b""] * self.size
        for word, rank in ranks.items():
            self.words[rank] = word
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs: dict[int, int] = {}
        for word, rank in ranks.items():
            for cut in range(1, len(word)):
                left, right = ranks.get(word[:cut]), ranks.get(word[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    @classmethod
    def read(cls, path: str) -> Ranks:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(word): int(rank) for word, rank in (line.split() for line in lines if line.strip())})

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, NONE where a side is negative or the pair does not merge."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.merged[at], NONE)

    def encode_one(self, word: bytes) -> list[int]:
        """Ids of one match, of any length."""
        n = len(word)
        ids = self.bytes[np.frombuffer(word, np.uint8)].tolist()
        if n < 2:
            return ids
        pairs, size, none = self.pairs, self.size, int(NONE)
        width = 1 << (n - 1).bit_length()
        # A node holds rank * width + position: the minimum is the leftmost of the least ranks.
        tree = [none * width] * (2 * width)
        for i in range(n - 1):
            tree[width + i] = pairs.get(ids[i] * size + ids[i + 1], none) * width + i
        for node in range(width - 1, 0, -1):
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a <= b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(at: int, rank: int) -> None:
            node, value = width + at, rank * width + at
            tree[node] = value
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                least = a if a <= b else b
                if tree[node] == least:
                    break
                tree[node] = least
                node >>= 1

        while tree[1] < none * width:
            rank, at = divmod(tree[1], width)
            gone = after[at]
            ids[at], ids[gone] = rank, -1
            after[at] = following = after[gone]
            put(gone, none)
            if following < n:
                before[following] = at
                put(at, pairs.get(rank * size + ids[following], none))
            else:
                put(at, none)
            if (left := before[at]) >= 0:
                put(left, pairs.get(ids[left] * size + rank, none))
        return [x for x in ids if x >= 0]

    def encode_many(self, words: list[bytes]) -> list[bytes]:
        """Ids of short matches, packed as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for low, width in ((0, 8), (8, 16), (16, SHORT)):
            which = np.flatnonzero((lengths > low) & (lengths <= width))
            for start in range(0, len(which), 65536):
                some = which[start : start + 65536]
                for i, packed in zip(some.tolist(), self._together([words[i] for i in some.tolist()], lengths[some], width)):
                    out[i] = packed
        for i in np.flatnonzero(lengths > SHORT).tolist():
            out[i] = np.array(self.encode_one(words[i]), "<u4").tobytes()
        return out

    def _together(self, words: list[bytes], lengths: np.ndarray, width: int) -> list[bytes]:
        n = len(words)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        ids = np.where(np.arange(width) < lengths[:, None], self.bytes[raw], -1)
        after = np.broadcast_to(np.arange(1, width + 1), (n, width)).copy()
        before = np.broadcast_to(np.arange(-1, width - 1), (n, width)).copy()
        # One more column than a tree needs, so that "no neighbour" has a leaf of its own to be written to.
        ids = np.concatenate([ids, np.full((n, 1), -1)], 1)
        tree = np.full((n, 2 * width), NONE * width)
        place = np.arange(width)
        tree[:, width:-1] = self.rank_of(ids[:, : width - 1], ids[:, 1:width]) * width + place[:-1]
        node = width >> 1
        while node:
            tree[:, node : 2 * node] = np.minimum(tree[:, 2 * node : 4 * node : 2], tree[:, 2 * node + 1 : 4 * node : 2])
            node >>= 1

        def put(rows: np.ndarray, at: np.ndarray, rank: np.ndarray) -> None:
            node = width + at
            tree[rows, node] = rank * width + at
            node = node >> 1
            while node[0]:
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                node = node >> 1

        rows = np.flatnonzero(tree[:, 1] < NONE * width)
        while rows.size:
            rank, at = tree[rows, 1] // width, tree[rows, 1] % width
            gone = after[rows, at]
            following = after[rows, gone]
            ids[rows, at], ids[rows, gone] = rank, -1
            after[rows, at] = following
            put(rows, gone, np.full(rows.size, NONE))
            put(rows, at, self.rank_of(rank, ids[rows, np.minimum(following, width)]))
            inner = following < width
            before[rows[inner], following[inner]] = at[inner]
            left = before[rows, at]
            has = left >= 0
            if has.any():
                put(rows[has], left[has], self.rank_of(ids[rows[has], left[has]], rank[has]))
            rows = rows[tree[rows, 1] < NONE * width]
        ids = ids[:, :width]
        live = ids >= 0
        flat = ids[live].astype("<u4").tobytes()
        ends = (np.cumsum(live.sum(1)) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends)]


class Codec:
    """Encodes and decodes texts; keeps the packed ids of up to ``cache`` matches."""

    def __init__(self, ranks: Ranks, pattern: str, cache: int = CACHE):
        import regex

        self.ranks, self.limit, self.known = ranks, cache, {}
        self.split = regex.compile(pattern).findall

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [self.split(t) for t in texts]
        known = self.known
        if len(known) > self.limit:
            known.clear()
        new = list({p for part in parts for p in part} - known.keys())
        # surrogates can not occur in UTF-8 columns
        known.update(zip(new, self.ranks.encode_many([p.encode() for p in new])))
        return [b"".join(map(known.__getitem__, part)) for part in parts]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.ranks.words.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec a worker process."""
    if (path, pattern) not in _CODECS:
        _CODECS.clear()
        _CODECS[path, pattern] = Codec(Ranks.read(path), pattern)
    return _CODECS[path, pattern]


def bpe_encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """``<id_col>, n_tokens, ids`` (binary, little-endian unsigned 32-bit) and, with ``decode``, ``decoded`` (binary).

    ``path``: a rank file that every executor has at this place.
    """
    chosen = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = codec(path, pattern)
        for part in slices(batches):
            ids = both.encode(texts(part))
            columns = [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            names = ["doc", "n_tokens", "ids"]
            if decode:
                columns.append(pa.array(map(both.decode, ids), pa.binary()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = chosen.schema["doc"].dataType.simpleString()
    schema = f"doc {kind}, n_tokens long, ids binary" + ", decoded binary" * decode
    return chosen.mapInArrow(run, schema).withColumnRenamed("doc", id_col)


def bpe_decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded`` (binary) to a frame with packed ids, in place of a column of that name; null ids give null."""
    name = ids_col

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = codec(path, pattern)
        for batch in batches:
            at = batch.schema.get_field_index(name)
            decoded = [None if x is None else both.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], [*batch.schema.names, "decoded"])

    schema = encoded.drop("decoded").schema.add("decoded", "binary")
    return encoded.drop("decoded").mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    out = bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decode=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
