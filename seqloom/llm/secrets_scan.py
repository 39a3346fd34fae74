"""Secret scans: base patterns and a token-efficiency test.

Ordinary words cost a vocabulary few tokens; random strings cost about one token for each character or two.  The test
takes whole runs of MIN_LENGTH or more characters of the base64 alphabets.  A run that holds a digit and a letter is a
span of kind ``random`` if it has at most MAX_RATIO characters a token under a tiktoken vocabulary, after known digests
(hexadecimal of the lengths of common hashes), UUIDs and identifiers (parts of letters, each with a vowel, joined by
``_ - /`` or a change of case, with a short number at the end of a part) are excluded.  A run of letters without a digit is
one if it has at most LETTER_RATIO characters a token, which words in any language written with these letters exceed.
A run that a base span covers in part is not reported twice.

Defined results: null text is empty and has no spans; offsets are code points, end exclusive; a repeated row repeats its
result; texts of any length are scanned whole; only id and text are read.
"""

from __future__ import annotations

import base64
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import slices, table, texts

KINDS = ["assign", "access", "hex", "random"]
#: Base patterns: fixed values of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A greedy run that fails for its length can not match from a later place in the run either.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
MIN_LENGTH = 20
MAX_RATIO = 2.1
LETTER_RATIO = 1.9
#: Lengths of hexadecimal digests that are known: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGESTS = {32, 40, 56, 64, 96, 128}
LETTER, DIGIT = re.compile(r"[A-Za-z]"), re.compile(r"[0-9]")
HEXADECIMAL = re.compile(r"[0-9a-fA-F]+")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: A part of an identifier without its number: upper case of up to six, or a word that may begin in upper case.
UPPER = re.compile(r"[A-Z]{1,6}")
WORD = re.compile(r"[A-Z]?(?:[AEIOUY][a-z]*|[a-z]+)")
SPLIT = re.compile(r"[_/=+-]+|(?<=[a-z0-9])(?=[A-Z])")
DIGITS = "0123456789"
VOWELS = frozenset("aeiouyAEIOUY")
#: Runs of at most so many characters are remembered.
SHORT = 256


def worded(part: str) -> bool:
    """A part of an identifier: a word with a vowel or a few letters in upper case, and at most four digits after it.
    Takes time in proportion to its length."""
    body = part.rstrip(DIGITS)
    if len(part) - len(body) > 4:
        return False
    return not body or bool(UPPER.fullmatch(body)) or bool(WORD.fullmatch(body)) and not VOWELS.isdisjoint(body)


def known(run: str) -> bool:
    """A digest, a UUID or an identifier."""
    if len(run) in DIGESTS and HEXADECIMAL.fullmatch(run) or UUID.fullmatch(run):
        return True
    return all(map(worded, SPLIT.split(run)))


class Scanner:
    def __init__(self, path: str, pattern: str, ratio: float = MAX_RATIO):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in lines if line.strip())}
        encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

        def random(run: str) -> bool:
            if DIGIT.search(run):
                return not known(run) and len(run) <= ratio * len(encode(run))
            return len(run) <= min(LETTER_RATIO, ratio) * len(encode(run))

        self.random = lru_cache(50_000)(random)

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, place of the kind in KINDS, end), sorted."""
        out = []
        if ":" in text or "=" in text:
            out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        base = deque(sorted(out))
        for m in RUN.finditer(text):
            run = m[0]
            # base spans in the order of their starts: those that end before this run stay behind for good
            while base and base[0][2] <= m.start():
                base.popleft()
            if base and base[0][0] < m.end():
                continue
            if LETTER.search(run) and (self.random if len(run) <= SHORT else self.random.__wrapped__)(run):
                out.append((m.start(), 3, m.end()))
        return sorted(out)


_SCANNERS: dict[tuple[str, str, float], Scanner] = {}


def scanner(path: str, pattern: str, ratio: float) -> Scanner:
    """One scanner a worker process."""
    if (path, pattern, ratio) not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[path, pattern, ratio] = Scanner(path, pattern, ratio)
    return _SCANNERS[path, pattern, ratio]


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
SPANS_SQL = "array<struct<kind: string, start: long, end: long>>"


def scan_secrets(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ratio: float = MAX_RATIO) -> DataFrame:
    """``<id_col>, spans``: kind, start, end of each secret, by start and then kind; one row for each input row."""
    chosen = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(path, pattern, ratio).spans
        for part in slices(batches):
            found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scan(t)] for t in texts(part)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, SPANS)], ["doc", "spans"])

    return chosen.mapInArrow(run, f"doc {chosen.schema['doc'].dataType.simpleString()}, spans {SPANS_SQL}").withColumnRenamed("doc", id_col)


def joined(spans: str, kinds: list[str] | None = None):
    """``kind:start:end`` of a span column, comma-joined; of some kinds only, if given."""
    some = F.col(spans) if kinds is None else F.filter(spans, lambda s: s["kind"].isin(kinds))
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: str, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = scan_secrets(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select(
        "doc_id",
        *[counted("spans", k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined("spans", KINDS[:3]), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )
