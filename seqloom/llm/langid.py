"""Language ID: script ranges narrow the candidates, Viterbi over per-word scores labels spans.

A word is a run of letters.  Its score in a language is the sum of log probabilities of its character trigrams (with
word ends, lower case, hashed into BUCKETS).  Its script leaves as candidates the languages that use this script; a word
of a script that none uses says nothing.  A path over the words pays PENALTY for each switch; the best path gives the
spans, and the language with the most letters is the document's.  A path that never switches is taken without the
search when no language can gain more than one switch costs over any stretch, which proves it the best.

Learning: counts of hashed trigrams and of scripts by language, added up over the cluster into a table of a size that
does not depend on the input.  The rows are a sample by hash, equally many of each language, TRAIN_ROWS expected.

Defined results: ``und`` with score 0 and no spans for a null text, a text without a letter and an empty model; ties go
to the language first in order of name; rows that repeat repeat their results; only id, text and language are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import crc_of_id, slices, table, texts

UNDETERMINED = "und"
BUCKETS = 1 << 15
#: Labelled rows that are expected in the sample, over all languages.
TRAIN_ROWS = 20_000
#: Cost of a switch, in natural logarithms.
PENALTY = 12.0
#: A script is a language's own if so large a share of its letters are of it.
SCRIPT_SHARE = 0.01
#: Log probability that a word is in a language that does not use its script.
FOREIGN = -40.0
CACHE = 300_000
#: The filter rejects documents under this score.
LEAST_SCORE = 0.2
WORDS = re.compile(r"[^\W\d_]+")

#: First code points of blocks and their scripts: fixed values of the Unicode block list.
BLOCKS = [
    (0x0000, "Latin"),
    (0x0370, "Greek"),
    (0x0400, "Cyrillic"),
    (0x0530, "Armenian"),
    (0x0590, "Hebrew"),
    (0x0600, "Arabic"),
    (0x0900, "Devanagari"),
    (0x0980, "Bengali"),
    (0x0A00, "Indic"),
    (0x0E00, "Thai"),
    (0x0E80, "Other"),
    (0x10A0, "Georgian"),
    (0x1100, "Hangul"),
    (0x1200, "Other"),
    (0x1E00, "Latin"),
    (0x1F00, "Greek"),
    (0x2000, "Other"),
    (0x3040, "Kana"),
    (0x3100, "Other"),
    (0x3400, "Han"),
    (0xA000, "Other"),
    (0xAC00, "Hangul"),
    (0xD800, "Other"),
    (0xF900, "Han"),
    (0xFB00, "Other"),
    (0xFF66, "Kana"),
    (0xFFA0, "Other"),
    (0x20000, "Han"),
    (0x30000, "Other"),
]
SCRIPTS = sorted({name for _, name in BLOCKS})
_STARTS = np.array([start for start, _ in BLOCKS])
_SCRIPT = np.array([SCRIPTS.index(name) for _, name in BLOCKS])


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams of lower-cased words, the place where each word's begin, and each word's script."""
    points = np.frombuffer(("\0" + "\0".join(words).lower() + "\0").encode("utf-32-le"), "<u4").astype(np.int64)
    inner = np.flatnonzero(points)
    mixed = points[inner - 1] * 1_000_003 + points[inner] * 8_191 + points[inner + 1] * 131
    begins = np.flatnonzero(points[inner - 1] == 0)
    script = _SCRIPT[np.searchsorted(_STARTS, points[inner[begins]], side="right") - 1]
    return (mixed ^ (mixed >> 15)) % BUCKETS, begins, script


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # BUCKETS x languages, log probabilities
    own: np.ndarray  # scripts x languages, whether the language uses the script

    def scores(self, words: list[str]) -> np.ndarray:
        hashed, begins, script = trigrams(words)
        out = np.add.reduceat(self.weights[hashed], begins, axis=0)
        own = self.own[script]
        known = own.any(1)
        out = np.where(own, out, FOREIGN + out.min(1, keepdims=True))
        out[~known] = 0
        return out - out.max(1, keepdims=True)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams: dict[str, np.ndarray] = {}
    for part in slices(batches):
        langs = part.column(part.schema.get_field_index("lang")).to_pylist()
        by: dict[str, list[str]] = {}
        for lang, text in zip(langs, texts(part)):
            by.setdefault(lang, []).extend(WORDS.findall(text))
        for lang, words in by.items():
            if not words:
                continue
            hashed, begins, script = trigrams(words)
            letters = np.diff(np.append(begins, len(hashed)))
            counts = grams.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS)))
            counts += np.concatenate([np.bincount(hashed, minlength=BUCKETS), np.bincount(script, letters, len(SCRIPTS))])
    for lang, counts in grams.items():
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(counts[some].astype(np.int64))], ["lang", "place", "n"])


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS) -> Model:
    """A model from rows with a language; ``train_rows`` of them are expected in the sample."""
    rows = labelled.filter(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not counts:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((len(SCRIPTS), 0), bool))
    each = train_rows / len(counts)
    rate: Column = F.lit(0)
    for lang, n in counts.items():
        rate = F.when(F.col("lang") == lang, F.lit(int(min(1.0, each / n) * (1 << 30)))).otherwise(rate)
    sample = rows.filter(F.pmod(F.xxhash64("doc", F.lit(9)), F.lit(1 << 30)) < rate)
    found = sample.select("text", "lang").mapInArrow(_count, "lang string, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r["lang"] for r in found})
    table_ = np.zeros((BUCKETS + len(SCRIPTS), len(langs)))
    for r in found:
        table_[r["place"], langs.index(r["lang"])] = r["n"]
    grams, scripts = table_[:BUCKETS], table_[BUCKETS:]
    weights = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * BUCKETS)) if langs else grams
    return Model(langs, weights, scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(0), 1))


def path(scores: np.ndarray, penalty: float = PENALTY) -> np.ndarray | int:
    """The best path over words (rows) and languages (columns): one language, or one for each word."""
    whole = scores.sum(0)
    best = int(whole.argmax())
    gain = np.cumsum(scores - scores[:, best : best + 1], axis=0)
    low = np.minimum.accumulate(np.concatenate([np.zeros((1, gain.shape[1])), gain[:-1]]), axis=0)
    if (gain - low).max() <= penalty:
        return best
    rows, back = scores.tolist(), []
    value = rows[0]
    for row in rows[1:]:
        top = max(value)
        at, least = value.index(top), top - penalty
        back.append([k if v >= least else at for k, v in enumerate(value)])
        value = [(v if v >= least else least) + s for v, s in zip(value, row)]
    now = value.index(max(value))
    out = [now]
    for step in reversed(back):
        now = step[now]
        out.append(now)
    return np.array(out[::-1])


class Labeller:
    """Labels texts; keeps the scores of up to ``cache`` words."""

    def __init__(self, model: Model, penalty: float = PENALTY, cache: int = CACHE):
        self.model, self.penalty, self.limit = model, penalty, cache
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.langs)))
        self.letters = np.zeros(0, np.int64)

    def label(self, texts: list[str]) -> list[tuple[str, float, list[dict]]]:
        if not self.model.langs:
            return [(UNDETERMINED, 0.0, [])] * len(texts)
        parts = [WORDS.findall(t) for t in texts]
        if len(self.known) > self.limit:
            self.known, self.scores, self.letters = {}, self.scores[:0], self.letters[:0]
        new = list({w for part in parts for w in part} - self.known.keys())
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.scores = np.concatenate([self.scores, self.model.scores(new)])
            self.letters = np.concatenate([self.letters, np.fromiter(map(len, new), np.int64, len(new))])
        return [self._one(text, words) for text, words in zip(texts, parts)]

    def _one(self, text: str, words: list[str]) -> tuple[str, float, list[dict]]:
        # a run may be of numerals that are no letters
        if not words or not any(map(str.isalpha, words)) and not any(c.isalpha() for w in words for c in w):
            return UNDETERMINED, 0.0, []
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        scores, letters, langs = self.scores[at], self.letters[at], self.model.langs
        found = path(scores, self.penalty)
        if isinstance(found, int):
            best, share, mine = found, 1.0, scores.sum(0)
            spans = [{"start": text.find(words[0]), "end": text.rfind(words[-1]) + len(words[-1]), "lang": langs[found]}]
        else:
            weight = np.bincount(found, letters, len(langs))
            best = int(weight.argmax())
            share, mine = weight[best] / weight.sum(), scores[found == best].sum(0)
            places = [m.span() for m in WORDS.finditer(text)]
            cuts = [0, *(np.flatnonzero(np.diff(found)) + 1).tolist(), len(found)]
            spans = [{"start": places[a][0], "end": places[b - 1][1], "lang": langs[found[a]]} for a, b in zip(cuts, cuts[1:])]
        margin = mine[best] - np.delete(mine, best).max(initial=mine[best] - 50)
        return langs[best], float(share * (1 - np.exp(-max(margin, 0.0)))), spans


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """``<id_col>, lang_pred, score, spans`` (start, end in code points, lang), a row for each input row."""
    chosen = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = Labeller(shared.value, penalty).label
        for part in slices(batches):
            langs, scores, spans = zip(*label(texts(part)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, SPANS)], ["doc", "lang_pred", "score", "spans"])

    kind = chosen.schema["doc"].dataType.simpleString()
    schema = f"doc {kind}, lang_pred string, score double, spans array<struct<start: long, end: long, lang: string>>"
    return chosen.mapInArrow(run, schema).withColumnRenamed("doc", id_col)


def keep_known(docs: DataFrame, model: Model, text_col: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The input without documents whose language is undetermined or scores under ``least``; columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = Labeller(shared.value).label
        for part in slices(batches, text_col):
            rows = [x or "" for x in part.column(at).to_pylist()]
            yield part.filter(pa.array([lang != UNDETERMINED and score >= least for lang, score, _ in label(rows)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    return crc_of_id(id_col) % 4 == 2


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs.filter(~held_out())))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", F.to_json("spans").alias("spans"))
