"""Toxicity: a linear-chain conditional random field tags toxic tokens; its marginals score documents.

Labelled tokens come from labelled documents: words whose share of toxic documents is beyond chance (log likelihood
ratio over document counts, GAIN at least) are the lexicon, and so are beginnings of words, which inflected forms share,
and beginnings that REPEATS words of a document have, as those that are frequent by chance seldom come again.  In toxic
documents the tokens that the lexicon marks are labelled toxic, in others clean.
The field is trained on whole documents.  A token's features are its entries in the lexicon and its form (beginning, end
and length, which words outside the lexicon have too); those of its neighbours count as well.  A document is one
chain: forward-backward gives each of its tokens a probability; a document's score is a logistic function of its highest
probability and its expected number of toxic tokens, also per word, fitted on the labelled documents.

Learning reads a sample by hash of at most about TRAIN_ROWS labelled documents, half of them toxic if there are as many,
for the lexicon and the scores, and of about FIELD_ROWS of these for the field; nothing else is bounded.  Document counts of
words are added up over the cluster; only the lexicon reaches the driver.

Defined results: null text is empty text and scores like a document without toxic tokens; without any toxic label every
score is 0; labels of a repeated doc_id count once (toxic if any says so), null labels do not count; rows that repeat
repeat their results; only id and text are read, besides the labels while learning.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm import crf
from seqloom.llm.common import crc_of_id, slices, table, texts
from seqloom.session import materialize, release

#: Labelled documents that are expected in the sample, and those of them that train the field.
TRAIN_ROWS = 16_000
FIELD_ROWS = 1_000
STEPS = 60
#: Least log likelihood ratio (natural logarithm) of a lexicon word, and least number of toxic documents with it.
GAIN = 12.0
LEAST = 4
#: Lengths of beginnings of words that can be in the lexicon, written with a star, or two if it takes REPEATS of them.
STARTS = (4, 5, 6, 7)
REPEATS = 3
#: Words whose features a worker remembers.
CACHE = 400_000
#: Stands for a word that is not remembered.
NEW = -(1 << 62)
THRESHOLD = 0.7
#: A token is an offence from this probability on.
OFFENCE = 0.5
#: And counts towards the expected number of toxic tokens from this one on.
LEAST_PART = 0.1
WORDS = re.compile(r"[^\W\d_]+")
LABELS = ["clean", "toxic"]


def lowered(text: str) -> list[str]:
    """Lower-cased words; as many as the text has, also where lower case is longer."""
    low = text.lower()
    return WORDS.findall(low) if len(low) == len(text) else [w.lower() for w in WORDS.findall(text)]


@dataclass
class Model:
    field: crf.Crf | None
    lexicon: frozenset[str]
    weights: np.ndarray  # of Scorer.inputs()
    rate: float  # score of every document where there is no field


def starts(word: str) -> list[str]:
    return [word[:n] for n in STARTS if len(word) >= n]


def entries(words: list[str]) -> set[str]:
    """The entries that a lexicon can have for a document."""
    often = Counter(p for w in words for p in starts(w))
    return {*words, *(p + "*" for p in often), *(p + "**" for p, n in often.items() if n >= REPEATS)}


def form(word: str) -> str:
    """Beginning, end and length of a word, joined by blanks."""
    return f"{word[:3]}- -{word[-3:]} {min(len(word), 12)}"


def _features(token: str) -> list[str]:
    """Of a token given as its form and its entries, joined by blanks."""
    begin, end, size, *found = token.split(" ")
    return [f"begin {begin}", f"end {end}", f"size {size}", *(f"entry {e}" for e in found if e)]


class Scorer:
    """Scores texts; keeps the features of up to CACHE words."""

    def __init__(self, model: Model):
        self.model = model
        self.begins = {e.rstrip("*") for e in model.lexicon if e.endswith("*")}
        self.known: dict[str, int] = {}  # a class, or -1 - place of a word whose entries depend on the document
        self.repeating: list[tuple[str, str, list[str]]] = []
        self.classes: dict[str, int] = {}
        self.pending: list[str] = []  # classes that the table does not have yet
        self.table = [np.zeros((0, len(LABELS)))] * 3
        self.size = 0

    def place(self, token: str) -> int:
        """The class of a token by its form and entries; tokens with the same known features are one class."""
        found = self.classes.get(token)
        if found is None:
            found = self.classes[token] = len(self.classes)
            self.pending.append(token)
        return found

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What tokens of each class add to their own scores, to those of the token after and of the token before."""
        if self.pending and self.model.field:
            field = self.model.field
            ids = [[field.index[f] for f in _features(t) if f in field.index] for t in self.pending]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            owner, flat = np.repeat(np.arange(len(ids)), sizes), np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum()))
            for k, weights in enumerate((field.own, field.prev, field.next)):
                new = np.stack([np.bincount(owner, weights[flat, c], len(ids)) for c in range(weights.shape[1])], 1)
                if self.size + len(new) > len(self.table[k]):
                    self.table[k] = np.concatenate([self.table[k][: self.size], new, np.zeros((len(new) + self.size, new.shape[1]))])
                self.table[k][self.size : self.size + len(new)] = new
            self.size += len(ids)
            self.pending = []
        return tuple(self.table)

    def _learn(self, words: set[str]) -> None:
        for word in words:
            begins = [p for p in starts(word) if p in self.begins]
            found = [word] if word in self.model.lexicon else []
            found += [p + "*" for p in begins if p + "*" in self.model.lexicon]
            once = " ".join([form(word), *found])
            often = [p for p in begins if p + "**" in self.model.lexicon]
            if often:
                self.known[word] = -1 - len(self.repeating)
                self.repeating.append((word, once, often))
            else:
                self.known[word] = self.place(once)

    def marked(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Classes of all words of the texts, one text after another, and how many each text has."""
        split = [lowered(t) for t in texts]
        lengths = np.array([len(x) for x in split], np.int64)
        words = list(chain.from_iterable(split))
        if len(self.known) > CACHE:
            self.known.clear()
            self.repeating.clear()
            self.classes.clear()
            self.pending.clear()
            self.size = 0
        flat = np.fromiter(map(self.known.get, words, repeat(NEW)), np.int64, len(words))
        new = np.flatnonzero(flat == NEW).tolist()
        if new:
            some = [words[k] for k in new]
            self._learn(set(some))
            flat[new] = list(map(self.known.__getitem__, some))
        ends = np.cumsum(lengths)
        at = np.flatnonzero(flat < 0)
        owner = np.searchsorted(ends, at, side="right")
        for i in np.unique(owner).tolist():  # texts with words whose beginnings may repeat
            some = at[owner == i]
            found = [self.repeating[-1 - k] for k in flat[some].tolist()]
            # every word of the text that has the beginning counts, as often as it is there
            count = Counter(p for _, _, often in found for p in often)
            flat[some] = [self.place(" ".join([once, *(p + "**" for p in often if count[p] >= REPEATS)])) for _, once, often in found]
        return flat, lengths

    def tokens(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """The probability of toxic of each word of each text; the texts' words."""
        if not self.model.field:
            return [np.zeros(0)] * len(texts), np.zeros(len(texts), np.int64)
        flat, lengths = self.marked(texts)
        if not len(flat):
            return [np.zeros(0)] * len(texts), lengths
        own, prev, next_ = self.rows()
        live = lengths > 0
        scores = self.model.field.emissions(own[flat], prev[flat], next_[flat], lengths[live])
        found = self.model.field.marginals(scores, lengths[live])[:, 1]
        return np.split(found, np.cumsum(lengths)[:-1]), lengths

    @staticmethod
    def inputs(tokens: np.ndarray, size: int) -> list[float]:
        total = float(tokens[tokens >= LEAST_PART].sum())
        return [1.0, float(tokens.max(initial=0.0)), float(np.log1p(total)), float(np.log1p(1000 * total / max(size, 1)))]

    def score(self, tokens: np.ndarray, size: int) -> float:
        if not self.model.field:
            return self.model.rate
        return float(1 / (1 + np.exp(-np.clip(self.model.weights @ self.inputs(tokens, size), -30, 30))))

    def offences(self, text: str, tokens: np.ndarray) -> list[dict]:
        worst = {k: float(tokens[k]) for k in np.flatnonzero(tokens >= OFFENCE).tolist()}
        if not worst:
            return []
        return [{"start": m.start(), "end": m.end(), "probability": worst[k]} for k, m in enumerate(WORDS.finditer(text)) if k in worst]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    weights = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (y - p) - ridge * weights
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(curve, slope)
        weights += step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS, field_rows: int = FIELD_ROWS) -> Model:
    """A model from documents and labels (``id_col``, ``label_col`` 0 or 1); ``train_rows`` and
    ``field_rows`` bound the expected samples of labelled rows."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("doc")).agg((F.max(label_col) > 0).alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts.get(True):
        return Model(None, frozenset(), np.zeros(4), 0.0)
    half = train_rows / 2
    rate = {t: min(1.0, (half if t else train_rows - min(half, counts[True])) / n) for t, n in counts.items()}
    part = F.when(F.col("toxic"), F.lit(int(rate[True] * (1 << 30)))).otherwise(F.lit(int(rate.get(False, 0) * (1 << 30))))
    # of distinct ids, so its expected size is bounded by train_rows
    sample = known.filter(F.pmod(F.xxhash64("doc", F.lit(7)), F.lit(1 << 30)) < part)
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "doc").dropDuplicates(["doc"])
    rows = materialize(rows.select("text", "toxic"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bool, Counter] = {True: Counter(), False: Counter()}
        for batch in slices(batches):
            for text, toxic in zip(texts(batch), batch.column(1).to_pylist()):
                seen[toxic].update(entries(lowered(text)))
        for toxic, words in seen.items():
            names = list(words)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([words[w] * toxic for w in names], pa.int64()), pa.array([words[w] * (not toxic) for w in names], pa.int64())], ["word", "bad", "good"])

    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not size.get(True):
        return Model(None, frozenset(), np.zeros(4), 0.0)
    prior = size[True] / sum(size.values())
    share = F.col("bad") / (F.col("bad") + F.col("good"))
    # of a word that no clean document has, the second term is zero
    gain = F.col("bad") * F.log(share / prior) + F.when(F.col("good") > 0, F.col("good") * F.log((1 - share) / max(1 - prior, 1e-9))).otherwise(0.0)
    words = rows.mapInArrow(count, "word string, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    words = words.filter((F.col("bad") >= LEAST) & (share > max(0.5, 1.5 * prior))).withColumn("gain", gain).filter(F.col("gain") >= GAIN)
    lexicon = frozenset(r["word"] for r in words.select("word").collect())
    if not lexicon:
        return Model(None, frozenset(), np.zeros(4), prior)

    # whole documents of a part of the sample, half of them toxic if there are as many
    bad = min(field_rows / 2, size[True])
    share = {True: bad / size[True], False: min(1.0, (field_rows - bad) / max(size.get(False, 0), 1))}
    part = F.when(F.col("toxic"), F.lit(int(share[True] * (1 << 30)))).otherwise(F.lit(int(share[False] * (1 << 30))))
    some = rows.filter(F.pmod(F.xxhash64("text", F.lit(3)), F.lit(1 << 30)) < part).select("text", "toxic").collect()
    draft = Scorer(Model(None, lexicon, np.zeros(4), 0.0))
    flat, lengths = draft.marked([r["text"] or "" for r in some])
    names = list(draft.classes)
    listed = [len(t.split(" ")) > 3 for t in names]
    chains = [[(names[k], "toxic" if r["toxic"] and listed[k] else "clean") for k in ids.tolist()] for r, ids in zip(some, np.split(flat, np.cumsum(lengths)[:-1])) if len(ids)]
    if not chains:
        return Model(None, frozenset(), np.zeros(4), prior)
    field = crf.fit(chains, _features, LABELS, steps=STEPS)
    shared = rows.sparkSession.sparkContext.broadcast(Model(field, lexicon, np.zeros(4), prior))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in slices(batches):
            inputs = [scorer.inputs(t, n) for t, n in zip(*scorer.tokens(texts(batch)))]
            yield pa.RecordBatch.from_arrays([pa.array(inputs, pa.list_(pa.float64())), batch.column(1)], ["inputs", "toxic"])

    points = rows.mapInArrow(measure, "inputs array<double>, toxic boolean").collect()
    weights = _logistic(np.array([r[0] for r in points]), np.array([float(r[1]) for r in points]))
    release(rows)
    return Model(field, lexicon, weights, prior)


OFFENCES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, score, offences`` (start, end in code points, probability), one row for each input row."""
    chosen = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as the sample of labelled rows makes it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for part in slices(batches):
            rows = texts(part)
            tokens, size = scorer.tokens(rows)
            scores = pa.array(map(scorer.score, tokens, size), pa.float64())
            yield pa.RecordBatch.from_arrays([part.column(0), scores, pa.array(map(scorer.offences, rows, tokens), OFFENCES)], ["doc", "score", "offences"])

    schema = f"doc {chosen.schema['doc'].dataType.simpleString()}, score double, offences array<struct<start: long, end: long, probability: double>>"
    return chosen.mapInArrow(run, schema).withColumnRenamed("doc", id_col)


def held_out(id_col: str = "doc_id") -> Column:
    return crc_of_id(id_col) % 3 == 1


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = score_toxicity(docs, fit(docs, labels.filter(~held_out())))
    return found.select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.to_json("offences").alias("offences"),
    )
