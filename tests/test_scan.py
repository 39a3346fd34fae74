import itertools
import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from seqloom.operators import classify, pml, scan
from seqloom.plans.engine import Engine, Index
from seqloom.session import materialize

LETTERS = "ACGT"


@pytest.fixture(scope="module")
def case(spark):
    """References with copies, other characters and none; reads with long parts of them, short ones and none."""
    rng = random.Random(3)
    draw = lambda n, of=LETTERS: "".join(rng.choice(of) for _ in range(n))
    refs = [draw(120) for _ in range(5)] + [draw(60, "AC")] * 3 + ["", "ACGNNACGTTN#ACGTAC", draw(9), "A" * 50]
    reads = [refs[0][10:90] + draw(8), brute.rc(refs[1])[5:70], refs[5][:40] + refs[2][3:60], draw(30), "G", "", "A" * 60, refs[10] + draw(3)]
    make = lambda rows, name: materialize(spark.createDataFrame(list(enumerate(rows)), f"{name} long, seq string"))
    segments = [s for r in refs for s in (r, brute.rc("".join(c if c in "ACGT#" else "T" for c in r)))]
    return make(refs, "doc_id"), make(reads, "read_id"), segments, dict(enumerate(reads))


def no_join(*_):
    raise AssertionError("references were joined")


def lengths(frame, reads):
    out = {i: [0] * len(s) for i, s in reads.items()}
    for r in frame.collect():
        out[r["read_id"]][r["pos"]] = r["len"]
    return out


def test_lengths_need_no_join_of_references(case, monkeypatch):
    refs, reads, segments, texts = case
    engine = Engine(Index(refs), 4)
    for name in ("islands", "short_words"):
        monkeypatch.setattr(f"seqloom.operators.matches.{name}", no_join)
    assert lengths(engine.ms(reads), texts) == {i: brute.ms(s, segments) for i, s in texts.items()}
    assert lengths(engine.zml(reads), texts) == {i: brute.zml(s, segments) for i, s in texts.items()}


def test_counts_need_no_join_of_references(case, monkeypatch):
    refs, reads, segments, texts = case
    engine = Engine(Index(refs), 4)
    monkeypatch.setattr("seqloom.operators.matches.islands", no_join)
    monkeypatch.setattr(Index, "kmers", no_join)
    for r in engine.count(reads).collect():
        text = texts[r["read_id"]]
        matched = brute.left(text, segments)[-1] if text else 0
        assert (r["matched"], r["total"], r["occurrences"]) == (matched, len(text), brute.occurrences(text[len(text) - matched :], segments) if matched else 0)
    want = sorted((i, *m) for i, s in texts.items() for m in brute.mems(s, segments, 12))
    assert sorted(tuple(r) for r in engine.mem(reads, 12).select("read_id", "s", "e", "cnt").collect()) == want
    for k in (3, 12, 31):
        cuts = {i: [s[p : p + k] for p in range(len(s) - k + 1)] for i, s in texts.items()}
        for r in engine.kmer_count(reads, k).collect():
            each = [n for w in cuts[r["read_id"]] if (n := brute.occurrences(w, segments))]
            assert (r["found"], r["occurrences"]) == (len(each), sum(each))
        for r in engine.kmer_membership(reads, k).collect():
            assert (r["found"], r["total"]) == (sum(brute.inside(w, segments) for w in cuts[r["read_id"]]), len(cuts[r["read_id"]]))


def test_many_reads_are_joined(case, monkeypatch):
    """Beyond the bound nothing is left out: results are those of the scan."""
    refs, reads, _, _ = case
    rows = lambda frame: sorted(map(tuple, frame.collect()))
    asked = lambda engine: [rows(f) for f in (engine.ms(reads), engine.count(reads), engine.mem(reads, 12), engine.kmer_count(reads, 6), engine.species_spans(reads, 12).select("read_id", "species", "s", "e", "n"))]
    few = asked(Engine(Index(refs), 4))
    monkeypatch.setattr(scan, "MOST_BASES", 5)
    assert asked(Engine(Index(refs), 4)) == few


def test_small_pieces_give_the_same(case, monkeypatch):
    refs, reads, segments, _ = case
    held = scan.collected(reads)
    whole = sorted(map(tuple, scan.spans(held, refs, 12).collect()))
    seeds, some = scan._Seeds.of(held, 12), []
    monkeypatch.setattr(scan, "TOGETHER", 1)
    monkeypatch.setattr(scan, "PAIRS", 1)
    for batch in refs.select("seq").toArrow().to_batches():
        for piece in scan._pieces(batch, True):
            some += [(a, b) for s, e, _ in seeds.islands(piece) for a, b in zip(s.tolist(), e.tolist())]
    assert len(some) == sum(r[3] for r in whole) > 0


def test_all_counts(case):
    refs, _, segments, _ = case
    got = {r["kmer"]: r["cnt"] for r in scan.all_counts(refs, 4).collect()}
    words = {"".join(w) for w in itertools.product(LETTERS, repeat=4)}
    assert got == {w: n for w in words if (n := brute.occurrences(w, segments))}


def test_bases_are_cut_once(case):
    """F4 to F10, F18 to F21: references of bases alone are cut for one strand, and few of their places are looked up among codes."""
    refs, reads, segments, texts = case
    batch = pa.RecordBatch.from_arrays([pa.array(["ACGTACC", None, "", "GGT"])], ["seq"])
    assert [(len(p.code), p.both) for p in scan._pieces(batch, True, once=True)] == [(10, True)]
    assert [p.both for p in scan._pieces(pa.RecordBatch.from_arrays([pa.array(["ACGN", "é"])], ["seq"]), True, once=True)] == [False, False]
    rng = np.random.default_rng(1)
    long = "".join(rng.choice(list(LETTERS), 200_000))
    held, looked = scan.collected(reads), []
    side = scan._Reached.of(held.both())
    piece = next(scan._pieces(pa.RecordBatch.from_arrays([pa.array([long])], ["seq"]), True, once=True))
    found = side.begun()
    common = scan.common
    scan.common = lambda a, b: looked.append(len(a)) or common(a, b)
    try:
        side.add(piece, found)
    finally:
        scan.common = common
    assert sum(looked) < len(long) / 100
    spans = {(s, e) for s, e in zip(*held.forward(*side.spans(found)))}
    ids = held.ids.to_pylist()
    whole, starts = "".join(texts[i] for i in ids), dict(zip(ids, held.starts.tolist()))
    assert all(whole[s:e] in long or brute.rc(whole[s:e]) in long for s, e in spans)
    for i, text in texts.items():
        want = brute.ms(text, [long, brute.rc(long)])
        assert want == [max((e - starts[i] - p for s, e in spans if s <= p + starts[i] < e), default=0) for p in range(len(text))]


def test_other_strand_of_codes():
    rng = random.Random(5)
    for k in (1, 7, 31):
        words = ["".join(rng.choice(LETTERS) for _ in range(k)) for _ in range(20)]
        code = lambda w: scan.codes(scan._CODE[np.frombuffer(w.encode(), np.uint8)])[:1] >> (2 * (scan.WIDTH - k))
        assert [int(scan.turned(code(w), k)[0]) for w in words] == [int(code(brute.rc(w))[0]) for w in words]


def test_walks_hold_a_slice(monkeypatch):
    """A batch is walked in parts of bounded bases, all of its reads once and in order."""
    monkeypatch.setattr(pml, "SLICE", 10)
    texts = ["ACGT", "", None, "ACGTA", "C", "A" * 30, "GG"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["read_id", "seq"])
    parts = list(pml._parts(batch))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(texts)))
    assert all(p.num_rows == 1 or sum(len(s or "") for s in p.column(1).to_pylist()) <= 10 for p in parts) and len(parts) == 3


def test_votes_are_added_up_in_the_walk(case, spark, monkeypatch):
    """no row a base is made for votes and colors; results are those of joins of bases."""
    from pyspark.sql import functions as F

    from seqloom.operators import colors

    refs, reads, _, _ = case
    reads = reads.unionByName(spark.createDataFrame([(100, None)], "read_id long, seq string"))
    engine = Engine(Index(refs))
    each = materialize(engine.pml(reads, runs=True)).select("read_id", F.size("lens").alias("m"), F.posexplode(F.arrays_zip("lens", "runs")).alias("pos", "x"))
    each = each.select("read_id", "pos", (F.col("m") - F.col("pos")).alias("step"), F.col("x.lens").alias("len"), F.col("x.runs").alias("run"))
    rows = lambda frame: sorted(tuple(str(r[c]) for c in sorted(frame.columns)) for r in frame.collect())
    found = colors.votes(each, engine.index.documents, 1)
    taxa = engine.index.species.select("species", F.col("taxon").alias("named")).distinct()
    wide = found.join(taxa, "species").drop("species").withColumnRenamed("named", "species")
    means = reads.select("read_id").join(each.groupBy("read_id").agg(F.avg("len").alias("mean")), "read_id", "left").fillna(0.0)
    want = rows(wide), rows(classify.classes(classify.best_two(wide), means))
    color = each.join(engine.index.colors[0], "run", "left").select("read_id", "pos", F.when(F.col("len") >= 1, F.coalesce("color_id", F.lit(-1))).otherwise(-1).alias("color_id"))
    want_colors = rows(color)

    monkeypatch.setattr(colors, "votes", no_join)
    monkeypatch.setattr(Engine, "pml", no_join)
    assert rows(engine._votes(reads, 1, False, False)[0]) == want[0]
    assert rows(engine.multi_class(reads)) == want[1]
    assert rows(engine.report_colors(reads)) == want_colors
    lens, runs = [np.array([1, 0, 3]), np.zeros(0, int), np.array([2])], [np.array([1, 0, 1]), np.zeros(0, int), np.array([2])]
    starts, species = np.array([0, 1, 3, 4]), np.array([5, 0, 2, 2])
    monkeypatch.setattr(pml, "SPREAD", 1)
    assert [x.tolist() for x in pml._voted(lens, runs, starts, species, 1)] == [[0, 0, 2], [0, 2, 2], [2, 2, 1], [3, 3, 1]]


def test_early_stop_adds_each_length_once(spark):
    rng = np.random.default_rng(2)
    lens = {i: (rng.random(n) < share).astype(int).tolist() for i, (n, share) in enumerate([(0, 0), (99, 0.1), (100, 0.1), (1234, 0.4), (1299, 0.39), (900, 0.9), (60_000, 0.4004)])}
    want = {}
    for i, each in lens.items():
        n = len(each)
        failed = [t for t in range(100, n + 1, 100) if 2 * t > n and sum(each[n - t :]) / t < classify.UNCLASSIFIED_MEAN]
        want[i] = min(failed, default=n)
    frame = classify.early_stop(spark.createDataFrame(list(lens.items()), "read_id long, lens array<int>"))
    assert {r["read_id"]: r["used"] for r in frame.collect()} == want
    assert "+ 1), 100)" in frame._jdf.queryExecution().optimizedPlan().toString()  # slices have one size, not that of the share
