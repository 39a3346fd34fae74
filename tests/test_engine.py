import random

import brute
import pytest
from pyspark.sql import functions as F

from seqloom.functions import sequence as S
from seqloom.operators import bwt, classify, colors, corpus, kmers, matches, order, pml, taxonomy
from seqloom.plans.engine import Engine, Index
from seqloom.session import materialize

K = 4
REFS = ["ACGTACGTTGCAACGGTACCA", "GGGGATTACAGATTACAGG", "", "AC", "ACGTACGTTGCAACGGTACCA"]
READS = ["GATTACA", "ACGTACGTTGCAACGGTACCA", "NNNN", "", "A", "TTTNACGTAC", "CCATTGACGTTTACCGGTAAACNACGG", "acgt%ACGT", "GGGGATTACAGATTACAGGT"]
SEGMENTS = [x for s in REFS for x in (s, brute.rc(s))]
TEXT = "".join(f"{s}%{brute.rc(s)}%" for s in REFS) + "$"


@pytest.fixture(scope="module")
def engine(spark):
    rows = [(i, s) for i, s in enumerate(REFS)]
    return Engine(Index(materialize(spark.createDataFrame(rows, "doc_id long, seq string"))), K)


@pytest.fixture(scope="module")
def reads(spark):
    return materialize(spark.createDataFrame([(i, s) for i, s in enumerate(READS)], "read_id long, seq string"))


def by_read(rows, value="len"):
    out = {i: [] for i in range(len(READS))}
    for r in sorted(rows, key=lambda r: (r["read_id"], r["pos"])):
        out[r["read_id"]].append(r[value])
    return out


def test_sequence_functions(spark):
    rows = [("acgTNx",), ("",), ("ACGT#",)]
    df = spark.createDataFrame(rows, "s string")
    got = df.select(S.clean(F.col("s")).alias("a"), S.clean(F.col("s"), "A").alias("b"), S.revcomp(F.col("s")).alias("c")).collect()
    assert [tuple(r) for r in got] == [("ACGTAA", "AAATAA", "AAAAAA"), ("", "", ""), ("ACGTA", "ACGTA", "#ACGT")]
    coded = spark.createDataFrame([("ACGT",), ("AAAA",), ("TTTT",), ("ACGN",)], "k string").select("k", S.kmer_code(F.col("k")).alias("n"))
    assert [r["n"] for r in coded.collect()] == [27, 0, 255, None]
    assert [r[0] for r in coded.filter("n is not null").select(S.kmer_decode(F.col("n"), 4)).collect()] == ["ACGT", "AAAA", "TTTT"]
    legal = df.select(S.legal(F.col("s"), 1).alias("one"), S.legal(F.col("s"), 2, 7).alias("two")).collect()
    assert legal[0]["one"] == "AAATAA" and set(legal[0]["two"]) <= set("ACGT") and len(legal[0]["two"]) == 6
    assert spark.createDataFrame([("Abc, é!",), (None,)], "t string").select(S.fold(F.col("t"))).collect()[1][0] == ""


def test_ranks_and_sums(spark):
    rows = [(i, random.Random(i).randint(0, 30)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v long")
    got = {r["id"]: r["s"] for r in order.running_sum(df, ["id"], "v", "s").collect()}
    total, want = 0, {}
    for i, v in rows:
        total += v
        want[i] = total
    assert got == want
    values = sorted(v for _, v in rows)
    assert all(r["r"] == values.index(r["v"]) for r in order.global_rank(df, ["v"], "r").collect())
    assert sorted(r["r"] for r in order.global_rank(df, ["v"], "r", unique=True).collect()) == list(range(500))
    assert order.running_sum(df.limit(0), ["id"], "v", "s").collect() == []


def test_positions_across_pieces(spark):
    seq = "".join(random.Random(1).choice("ACGT") for _ in range(2 * corpus.PIECE + 37))
    df = spark.createDataFrame([(0, seq), (1, "AC"), (2, "")], "doc_id long, seq string")
    got = {r["pos"]: r["kmer"] for r in corpus.positions(df, 5, ["doc_id"]).collect()}
    assert got == {i: seq[i : i + 5] for i in range(len(seq) - 4)}


def test_offsets(engine):
    want, total = {}, 0
    for i, s in enumerate(REFS):
        total += 2 * len(s) + 2
        want[i] = total
    assert {r["doc_id"]: r["end_off"] for r in corpus.doc_offsets(engine.index.refs).collect()} == want


def test_kmers(engine, reads):
    table = {r["kmer"]: r["cnt"] for r in engine.index.kmers(K).collect()}
    assert table == {w: brute.occurrences(w, SEGMENTS) for w in {s[i : i + K] for s in SEGMENTS for i in range(len(s) - K + 1)}}
    got = {r["read_id"]: (r["found"], r["total"]) for r in kmers.membership(reads, engine.index.kmers(K), K).collect()}
    words = lambda s: [s[i : i + K] for i in range(len(s) - K + 1)]
    assert got == {i: (sum(w in table for w in words(s)), len(words(s))) for i, s in enumerate(READS)}
    sums = {r["read_id"]: (r["found"], r["occurrences"]) for r in engine.kmer_count(reads, K).collect()}
    assert sums == {i: (got[i][0], sum(table.get(w, 0) for w in words(s))) for i, s in enumerate(READS)}
    tokens = {r["read_id"]: (r["found"], r["tokens"]) for r in engine.kmer(reads, K).collect()}
    for i, s in enumerate(READS):
        want = brute.tokens(s, SEGMENTS, K)
        assert tokens[i] == (sum(n for _, n in want), " ".join(f"{a}:{n}" for a, n in want))
        assert tokens[i][0] == got[i][0]


def test_matches(engine, reads):
    assert by_read(engine.ms(reads).collect()) == {i: brute.ms(s, SEGMENTS) for i, s in enumerate(READS)}
    assert by_read(engine.zml(reads).collect()) == {i: brute.zml(s, SEGMENTS) for i, s in enumerate(READS)}
    assert by_read(engine.left(reads).collect()) == {i: brute.left(s, SEGMENTS) for i, s in enumerate(READS)}


def test_count_and_mems(engine, reads):
    for r in engine.count(reads).collect():
        s = READS[r["read_id"]]
        n = brute.left(s, SEGMENTS)[-1] if s else 0
        assert (r["matched"], r["total"], r["occurrences"]) == (n, len(s), brute.occurrences(s[len(s) - n :], SEGMENTS)), s
    got = sorted((r["read_id"], r["s"], r["e"], r["cnt"]) for r in engine.mem(reads, 5).collect())
    assert got == sorted((i, *m) for i, s in enumerate(READS) for m in brute.mems(s, SEGMENTS, 5))
    assert engine.mem(reads.limit(0), 5).collect() == []


def test_suffix_order(engine):
    sa, c, lf = brute.transform(TEXT)
    rows = sorted(engine.index.rows.collect(), key=lambda r: r["row"])
    assert [r["pos"] for r in rows] == sa and [r["c"] for r in rows] == c and [r["lf"] for r in rows] == lf
    runs = [0]
    for a, b in zip(c, c[1:]):
        runs.append(runs[-1] + (a != b))
    assert [r["run"] for r in rows] == runs
    moves = {r["run"]: r for r in engine.index.moves.collect()}
    for run, r in moves.items():
        p = runs.index(run)
        assert (r["p"], r["n"], r["c"]) == (p, runs.count(run), c[p])
        assert r["id"] == runs[lf[p]] and r["off"] == lf[p] - runs.index(runs[lf[p]])
    ok = bwt.verify(engine.index.rows).first()
    assert ok["ok"] and ok["n"] == len(TEXT)
    assert "".join(r["c"] for r in sorted(bwt.reconstruct(engine.index.rows.select("row", "c")).collect(), key=lambda r: r["pos"])) == TEXT
    split = bwt.runs(engine.index.rows.drop("run"), 2).groupBy("run").count().agg(F.max("count")).first()[0]
    assert split == 2
    for r in bwt.locate(engine.index.rows, bwt.sampled(engine.index.sa, 9), engine.index.rows.select("row")).collect():
        assert r["pos"] == sa[r["row"]]
    for r in bwt.run_lcs(engine.index.rows, engine.index.text, 5).collect():
        ends = [sa[k] for k in range(len(sa)) if runs[k] == r["run"]]
        a, b = TEXT[: ends[0]][::-1], TEXT[: ends[-1]][::-1]
        assert r["lcs"] == min(5, brute.lcp(a, b)), r
    chars = [moves[k]["c"] for k in range(len(moves))]
    for r in bwt.neighbours(engine.index.moves).collect():
        above = [k for k in range(r["run"]) if chars[k] == r["c"]]
        below = [k for k in range(r["run"] + 1, len(chars)) if chars[k] == r["c"]]
        assert r["up"] == (r["run"] - above[-1] if above else None) and r["down"] == (below[0] - r["run"] if below else None)


def test_walks(engine, reads):
    for r in engine.pml(reads, sa_entries=True).collect():
        assert r["lens"] == brute.pml(READS[r["read_id"]], TEXT), READS[r["read_id"]]
        assert r["sa"] == brute.pml(READS[r["read_id"]], TEXT, places=True)
    for r in engine.rpml(reads).collect():
        assert len(r["lens"]) == len(READS[r["read_id"]])
        assert all(a <= b for a, b in zip(r["lens"], brute.ms(READS[r["read_id"]], [TEXT])))


def test_walk_by_chance(spark):
    rng = random.Random(5)
    refs = ["".join(rng.choice("ACGT") for _ in range(rng.randint(1, 60))) for _ in range(4)]
    text = "".join(f"{s}%{brute.rc(s)}%" for s in refs) + "$"
    index = Index(spark.createDataFrame(list(enumerate(refs)), "doc_id long, seq string")).arrays()
    some = ["".join(rng.choice("ACGTN") if rng.random() < 0.3 else refs[0][i % len(refs[0])] for i in range(rng.randint(0, 50))) for _ in range(40)]
    got, befores, _ = pml.walk(index, some, rows=True)
    assert [index.pos[x].tolist() for x in befores] == [brute.pml(s, text, places=True) for s in some]
    assert [x.tolist() for x in got] == [brute.pml(s, text) for s in some]


def test_thresholds(engine):
    """The first least common prefix between two rows with a base, and how many rows the splits make."""
    rows = engine.index.rows.select("row", "pos", "c", "run").toPandas()
    sa, c, _ = brute.transform(TEXT)
    lcps = [0] + [brute.lcp(TEXT[sa[i - 1] :], TEXT[sa[i] :]) for i in range(1, len(sa))]
    found = engine.index.thresholds.collect()
    for r in found:
        assert all(c[k] != r["c"] for k in range(r["first"], r["last"] + 1))
        assert (r["first"] == 0 or c[r["first"] - 1] == r["c"]) and (r["last"] + 1 == len(c) or c[r["last"] + 1] == r["c"])
        stop = min(r["last"] + 1, len(c) - 1)
        assert r["cut"] == min(range(r["first"], stop + 1), key=lambda k: (lcps[k], k))
    assert sum(r["last"] - r["first"] + 1 for r in found) == sum(x != b for b in "ACGT" for x in c)
    heads = {k for k in range(len(c)) if k == 0 or c[k] != c[k - 1]}
    assert pml.split_rows(rows) == len(heads | {r["cut"] for r in found if r["first"] < r["cut"] <= r["last"]})


def test_null_reads_are_bounded(spark):
    rng = random.Random(3)
    refs = [(i, "".join(rng.choice("ACGT") for _ in range(rng.choice([40, 151, 700])))) for i in range(300)] + [(900, "N" * 400), (901, ""), (902, None)]
    frame = spark.createDataFrame(refs, "doc_id long, seq string")
    got = [tuple(r) for r in classify.null_reads(frame).collect()]
    assert len(got) == 1000 and got == [tuple(r) for r in classify.null_reads(frame.repartition(3)).collect()]
    by = dict(refs)
    assert all(s[::-1] in by[int(name.split("_")[0])] and "N" not in s and len(s) == min(150, len(by[int(name.split("_")[0])])) for name, s in got)
    assert classify.null_reads(frame.filter("doc_id = 1 or doc_id >= 900")).count() <= 100


def test_colors(engine):
    sa, c, _ = brute.transform(TEXT)
    ends, total = [], 0
    for s in REFS:
        total += 2 * len(s) + 2
        ends.append(total)
    doc = lambda p: next((i for i, e in enumerate(ends) if p < e), None)
    rows = sorted(engine.index.rows.collect(), key=lambda r: r["row"])
    sets = {}
    for r in rows:
        if doc(r["pos"]) is not None:
            sets.setdefault(r["run"], set()).add(doc(r["pos"]))
    ids = {}
    for run in sorted(sets):
        ids.setdefault(tuple(sorted(sets[run])), len(ids))
    runs, named = engine.index.colors
    assert {r["run"]: r["color_id"] for r in runs.collect()} == {run: ids[tuple(sorted(s))] for run, s in sets.items()}
    assert {r["color_id"]: tuple(r["docs"]) for r in named.collect()} == {v: k for k, v in ids.items()}
    offset = 0
    for r in sorted(colors.flat_colors(named).collect(), key=lambda r: r["color_id"]):
        assert r["flat_off"] == offset
        offset += r["size"] + 1
    merges = colors.clusters(colors.similarity(named), len(REFS), len(sets))
    assert len(merges) == len(REFS) - 1
    packed = {r["color_id"]: set(r["docs"]) for r in colors.tree_compress(named, merges, len(REFS)).collect()}
    assert all(set(k) <= packed[v] for k, v in ids.items())
    assert [r["color_id"] for r in colors.frequent(named, 2).collect()] == [v for k, v in sorted(ids.items(), key=lambda x: (len(x[0]) == 1, sum(tuple(sorted(s)) == x[0] for s in sets.values()), x[1]), reverse=True)[:2]]


def test_classification(spark):
    sizes = [0, 1, 149, 150, 151, 299, 300, 310, 449, 450]
    rows = [(i, p, (p * 7 + i) % 23) for i, m in enumerate(sizes) for p in range(m)]
    lengths = spark.createDataFrame(rows, "read_id long, pos long, len long")
    totals = spark.createDataFrame(list(enumerate(sizes)), "read_id long, total long")
    got = {(r["read_id"], r["bin"]): r["top"] for r in classify.bins(lengths, totals).collect()}
    want = {}
    for i, m in enumerate(sizes):
        count = max(1, m // 150)
        for p in range(m):
            key = (i, min((m - 1 - p) // 150, count - 1))
            want[key] = max(want.get(key, 0), (p * 7 + i) % 23)
    assert got == want
    thr = spark.range(1).select(F.lit(22).cast("long").alias("thr"))
    for r in classify.report(classify.bins(lengths, totals), thr).collect():
        tops = [v for (i, _), v in want.items() if i == r["read_id"]]
        assert (r["above"], r["below"]) == (sum(t >= 22 for t in tops), sum(t < 22 for t in tops))
        assert (r["status"] == "FOUND") == (2 * r["above"] > len(tops)) and r["avg_max"] == pytest.approx(sum(tops) / len(tops))
    stats = classify.null_statistics(spark.createDataFrame([(x,) for x in [1] * 9 + [7] * 5 + [9] * 4], "len long")).first()
    assert (stats["num_values"], stats["percentile"]) == (18, 7)
    empty = classify.null_statistics(spark.createDataFrame([], "len long")).first()
    assert (empty["num_values"], empty["percentile"]) == (0, 0)
    votes = spark.createDataFrame([(1, 3, 10, 5), (1, 2, 10, 4), (1, 9, 1, 1), (2, 5, 4, 9)], "read_id long, species int, cnt long, step int")
    two = {r["read_id"]: r.asDict() for r in classify.best_two(votes).collect()}
    assert (two[1]["best"], two[1]["second"]) == (2, 3) and two[2]["second"] is None
    means = spark.createDataFrame([(1, 0.9), (2, 0.1), (3, 0.9)], "read_id long, mean double")
    assert {r["read_id"]: (r["best"], r["second"]) for r in classify.classes(classify.best_two(votes), means).collect()} == {1: (2, 3), 2: (0, 0), 3: (0, 0)}
    stop = spark.createDataFrame([(1, [0] * 250), (2, [1] * 250), (3, [])], "read_id long, lens array<int>")
    assert {r["read_id"]: r["used"] for r in classify.early_stop(stop).collect()} == {1: 200, 2: 250, 3: 0}


def test_multi_class_and_report(engine, reads):
    got = {r["read_id"]: (r["best"], r["second"]) for r in engine.multi_class(reads).collect()}
    assert set(got) == set(range(len(READS))) and got[3] == (0, 0) and got[8][0] == 1
    status = {r["read_id"]: r["status"] for r in engine.classify(reads, null=reads.filter("read_id = 2")).collect()}
    assert status[1] == "FOUND" and status[2] == "NOT_PRESENT"
    kept = classify.filtered(reads, engine.classify(reads, "ms", null=reads.filter("read_id = 2")), invert=True)
    assert 1 not in {r["read_id"] for r in kept.collect()}


def test_taxonomy(spark):
    tree = spark.createDataFrame([(2, 1), (3, 1), (4, 2), (5, 2), (6, 4)], "child int, parent int")
    pairs = spark.createDataFrame([(1, 6, 5), (2, 6, 3), (3, 4, 6), (4, 5, 0), (5, 5, 99)], "key int, a int, b int")
    assert {r["key"]: r["lca"] for r in taxonomy.lca(pairs, tree, 1).collect()} == {1: 2, 2: 1, 3: 4, 4: 5, 5: 1}


def test_index_is_kept(spark, engine, reads, tmp_path):
    engine.index.save(str(tmp_path / "index"), [3, 4])
    again = Engine(Index.load(spark, str(tmp_path / "index")), K)
    assert {r["read_id"]: r["lens"] for r in again.pml(reads).collect()} == {r["read_id"]: r["lens"] for r in engine.pml(reads).collect()}
    assert spark.read.parquet(str(tmp_path / "index/kmers")).select("k").distinct().count() == 2


def test_short_words_of_short_segments(spark):
    refs = spark.createDataFrame([("AC", 1), ("GGT", 2), ("", 1)], "seq string, weight int")
    assert {r["word"] for r in matches.short_words(refs, 5).collect()} == {"A", "C", "AC", "G", "GG", "GGT", "GT", "T"}
