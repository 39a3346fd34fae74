import hashlib
import random
from collections import Counter, defaultdict

import fixtures
import numpy as np
import xxhash

from seqloom.llm import exact_dedup, graph, simhash
from seqloom.session import materialize


def normal(t):
    return (t or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"})


def test_exact(spark, tmp_path):
    docs = fixtures.stored(spark, tmp_path)
    got = exact_dedup.exact_dedup(docs, digest=True).collect()
    rows = [(r[0], r[1]) for r in fixtures.documents()]
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256(normal(t).encode()).hexdigest()].append((-len(t or ""), i is None, i or 0, i))
    for r in got:
        group = groups[r["text_sha256"]]
        assert r["group_size"] == len(group) and r["keep_id"] == min(group)[3]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter(groups.keys())
    again = {(r["row_id"], r["kept"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(docs).collect()}
    assert again == {(r["row_id"], r["kept"], r["keep_id"], r["group_size"]) for r in got}
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert {normal(r["text"]) for r in kept.collect()} == {normal(t) for _, t in rows}


def test_exact_without_broadcast(spark, tmp_path, monkeypatch):
    docs = fixtures.stored(spark, tmp_path)
    want = {tuple(r) for r in exact_dedup.keep_first(docs).collect()}
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    assert {tuple(r) for r in exact_dedup.keep_first(docs).collect()} == want


def test_exact_of_nothing(spark, tmp_path):
    docs = fixtures.stored(spark, tmp_path, [])
    assert exact_dedup.exact_dedup(docs, digest=True).collect() == []
    assert exact_dedup.keep_first(docs).collect() == []


def brute_fingerprint(text, words=4):
    parts = [w for w in __import__("re").split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]
    if not parts:
        return 0
    shingles = [" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, bits=4):
    label = list(range(len(fps)))
    a = np.array(fps, np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= bits
    done = False
    while not done:
        done = True
        for i in range(len(fps)):
            least = min(label[j] for j in np.flatnonzero(near[i]))
            if least < label[i]:
                label[i], done = least, False
    return label


def test_triples_meet_all_fours():
    from itertools import combinations

    sets = simhash.triples()
    assert len(sets) == 20 and all(any(set(t) <= set(four) for t in sets) for four in combinations(range(8), 4))


def test_simhash(spark, tmp_path):
    docs = fixtures.stored(spark, tmp_path)
    rows = [(r[0], r[1] or "") for r in fixtures.documents()]
    got = simhash.near_dedup(docs).collect()
    assert len(got) == len(rows)
    fps = {t: brute_fingerprint(t) for _, t in rows}
    unique = sorted(set(fps.values()))
    label = dict(zip(unique, brute_components(unique)))
    least = {}
    for i, t in rows:
        if i is not None:
            least[label[fps[t]]] = min(least.get(label[fps[t]], i), i)
    want = Counter((i, fps[t], least.get(label[fps[t]])) for i, t in rows)
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == want
    assert simhash.near_dedup(docs.limit(0)).collect() == []


def test_links_of_dense_groups(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b, n, most in [(base[0], 500, 9), *((x, 6, 6) for x in base[1:20])]:
        for _ in range(n):
            x = b
            for k in rng.sample(range(64), rng.randint(1, most)):
                x ^= 1 << k
            fps.add(x)
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    nodes = materialize(spark.createDataFrame([(x, x) for x in signed], "node long, fp long"))
    groups = defaultdict(set)
    for r in graph.components(simhash.links(nodes, 4, 40), "a", "b").collect():
        groups[r["root"]].add(r["node"])
    want = defaultdict(set)
    for x, k in zip(signed, brute_components(fps)):
        want[k].add(x)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in want.values() if len(g) > 1}


def test_count_filter_rejects_pairs_and_loses_none():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 64, 4000, np.uint64, endpoint=False)
    b = a.copy()
    for k in range(4):  # three shared bytes in half of the pairs, near copies in the others
        b ^= np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64)
    b[::2] ^= np.uint64(0x0101010101)
    bytes_shared = (a.view(np.uint8).reshape(-1, 8) == b.view(np.uint8).reshape(-1, 8)).sum(1)
    assert (simhash.tallied(a, b) == (bytes_shared >= 4)).all()
    near = np.bitwise_count(a ^ b) <= 4
    assert (simhash.linked(a, b) == near).all() and near.any()
    assert (~simhash.tallied(a, b)).sum() > 1000


def test_signature_recall_in_every_band():
    """Pairs of sets of shingles with a similarity of 0.8 and more: share that is found by postings and tally."""
    rng = np.random.default_rng(5)
    for similarity, size in [(0.8, 9), (0.8, 90), (0.82, 400), (0.86, 60), (0.9, 40), (0.95, 200)]:
        found = 0
        for _ in range(300):
            common = max(1, round(similarity * size))
            x = rng.integers(0, 1 << 63, size).astype(np.uint64)
            cut = common + (size - common) // 2
            a, b = x[:cut], np.concatenate([x[:common], x[cut:]])
            p, q = (np.frombuffer(simhash.signature(s), np.uint8) for s in (a, b))
            meet = (simhash._bands(p[None]) == simhash._bands(q[None])).any()
            found += bool(meet and (p == q).sum() >= simhash.least_tally())
        assert found == 300, (similarity, size, found)


def replaced(spark, docs, call):
    """What a filter keeps if files are dealt otherwise between the call and the action."""
    before = spark.conf.get("spark.sql.files.minPartitionNum", None)
    try:
        out = call(docs)
        spark.conf.set("spark.sql.files.minPartitionNum", "2")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64m")
        return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in out.collect())
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum") if before is None else spark.conf.set("spark.sql.files.minPartitionNum", before)
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_other_partitions_between_call_and_action(spark, tmp_path):
    docs = fixtures.stored(spark, tmp_path)
    for call in (exact_dedup.keep_first, simhash.keep_one):
        want = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in call(docs).collect())
        for parts in ("1", "7", "16"):
            spark.conf.set("spark.sql.files.minPartitionNum", parts)
            assert replaced(spark, docs, call) == want
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_frames_that_are_no_plain_scan(spark, tmp_path):
    docs = fixtures.stored(spark, tmp_path)
    twice = docs.unionByName(docs)
    assert exact_dedup.keep_first(twice).count() == exact_dedup.keep_first(docs).count()
    assert simhash.keep_one(twice).count() == simhash.keep_one(docs).count()


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 103), (103, 101), (5, 5), (200, 200), (None, 3), (101, 100)]
    got = {(r["node"], r["root"]) for r in graph.components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    assert got == {(i, 0) for i in range(61)} | {(i, 100) for i in (100, 101, 103)}
    assert graph.components(spark.createDataFrame([], "x long, y long"), "x", "y").collect() == []


def test_keep_one(spark, tmp_path):
    docs = fixtures.stored(spark, tmp_path)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    texts = {r["text"] for r in kept.collect()}
    rows = fixtures.documents()
    near = {t for i, t, *_ in rows if t and ("changed" in t or t.endswith(" tail"))}
    assert len(texts & near) <= 1  # one of a base and its near copies
    assert {r["doc_id"] for r in kept.collect()} >= set(range(30, 70))  # others stay
    assert simhash.keep_one(docs.limit(0)).collect() == []
    assert not any(simhash.signature(simhash.shingles("")))


def test_keep_one_is_exact(spark, tmp_path, monkeypatch):
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = ["", " \n", "one", "one two three four"]
    for n in [8, 8, 9, 10, 16, 19, 24, 40, 60, 120, 300] * 6:
        base = [rng.choice(vocabulary) for _ in range(n)]
        texts.append(" ".join(base))
        for _ in range(3):
            other = list(base)
            for _ in range(rng.randint(0, max(1, n // 40))):
                other[rng.randrange(n)] = rng.choice(vocabulary)
            texts.append(" ".join(other + [f"tail{k}" for k in range(rng.randint(0, 1 + n // 12))]))
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    texts += [passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 8, 40]))) for _ in range(60)]
    rng.shuffle(texts)
    sets = [simhash.shingles(t) for t in texts]
    sets = [set(x.tolist()) for x in sets]
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    assert 70 < len(set(label)) < len(label) - 30
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    monkeypatch.setattr(simhash, "NEAR_TILE", 16)
    kept = simhash.keep_one(spark.read.parquet(f"{tmp_path}/docs"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(label))


def test_edges_of_a_large_group_grow_with_its_members(spark, tmp_path, monkeypatch):
    """One group of near copies over 24 tiles and more: what is joined grows with its members, not with pairs of tiles."""
    rng = random.Random(21)
    base, n, texts = [f"w{k}" for k in range(120)], 400, []
    for k in range(n):
        words = list(base)
        words[rng.randrange(120)] = f"x{k}"
        texts.append(" ".join(words))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    seen, components = [], simhash.components

    def counted(edges, a, b):
        seen.append(edges.count())
        return components(edges, a, b)

    monkeypatch.setattr(simhash, "NEAR_TILE", 16)
    monkeypatch.setattr(simhash, "components", counted)
    kept = simhash.keep_one(spark.read.parquet(f"{tmp_path}/docs"))
    assert [r["doc_id"] for r in kept.collect()] == [0]
    assert seen and max(seen[1:]) <= 2 * n, seen  # the first: fingerprints, as below
    near = materialize(spark.createDataFrame([(x, x) for x in sorted({0} | {1 << a | 1 << b for a in range(62) for b in range(a)})], "node long, fp long"))
    seen.clear()
    assert simhash.links(near, 4, 20).count() == near.count() - 1
    assert max(seen) <= 20 * near.count(), seen


def test_no_postings_are_broadcast(spark):
    """A node is twenty postings, which Spark takes for one row: none of them may reach the driver."""
    rng = np.random.default_rng(5)
    fps = np.unique(rng.integers(0, 1 << 20, 1500))
    nodes = materialize(spark.createDataFrame([(int(x), int(x)) for x in fps], "node long, fp long"))
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsList().size()
    assert simhash._by_fingerprint(nodes) is not None
    most = 0
    runs = store.executionsList()
    for i in range(before, runs.size()):
        run = runs.apply(i).executionId()
        values, found = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (found.apply(j) for j in range(found.size())):
            for metric in (node.metrics().apply(k) for k in range(node.metrics().size())):
                if node.name() == "BroadcastExchange" and metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    most = max(most, int(values.get(metric.accumulatorId()).get().replace(",", "")))
    assert most <= len(fps)
