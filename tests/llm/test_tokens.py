import base64
import hashlib
import random

import fixtures
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from seqloom.llm import bpe, packing
from seqloom.session import materialize

RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(4)
    some = ["".join(rng.choice("abc thé\n\t'sß1!中 AÉ̱.,|<>") for _ in range(rng.randint(1, 90))) for _ in range(200)]
    return some + ["x" * n for n in (7, 8, 9, 16, 17, 31, 32, 33, 200, 5000)] + ["<|endoftext|> it's", "İıſK 's 're 'LL", " \x1c \x85　"]


def test_bpe(spark, reference):
    rows = fixtures.documents() + [(2000 + i, t, None, None, 0, 0.0, "", "", 0, "") for i, t in enumerate(odd_texts())]
    got = bpe.bpe_encode(fixtures.frame(spark, rows), RANKS, P.PATTERN, decode=True).collect()
    want = sorted((r[0] is None, r[0] or 0, np.array(reference.encode_ordinary(r[1] or ""), "<u4").tobytes(), (r[1] or "").encode()) for r in rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, bytes(r["ids"]), bytes(r["decoded"])) for r in got) == want
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in got)
    encoded = bpe.bpe_encode(fixtures.frame(spark, rows[:20]), RANKS, P.PATTERN)
    assert sorted(bytes(r["decoded"]) for r in bpe.bpe_decode(encoded, RANKS, P.PATTERN).collect()) == sorted((r[1] or "").encode() for r in rows[:20])
    assert bpe.bpe_encode(fixtures.frame(spark, []), RANKS, P.PATTERN, decode=True).collect() == []


def test_tree_of_one_and_many():
    ranks = bpe.Ranks.read(RANKS)
    rng = random.Random(8)
    words = [bytes(rng.choice(b"thereandon\xc3\xa9") for _ in range(rng.randint(1, 32))) for _ in range(3000)]
    assert ranks.encode_many(words) == [np.array(ranks.encode_one(w), "<u4").tobytes() for w in words]


def test_word_ids_of_letters_that_change_in_lower_case():
    """Combining marks, and U+0130, whose lower case ends in one."""
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    rng = random.Random(17)
    some = list("abzAZ09.,!?&%*# \n'-_") + list("\u00e9\u00c9\u00df\u00ff\u00c0\u00f1\u00f7\u0130\u0307\u0301\u0323\u0131\ufb00\u03a9\u017f\u212a\u1e9e\u01c5\u03a3\u03c2\xa0\u200b") + ["\u0130&", "<s>"]
    texts = ["\u0130&", *("".join(rng.choice(some) for _ in range(rng.randint(0, 14))) for _ in range(20_000))]
    ids, counts = packing.Tokens(WORDS).encode(pa.array(texts))
    found = np.split(ids, np.cumsum(counts)[:-1])
    want = tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [t for t, a, b in zip(texts, found, want) if a.tolist() != b.ids] == []


def whole(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_word_ids():
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    texts = odd_texts() + [r[1] or "" for r in fixtures.documents()]
    ids, counts = packing.Tokens(WORDS, cache=50).encode(pa.array(texts))
    ends = np.cumsum(counts)
    for text, a, b in zip(texts, [0, *ends], ends):
        assert ids[a:b].tolist() == whole(tokenizer, text), text
    ids, counts = packing.Tokens(WORDS).encode(pa.array([None, "", "a"], pa.string()))
    assert counts.tolist() == [0, 0, 1]


def test_word_ids_of_words_looked_up_in_parts(monkeypatch):
    texts = odd_texts() + [r[1] or "" for r in fixtures.documents()]
    ids, counts = packing.Tokens(WORDS).encode(pa.array(texts))
    monkeypatch.setattr(packing, "DISTINCT", 7)
    some, sizes = packing.Tokens(WORDS, cache=5).encode(pa.array(texts))
    assert some.tolist() == ids.tolist() and sizes.tolist() == counts.tolist()


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing(spark, capacity):
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    rows = fixtures.documents()
    got = packing.pack_documents(fixtures.frame(spark), WORDS, capacity, with_ids=True).collect()
    want = []
    for r in rows:
        ids = whole(tokenizer, r[1]) + [1]
        for k in range(0, len(ids), capacity):
            raw = np.array(ids[k : k + capacity], "<u4").tobytes()
            want.append((str(r[0]), k // capacity, k, len(raw) // 4, raw))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in got) == sorted(want)
    import zlib

    assert all(r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) for r in got)
    check_places([(r["sequence_id"], r["offset"], r["length"]) for r in got], capacity)
    least = -(-sum(r["length"] for r in got) // capacity)
    assert len({r["sequence_id"] for r in got}) <= least + max(2, least // 20)


def check_places(rows, capacity):
    by = {}
    for sequence, offset, length in rows:
        by.setdefault(sequence, []).append((offset, length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity


def placed(runs, histogram):
    for k, (length, rank, first, per, offset) in enumerate(runs):
        stop = runs[k + 1][1] if k + 1 < len(runs) and runs[k + 1][0] == length else histogram[length]
        for j in range(stop - rank):
            yield first + j // per, offset + j % per * length, length


def best_fit_decreasing(histogram, capacity):
    bins = packing._Bins(capacity)
    for n in sorted(histogram, reverse=True):
        bins.best_fit(n, 0, histogram[n])
    return sum(count for count, _ in bins.all())


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 100, 1000])
    histogram = {}
    for _ in range(rng.randint(1, 400)):
        n = min(capacity, max(1, int(rng.expovariate(1 / capacity * 3)))) if seed % 2 else rng.randint(1, capacity)
        histogram[n] = histogram.get(n, 0) + rng.choice([1, 1, 7])
    rows = list(placed(packing.plan(histogram, capacity).tolist(), histogram))
    assert sorted(r[2] for r in rows) == sorted(n for n, c in histogram.items() for _ in range(c))
    check_places(rows, capacity)
    used = len({r[0] for r in rows})
    assert {r[0] for r in rows} == set(range(used))
    assert used <= best_fit_decreasing(histogram, capacity) * 1.03 + 2


def test_configurations_are_optimal_where_that_is_known():
    # three sizes that fit exactly: 6 + 4, 5 + 5
    found = packing.configurations(np.array([6, 5, 4]), np.array([30, 40, 30]), 10)
    assert sum(times for _, times in found) == 50
    assert packing.plan({}, 10).shape == (0, 5)


def test_pack_any_table(spark):
    rows = [(i, n, "kept") for i, n in enumerate([5] * 70 + [3] * 70 + [10, 1])]
    table = materialize(spark.createDataFrame(rows, "k long, length long, _extra string"))
    got = packing.pack(table, 10).collect()
    check_places([(r["sequence_id"], r["offset"], r["length"]) for r in got], 10)
    assert len(got) == len(rows) and got[0]["_extra"] == "kept"
    with pytest.raises(ValueError):
        packing.pack(materialize(spark.createDataFrame([(1, 11)], "k long, length long")), 10)
    empty = packing.pack_documents(fixtures.frame(spark, []), WORDS)
    assert empty.collect() == [] and hashlib.sha256(b"").hexdigest()


def test_pack_names_that_clash(spark, tmp_path):
    rows = [(i, 1 + i % 7, i, i, i, i, i) for i in range(40)]
    spark.createDataFrame(rows, "id long, length int, _salt long, _rank long, _n long, offset long, sequence_id long").write.parquet(f"{tmp_path}/p")
    pieces = spark.read.parquet(f"{tmp_path}/p")
    got = packing.pack(pieces, 10).collect()
    assert sorted((r["id"], r["_salt"], r["_rank"], r["_n"]) for r in got) == [(i, i, i, i) for i in range(40)]
    used = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values()) <= 10
