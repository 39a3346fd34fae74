import random
import re
from pathlib import Path

import fixtures
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from seqloom.llm import crf, html_text, langid, pii, secrets_scan, toxicity

RANKS = P.path("byte_bpe_50k.tiktoken")


# ---- the field ----------------------------------------------------------------------------------------------------


def paths(model, scores):
    """All label paths of one chain and their scores."""
    from itertools import product

    n = len(model.labels)
    for path in product(range(n), repeat=len(scores)):
        total = model.start[path[0]] + model.end[path[-1]] + sum(scores[t, k] for t, k in enumerate(path))
        yield path, total + sum(model.trans[a, b] for a, b in zip(path, path[1:]))


def test_decoding_is_exact():
    rng = np.random.default_rng(3)
    model = crf.Crf(["a", "b", "c"], {}, *(np.zeros((0, 3)),) * 3, rng.normal(size=(3, 3)), rng.normal(size=3), rng.normal(size=3))
    lengths = np.array([1, 5, 2, 4, 3])
    scores = rng.normal(size=(lengths.sum(), 3)) * 2
    best, soft = model.viterbi(scores, lengths), model.marginals(scores, lengths)
    at = 0
    for n in lengths:
        found = list(paths(model, scores[at : at + n]))
        assert tuple(best[at : at + n]) == max(found, key=lambda x: x[1])[0]
        weights = np.exp([s for _, s in found])
        for t in range(n):
            for k in range(3):
                assert soft[at + t, k] == pytest.approx(sum(w for (p, _), w in zip(found, weights) if p[t] == k) / weights.sum())
        at += n


def test_marginals_of_long_chains(monkeypatch):
    """Segments are exact: the same as in one piece, and as summing over all paths."""
    rng = np.random.default_rng(8)
    for labels in ("ab", "abcd"):
        k = len(labels)
        model = crf.Crf(list(labels), {}, *(np.zeros((0, k)),) * 3, rng.normal(size=(k, k)) * 2, rng.normal(size=k), rng.normal(size=k))
        lengths = np.array([1, 700, 3, 129, 64, 65, 2])
        scores = rng.normal(size=(lengths.sum(), k)) * 2
        found = []
        for size in (3, 64, 10_000):
            monkeypatch.setattr(crf, "SEGMENT", size)
            found.append(model.marginals(scores, lengths))
        assert np.allclose(found[0], found[1]) and np.allclose(found[0], found[2]) and np.allclose(found[0].sum(1), 1)


def test_training_learns_neighbours():
    chains = [[("mr", "O"), ("x", "N"), ("y", "O")], [("x", "O"), ("mr", "O"), ("y", "N")], [("y", "O"), ("x", "O")]]
    model = crf.fit(chains, lambda t: [t], ["O", "N"], steps=200)
    rows = [model.rows([t]) for t in ("y", "mr", "x", "x")]
    scores = model.emissions(*(np.array(x) for x in zip(*rows)), np.array([4]))
    assert model.viterbi(scores, np.array([4])).tolist() == [0, 0, 1, 0]


# ---- secrets ------------------------------------------------------------------------------------------------------


def base_secrets(text):
    out = []
    for kind, pattern, flags, good in [
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 24),
    ]:
        out += [(m.start(), secrets_scan.KINDS.index(kind), m.end()) for m in re.finditer(pattern, text, flags) if good(m)]
    return sorted(out)


def test_secrets(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice(["password", "token", " = ", ":", '"', "AKIA", "ABCDEFGHIJKLMNOP99", "0a1b2c3d4e5f", "ffff", " ", "é", "api_key", "APIKEY", "zz", "\n"]) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    texts += [None, "", "x" * 200_000, "f" * 100_000]
    scan = secrets_scan.Scanner(RANKS, P.PATTERN)
    for t in texts:
        assert [s for s in scan.spans(t or "") if s[1] < 3] == base_secrets(t or "")
    noise = "Xk9vQz2LpR7tWb4NsYc8"
    plain = ["550e8400-e29b-41d4-a716-446655440000", "d41d8cd98f00b204e9800998ecf8427E", "my_long_variable_name_number_2", "someCamelCaseIdentifier2", "internationalisation-of-names"]
    assert [k for _, k, _ in scan.spans(f"see {noise} there")] == [3]
    assert all(not any(k == 3 for _, k, _ in scan.spans(f"see {x} there")) for x in plain)
    assert [k for _, k, _ in scan.spans(f"token={noise}")] == [0]
    rows = [(i, t, None, None, 0, 0.0, "", "", 0, "") for i, t in enumerate([*texts[:50], None, f"see {noise}"])]
    found = secrets_scan.scan_secrets(fixtures.frame(spark, rows + rows[:1]), RANKS, P.PATTERN)
    got = found.select("doc_id", secrets_scan.joined("spans").alias("s"), *[secrets_scan.counted("spans", k).alias(k) for k in secrets_scan.KINDS]).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        spans = scan.spans(rows[r["doc_id"]][1] or "")
        assert r["s"] == ",".join(f"{secrets_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert [r[k] for k in secrets_scan.KINDS] == [sum(x == n for _, x, _ in spans) for n in range(4)]
    assert secrets_scan.scan_secrets(fixtures.frame(spark, []), RANKS, P.PATTERN).collect() == []


def test_random_runs_whole_and_in_linear_time():
    import time

    scan = secrets_scan.Scanner(RANKS, P.PATTERN)
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    assert sum(len(scan.spans("".join(rng.choice(letters) for _ in range(32)))) for _ in range(200)) > 190
    assert not any(scan.spans(x) for x in ["internationalisierungsbestrebungen", "Donaudampfschifffahrtsgesellschaft", "getElementsByClassNameOrTag", "usr/local/share/documentation"])
    began = time.time()
    assert scan.spans("o" * 1_000_000 + "12345") == []  # few tokens
    long = "".join(rng.choice(letters + "0123456789") for _ in range(1_000_000))
    assert scan.spans(f"x {long} y") == [(2, 3, 1_000_002)]
    scan.spans("ab1-" * 250_000 + " token=abcdef " * 1000)
    assert time.time() - began < 30


# ---- personal data ------------------------------------------------------------------------------------------------


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0


def base_pii(text):
    digits = lambda m: re.sub(r"\D", "", m[0], flags=re.A)
    tests = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, (p, good) in enumerate(tests) for m in re.finditer(p, text) if good(m)]


@pytest.fixture(scope="module")
def tagger():
    return pii.Tagger(pii.train())


def test_base_of_personal_data():
    rng = random.Random(9)
    texts = ["".join(rng.choice("a1.@-+ 2.3é%()0") for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    texts += ["4111 1111 1111 1111", "4111-1111-1111-1112", "0" * 40, "1" * 19, "+1 (312) 555-4560.", "300.1.1.1 1.2.3.4.5.6.7.8", "a@b.c@d.e", "1" * 50_000, "a" * 50_000 + "@"]
    for t in texts:
        assert sorted(pii.base_spans(t)) == sorted(base_pii(t)), t


def test_field_finds_what_it_was_shown(tagger):
    for line in pii.LABELLED.strip().splitlines():
        raw = re.sub(r"\[(person|address|id) ([^\]]+)\]", r"\2", line)
        want = re.findall(r"\[(person|address|id) ([^\]]+)\]", line)
        assert [(pii.KINDS[k], raw[a:b]) for k, a, b in tagger.spans([raw])[0] if k > 3] == want


def test_field_on_new_words(tagger):
    found = lambda t: [(pii.KINDS[k], t[a:b]) for k, a, b in tagger.spans([t])[0]]
    assert found("Please contact Mr. Tom Hanks about it") == [("person", "Tom Hanks")]
    assert found("é 中 name: Sara Connor") == [("person", "Sara Connor")]
    assert found("address: 99 Long Road") == [("address", "99 Long Road")]
    assert found("ssn 111-22-3333") == [("id", "111-22-3333")]
    for clean in ["The name of the rose is good.", "In 1998 there were 40 streets.", "THE!! ROAD!! IS!! LONG!! 12!!", "Von der Straße. Und Anna ging.", "La rue. Le Nom. 15 Ans", ""]:
        assert found(clean) == []


def test_field_reads_long_lines_whole(tagger):
    for n in [*range(56, 70), 127, 128, 5000]:
        for cue, kind, span in [("name:", "person", "Sara Connor"), ("address:", "address", "99 Long Road"), ("passport number", "id", "X1234567")]:
            text = f"{'x ' * n}{cue} {span} {'y ' * 70}"
            assert [(pii.KINDS[k], text[a:b]) for k, a, b in tagger.spans([text, "name: Wei Chen"])[0]] == [(kind, span)], (n, cue)


def test_cue_at_any_place_of_a_long_line(tagger):
    lines = ["x " * n + "name: Sara Connor" for n in range(131)]
    assert [[(k, len(t) - a, len(t) - b) for k, a, b in found] for t, found in zip(lines, tagger.spans(lines))] == [[(4, 11, 0)]] * 131
    long = "7" * 100_000
    assert pii.shape(long + "a") == "d+x" and pii.shape("a" * 60 + "7") == "xd"


def test_personal_data(spark, tagger, tmp_path):
    texts = [None, "", "mail a.b@c.de or 10.0.0.1", "Dear Mr. Smith, call +49 (30) 123-4567 now", "x " * 50_000 + "name: Sara Connor"]
    rows = [(i, t, "en", None, 7, 0.0, "", "", 0, "") for i, t in enumerate([*texts, texts[2]])]
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(fixtures.frame(spark, rows)).collect()}
    for i, t in enumerate(texts):
        assert [(s["kind"], s["start"], s["end"]) for s in got[i]] == [(pii.KINDS[k], a, b) for k, a, b in tagger.spans([t or ""])[0]]
    assert got[4][0]["start"] == 100_006
    masked = {r["doc_id"]: r["text"] for r in pii.mask_pii(fixtures.frame(spark, rows)).collect()}
    assert masked[0] is None and masked[1] == "" and masked[2] == "mail <email> or <ip>" and masked[3] == "Dear Mr. <person>, call <phone> now"
    assert pii.find_pii(fixtures.frame(spark, [])).collect() == [] and pii.mask_pii(fixtures.frame(spark, [])).collect() == []


# ---- languages ----------------------------------------------------------------------------------------------------


def language_rows():
    rng = random.Random(12)
    kinds = {"aa": "abcdefg", "bb": "defghij", "ru": "абвгде"}
    rows = [(i, fixtures.prose(rng, 60, kinds[lang]), lang) for i, lang in enumerate(list(kinds) * 40)]
    return [(i, t, lang, None, 0, 0.0, "", "", 0, "") for i, t, lang in rows]


def best_path(scores, penalty):
    from itertools import product

    n = scores.shape[1]
    value = lambda p: sum(scores[t, k] for t, k in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:]))
    return max(value(p) for p in product(range(n), repeat=len(scores))), value


def test_language_path_is_best():
    rng = np.random.default_rng(2)
    for _ in range(60):
        scores = rng.normal(size=(rng.integers(1, 7), 3)) * 3
        found = langid.path(scores, 2.0)
        path = [found] * len(scores) if isinstance(found, int) else found.tolist()
        best, value = best_path(scores, 2.0)
        assert value(path) == pytest.approx(best)


def test_language_counts_by_brute_force(spark):
    """Trigrams of every labelled text, script by script, and the weights that follow."""
    import math
    from collections import Counter

    rng = random.Random(31)
    rows = [(i, fixtures.prose(rng, 12, "etaoin") if i % 2 else fixtures.prose(rng, 9, "\u03b1\u03b2\u03b3xy") + " \u4e2d\u6587!", "en" if i % 2 else "el") for i in range(60)]
    rows += [(60, None, "en"), (61, "", "el"), (62, "not counted", None), (63, "12 %%", "en")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["el", "en"]
    for k, lang in enumerate(model.langs):
        grams, scripts, letters = Counter(), Counter(), 0
        for _, text, mine in rows:
            for word in langid.WORDS.findall(text or "") if mine == lang else ():
                padded = [0, *map(ord, word.lower()), 0]
                for a, b, c in zip(padded, padded[1:], padded[2:]):
                    mixed = a * 1_000_003 + b * 8_191 + c * 131
                    grams[(mixed ^ (mixed >> 15)) % langid.BUCKETS] += 1
                start = max(s for s, _ in langid.BLOCKS if s <= ord(word[0].lower()))
                scripts[dict(langid.BLOCKS)[start]] += len(word)
                letters += len(word)
        total = sum(grams.values()) + 0.5 * langid.BUCKETS
        assert np.allclose(model.weights[list(grams), k], [math.log((n + 0.5) / total) for n in grams.values()])
        others = np.setdiff1d(np.arange(langid.BUCKETS), list(grams))
        assert np.allclose(model.weights[others, k], math.log(0.5 / total))
        assert [bool(x) for x in model.own[:, k]] == [scripts[s] >= langid.SCRIPT_SHARE * letters for s in langid.SCRIPTS]


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="needs the driver's tables")
def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.fit(docs.filter(~held))
    found = langid.identify(docs.filter(held), model).join(docs.select("doc_id", "lang"), "doc_id").filter("lang is not null and lang_pred <> 'und'").collect()
    assert len(found) > 100 and np.mean([r["lang_pred"] == r["lang"] for r in found]) > 0.98


def test_languages(spark):
    rows = language_rows()
    docs = fixtures.frame(spark, rows)
    model = langid.fit(docs.filter("doc_id % 4 <> 2"))
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert np.mean([got[r[0]]["lang_pred"] == r[2] for r in rows if r[0] % 4 == 2]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())
    first, second = rows[0][1], rows[2][1]
    odd = [None, "", "123 !!", "²½", first + " " + second, "中文", "\x00 " + first, first.upper()]
    extra = [(i, t, None, None, 0, 0.0, "", "", 0, "") for i, t in enumerate(odd)]
    got = {r["doc_id"]: r for r in langid.identify(fixtures.frame(spark, extra), model).collect()}
    assert [got[i]["lang_pred"] for i in range(4)] == ["und"] * 4 and got[5]["lang_pred"] in model.langs and got[7]["lang_pred"] == "aa"
    spans = got[4]["spans"]
    assert {s["lang"] for s in spans} == {"aa", "ru"} and [s["end"] - s["start"] for s in spans] == [len(first), len(second)]
    kept = langid.keep_known(fixtures.frame(spark, extra + rows), model)
    assert {r["text"] for r in kept.collect()} >= {r[1] for r in rows} and kept.filter(F.col("text").isNull() | (F.col("text") == "")).count() == 0
    none = langid.fit(fixtures.frame(spark, []))
    assert {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(fixtures.frame(spark, []), model).collect() == []


# ---- toxicity -----------------------------------------------------------------------------------------------------


def test_toxicity(spark):
    rng = random.Random(13)
    rows, marks = [], []
    for i in range(400):
        words = fixtures.prose(rng, 60).split()
        if i % 5 == 0:
            for bad in rng.sample(["blorgh", "snarf"], 1) + ["zwick" + rng.choice(["et", "ung", "ast", "ol"])] * 2:
                words.insert(rng.randint(0, len(words)), bad)
        rows.append((i, " ".join(words), "en", None, 0, 0.0, "", "", 0, ""))
        marks.append((i, int(i % 5 == 0), 1))
    docs = fixtures.frame(spark, rows)
    labels = spark.createDataFrame([*marks, (7, None, 0), (None, 1, 0), (0, 1, 0)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(docs, labels.filter("doc_id % 3 <> 1"))
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    held = [i for i in range(400) if i % 3 == 1]
    assert np.mean([(got[i]["score"] >= toxicity.THRESHOLD) == (i % 5 == 0) for i in held]) > 0.97
    worst = {rows[i][1][o["start"] : o["end"]] for i in range(0, 400, 5) for o in got[i]["offences"]}
    assert worst and all(re.match("blorgh|snarf|zwick", w) for w in worst)
    odd = [(i, t, None, None, 0, 0.0, "", "", 0, "") for i, t in enumerate([None, "", "İ BLORGH x", "x " * 50_000 + "blorgh"])]
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(fixtures.frame(spark, odd + odd[:1]), model).collect()}
    assert got[0]["score"] == got[1]["score"] < 0.5 and got[2]["offences"][0]["start"] == 2 and got[3]["offences"][0]["start"] == 100_000
    none = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert {r["score"] for r in toxicity.score_toxicity(docs, none).collect()} == {0.0}
    assert toxicity.fit(docs, labels.limit(0)).rate == 0.0
    assert toxicity.score_toxicity(fixtures.frame(spark, []), model).collect() == []


def test_lexicon_counts_and_scores_by_brute_force(spark, monkeypatch):
    """Entries, document counts, gains, inputs and scores as their definitions have them."""
    import math
    from collections import Counter

    rng = random.Random(23)
    bad = ["zwicket", "zwickung", "zwickast", "blorgh"]
    texts, toxic = [], []
    for i in range(240):
        words = fixtures.prose(rng, 25).split()
        toxic.append(i % 3 == 0)
        if toxic[-1]:
            words[3:3] = [bad[3], rng.choice(bad[:3])]
            words += [rng.choice(bad[:3]), rng.choice(bad[:3])]
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(t)) for i, t in enumerate(toxic)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    count = {True: Counter(), False: Counter()}
    for t, mark in zip(texts, toxic):
        words = re.findall(r"[^\W\d_]+", t.lower())
        begins = Counter(w[:n] for w in words for n in (4, 5, 6, 7) if len(w) >= n)
        count[mark].update({*words, *(b + "*" for b in begins), *(b + "**" for b, n in begins.items() if n >= 3)})
    prior, want = sum(toxic) / len(toxic), set()
    for entry, a in count[True].items():
        b = count[False][entry]
        share = a / (a + b)
        gain = a * math.log(share / prior) + (b * math.log((1 - share) / (1 - prior)) if b else 0)
        if a >= toxicity.LEAST and share > max(0.5, 1.5 * prior) and gain >= toxicity.GAIN:
            want.add(entry)
    assert model.lexicon == want and "zwic**" in want and "blorgh" in want
    # scores from the field's marginals over whole documents
    scorer = toxicity.Scorer(model)
    for text, row in zip(texts[:30], sorted(toxicity.score_toxicity(docs, model).collect(), key=lambda r: r["doc_id"])):
        words = re.findall(r"[^\W\d_]+", text.lower())
        begins = Counter(w[:n] for w in words for n in (4, 5, 6, 7) if len(w) >= n)
        tokens = []
        for w in words:
            found = [e for e in [w, *(w[:n] + "*" for n in (4, 5, 6, 7) if len(w) >= n)] if e in want]
            found += [w[:n] + "**" for n in (4, 5, 6, 7) if len(w) >= n and w[:n] + "**" in want and begins[w[:n]] >= 3]
            tokens.append([f"begin {w[:3]}-", f"end -{w[-3:]}", f"size {min(len(w), 12)}", *(f"entry {e}" for e in found)])
        field = model.field
        emit = np.zeros((len(tokens), 2))
        for t, found in enumerate(tokens):
            own, prev, next_ = field.rows(found)
            emit[t] += own
            if t + 1 < len(tokens):
                emit[t + 1] += prev
            if t:
                emit[t - 1] += next_
        alpha = [emit[0] + field.start]
        for t in range(1, len(emit)):
            alpha.append(np.log(np.exp(alpha[-1][:, None] + field.trans).sum(0)) + emit[t])
        beta = [field.end]
        for t in range(len(emit) - 1, 0, -1):
            beta.insert(0, np.log(np.exp(field.trans + emit[t] + beta[0]).sum(1)))
        soft = np.exp(np.array(alpha) + np.array(beta))
        chance = soft[:, 1] / soft.sum(1)
        total = chance[chance >= toxicity.LEAST_PART].sum()
        inputs = [1.0, chance.max(), np.log1p(total), np.log1p(1000 * total / len(words))]
        assert row["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(model.weights @ inputs, -30, 30))))
        assert len(row["offences"]) == (chance >= toxicity.OFFENCE).sum() and scorer is not None


def test_toxicity_of_unlisted_words(spark):
    """Words that no training document has are tagged by their form."""
    rng = random.Random(29)
    rows = []
    for i in range(300):
        words = fixtures.prose(rng, 30).split()
        if i % 2 == 0:
            words.insert(rng.randint(0, 20), "xq" + "".join(rng.choice("aeiou") for _ in range(5)) + "zz")
            words.insert(rng.randint(0, 20), "xqzz")
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("toxic")))
    new = "xqzzandmorezz"
    assert new not in model.lexicon
    tokens, _ = toxicity.Scorer(model).tokens(["there " * 10 + new + " there" * 10, "there " * 21])
    assert tokens[0][10] > 3 * tokens[1].max()


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="needs the driver's tables")
def test_toxicity_held_out(spark):
    """On the driver's tables: better than any hit in the lexicon."""
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")
    docs, labels = read("documents"), read("labels")
    model = toxicity.fit(docs, labels.filter(~toxicity.held_out()))
    held = labels.filter(toxicity.held_out()).select("doc_id", "toxic").dropDuplicates(["doc_id"])
    some = docs.join(held, "doc_id")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(some, model).collect()}
    rows = some.select("doc_id", "toxic", "text").collect()
    right = np.mean([(scores[r["doc_id"]] >= toxicity.THRESHOLD) == bool(r["toxic"]) for r in rows])
    hit = np.mean([bool(toxicity.entries(toxicity.lowered(r["text"] or "")) & model.lexicon) == bool(r["toxic"]) for r in rows])
    assert right > 0.98 and right > hit


# ---- pages --------------------------------------------------------------------------------------------------------


def text_of(html):
    return " ".join(x.text for x in html_text.own(html_text.parse(html)))


def test_markup():
    assert text_of("<p>a<b>b</b>c <i>d</i><br>e<p>f&amp;&lt;&#233;&nbsp; g") == "abc d e f&<é g"
    assert text_of("<article><h1>T</h1><p>one<p>two</article><footer>f</footer>") == "T one two"
    assert text_of('<script>var a="</p><p>x";</script><style>p{}</style><!-- <p>c</p> --><p title="a>b">t</p>') == "t"
    assert text_of("<nav><a href=x>m</a></nav><div class='side sidebar-left'>s</div><main><div>x<form><input>y</form></div></main>") == "x"
    assert text_of('<article><p>body</p><div class="comments"><article><p>long long comment</p></article></div><aside>z</aside></article>') == "body"
    assert text_of('<article>a<div class="ad">buy</div><div id="cookie-notice">c</div><div role="complementary">d</div>b</article>') == "a b"
    assert text_of("<header>site</header><p>text</p><ul><li><a href=1>one</a><li><a href=2>two</a></ul>") == "text"
    assert text_of("a < b and <p>c") == "a < b and c"
    assert text_of("") == "" and text_of("<p>  </p>") == "" and text_of("<article><p>cut off <b") == "cut off"
    assert text_of("<ul><li>one<li>two</ul><table><tr><td>x<td>y</table>") == "one two x y"
    assert text_of("<p>" * 3000 + "deep") == "deep"
    assert text_of("<div>" * 3000 + "deep") == "deep"


def test_classes_are_a_prior_alone():
    """Names of paragraphs and headings never bar them, nor names that only begin like one."""
    inside = '<h2 class="section-header">h</h2><p class="alert">a</p><p class="share-price">p</p><div id="related-work">r</div>'
    assert text_of(f"<article><p>{'text ' * 9}</p>{inside}</article>") == "text " * 9 + "h a p r"
    assert text_of(f"<div class=x><p>{'text ' * 9}</p><div class='ad'>buy</div></div>") == ("text " * 9).strip()
    assert text_of(f"<div class='widget'><p>{'text ' * 9}</p></div><p>b</p>") == "text " * 9 + "b"  # most of the text


def brute_match(a, b):
    """Simple tree matching by its definition."""
    if a.label != b.label:
        return 0
    if a.tag == "#":
        return 2 if a.text == b.text else 1
    best = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children):
        for j, y in enumerate(b.children):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + brute_match(x, y))
    return 1 + best[-1][-1]


def weight_of(a, b, found):
    """The weight of an alignment, which must keep labels, parents and order."""
    other = {x.index: (x, above) for x, above in html_text.walk(b)}
    total, last = 0, -1
    for x, above in html_text.walk(a):
        if id(x) in found:
            y, parent = other[found[id(x)]]
            assert x.label == y.label and (above is None or found[id(above)] == parent.index) and y.index > last
            total, last = total + (2 if x.tag == "#" and x.text == y.text else 1), y.index
    return total


@pytest.mark.parametrize("cells", [1 << 22, 6])
def test_matching_is_exact(monkeypatch, cells):
    monkeypatch.setattr(html_text, "CELLS", cells)
    rng = random.Random(21)

    def page(depth=0):
        out = ""
        for _ in range(rng.randint(0, 4 if depth < 3 else 0)):
            tag = rng.choice(["div", "ul", "section"])
            out += rng.choice([f"<p>{rng.choice('xyz')}</p>", f"<{tag}>{rng.choice('uv')}</{tag}>", f"<{tag}>{page(depth + 1)}</{tag}>", f"<p>{rng.choice('xyz')}</p>"])
        return out

    for _ in range(300):
        a, b = html_text.parse(page()), html_text.exemplar(page())
        want = brute_match(a, b)
        assert html_text.Matcher()(a, b) == want and weight_of(a, b, html_text.align(a, b)) == want


def test_matching_of_deep_and_long_pages():
    a, b = html_text.parse("<div>" * 5000 + "deep"), html_text.exemplar("<div>" * 5000 + "down")
    assert len(html_text.align(a, b)) == 5002
    long = html_text.exemplar("".join(f"<p>{k}</p>" for k in range(4000)))
    found = html_text.align(html_text.parse("".join(f"<p>{k}</p>" for k in range(1, 4001) if k % 100)), long)
    assert len(found) == 1 + 2 * 3960


def plain_pages(count, host="c.example"):
    """Pages without any tag or class that tells: menu, teaser, article, legal line."""
    rng = random.Random(5)
    words = lambda n: " ".join(rng.choice(["stone", "river", "green", "walk", "light", "paper", "seven"]) + str(rng.randint(0, 99)) for _ in range(n))
    rows, want = [], {}
    for i in range(count):
        text = [words(12) for _ in range(rng.randint(2, 5))]
        prose = "".join(f"<p>{x}</p>" for x in text)
        html = f"<body><div class='k1'><div>Home of all things we sell</div><div>{words(2)}</div></div><div class='k2'><p>Written by our staff</p>{prose}<div>Tell us what you think of this</div></div><div class='k3'>All of it is ours</div></body>"
        rows.append((i, f"http://{host}/{i}", html))
        want[i] = " ".join(text)
    return rows, want


def test_the_wrapper_decides(spark, monkeypatch):
    """Without templates and regions from aligned pages the boilerplate stays: nothing else tells it."""
    rows, want = plain_pages(30)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_text.extract_text(pages).collect()} == want
    without = {r["page_id"]: r["text"] for r in html_text.extract_text(pages, least=1000).collect()}
    assert all(without[i] != want[i] and "Written by our staff" in without[i] for i in want)


def test_layouts_of_a_host_have_their_own_wrappers(spark):
    first, want = plain_pages(12)
    second = [(100 + i, f"http://c.example/b{i}", f"<body><section class=z><h1>Part {i}</h1><p>line {i} and more of it</p><p>Thanks for reading us</p></section></body>") for i in range(9)]
    pages = spark.createDataFrame(first + second, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(pages).collect()}
    assert got == want | {100 + i: f"Part {i} line {i} and more of it" for i in range(9)}


def test_copies_on_a_host_keep_their_text(spark):
    rows = [(i, f"http://d.example/{i}", f"<article><p>{'the same long paragraph ' * 5}</p><p>end {i}</p></article>") for i in range(5)]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: "the same long paragraph " * 5 + f"end {i}" for i in range(5)}


def test_pages(spark):
    rows, want = [], {}
    for i in range(40):
        body = "".join(f"<p>text {i} {k}</p>" for k in range(1 + i % 4))
        rows.append((i, f"http://a.example/{i}", f"<html><body><article><h1>Title {i}</h1>{body}<p>Read more on our site.</p></article></body></html>", "x"))
        want[i] = " ".join([f"Title {i}", *(f"text {i} {k}" for k in range(1 + i % 4))])
    for i in range(40, 42):  # too few pages to tell
        rows.append((i, f"https://b.example/{i}", f"<article><p>Same</p><p>n {i}</p></article>", None))
        want[i] = f"Same n {i}"
    rows += [(50, None, "<p>no url</p>", None), (51, "http://a.example/x", None, None), (52, "http://a.example/y", "", None), (0, *rows[0][1:])]
    want |= {50: "no url", 51: "", 52: ""}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = html_text.extract_text(pages).collect()
    assert len(got) == len(rows) and {r["page_id"]: r["text"] for r in got} == want
    assert html_text.extract_text(pages.limit(0)).collect() == []


def test_pages_without_broadcast(spark, monkeypatch):
    rows = [(i, f"http://a.example/{i}", f"<p>text {i}</p><p>always</p>") for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    monkeypatch.setattr(html_text, "BROADCAST_BYTES", -1)
    assert {r["page_id"]: r["text"] for r in html_text.extract_text(pages).collect()} == {i: f"text {i}" for i in range(12)}


@pytest.mark.parametrize("most", [1 << 24, -1])
def test_template_takes_its_own_text_alone(spark, monkeypatch, most):
    page = lambda *paragraphs: f"<article>{''.join(f'<p>{x}</p>' for x in paragraphs)}</article>"
    rows = [(i, f"http://a.example/{i}", page(f"text {i}", "Read more on our site.")) for i in range(60)]
    rows += [(60, "http://a.example/60", page("text 60", "Other words.")), (61, "http://a.example/61", page("text 61", "One more paragraph."))]
    monkeypatch.setattr(html_text, "BROADCAST_BYTES", most)
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want = {i: f"text {i}" for i in range(60)} | {60: "text 60 Other words.", 61: "text 61 One more paragraph."}
    assert {r["page_id"]: r["text"] for r in got} == want
