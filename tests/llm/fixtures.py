"""Documents with the hard cases: nulls, empty and long texts, ties, repeated rows, columns with clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row_id string, spans string, salt int, ids string"


def prose(rng, n, letters="etaoinshr"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(n))


def documents():
    rng = random.Random(11)
    texts = [None, "", " \t\r\n", "\x0b\x0c", "One two", "Onetwo", " One two ", "one two", "é́ 中文 don't 🎉\n\n x", "a" * 3000, "ab " * 4000, "%%% ### 123", "\x1c\x85 a"]
    base = prose(rng, 300)
    texts += [base, base + " ", base.replace(" ", "\n", 3), base.upper(), base + " tail"]
    words = base.split()
    for k in range(12):
        copy = list(words)
        copy[10 + 20 * k] = "changed"
        texts.append(" ".join(copy))
    texts += [prose(rng, rng.randint(1, 200)) for _ in range(40)]
    texts += [prose(rng, 30, "äöüßschein") for _ in range(10)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(4, "One two"), (1000, base), (None, "no id at all, but a text"), (-5, "One two")]
    return [(i, t, "de" if t and "ß" in t else "en", None, 0, 1.5, "x", "y", 3, "z") for i, t in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def stored(spark, tmp_path, rows=None):
    path = str(tmp_path / "documents.parquet")
    frame(spark, rows).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
