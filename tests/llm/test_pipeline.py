import fixtures
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from seqloom import session
from seqloom.llm import exact_dedup, pii


def test_stages(spark, tmp_path):
    rows = fixtures.documents()
    rows.append((3000, "Write to a.b@c.example today, dear Mr. Smith, about the shining stone path.", "en", "s", 72, 0.0, "", "", 0, ""))
    fixtures.stored(spark, tmp_path, rows)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, counts = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"{k}.parquet"))
        docs = spark.read.parquet(str(tmp_path / f"{k}.parquet"))
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == columns
    known, exact, near, private, packed = (spark.read.parquet(str(tmp_path / f"{k}.parquet")) for k in range(5))
    assert all(r["text"] and any(c.isalpha() for c in r["text"]) for r in known.collect())
    texts = [r["text"] for r in exact.collect()]
    squeezed = ["".join(t.split()) for t in texts]
    assert len(set(squeezed)) == len(squeezed) == len({"".join(r["text"].split()) for r in known.collect()})
    assert len([t for t in (r["text"] for r in near.collect()) if "changed" in t]) <= 1
    last = {r["doc_id"]: r for r in private.collect()}[3000]
    assert last["text"].startswith("Write to <email> today, dear Mr. <person>,") and last["n_chars"] == len(last["text"])
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in private.collect()}
    assert corpus_pipeline.ORACLE_SQL is None and exact_dedup.SQL and pii.KINDS


def test_run_is_the_stages(spark, tmp_path):
    fixtures.stored(spark, tmp_path)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)


def test_arrow_batches_are_bounded_by_bytes(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    try:
        spark.conf.unset(name)
        session.ship(spark)
        found = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("x"), 40_000).alias("text")).mapInArrow(sizes, "n long").collect()
        assert sum(r["n"] for r in found) >= 400 * 40_000 and max(r["n"] for r in found) <= (8 << 20) + 50_000
        spark.conf.set(name, "1m")  # a smaller bound stays
        session.ship(spark)
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.set(name, before)
