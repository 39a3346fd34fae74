from pathlib import Path

import duckdb
import pytest

from seqloom.llm import registry

DATA = Path("/root/testdata/sf0.001")
COLUMNS = {
    "op1_": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op2_": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op3_": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op4_": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op5_": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op6_": "page_id bigint, url string, text string, n_chars bigint",
    "op7_": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_": "query_id bigint, rank int, vec_id bigint, score double",
    "op9_": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op10_": "doc_id bigint, fingerprint string, component_id bigint",
}


def test_each_operator_has_one_query():
    assert sorted(k.split("_")[0] for k in registry.QUERIES) == sorted(p[:-1] for p in COLUMNS)
    assert set(registry.SQL) <= set(registry.QUERIES)


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_columns_and_rows(spark, name):
    found = registry.QUERIES[name](spark, str(DATA))
    kinds = dict(found.dtypes)
    for column in COLUMNS[name.split("_")[0] + "_"].split(", "):
        key, kind = column.split(" ")
        assert kinds[key] == kind, (name, key, kinds)
    rows = found.collect()
    table = {"op6_html_text": "pages", "op8_nearest_neighbours": "embeddings"}.get(name, "documents")
    there = spark.read.parquet(str(DATA / f"{table}.parquet")).count()
    if name.startswith("op1_"):
        assert len({r["doc_id"] for r in rows}) == there
    elif not name.startswith("op8_"):
        assert len(rows) == there
    for r in rows[:50]:
        if "score" in kinds and table == "documents":
            assert 0 <= r["score"] <= 1


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    want = con.execute(registry.SQL[name])
    names = [c[0] for c in want.description]
    got = registry.QUERIES[name](spark, str(DATA))
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, (tuple(r[c] for c in sorted(names)) for r in got.collect()))) == sorted(map(str, (tuple(r[names.index(c)] for c in sorted(names)) for r in want.fetchall())))
