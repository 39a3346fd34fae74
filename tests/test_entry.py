from pathlib import Path

import duckdb
import pytest

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", ["doc_offsets", "kmer_table", "kmer_tokens", "zml", "mem", "move_rows", "color_similarity", "bin_max", "read_classes", "taxon_lca"])
def test_same_as_sql(spark, name):
    import __spark_entry__ as entry

    got = entry.queries()[name](spark, str(DATA))
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    want = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    rows = sorted(map(str, (tuple(r[names.index(c)] for c in sorted(names)) for r in want.fetchall())))
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, (tuple(r[c] for c in sorted(names)) for r in got.collect()))) == rows


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
