"""Against known results of a known collection, where its files are at hand: environment variables name them.

GOLDEN_REFS: a FASTA file of references; GOLDEN_READS: reads; GOLDEN_LENGTHS: the sorted lines of their pseudo-matching
lengths; GOLDEN_RUNS and GOLDEN_SPLIT: the index's runs, and its rows when these are split at thresholds; GOLDEN_ABSENT: the
sorted lines of the reads that are not found.
"""

import argparse
import os

import pytest

from seqloom import cli
from seqloom.operators import classify, pml
from seqloom.plans.engine import Engine, Index
from seqloom.session import materialize
from seqloom.sources import fasta

pytestmark = pytest.mark.skipif("GOLDEN_REFS" not in os.environ, reason="no golden files are named")


@pytest.fixture(scope="module")
def engine(spark):
    refs = cli.references(spark, argparse.Namespace(fasta=os.environ["GOLDEN_REFS"], list=None, soft_mask="upper"))
    return Engine(Index(refs.select("doc_id", "part", "seq"), separators=False))


def test_runs_and_split_rows(engine):
    rows = engine.index.rows.select("row", "pos", "c", "run").toPandas()
    assert rows["run"].nunique() == int(os.environ["GOLDEN_RUNS"])
    assert pml.split_rows(rows) == int(os.environ["GOLDEN_SPLIT"])


def test_lengths(spark, engine):
    reads = materialize(fasta.read_reads(spark, os.environ["GOLDEN_READS"]).withColumnRenamed("name", "read_id"))
    lines = [x.rstrip() for r in fasta.lengths_text(engine.pml(reads)).collect() for x in r["value"].split("\n")]
    assert sorted(lines) == sorted(x.rstrip() for x in open(os.environ["GOLDEN_LENGTHS"]).read().split("\n") if x.strip())


def test_reads_that_are_not_found(spark, engine):
    reads = materialize(fasta.read_reads(spark, os.environ["GOLDEN_READS"]).withColumnRenamed("name", "read_id"))
    kept = classify.filtered(reads, engine.classify(reads), invert=True)
    lines = [x for r in fasta.fasta_text(kept).collect() for x in r["value"].split("\n")]
    assert sorted(lines) == sorted(x.rstrip() for x in open(os.environ["GOLDEN_ABSENT"]).read().split("\n") if x.strip())
