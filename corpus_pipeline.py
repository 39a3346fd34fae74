"""A training corpus out of ``documents``: language ID, exact dedup, near-dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir), docs being what the stage before has written, and returns a DataFrame; all but
the last return the columns of ``documents``.  Texts change in one stage: personal data is replaced by its kind.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import exact_dedup, langid, packing, pii, simhash
from seqloom.session import release, scratch, ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null texts, texts without letters, texts that no learned language explains."""
    ship(spark)
    return langid.keep_known(docs, langid.fit(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of equal texts stays: the longest as written, then the smallest doc_id."""
    ship(spark)
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest doc_id."""
    ship(spark)
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the new text."""
    ship(spark)
    out = pii.mask_pii(docs)
    if "n_chars" in out.columns:
        kind = out.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(kind))
    return out


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in sequences of 4096 tokens."""
    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("pii", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: Learned models and tokenizers are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next."""
    docs = source = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scratch(spark) as keep:  # what a stage writes on its way goes when its result is written
            then = keep(stage(spark, docs, sf_dir))
        if docs is not source:
            release(docs)
        docs = then
    return STAGES[-1][1](spark, docs, sf_dir)
