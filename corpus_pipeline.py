"""Corpus pipeline: language, near-duplicates, repeated passages, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
result as Parquet to the shared folder and reads it back as the next stage's input.
All but the last return the columns of ``documents``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ownerlens.llm import bpe, chunks, langid, leaks, simhash
from ownerlens.session import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a recognised language; ``lang`` becomes the predicted one.

    Texts that are null, have no letter or tie between two languages go.
    """
    model = langid.train(docs)
    known = langid.predict(docs, model, tuple(COLUMNS)).filter((F.col("lang_pred") != langid.UNKNOWN) & ~F.col("ambiguous"))
    return known.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of every near-duplicate group; of equal rows, one."""
    return simhash.one_of_each(docs).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take passages out of all but the first document that holds them; ``n_chars`` follows the text."""
    left = chunks.remove(docs, materialise(chunks.repeated_passages(docs), "passages"))
    return left.select("doc_id", "text", "lang", "source", F.when(F.col("text").isNotNull(), F.length("text").cast("bigint")).alias("n_chars"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold benchmark questions."""
    found = leaks.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return leaks.clean(docs, materialise(found, "leaks")).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digests of the ids and of the bytes decoded from them."""
    return bpe.digests(docs, with_ids=True)


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("token_ids", token_ids),
]

#: Hashing, trained classifiers and merges are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
