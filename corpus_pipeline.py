"""Corpus pipeline: language ID, near duplicates, repeated passages, benchmark leaks, token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet in the shared checkpoint folder and read again as the next
stage's ``docs``.  All stages but the last return the columns of ``documents``.
Repeated rows, nulls and extra columns are handled as the operators say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.llm import bpe, decontaminate, langid, simhash, suffixes
from strideframe.session import scratch_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language, a null ``lang`` filled in; texts that are null, without a letter or that
    no language codes in fewer than 8 bits a byte go."""
    return langid.identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the smallest id."""
    return simhash.representatives(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that repeated 200-byte strings cover."""
    return suffixes.without_repeats(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no item of ``benchmark`` leaked."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids (binary, little-endian unsigned 32-bit) of each document."""
    got = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return got.select("payload.doc_id", "payload.lang", "payload.source",
                      F.floor(F.length("ids") / 4).alias("n_tokens"), "ids")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("token_ids", token_ids),
]

#: No SQL for hashing, code lengths and merges; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = scratch_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
