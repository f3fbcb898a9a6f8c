"""Registered queries of the operators: ``name -> (spark, sf_dir) -> DataFrame``, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_dir
from . import (alignment, bpe, decontaminate, host_reputation, host_rules, langid, licences, middles, quality, quotes, simhash, suffixes,
               token_files)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    """Path of a public tokenizer's file; the files stay where they are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_licences(spark, d):
    return licences.licences_of(_table(spark, d, "documents"))


def op2_bpe(spark, d):
    return bpe.token_digests(_table(spark, d, "documents"), _vocabulary("byte_bpe_50k.json"))


def op3_quotes(spark, d):
    return quotes.link(_table(spark, d, "conversations"))


def op4_host_reputation(spark, d):
    return host_reputation.judge_labelled(_table(spark, d, "pages"), _table(spark, d, "labels"))


def op5_decontaminate(spark, d):
    return decontaminate.leaks(_table(spark, d, "documents"), _table(spark, d, "benchmark"))


def op6_language_id(spark, d):
    return langid.languages_of(_table(spark, d, "documents"))


def op7_suffix_dedup(spark, d):
    return suffixes.repeat_digests(_table(spark, d, "documents"))


def op8_simhash(spark, d):
    return simhash.near_duplicates(_table(spark, d, "documents")).select("doc_id", "fingerprint", "component_id")


def op9_host_rules(spark, d):
    return host_rules.judge(_table(spark, d, "documents"))


def op10_token_files(spark, d):
    folder = scratch_dir(spark, "token_files")
    token_files.write(_table(spark, d, "documents").select("doc_id", "text"), folder, _vocabulary("word_bpe_49k.json"))
    return token_files.positions(spark, folder)


def op11_alignment(spark, d):
    return alignment.digests(_table(spark, d, "documents"), _vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model"))


def op12_middles(spark, d):
    return middles.round_trips(_table(spark, d, "documents"))


def op13_quality(spark, d):
    return quality.judge(_table(spark, d, "documents"), _table(spark, d, "labels"))


QUERIES = {f.__name__: f for f in (op1_licences, op2_bpe, op3_quotes, op4_host_reputation, op5_decontaminate, op6_language_id,
                                   op7_suffix_dedup, op8_simhash, op9_host_rules, op10_token_files, op11_alignment, op12_middles,
                                   op13_quality)}

#: DuckDB SQL of the queries that SQL can express; tests hold the others against brute force.
ORACLE: dict[str, str] = {
    "op3_quotes": quotes.SQL,
    "op4_host_reputation": host_reputation.SQL,
    "op9_host_rules": host_rules.SQL,
    "op12_middles": middles.SQL,
}
