"""Corpus pipeline: language ID, near-dedup, decontamination, PII masking, packing.

``STAGES`` lists the stages in order.  Each takes (spark, docs, sf_dir) and
returns a DataFrame; all but the last return the columns of ``documents``.  A
stage's result is written and read back before the next one starts, so each
works on all its predecessor kept and a lost executor rereads files."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparktab.llm import decontaminate, language_id, packing, pii, simhash
from sparktab.session import written


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: no text or no letter."""
    profiles = language_id.learn_profiles(docs, ~language_id.held_out(docs["doc_id"]))
    return language_id.known_language_only(docs, profiles)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of fingerprints linked at two bits or fewer."""
    return simhash.one_of_each_group(docs, shingle=3, max_bits=2, seed=42)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark passage, also with some words replaced."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts by its kind."""
    return pii.mask_pii(docs, pii.fit(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", keep_known_languages),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("pii", mask_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: SQL has neither the tokenizer nor the learned stages; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
