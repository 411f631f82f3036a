"""Registered queries of this subpackage: ``opN_<name>`` and their DuckDB twins."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .oracles import MERKLE, TRIE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens
    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan_secrets
    return scan_secrets(documents(spark, sf_dir))


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import held_out, learn_profiles, predict_languages
    docs = documents(spark, sf_dir)
    return predict_languages(docs, learn_profiles(docs, ~held_out(docs["doc_id"])))


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack
    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates
    return near_duplicates(documents(spark, sf_dir), shingle=3, max_bits=2, seed=42)


@query
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks
    found = find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.drop("key").withColumn("item_id", found["item_id"].cast("long"))


@query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii, fit
    docs = documents(spark, sf_dir)
    return find_pii(docs, fit(docs))


@query
def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .code_search import top_k
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(rows, rows.where("vec_id % 100 = 0"), id_col="vec_id", vector_col="embedding", k=10)


ORACLES["op8_exact_top_k"] = """
WITH pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id AS neighbor_id,
         CAST(list_sum(list_transform(range(1, 1 + len(q.embedding)),
              lambda i: CASE WHEN (q.embedding[i] > 0) <> (r.embedding[i] > 0) THEN 1 ELSE 0 END)) AS INTEGER) AS distance
  FROM embeddings q, embeddings r WHERE q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank,
         neighbor_id, distance FROM pairs)
SELECT * FROM ranked WHERE rank <= 10
"""


@query
def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_chats
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@query
def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats
    return remove_repeats(documents(spark, sf_dir), length=400)


@query
def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import score_texts
    return score_texts(documents(spark, sf_dir))


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import verify_manifest
    return verify_manifest(documents(spark, sf_dir))


ORACLES["op12_merkle_manifest"] = MERKLE


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import prefix_trie
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLES["op13_prefix_trie"] = TRIE
