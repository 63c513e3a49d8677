"""The queries that apply the operators, with production parameters, to their whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import bpe, chat, exact_dedup, filter_audit, fixity, jaccard, packing, passages, quality, ranked_search, secrets, sharding, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), 8)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"))


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(_table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "common_distance", "base_failed", "kept")


def op5_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return fixity.audit(pages, fixity.damaged_copy(pages))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_report(_table(spark, sf_dir, "documents"))


def op8_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.conversation_digests(conversations.unionByName(extra))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_passages(_table(spark, sf_dir, "documents"), returns=("kept_sha256",))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Query]:
    """Every query of this subpackage by name."""
    return {f.__name__: f for f in (op1_jump_shards, op2_secret_scan, op3_bpe_codec, op4_quality_rules, op5_merkle_fixity, op6_jaccard_join, op7_exact_dedup, op8_chat_parts, op9_best_fit_packing, op10_substring_dedup, op11_ranked_search, op12_toxicity, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    return {
        "op4_quality_rules": quality.QUALITY_SQL,
        "op5_merkle_fixity": fixity.FIXITY_SQL,
        "op7_exact_dedup": exact_dedup.DEDUP_SQL,
        "op8_chat_parts": chat.CHAT_SQL,
        "op10_substring_dedup": passages.PASSAGES_SQL,
        "op11_ranked_search": ranked_search.SEARCH_SQL,
        "op13_filter_audit": filter_audit.FILTER_SQL,
    }
