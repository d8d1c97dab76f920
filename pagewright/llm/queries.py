"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import archives, bpe, conversations, divergence, embed_dedup, html_text, jaccard, mixing, oracles, quality, suffix_dedup, token_files, toxicity, url_filter
from pagewright.llm.common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.links(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.texts(table(spark, sf_dir, "pages"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.links(table(spark, sf_dir, "embeddings"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_damaged(table(spark, sf_dir, "conversations"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_packaged_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.round_trip(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    operators = (
        op1_mix_sources, op2_quality_rules, op3_suffix_dedup, op4_toxicity, op5_ngram_jaccard, op6_byte_bpe, op7_html_text, op8_url_filter, op9_embedding_dedup, op10_token_files,
        op11_conversation_repair, op12_source_divergence, op13_packaged_warc,
    )
    return {f.__name__: f for f in operators}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mix_sources": oracles.MIX_SOURCES,
        "op2_quality_rules": oracles.QUALITY_RULES,
        "op3_suffix_dedup": oracles.SUFFIX_DEDUP,
        "op5_ngram_jaccard": oracles.NGRAM_JACCARD,
        "op9_embedding_dedup": oracles.EMBEDDING_DEDUP,
        "op11_conversation_repair": oracles.CONVERSATION_REPAIR,
        "op12_source_divergence": oracles.SOURCE_DIVERGENCE,
        "op13_packaged_warc": oracles.PACKAGED_PAGES,
    }
