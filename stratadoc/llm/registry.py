"""The corpus operators' queries, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratadoc.llm.shared import table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratadoc.llm.lm_score import score_documents

    return score_documents(spark, table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratadoc.llm.quality import score_quality

    return score_quality(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratadoc.llm.warc import page_digests

    return page_digests(spark, table(spark, sf_dir, "pages"))


def op4_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratadoc.llm.media_jpeg import media_digests

    return media_digests(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratadoc.llm.decontaminate import find_leaks

    return find_leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratadoc.llm.chat_format import conversation_digests

    return conversation_digests(spark, table(spark, sf_dir, "conversations"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratadoc.llm.packing import packed_pieces

    return packed_pieces(table(spark, sf_dir, "documents"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratadoc.llm.simhash_dedup import near_duplicates

    return near_duplicates(spark, table(spark, sf_dir, "documents"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratadoc.llm.token_store import token_digests

    return token_digests(spark, table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratadoc.llm.secret_scan import scan_documents, span_digests

    return span_digests(scan_documents(spark, table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_scoring, op2_quality_classifier, op3_warc_segments, op4_media_jpeg, op5_decontamination, op6_chat_format, op7_packing, op8_simhash_dedup, op9_token_store, op10_secret_scan)}


def oracle_sql() -> dict[str, str]:
    """None of the ten can be said in SQL on whole tables: each is tested against brute force instead."""
    return {}
