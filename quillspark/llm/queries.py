"""The thin queries of the training-data operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import bpe, chat_format, embedding_dedup, fill_middle, filter_audit, html_template, mixing, ngram_join, pii, quality, substring_dedup, token_counts, toxicity
from quillspark.llm.common import table


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.op1(table(spark, sf_dir, "conversations"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op2(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op3(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.op4(table(spark, sf_dir, "documents"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.op5(table(spark, sf_dir, "embeddings"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.op6(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op7(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op8(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.op9(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op10(table(spark, sf_dir, "documents"))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.op11(table(spark, sf_dir, "pages"))


def op12_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.op12(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.op13(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_formatting,
        op2_source_mixing,
        op3_quality_rules,
        op4_ngram_jaccard_join,
        op5_embedding_near_dedup,
        op6_substring_dedup,
        op7_toxicity,
        op8_pii,
        op9_token_counts,
        op10_bpe,
        op11_html_extraction,
        op12_filter_interaction,
        op13_fill_middle,
    )
}
ORACLES: dict[str, str] = {"op1_chat_formatting": chat_format.SQL, "op9_token_counts": token_counts.SQL, "op12_filter_interaction": filter_audit.SQL, "op13_fill_middle": fill_middle.SQL}
