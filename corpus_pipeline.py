"""A corpus pipeline of five stages over documents; each works on all that the one before has kept.

Every stage is written as Parquet to the shared folder and read again, so a lost executor costs
no more than a stage's own work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, mixing, ngram_join, pii, quality
from quillspark.llm.common import Written, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    own = {f"column_{i}": c for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}  # so that none clashes with a measure
    named = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(k) for k, c in own.items()))
    kept = quality.judge(named, quality.trusted_ids(table(spark, sf_dir, "labels")), ("doc_id", "text", *own)).where("kept")
    back = {c: k for k, c in own.items()}
    return kept.select(*(F.col(back.get(c, c)).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id."""
    return ngram_join.drop_near_copies(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return pii.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix holds it."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")  # so that no column clashes with the mix's
    rows = Written(docs.select(F.monotonically_increasing_id().alias("row"), whole), "rows").df
    texts = rows.select("row", "doc.doc_id", "doc.source", "doc.text")
    mixed = mixing.mix(texts, mixing.quality_weights(table(spark, sf_dir, "labels")), keep=("row",)).where("copies > 0").select("row", "copies")
    each = rows.join(mixed, "row").select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select(*(F.col(f"doc.`{c}`").alias(c) for c in docs.columns))


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of every text, as counts and digests."""
    return bpe.op10(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("pii", personal_data),
    ("source_mixing", source_mix),
    ("bpe", bpe_tokens),
]
#: Hashed likelihood ratios, weighted sampling by Spark's hash and BPE have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        written = Written(stage(spark, docs, sf_dir), name)
        if before:
            before.drop()
        docs, before = written.df, written
    return STAGES[-1][1](spark, docs, sf_dir)
