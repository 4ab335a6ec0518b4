"""Labelled corpora: hash audits, duplicates, splits, leakage, labelling counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.numbers import stable_fraction

def label_conflicts(entries: DataFrame, digest: str, label: str) -> DataFrame:
    """All members of hashes that carry more than one label (A14). The labels of a hash are counted before they meet its members."""
    labels = entries.where(F.col(label).isNotNull() & F.col(digest).isNotNull()).groupBy(digest, label).agg(F.count("*").alias("n"))
    bad = labels.groupBy(digest).agg(F.array_sort(F.collect_list(label)).alias("labels")).where(F.size("labels") > 1)
    return entries.join(bad, digest)


def duplicates(entries: DataFrame, digest: str, path: str, pinned: Column) -> DataFrame:
    """Copies to remove with the one kept: pinned ones first, then the smallest path; pinned copies stay."""
    rank = F.struct((~pinned).cast("int").alias("loose"), F.col(path).alias("p"))
    keep = entries.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.min(rank).alias("kept"), F.count("*").alias("n")).where("n > 1")
    joined = entries.withColumn("_pinned", pinned).join(keep, digest)
    return joined.where(~F.col("_pinned") & (F.col(path) != F.col("kept.p"))).select(*entries.columns, F.col("kept.p").alias("retained_copy"))


def first_seen(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key in input order."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*(c for c in rows.columns if c not in keys)), F.col(order)).alias("r")).select(*keys, "r.*")


def assign_splits(sessions: DataFrame, key: str, seed: int, eval_fraction: float, holdouts: DataFrame | None = None) -> DataFrame:
    """Distinct sessions with a split: holdout if requested, else eval below a stable fraction, else train."""
    ids = sessions.select(key).where(F.col(key).isNotNull()).distinct()
    ids = ids.join(holdouts.select(key).distinct().withColumn("held", F.lit(True)), key, "left") if holdouts is not None else ids.withColumn("held", F.lit(None).cast("boolean"))
    split = F.when(F.coalesce("held", F.lit(False)), "holdout").when(stable_fraction(F.col(key), seed) < eval_fraction, "eval").otherwise("train")
    return ids.select(key, split.alias("split"))


def merge_splits(stored: DataFrame, sessions: DataFrame, key: str, seed: int, eval_fraction: float, holdouts: DataFrame) -> DataFrame:
    """Splits after new sessions and holdouts: a requested holdout overrides, a stored split stays, the rest is assigned."""
    fresh = assign_splits(sessions.select(key).unionByName(holdouts.select(key)), key, seed, eval_fraction, holdouts)
    both = stored.select(key, F.col("split").alias("old")).join(fresh, key, "full_outer")
    return both.select(key, F.when(F.col("split") == "holdout", F.col("split")).otherwise(F.coalesce("old", "split")).alias("split"))


def leaking(train: DataFrame, evaluation: DataFrame, key: str) -> DataFrame:
    """Keys on both sides; must be empty."""
    return train.select(key).intersect(evaluation.select(key))


def without(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """rows whose key isn't in other."""
    return rows.join(other.select(key).distinct(), key, "left_anti")


def _whole(phrases: list[str]) -> str:
    return r"\b(" + "|".join(phrases) + r")\b"


def transcript_class(text: Column, phrase: str, terms: list[str]) -> Column:
    """excluded if a transcript holds the phrase itself, hard_negative if one of the terms like it, else false_positive (P13). Phrase and terms in upper case."""
    upper = F.upper(text)
    return F.when(upper.rlike(_whole([phrase])), "excluded").when(upper.rlike(_whole(terms)), "hard_negative").otherwise("false_positive")


def transcript_terms(text: Column, phrase: str, terms: list[str]) -> Column:
    """The sorted distinct terms that decide the class."""
    upper = F.upper(text)
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(upper, F.lit(_whole(terms)), F.lit(1))))
    return F.when(upper.rlike(_whole([phrase])), F.array(F.lit(phrase))).otherwise(found)


def fired_said(fired: Column, said: Column) -> Column:
    """wake, false_positive, missed_wake or near_miss."""
    return F.when(fired & said, "wake").when(fired, "false_positive").when(said, "missed_wake").otherwise("near_miss")


def top_per_class(rows: DataFrame, kind: str, score: str, key: str, n: int) -> DataFrame:
    """The n best of each class (L3)."""
    w = Window.partitionBy(kind).orderBy(F.col(score).desc(), key)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def sample_by_hash(rows: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """n rows by a seeded hash of the key: a sample that doesn't depend on order or partitions."""
    return rows.orderBy(F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256), key).limit(n)


def capped_weak(rows: DataFrame, weak: Column, order: str, share: float, slices: int = 4096) -> DataFrame:
    """All strong rows, and of the weak ones the first, at most max(1, share of all) (L10). order: a number, distinct for each row.

    Slices of the order are counted to find the one in which the cut lies; only that slice is ranked.
    """
    few = F.greatest(F.floor(F.count("*") * share), F.lit(1)).alias("_allowed")
    ends = rows.agg(few, F.min(F.when(weak, F.col(order))).alias("_low"), F.max(F.when(weak, F.col(order))).alias("_high"))
    place = F.floor((F.col(order) - F.col("_low")) / (F.col("_high") - F.col("_low") + 1) * slices)
    weaker = rows.where(weak).crossJoin(F.broadcast(ends)).withColumn("_slice", F.coalesce(place, F.lit(-1)))
    cells = weaker.groupBy("_slice").agg(F.count("*").alias("_n"), F.first("_allowed").alias("_most"))
    until = F.sum("_n").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0))  # over the slices, not the rows
    cells = cells.withColumn("_left", F.col("_most") - until + F.col("_n")).where("_left > 0").select("_slice", "_n", "_left")
    kept = weaker.join(F.broadcast(cells), "_slice")
    whole = kept.where("_n <= _left").select(*rows.columns)
    cut = kept.where("_n > _left").withColumn("_rank", F.row_number().over(Window.partitionBy("_slice").orderBy(order)))
    return rows.where(~F.coalesce(weak, F.lit(False))).unionByName(whole).unionByName(cut.where("_rank <= _left").select(*rows.columns))


def within_caps(records: DataFrame, kind: str, order: list[str], size: str, per_class: int, most: int, most_bytes: int) -> DataFrame:
    """What a spool keeps in its steady state: the newest of each class, then the newest overall by number and bytes."""
    newest = [F.col(c).desc() for c in order]
    rows = records.withColumn("place", F.row_number().over(Window.partitionBy(kind).orderBy(*newest))).where(F.col("place") <= per_class).drop("place")
    overall = Window.orderBy(*newest)
    rows = rows.withColumn("place", F.row_number().over(overall)).withColumn("until", F.sum(size).over(overall.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where((F.col("place") <= most) & (F.col("until") <= most_bytes)).drop("place", "until")


def spool_summary(records: DataFrame, fired: Column, near: Column, label: str, score: str) -> DataFrame:
    """Counts and scores of a spool."""
    return records.agg(
        F.count("*").alias("n"),
        F.count_if(fired).alias("n_fired"),
        F.count_if(near).alias("n_near"),
        F.count(label).alias("n_labelled"),
        F.min(score).alias("least"),
        F.max(score).alias("most"),
        F.percentile(score, F.lit(0.5)).alias("middle"),
    )
