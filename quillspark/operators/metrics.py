"""Measures of detectors over clips and sessions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.numbers import per_hour
from quillspark.operators.tables import Written


def pooled_rate(sessions: DataFrame, by: list[str], count: str, seconds: str) -> DataFrame:
    """Events an hour over all sessions of a group: a ratio of sums, not a mean of ratios."""
    return sessions.groupBy(*by).agg(F.count("*").alias("n_sessions"), F.sum(count).alias("n"), F.sum(seconds).alias("seconds"), per_hour(F.sum(count), F.sum(seconds)).alias("per_hour"))


def recall(results: DataFrame, by: str, ok: str) -> DataFrame:
    """Share of true by category; nulls don't count."""
    return results.groupBy(by).agg(F.avg(F.col(ok).cast("int")).alias("recall"), F.count(ok).alias("n_checked"))


def best_of_clips(windows: DataFrame, clip: list[str], score: str) -> DataFrame:
    """The highest score of each clip's windows."""
    return windows.groupBy(*clip).agg(F.max(score).alias("best"))


def expected_hits(windows: DataFrame, clip: str, score: str, threshold: float) -> DataFrame:
    """Sum over clips of the share of their phases that score the threshold or more."""
    each = windows.groupBy(clip).agg(F.avg((F.col(score) >= threshold).cast("int")).alias("share"))
    return each.agg(F.sum("share").alias("expected"), F.count("*").alias("n_clips"))


def lag_window(cuts: DataFrame, clip: str, cut: str, score: str, base: str, span: int = 100) -> DataFrame:
    """The lags all clips allow: each clip's is its last cut before the first that scores under half its base; from the largest to the smallest and a span."""
    half = F.col(score) >= 0.5 * F.col(base)
    miss = cuts.groupBy(clip).agg(F.min(F.when(~half, F.col(cut))).alias("miss"))
    lags = cuts.join(miss, clip).where(half & (F.col("miss").isNull() | (F.col(cut) < F.col("miss")))).groupBy(clip).agg(F.max(cut).alias("lag"))
    out = lags.agg(F.max("lag").alias("low"), (F.min("lag") + span).alias("high"), F.count("*").alias("n_clips"))
    return out.withColumn("feasible", F.col("low") <= F.col("high"))


def active_frames(frames: DataFrame, clip: str, index: str, level: str, within: float) -> DataFrame:
    """First and last frame whose level is within so many decibels of the clip's highest, and how many are."""
    top = frames.groupBy(clip).agg(F.max(level).alias("_top"))
    near = frames.join(top, clip).where(F.col(level) >= F.col("_top") - within)
    return near.groupBy(clip).agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count("*").alias("n"))


def within_hold(rows: DataFrame, key: str, time: str, order: list[str], holds: Column, seconds: int) -> DataFrame:
    """Rows whose predecessor holds a question that hasn't expired, the bound included (T15). time is in microseconds."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = rows.withColumn("_held", F.lag(holds).over(w)).withColumn("_at", F.lag(time).over(w))
    return marked.where(F.coalesce("_held", F.lit(False)) & (F.col(time) - F.col("_at") <= seconds * 1_000_000)).drop("_held", "_at")


def near_phrase(phones: Column, target: Column, sizes: tuple[int, ...] = (3, 4, 5), most: int = 1) -> Column:
    """Whether a run of phones, a character each, is within some edits of a target."""
    parts = [_runs(phones, n) for n in sizes]
    return F.exists(F.concat(*parts), lambda p: F.levenshtein(p, target) <= most)


def _runs(phones: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(phones) - n + 1, F.lit(1))), lambda i: phones.substr(i, F.lit(n)))


def status_counts(results: DataFrame, status: str = "status", strict: bool = False) -> DataFrame:
    """Total and number of passed, failed, skipped and error; strict counts an empty run as an error."""
    n = lambda kind: F.count_if(F.col(status) == kind)
    empty = F.when(F.lit(strict) & (F.count("*") == 0), 1).otherwise(0)
    return results.agg(F.count("*").alias("total"), *(n(k).alias(k) for k in ("passed", "failed", "skipped")), (n("error") + empty).alias("errors"))


def background_rate(reports: DataFrame, background: list[str], category: str = "category", seconds: str = "seconds", activations: str = "activations") -> DataFrame:
    """Seconds of the background categories, their activations, and activations an hour (A8, A10). activations: an array for each report."""
    quiet = F.col(category).isin(background)
    n, total = F.sum(F.when(quiet, F.size(activations)).otherwise(0)), F.sum(F.when(quiet, F.col(seconds)).otherwise(0.0))
    return reports.agg(total.alias("background_seconds"), n.cast("long").alias("n_activations"), per_hour(n, total).alias("per_hour"))


def wake_evaluation(results: DataFrame, background: list[str], strict: bool = False) -> DataFrame:
    """The summary of an evaluation run in one row: counts by status, background seconds and activations an hour (Q7)."""
    return status_counts(results, strict=strict).crossJoin(background_rate(results, background))


def blockers(rules: dict[str, Column]) -> Column:
    """The names of the rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())))


def verdict(rules: dict[str, tuple[str, Column]]) -> Column:
    """PASS, SKIP or FAIL with the reason of the first rule that holds, as "FAIL: reason"; PASS if none does (P20)."""
    out = F.lit("PASS")
    for reason, (kind, rule) in reversed(rules.items()):
        out = F.when(F.coalesce(rule, F.lit(False)), F.lit(f"{kind}: {reason}")).otherwise(out)
    return out


def pooled_windows(rows: DataFrame, key: str, place: str, vector: str, width: int = 16, block: int = 4096) -> DataFrame:
    """key, place and pooled: means and then population deviations, dimension by dimension, of a row's vector and those before it, width at most.

    place numbers a stream's rows one by one. Rows are pooled in blocks of places, each with the
    width - 1 rows before it, so a long stream is many tasks; inside a block they come from
    running sums of vectors less the block's mean, which keeps the differences exact. Vectors of
    a stream have one length; a stream's null vectors aren't allowed.
    """
    name = rows.schema[key]
    at = F.floor(F.col(place) / block)
    sent = rows.select(F.col(key).alias("key"), F.col(place).cast("long").alias("place"), F.transform(vector, lambda x: x.cast("double")).alias("vector"), F.explode(F.sequence(at, F.floor((F.col(place) + width - 1) / block))).alias("block"))

    def pool(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        places, number = pdf["place"].to_numpy(), int(pdf["block"].iloc[0])
        values = np.stack(pdf["vector"].to_numpy()).astype(float)
        middle = values.mean(axis=0)
        values -= middle
        sums = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0)])
        squares = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values**2, axis=0)])
        ends = np.flatnonzero(places >= number * block) + 1
        starts = np.maximum(ends - width, 0)
        n = (ends - starts)[:, None]
        mean = (sums[ends] - sums[starts]) / n
        deviation = np.sqrt(np.maximum((squares[ends] - squares[starts]) / n - mean**2, 0))
        return pd.DataFrame({"key": pd.Series([pdf["key"].iloc[0]] * len(ends), dtype=object), "place": places[ends - 1], "pooled": pd.Series(np.hstack([mean + middle, deviation]).tolist(), dtype=object)})

    kind = name.dataType.simpleString()
    return sent.groupBy("key", "block").applyInPandas(pool, f"key {kind}, place bigint, pooled array<double>").select(F.col("key").alias(key), F.col("place").alias(place), "pooled")


def _one_less(text: Column) -> Column:
    """A text and all that deleting one of its characters leaves; two texts within one edit of each other have one of these in common."""
    n = F.length(text)
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(text.substr(F.lit(1), i - 1), text.substr(i + 1, n)))
    return F.array_distinct(F.concat(F.array(text), cut))


#: Pairs of a word's phones and a target up to which each task gets them all.
LISTED_PAIRS = 100_000


def near_targets(words: DataFrame, targets: DataFrame, key: str, phones: str, target: str, sizes: tuple[int, ...] = (3, 4, 5)) -> DataFrame:
    """key and target of every pair in which a run of the word's phones, a character each and as many as sizes tell, is within one edit of the target.

    Equal words are worked out once. Their runs and the targets meet by what one deletion leaves, each distinct run once, and are
    compared where they meet; never every word with every target. Runs are never broadcast, whatever the estimated size of the
    words that they are made from. Nulls and empty targets meet nothing.
    """
    texts = words.select(F.col(phones).alias("_phones")).distinct()
    runs = texts.select("_phones", F.explode(F.array_distinct(F.concat(*(_runs(F.col("_phones"), n) for n in sizes)))).alias("_run")).where(F.length("_run").isin(list(sizes)))  # a shorter word has no run
    marks = targets.select(F.col(target).alias("_target")).where(F.length("_target") > 0).distinct()
    left = runs.select("_run").distinct().withColumn("_part", F.explode(_one_less(F.col("_run"))))
    met = left.hint("merge").join(marks.withColumn("_part", F.explode(_one_less(F.col("_target")))), "_part").select("_run", "_target").distinct()
    near = met.where(F.levenshtein("_run", "_target") <= 1)
    pairs = Written(runs.hint("merge").join(near, "_run").select("_phones", "_target").distinct(), "near").df
    each = words.select(key, F.col(phones).alias("_phones"))
    if pairs.count() <= LISTED_PAIRS:  # a key's rows then stay where they are made
        found = each.repartition(key).join(F.broadcast(pairs), "_phones")
    else:
        found = each.hint("merge").join(pairs, "_phones")
    return found.select(key, F.col("_target").alias(target)).distinct()
