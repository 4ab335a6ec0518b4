"""Capture records: their outcomes and sessions, listings, caps, label logs and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.detection import bucket_best


def with_transcripts(records: DataFrame, outcomes: DataFrame, key: str, order: str) -> DataFrame:
    """records with the transcript of their latest speech outcome, null if there is none (J4). outcomes: key, order, kind, transcript."""
    latest = outcomes.where("kind = 'stt'").groupBy(key).agg(F.max_by("transcript", order).alias("transcript"))
    return records.join(latest, key, "left")


def link_audit(commands: DataFrame, captures: DataFrame, link: str, key: str) -> DataFrame:
    """Commands with the capture they name, and captures that none names, each with a state (J5): linked, unknown_capture, without_capture or unused."""
    named = commands.select("command_id", F.col(link).alias("capture"))
    known = captures.select(F.col(key).alias("capture")).distinct().withColumn("found", F.lit(True))
    both = named.join(known, "capture", "full_outer")
    state = F.when(F.col("command_id").isNull(), "unused").when(F.col("capture").isNull(), "without_capture").when(F.col("found").isNull(), "unknown_capture").otherwise("linked")
    return both.select("command_id", "capture", state.alias("state"))


def train_labels(records: DataFrame, labels: list[str]) -> DataFrame:
    """Records that a person labelled with one of these labels (P5)."""
    return records.where(F.col("label").isin(labels) & F.col("labeled_at").isNotNull())


def session_examples(records: DataFrame, splits: DataFrame, key: str, labels: list[str]) -> DataFrame:
    """Labelled records with their session's split; records of sessions without one are left out."""
    return train_labels(records, labels).join(splits.select(key, "split").where("split IS NOT NULL").distinct(), key)


def with_sessions(records: DataFrame, sessions: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """records with columns of their session, null for an unknown one."""
    return records.join(sessions.select(key, *columns), key, "left")


def listing(records: DataFrame, score: str, key: str, limit: int, unreviewed: bool = False) -> DataFrame:
    """The best records, and in n_more how many the limit leaves out (L2). unreviewed: only those without a label."""
    if unreviewed:
        records = records.where(F.col("label").isNull())
    total = records.agg(F.count("*").alias("_total"))
    best = records.orderBy(F.col(score).desc(), key).limit(limit)
    return best.crossJoin(F.broadcast(total)).withColumn("n_more", F.greatest(F.col("_total") - limit, F.lit(0))).drop("_total")


def capped_best(rows: DataFrame, key: str, index: str, score: str, width: int, least: float, cap: int) -> DataFrame:
    """The best row of each bucket, and of these the best overall, up to a cap (L4)."""
    best = bucket_best(rows, key, index, score, width, least)
    return best.orderBy(F.col(score).desc(), F.col(key).desc(), F.col(index).desc()).limit(cap)


def review_order(names: DataFrame, suspect: str, name: str) -> DataFrame:
    """Names with their place: plain ones first, then short ones, then by letters without case."""
    return names.withColumn("place", F.row_number().over(Window.partitionBy("group").orderBy(suspect, F.length(name), F.lower(name), name)))


def loud_slices(slices: DataFrame, level: str, key: str, least: float, seed: str, n: int) -> DataFrame:
    """n slices above a level, by a seeded hash of their key in place of drawing until one is loud enough."""
    return slices.where(F.col(level) > least).orderBy(F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256), key).limit(n)


def pooled(sources: dict[str, DataFrame]) -> DataFrame:
    """All rows of several sources with their origin; a column that a source lacks is null."""
    out = None
    for origin, df in sources.items():
        one = df.withColumn("origin", F.lit(origin))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def within_budget(rows: DataFrame, by: list[str], order: str, limit: int) -> DataFrame:
    """The first rows of each key, as many as its budget."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return rows.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")


def class_report(records: DataFrame, fired: Column, said: Column, at: Column) -> DataFrame:
    """Number of each class, the hours all span, and the share of false positives among what fired."""
    return records.agg(
        F.count_if(fired & said).alias("n_wake"),
        F.count_if(fired & ~said).alias("n_false_positive"),
        F.count_if(~fired & said).alias("n_missed_wake"),
        F.count_if(~fired & ~said).alias("n_near_miss"),
        ((F.max(at) - F.min(at)) / 3_600_000_000).alias("span_hours"),
        F.try_divide(F.count_if(fired & ~said), F.count_if(fired)).alias("false_share"),
    )


def label_audit(records: DataFrame, by: str) -> DataFrame:
    """Labels by origin: positives, negatives and unlabelled, and positives that no person gave, which must be none."""
    positive, manual = F.coalesce(F.col("label") == "positive", F.lit(False)), F.col("labeled_at").isNotNull()
    return records.groupBy(by).agg(
        F.count_if(positive).alias("n_positive"), F.count_if(F.col("label") == "negative").alias("n_negative"), F.count_if(F.col("label").isNull()).alias("n_unlabelled"), F.count_if(positive & ~manual).alias("n_automatic_positive")
    )


def count_mismatches(sources: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """Classes whose number of sources and of features differ."""
    n = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    both = n(sources, "n_sources").join(n(features, "n_features"), key, "full_outer").fillna(0, ["n_sources", "n_features"])
    return both.where("n_sources <> n_features")


def relabelled(records: DataFrame, log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """records with the label of their last log entry, and when it was given; those without one keep theirs."""
    last = log.groupBy(key).agg(F.max_by(F.struct(F.col("label").alias("new"), F.col("labeled_at").alias("at")), F.struct(*order)).alias("_last"))
    joined = records.join(last, key, "left")
    pick = lambda new, old: F.when(F.col("_last").isNotNull(), F.col(new)).otherwise(F.col(old))
    return joined.withColumns({"label": pick("_last.new", "label"), "labeled_at": pick("_last.at", "labeled_at")}).drop("_last")


def context_bounds(start: Column, end: Column, before: int, after: int, length: Column) -> tuple[Column, Column]:
    """A window with its context, within the recording."""
    return F.greatest(start - before, F.lit(0)), F.least(end + after, length)


def teacher(label: Column, ambiguous: Column, clipped: Column, silent: Column, disagreed: Column, peak: Column, below: Column, trusted: list[str], quiet: int = 100, loud: int = 5000, very_loud: int = 8000) -> dict[str, Column]:
    """A label and the reason for it, by the first rule that holds: a person's label, what can't be told, then levels (P18). No rule gives a positive."""
    sure = lambda c: F.coalesce(c, F.lit(False))
    rules = [
        (sure(label.isin(trusted)), label, "trusted_manual"),
        (sure(ambiguous), None, "homophone_ambiguous"),
        (sure(clipped), None, "clipping"),
        (sure(silent), None, "empty_asr"),
        (sure(disagreed), None, "teacher_disagreement"),
        (peak < quiet, F.lit("negative"), "quiet_window"),
        ((peak >= very_loud) & sure(below), None, "uncertain_alignment"),
        (peak >= loud, None, "no_automatic_positive"),
    ]
    given, reason = F.lit("negative"), F.lit("conservative_negative")
    for rule, value, why in reversed(rules):
        given = F.when(rule, F.lit(None).cast("string") if value is None else value).otherwise(given)
        reason = F.when(rule, why).otherwise(reason)
    return {"label": given, "reason": reason}


def context_flags(windows: DataFrame, chunks: DataFrame, key: str, before: int, after: int, capacity: int, deadline_us: int) -> DataFrame:
    """windows (key, id, start, end, at) with whether the audio before them is gone from the ring, or the audio after them came too late.

    chunks (key, end, arrived) tell how far a stream had come at a time: a window's own end, and the deadline.
    """
    points = windows.select(key, "id", F.col("at").alias("time"), F.lit(1).alias("kind")).unionByName(windows.select(key, "id", (F.col("at") + deadline_us).alias("time"), F.lit(2).alias("kind")))
    marks = chunks.select(key, F.lit(None).cast("bigint").alias("id"), F.col("arrived").alias("time"), F.lit(0).alias("kind"), F.col("end").alias("reached"))
    both = points.withColumn("reached", F.lit(None).cast("bigint")).unionByName(marks)
    upto = F.max("reached").over(Window.partitionBy(key).orderBy("time", "kind").rowsBetween(Window.unboundedPreceding, 0))
    seen = both.withColumn("reached", F.coalesce(upto, F.lit(0))).where("kind > 0").groupBy(key, "id").agg(F.max(F.when(F.col("kind") == 1, F.col("reached"))).alias("now"), F.max(F.when(F.col("kind") == 2, F.col("reached"))).alias("late"))
    out = windows.join(seen, [key, "id"])
    gone = F.greatest(F.col("start") - before, F.lit(0)) < F.col("now") - capacity
    return out.withColumns({"pre_context_missing": gone | (F.col("start") < before), "post_context_missing": F.col("late") < F.col("end") + after}).drop("now", "late")


def hold_spans(acquired: DataFrame, released: DataFrame, id: str, timeout_us: int) -> DataFrame:
    """acquired (id, at) with until: the release of the same id, or the timeout if that comes first."""
    first = released.groupBy(id).agg(F.min("at").alias("_released"))
    end = F.least(F.coalesce("_released", F.col("at") + timeout_us), F.col("at") + timeout_us)
    return acquired.join(first, id, "left").withColumn("until", F.greatest(end, F.col("at"))).drop("_released")


def write_commands(commands: DataFrame, path: str) -> None:
    """Speech commands, and copies of the failed ones in a folder of their own."""
    commands.write.mode("append").json(f"{path}/commands")
    commands.where("failed").write.mode("append").json(f"{path}/failures")
