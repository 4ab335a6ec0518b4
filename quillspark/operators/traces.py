"""Traces: filtered and merged listings, nesting, stage sums, retention and failures.

A trace store has trace_id, seq (order of arrival), started_at, success (true, false or null) and
more. Nothing here reads the clock: cutoffs are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def list_traces(traces: DataFrame, limit: int, only_failures: bool = False, error_stage: str | None = None, start=None, end=None) -> DataFrame:
    """The newest by arrival that pass all filters. Failed is success = false, not null; a null time fails a bound."""
    if only_failures:
        traces = traces.where(F.col("success").eqNullSafe(F.lit(False)))
    if error_stage is not None:
        traces = traces.where(F.col("error_stage") == error_stage)
    if start is not None:
        traces = traces.where(F.col("started_at") >= start)
    if end is not None:
        traces = traces.where(F.col("started_at") <= end)
    return traces.orderBy(F.col("seq").desc()).limit(limit)


def get_trace(traces: DataFrame, trace_id) -> DataFrame:
    """The latest with that id."""
    newest = F.max_by(F.struct(*traces.columns), F.col("seq"))
    return traces.where(F.col("trace_id") == trace_id).groupBy("trace_id").agg(newest.alias("t")).select("t.*")


def merged_newest(traces: DataFrame, store: str, limit: int) -> DataFrame:
    """The newest of each store, together sorted by time and limited again (L1)."""
    each = Window.partitionBy(store).orderBy(F.col("seq").desc())
    some = traces.withColumn("rank", F.row_number().over(each)).where(F.col("rank") <= limit).drop("rank")
    return some.orderBy(F.col("started_at").desc_nulls_last(), F.col("seq").desc()).limit(limit)


def nest_events(traces: DataFrame, events: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """traces with an array of their events in order, empty if none; events without a trace drop out."""
    nested = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *keep))).alias("events"))
    out = traces.join(nested, key, "left")
    return out.withColumn("events", F.coalesce("events", F.array().cast(nested.schema["events"].dataType)))


def stage_sums(spans: DataFrame, key: str, stage: str, duration: str, stages: list[str]) -> DataFrame:
    """Sum of durations by trace and stage, a column each."""
    return spans.groupBy(key).agg(*(F.sum(F.when(F.col(stage) == s, F.col(duration))).alias(f"{s}_ms") for s in stages))


def retained(traces: DataFrame, newest: int, cutoff) -> DataFrame:
    """The newest by arrival that aren't older than the cutoff; a null time is kept.

    The place of the last one kept is the only thing that needs the global order.
    """
    last = traces.select("seq").orderBy(F.col("seq").desc()).limit(newest).agg(F.min("seq").alias("least"))
    return traces.join(F.broadcast(last), F.col("seq") >= F.col("least")).drop("least").where(F.col("started_at").isNull() | (F.col("started_at") >= cutoff))


def first_failures(events: DataFrame, key: str, order: str, failed: Column, keep: list[str]) -> DataFrame:
    """The first failure of each trace."""
    return events.where(failed).groupBy(key).agg(F.min_by(F.struct(*keep), F.col(order)).alias("f"), F.count("*").alias("n_failures")).select(key, "f.*", "n_failures")


def latest_by_type(events: DataFrame, key: str, kind: str, order: list[str], keep: list[str]) -> DataFrame:
    """The latest event of each type."""
    return events.groupBy(key, kind).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("e")).select(key, kind, "e.*")


def totals(events: DataFrame, key: str, order: str, elapsed: str) -> DataFrame:
    """Elapsed time of each trace's last event, and its number of events."""
    return events.groupBy(key).agg(F.max_by(elapsed, order).alias("total_ms"), F.count("*").alias("n_events"))


def span_durations(events: DataFrame, key: str, kind: str, time: str, start: str, complete: str) -> DataFrame:
    """Milliseconds from the first start to the first complete event of each trace, not below 0."""
    at = lambda k: F.min(F.when(F.col(kind) == k, F.unix_micros(F.col(time).cast("timestamp"))))
    return events.groupBy(key).agg(at(start).alias("a"), at(complete).alias("b")).select(key, F.greatest(F.bround((F.col("b") - F.col("a")) / 1000).cast("long"), F.lit(0).cast("long")).alias("duration_ms"))


def failure_counters(events: DataFrame, kind: Column, order: str, keep: list[str]) -> DataFrame:
    """Failures by kind with the last of each."""
    return events.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.max_by(F.struct(*keep), F.col(order)).alias("last")).select("kind", "n", "last.*")


def redacted(traces: DataFrame, blank: list[str], masked: list[str]) -> DataFrame:
    """Some columns null, others replaced by a mark where they hold anything."""
    return traces.withColumns({c: F.lit(None).cast(traces.schema[c].dataType) for c in blank} | {c: F.when(F.col(c).isNotNull(), F.lit("**REDACTED**")) for c in masked})


def pipeline_spans(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each run of a pipeline, from the latest event of each type.

    events: key, type, at (microseconds) and text (of stt-end); those without a time don't count.
    upload_ms lasts from stt-start to stt-vad-end, stt_ms from there, or from stt-start if no end
    of speech was seen (vad false), to stt-end. An stt span without text fails the run.
    """
    types = ["run-start", "wake_word-end", "stt-start", "stt-vad-start", "stt-vad-end", "stt-end"]
    latest = F.struct(F.col("at"), F.col("text"))
    pick = {t: F.max_by(latest, F.when((F.col("type") == t) & F.col("at").isNotNull(), F.struct(*order))).alias(t) for t in types}
    runs = events.groupBy(key).agg(*pick.values())
    at = {t: F.col(f"`{t}`.at") for t in types}
    ms = lambda a, b: F.greatest(F.bround((b - a) / 1000).cast("long"), F.lit(0).cast("long"))
    start = F.coalesce(at["stt-vad-end"], at["stt-start"])
    text = F.coalesce(F.col("`stt-end`.text"), F.lit(""))
    heard = at["stt-end"].isNotNull() & start.isNotNull()
    return runs.select(
        key,
        *(F.when(at[t].isNotNull() & at["run-start"].isNotNull(), ms(at["run-start"], at[t])).alias(n) for t, n in (("wake_word-end", "wake_ms"), ("stt-vad-start", "speech_start_ms"), ("stt-vad-end", "speech_end_ms"))),
        F.when(at["stt-start"].isNotNull() & at["stt-vad-end"].isNotNull(), ms(at["stt-start"], at["stt-vad-end"])).alias("upload_ms"),
        F.when(heard, ms(start, at["stt-end"])).alias("stt_ms"),
        F.when(heard, at["stt-vad-end"].isNotNull()).alias("vad"),
        F.when(heard, F.length(text).cast("long")).alias("text_length"),
        F.when(heard, F.trim(text) != "").alias("stt_success"),
        F.when(heard & (F.trim(text) == ""), "stt_failed").alias("error_type"),
    )


def finished(events: DataFrame, key: str, kind: str, at: str, last: str, now, timeout_us: int) -> DataFrame:
    """Runs that are over: complete with their last event, or timeout if none came within the time."""
    runs = events.groupBy(key).agg(F.min(at).alias("began"), F.max(F.when(F.col(kind) == last, F.col(at))).alias("ended"))
    state = F.when(F.col("ended").isNotNull() & (F.col("ended") - F.col("began") <= timeout_us), "complete").when(F.lit(now) - F.col("began") > timeout_us, "timeout")
    return runs.withColumn("state", state).where("state IS NOT NULL").select(key, "state", F.when(F.col("state") == "complete", F.col("ended")).otherwise(F.col("began") + timeout_us).alias("at"))


def closed_spans(spans: DataFrame, failures: DataFrame, key: str) -> DataFrame:
    """spans (key, opened, closed, success) with those that the trace's first failure found open closed by it as failed."""
    first = failures.groupBy(key).agg(F.min("at").alias("_failed"))
    joined = spans.join(first, key, "left")
    cut = F.coalesce((F.col("opened") <= F.col("_failed")) & (F.col("closed").isNull() | (F.col("closed") > F.col("_failed"))), F.lit(False))
    return joined.withColumns({"closed": F.when(cut, F.col("_failed")).otherwise(F.col("closed")), "success": F.when(cut, False).otherwise(F.col("success"))}).drop("_failed")


def with_timings(traces: DataFrame, timings: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """traces with a satellite's timings of the same conversation, the latest if it sent several."""
    latest = timings.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_t")).select(key, "_t.*")
    return traces.join(latest, key, "left")


def spoken(error: Column, messages: dict[str, str], default: str) -> Column:
    """What to say of an error (P26); kinds of errors (P21) work the same way."""
    out = F.lit(default)
    for kind, text in reversed(messages.items()):
        out = F.when(error == kind, text).otherwise(out)
    return F.when(error.isNotNull(), out)
