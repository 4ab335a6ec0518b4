"""Streaming twins of batch operators (T2, T3, T7, T8, T13): over the same rows in order they give the same result."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def refractory(rows: DataFrame, key: str, index: str, gap: int) -> DataFrame:
    """key and index of the rows that fire, as operators.detection.refractory; rows of a key must come in order across batches.

    The state of a key is the index of its last fire. Rows at or before it that come late don't fire.
    """
    kind = rows.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        times = sorted({int(t) for b in batches for t in b[index]})
        out = []
        for t in times:
            if last is None or t - last >= gap:
                last = t
                out.append(t)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({key: pd.Series([k[0]] * len(out)), index: pd.Series(out, dtype="int64")})

    return rows.select(key, F.col(index).cast("long").alias(index)).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {index} bigint", "last bigint", "append", GroupStateTimeout.NoTimeout)


def tumbling_best(rows: DataFrame, time: str, key: str, score: str, width: str, late: str) -> DataFrame:
    """The best score of each key and time window; windows close when the watermark passes them."""
    return rows.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.max(score).alias("best"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "best", "n")


def finished_traces(events: DataFrame, time: str, key: str, kind: str, end: str, quiet: str, late: str) -> DataFrame:
    """Traces when they have been quiet for a while: events, and whether the end event came."""
    sessions = events.withWatermark(time, late).groupBy(F.session_window(time, quiet), key)
    return sessions.agg(F.count("*").alias("n_events"), F.max((F.col(kind) == end).cast("int")).alias("ended")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_events", (F.col("ended") == 1).alias("completed"))


def with_context(detections: DataFrame, audio: DataFrame, key: str, time: str, after: str, late: str) -> DataFrame:
    """Detections with the audio rows up to a while after them; without any, a row with null audio comes once the watermark has passed."""
    left = detections.withWatermark(time, late).alias("d")
    right = audio.withWatermark("audio_time", late).alias("a")
    near = F.expr(f"a.{key} = d.{key} AND a.audio_time >= d.{time} AND a.audio_time <= d.{time} + INTERVAL {after}")
    return left.join(right, near, "left_outer").select(F.col(f"d.{key}").alias(key), F.col(f"d.{time}").alias(time), F.col("a.audio_time"), F.col("a.audio_time").isNull().alias("post_context_missing"))
