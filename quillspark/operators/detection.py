"""Score streams into detections: windows, refractory suppression, cascades, clusters, interval joins.

Rows of a stream are ordered by an integer index. A stream may be of any length: what needs the
row before works within buckets of the index and takes a bucket's last row from a small table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.lexical import with_checkpoints


def previous(rows: DataFrame, key: str, index: str, bucket: int) -> DataFrame:
    """rows with the column previous: the stream's largest smaller-or-equal index before the row, by bucket and then across buckets."""
    rows = rows.withColumn("bucket", F.floor(F.col(index) / bucket))
    inside = F.lag(index).over(Window.partitionBy(key, "bucket").orderBy(index))
    ends = rows.groupBy(key, "bucket").agg(F.max(index).alias("last"))
    ends = ends.withColumn("carried", F.lag("last").over(Window.partitionBy(key).orderBy("bucket"))).drop("last")
    return rows.withColumn("inside", inside).join(ends, [key, "bucket"]).withColumn("previous", F.coalesce("inside", "carried")).drop("inside", "carried", "bucket")


def islands(rows: DataFrame, key: str, index: str, gap: int, bucket: int) -> DataFrame:
    """rows with the column island: the index of the last row at or before this one that follows its predecessor by gap or more."""
    rows = previous(rows, key, index, bucket)
    start = F.when(F.col("previous").isNull() | (F.col(index) - F.col("previous") >= gap), F.col(index))
    rows = rows.withColumn("start", start).withColumn("bucket", F.floor(F.col(index) / bucket))
    run = Window.partitionBy(key, "bucket").orderBy(index).rangeBetween(Window.unboundedPreceding, 0)
    lasts = rows.groupBy(key, "bucket").agg(F.max("start").alias("last"))
    before = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    lasts = lasts.withColumn("carried", F.max("last").over(before)).drop("last")
    rows = rows.withColumn("inside", F.max("start").over(run)).join(lasts, [key, "bucket"])
    return rows.withColumn("island", F.coalesce("inside", "carried")).drop("previous", "start", "bucket", "inside", "carried")


#: Rows of an island that are folded as one array at most, and refractory times that a block of a longer island spans.
FOLDED_ROWS, BLOCK_GAPS = 2048, 256


def refractory(rows: DataFrame, key: str, index: str, gap: int, bucket: int | None = None, folded_rows: int = FOLDED_ROWS) -> DataFrame:
    """key and index of the rows that fire: the first of a stream, then each that follows the last that fired by gap or more.

    A row that follows its predecessor by gap fires whatever came before, so the rows from one
    such to the next, an island, are folded by themselves; islands of more than folded_rows rows
    by blocks. Islands are found at once and kept in the session's checkpoint folder.
    """
    with_checkpoints(rows.sparkSession)
    rows = islands(rows.select(key, F.col(index).cast("long").alias(index)).where(F.col(index).isNotNull()), key, index, gap, bucket or 64 * gap).checkpoint()
    nothing = F.array().cast("array<bigint>")
    folded = F.aggregate("sorted", nothing, lambda out, x: F.when(F.try_element_at(out, F.lit(-1)).isNull() | (x - F.try_element_at(out, F.lit(-1)) >= gap), F.array_append(out, x)).otherwise(out))

    def fold(short: DataFrame) -> DataFrame:
        return short.groupBy(key, "island").agg(F.array_sort(F.collect_set(index)).alias("sorted")).select(key, F.explode(folded).alias(index))

    long = rows.groupBy(key, "island").agg(F.count("*").alias("_n")).where(F.col("_n") > folded_rows).drop("_n")
    if long.isEmpty():
        return fold(rows)
    return fold(rows.join(long, [key, "island"], "left_anti")).unionByName(_by_blocks(rows.join(long, [key, "island"], "left_semi"), key, index, gap).select(key, index))


def _by_blocks(rows: DataFrame, key: str, index: str, gap: int) -> DataFrame:
    """The rows of long islands that fire.

    What comes before a block matters only by the row of the block that fires first: one within
    gap of its start, or the first after. For each of these a task finds the block's last fire,
    and a row goes on with both. Passing through these rows in order, block after block, settles
    where each block is entered; then every block is run through by itself.
    """
    rows = rows.select(key, "island", F.col(index).alias("_at")).distinct().withColumn("_block", F.floor(F.col("_at") / (gap * BLOCK_GAPS)))
    name, kind = key, rows.schema[key].dataType.simpleString()
    block = [name, "island", "_block"]

    def following(at: np.ndarray) -> np.ndarray:
        return np.searchsorted(at, at + gap)

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        at = np.sort(pdf["_at"].to_numpy())
        nxt = following(at)
        nxt = np.where(nxt < len(at), nxt, np.arange(len(at)))
        while not np.array_equal(further := nxt[nxt], nxt):  # twice as far each time
            nxt = further
        n = min(int(np.searchsorted(at, (int(pdf["_block"].iloc[0]) * BLOCK_GAPS + 1) * gap)) + 1, len(at))
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * n for c in block}, "_first": at[:n], "_last": at[nxt[:n]]})

    def entries(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, last, entered = None, None, None
        for part in parts:
            out = []
            for k, island, number, first, end in part.itertuples(index=False, name=None):
                if (k, island) != stream:
                    stream, last, entered = (k, island), None, None
                if number != entered and (last is None or first >= last + gap):
                    out.append((k, island, number, first))
                    last, entered = end, number
            yield pd.DataFrame(out, columns=[*block, "_entry"]).astype({"island": "int64", "_block": "int64", "_entry": "int64"})

    def fires(pdf: pd.DataFrame) -> pd.DataFrame:
        at = np.sort(pdf["_at"].to_numpy())
        nxt, i, out = following(at), int(np.searchsorted(at, pdf["_entry"].iloc[0])), []
        while i < len(at):
            out.append(at[i])
            i = nxt[i]
        return pd.DataFrame({name: pd.Series([pdf[name].iloc[0]] * len(out), dtype=object), index: np.array(out, np.int64)})

    schema = f"`{name}` {kind}, island bigint, _block bigint"
    found = rows.groupBy(*block).applyInPandas(exits, f"{schema}, _first bigint, _last bigint")
    found = found.repartition(name, "island").sortWithinPartitions(*block, "_first").mapInPandas(entries, f"{schema}, _entry bigint")
    return rows.join(found, block).groupBy(*block).applyInPandas(fires, f"`{name}` {kind}, `{index}` bigint")


def cascade(rows: DataFrame, key: str, index: str, score: str, verifier: str, mine: float, detect: float, verify: float, gap: int) -> DataFrame:
    """rows with mined, and the gate that decides: below, refractory, vetoed or fired (T5).

    Rows are mined by score before any gate. A verifier's veto, or no score of its own, stops a row without starting the
    refractory time, so only rows that pass the verifier are suppressed by each other, and any row within the time after one
    that fired is refractory.
    """
    passing = rows.where((F.col(score) >= detect) & (F.col(verifier) >= verify))
    fires = refractory(passing, key, index, gap).select(key, F.col(index).alias("_fire"), F.explode(F.array(F.floor(F.col(index) / gap), F.floor(F.col(index) / gap) + 1)).alias("_bucket"))
    near = rows.select(key, index).distinct().withColumn("_bucket", F.floor(F.col(index) / gap)).join(fires, [key, "_bucket"])
    same, after = F.max(F.col("_fire") == F.col(index)), F.max((F.col("_fire") < F.col(index)) & (F.col(index) - F.col("_fire") < gap))
    found = rows.join(near.groupBy(key, index).agg(same.alias("_same"), after.alias("_after")), [key, index], "left").fillna(False, ["_same", "_after"])
    passes = F.coalesce(F.col(verifier) >= verify, F.lit(False))
    gate = F.when(~F.coalesce(F.col(score) >= detect, F.lit(False)), "below").when(F.col("_after"), "refractory").when(~passes, "vetoed").when(F.col("_same"), "fired").otherwise("refractory")
    return found.withColumns({"mined": F.coalesce(F.col(score) >= mine, F.lit(False)), "gate": gate}).select(*rows.columns, "mined", "gate")


def replay(windows: DataFrame, key: str, index: str, score: str, threshold: float, gap: int) -> DataFrame:
    """Scored windows of recorded sessions as what a detector does with them: windows, best score and activations of each (Q6)."""
    fires = refractory(windows.where(F.col(score) >= threshold), key, index, gap).groupBy(key).agg(F.count("*").alias("n_activations"))
    seen = windows.groupBy(key).agg(F.count("*").alias("n_windows"), F.max(score).alias("best"))
    return seen.join(fires, key, "left").fillna(0, ["n_activations"])


def sampling_class(score: Column, fraction: Column, detect: float, mine: float, below: float) -> Column:
    """detection, near_threshold, below_threshold by a fraction of the rest, or null."""
    return F.when(score >= detect, "detection").when(score >= mine, "near_threshold").when(fraction < below, "below_threshold")


def outside_intervals(points: DataFrame, intervals: DataFrame, key: str, index: str, bucket: int) -> DataFrame:
    """points in no interval of their stream, both ends included (J8). Intervals have start and end.

    Both sides meet by stream and bucket of the index; an interval goes to each bucket it touches.
    """
    spread = intervals.select(key, "start", "end", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))).alias("bucket"))
    p = points.withColumn("bucket", F.floor(F.col(index) / bucket))
    on = (p[key] == spread[key]) & (p["bucket"] == spread["bucket"]) & F.col(index).between(F.col("start"), F.col("end"))
    return p.join(spread, on, "left_anti").drop("bucket")


def overlapping(points: DataFrame, spans: DataFrame, key: str, index: str, window: int, bucket: int) -> DataFrame:
    """Pairs of points and spans with start < index and end > index - window."""
    spread = spans.select(F.col(key).alias("span_key"), "span_id", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("end") + window) / bucket))).alias("span_bucket"))
    p = points.withColumn("bucket", F.floor(F.col(index) / bucket))
    on = (p[key] == spread["span_key"]) & (p["bucket"] == spread["span_bucket"]) & (F.col("start") < F.col(index)) & (F.col("end") > F.col(index) - window)
    return p.join(spread, on).drop("bucket", "span_key", "span_bucket")


def near_points(anchors: DataFrame, points: DataFrame, key: str, index: str, low: int, high: int) -> DataFrame:
    """Pairs of anchors (with column at) and points with low <= index - at <= high."""
    width = max(1, high - low)
    spread = anchors.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("at") + low) / width), F.floor((F.col("at") + high) / width))))
    p = points.withColumn("bucket", F.floor(F.col(index) / width))
    return spread.join(p, [key, "bucket"]).where((F.col(index) - F.col("at")).between(low, high)).drop("bucket")


def window_grid(streams: DataFrame, length: str, window: int, hop: int) -> DataFrame:
    """streams with a row for each window on the grid: window_end from window on, every hop, up to the length."""
    grid = F.when(F.col(length) >= window, F.sequence(F.lit(window).cast("long"), F.col(length).cast("long"), F.lit(hop).cast("long")))
    return streams.withColumn("window_end", F.explode(grid))


def last_of_chunk(chunks: DataFrame, key: str, end: str, window: int, hop: int) -> DataFrame:
    """Of chunks that end at an index, those that emit a window: the latest grid point they reach, if it is a new one."""
    point = F.when(F.col(end) >= window, F.floor((F.col(end) - window) / hop) * hop + window)
    before = F.lag("point").over(Window.partitionBy(key).orderBy(end))
    rows = chunks.withColumn("point", point).withColumn("before", before)
    return rows.where("point IS NOT NULL AND (before IS NULL OR point > before)").withColumn("lag", F.col(end) - F.col("point")).drop("before")


def bucket_best(rows: DataFrame, key: str, index: str, score: str, width: int, least: float) -> DataFrame:
    """The best row of each bucket with a score of least or more; of equal ones the earliest."""
    best = F.max_by(F.struct(index, score), F.struct(F.col(score), -F.col(index)))
    groups = rows.where(F.col(score) >= least).groupBy(key, F.floor(F.col(index) / width).alias("bucket")).agg(best.alias("best"))
    return groups.select(key, "bucket", "best.*")


def clusters(rows: DataFrame, key: str, start: str, end: str, score: str) -> DataFrame:
    """Clusters of overlapping half-open windows of a stream, in order of start.

    A window joins the first open cluster whose range it overlaps; one that scores as high or
    higher gives the cluster its range. Windows after a gap that no earlier window reaches can't
    join an earlier cluster, so each run of overlapping windows is folded by itself.
    """
    rows = rows.select(key, F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"), F.col(score).cast("double").alias("score"))
    rows = rows.withColumn("new", F.coalesce(F.col("s") >= F.max("e").over(Window.partitionBy(key).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)))
    rows = rows.withColumn("run", F.sum(F.col("new").cast("int")).over(Window.partitionBy(key).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(key, "run").agg(F.array_sort(F.collect_list(F.struct("s", "e", "score"))).alias("all"))
    kind = "array<struct<first:bigint,s:bigint,e:bigint,score:double,n:bigint>>"

    def step(out: Column, x: Column) -> Column:
        hit = F.array_position(F.transform(out, lambda c: (c["s"] < x["e"]) & (x["s"] < c["e"])), True)
        new = F.array(F.struct(x["s"].alias("first"), x["s"].alias("s"), x["e"].alias("e"), x["score"].alias("score"), F.lit(1).cast("long").alias("n"))).cast(kind)

        def merged(c: Column, i: Column) -> Column:
            wins = x["score"] >= c["score"]
            pick = lambda f: F.when(wins, x[f]).otherwise(c[f])
            return F.when(i + 1 == hit, F.struct(c["first"].alias("first"), pick("s").alias("s"), pick("e").alias("e"), pick("score").alias("score"), (c["n"] + 1).alias("n"))).otherwise(c)

        return F.when(hit > 0, F.transform(out, merged).cast(kind)).otherwise(F.concat(out, new))

    folded = F.aggregate("all", F.array().cast(kind), step)
    return runs.select(key, F.explode(folded).alias("c")).select(key, F.col("c.first").alias("first_start"), F.col("c.s").alias("start"), F.col("c.e").alias("end"), F.col("c.score").alias("score"), F.col("c.n").alias("n_windows"))


def stale(detections: DataFrame, boundaries: DataFrame, key: str, index: str, order: str) -> DataFrame:
    """detections with the last boundary that came before them in order, and whether they lie at or before it."""
    both = detections.select(key, order, F.col(index).alias("index"), F.lit(1).alias("kind")).unionByName(boundaries.select(key, order, F.col("boundary").alias("index"), F.lit(0).alias("kind")))
    w = Window.partitionBy(key).orderBy(order, "kind").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("boundary", F.last(F.when(F.col("kind") == 0, F.col("index")), ignorenulls=True).over(w))
    return both.where("kind = 1").select(key, order, F.col("index").alias(index), "boundary", F.coalesce(F.col("index") <= F.col("boundary"), F.lit(False)).alias("stale"))


def holds(changes: DataFrame, key: str, order: list[str], delta: str) -> DataFrame:
    """Running number of holds, and whether a row ends the last one."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    held = F.sum(delta).over(w)
    return changes.withColumn("held", held.cast("long")).withColumn("restored", (F.col("held") == 0) & (F.col(delta) < 0))


def threshold_sweep(rows: DataFrame, score: str, thresholds: list[float], by: list[str]) -> DataFrame:
    """Number of rows at or above each threshold."""
    sweep = F.explode(F.array(*(F.lit(float(t)) for t in thresholds)))
    return rows.withColumn("threshold", sweep).groupBy(*by, "threshold").agg(F.count_if(F.col(score) >= F.col("threshold")).alias("n_hits"))
