"""Evaluation results: selection, scoring by bags, rates, gates, qualification."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.numbers import rate


def select_cases(cases: DataFrame, suite: DataFrame | None = None, category: str | None = None, tag: str | None = None, household: str | None = None, case_id: str | None = None) -> DataFrame:
    """Cases of a suite in its order, of a category or household, with a tag; a case_id selects that case whatever else is asked."""
    if case_id is not None:
        return cases.where(F.col("case_id") == case_id)
    if suite is not None:
        cases = cases.join(suite, "case_id")
    for column, value in (("category", category), ("household", household)):
        if value is not None:
            cases = cases.where(F.col(column) == value)
    if tag is not None:
        cases = cases.where(F.array_contains("tags", tag))
    return cases.orderBy("pos") if suite is not None else cases


def unresolved(suite: DataFrame, cases: DataFrame) -> DataFrame:
    """Suite ids without a case; must be empty."""
    return suite.join(cases.select("case_id"), "case_id", "left_anti")


def unique_owners(owners: DataFrame, label: str, *key: str) -> DataFrame:
    """Labels with exactly one distinct owner, by one column or several."""
    pairs = owners.select(label, *key).where(F.col(label).isNotNull()).distinct()
    first = [F.min(k).alias(k) for k in key]
    return pairs.groupBy(label).agg(F.count("*").alias("n"), *first).where("n = 1").drop("n")


def first_owners(owners: DataFrame, label: str, key: str, order: str) -> DataFrame:
    """The first owner of each label (J11, fourth variant)."""
    return owners.where(F.col(label).isNotNull()).groupBy(label).agg(F.min_by(key, order).alias(key))


def bag_comparison(expected: DataFrame, actual: DataFrame, case: str, item: str) -> DataFrame:
    """Of each case: items matched, missing and unexpected as bags, and whether the bags are equal (J20 strict, X2).

    Items are counted first, both sides in one pass, so a case with many equal calls is one row.
    """
    side = lambda df, e: df.select(case, item, F.lit(e).cast("long").alias("e"), F.lit(1 - e).cast("long").alias("a"))
    apart = F.when(F.col(case).isNull() | F.col(item).isNull(), F.col("e")).alias("_apart")  # null equals nothing
    both = side(expected, 1).unionByName(side(actual, 0)).groupBy(case, item, apart).agg(F.sum("e").alias("e"), F.sum("a").alias("a"))
    out = both.groupBy(case).agg(
        F.sum(F.least("e", "a")).alias("n_matched"), F.sum(F.greatest(F.col("e") - F.col("a"), F.lit(0))).alias("n_missing"), F.sum(F.greatest(F.col("a") - F.col("e"), F.lit(0))).alias("n_unexpected")
    )
    return out.withColumn("equal", (F.col("n_missing") == 0) & (F.col("n_unexpected") == 0))


def summarize(results: DataFrame) -> DataFrame:
    """One row of totals and rates (A1, A4). Columns: passed, expected_type, outcome, n_calls."""
    acts, quiet = F.col("expected_type").isin("action", "status"), F.col("expected_type").isin("clarification", "refusal")
    passed = lambda which: rate(F.count_if(which & F.col("passed")), F.count_if(which))
    share = lambda kind: rate(F.count_if(F.col("outcome") == kind), F.count("*"))
    return results.agg(
        F.count("*").alias("total"),
        F.count_if("passed").alias("passed"),
        rate(F.count_if("passed"), F.count("*")).alias("overall_pass_rate"),
        passed(acts).alias("action_execution_accuracy"),
        rate(F.count_if(quiet & (F.col("n_calls") > 0)), F.count_if(quiet)).alias("false_action_rate"),
        passed(F.col("expected_type") == "clarification").alias("clarification_accuracy"),
        passed(F.col("expected_type") == "refusal").alias("refusal_accuracy"),
        share("malformed_output").alias("malformed_output_rate"),
        share("unknown_tool").alias("unknown_tool_rate"),
        share("invalid_arguments").alias("invalid_argument_rate"),
    )


def category_rates(results: DataFrame) -> DataFrame:
    """Pass rate by category (A2)."""
    return results.groupBy("category").agg(F.count("*").alias("n"), rate(F.count_if("passed"), F.count("*")).alias("pass_rate"))


def flag_counts(results: DataFrame) -> DataFrame:
    """Flags over all results, with one for passed results whose output was malformed (A3)."""
    extra = F.when(F.col("passed") & (F.col("outcome") == "malformed_output"), F.array(F.lit("malformed_treated_as_abstention"))).otherwise(F.array().cast("array<string>"))
    return results.select(F.explode(F.concat("flags", extra)).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def failed_gates(summary: DataFrame, categories: DataFrame, flags: DataFrame, gates: DataFrame) -> DataFrame:
    """Gates that don't hold, as kind, key, bound and value.

    gates has kind (min_overall, category_min, max_rate or zero_flag), key and bound. A required
    category without cases fails with a null value. Rates are rows here, so all kinds are one join.
    """
    names = [c for c in summary.columns if c.endswith(("_rate", "_accuracy"))]
    rates = summary.select(F.explode(F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in names))).alias("r")).select("r.*")
    kinds = [
        (rates.where("key = 'overall_pass_rate'"), "min_overall"),
        (categories.select(F.col("category").alias("key"), F.col("pass_rate").alias("value")), "category_min"),
        (rates, "max_rate"),
        (flags.select(F.col("flag").alias("key"), F.col("n").cast("double").alias("value")), "zero_flag"),
    ]
    values = None
    for df, kind in kinds:
        one = df.select(F.lit(kind).alias("kind"), "key", "value")
        values = one if values is None else values.unionByName(one)
    joined = gates.join(values, ["kind", "key"], "left")
    low = F.col("kind").isin("min_overall", "category_min") & (F.col("value") < F.col("bound"))
    absent = (F.col("kind") == "category_min") & F.col("value").isNull()
    high = (F.col("kind") == "max_rate") & (F.col("value") > F.col("bound"))
    flagged = (F.col("kind") == "zero_flag") & (F.col("value") > 0)
    return joined.where(low | absent | high | flagged)


def qualification(c: dict[str, Column], bound: float = 0.02, hours: float = 150.0) -> Column:
    """rejected, insufficient_evidence, evaluated or qualified, by the first rule that holds.

    c: stopped, empty, recall, baseline_recall, fa_per_hour, baseline_fa, late, failed, feasible and background_seconds.
    """
    finite = ~F.isnan(c["fa_per_hour"]) & (c["fa_per_hour"] < float("inf"))
    worse = (c["recall"] + 1e-9 < c["baseline_recall"]) | (c["fa_per_hour"] > F.least(c["baseline_fa"], F.lit(bound)) + 1e-9)
    return (
        F.when(c["stopped"] | c["empty"] | ~finite | worse | c["late"] | (c["failed"] > 0), "rejected")
        .when(~c["feasible"] | (c["background_seconds"] / 3600.0 < hours) | (c["fa_per_hour"] > bound), "insufficient_evidence")
        .when(c["recall"] <= c["baseline_recall"], "evaluated")
        .otherwise("qualified")
    )


def variant_summary(phrases: DataFrame, variant: str, error: str) -> DataFrame:
    """Errors by variant: mean, middle, 95th percentile and exact matches."""
    return phrases.groupBy(variant).agg(F.avg(error).alias("mean_error"), F.percentile(error, F.lit(0.5)).alias("p50"), F.percentile(error, F.lit(0.95)).alias("p95"), F.count_if(F.col(error) == 0).alias("n_exact"))


def variant_delta(summary: DataFrame, variant: str, base: str, other: str) -> DataFrame:
    """How much another variant's mean error and number of exact matches exceed the base's, in one row."""
    pick = lambda name, column: F.max(F.when(F.col(variant) == name, F.col(column)))
    return summary.agg(*((pick(other, c) - pick(base, c)).alias(f"delta_{c}") for c in ("mean_error", "n_exact")))


def gain_recommendation(levels: Column, target: float, low: float = -12.0, high: float = 24.0) -> Column:
    """The middle distance to a target level, within limits."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.percentile(F.lit(target) - levels, F.lit(0.5))))


def near_duplicate_groups(cases: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Keys with more cases than the limit."""
    return cases.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > limit)


def case_numbers(cases: DataFrame, by: list[str], order: str) -> DataFrame:
    """Cases with their number within a group, from 1."""
    return cases.withColumn("number", F.row_number().over(Window.partitionBy(*by).orderBy(order)))


def late_cases(results: DataFrame, cases: DataFrame, rate: int = 16_000, slack_ms: float = 50.0) -> DataFrame:
    """Checked detections with whether they are late: more than the slack after the end of speech. Rows with a null on either side aren't checked."""
    joined = results.join(cases, "case_id").where("speech_end_ms IS NOT NULL AND detection_sample IS NOT NULL")
    at = F.col("detection_sample") / rate * 1000.0
    return joined.select("case_id", (at > F.col("speech_end_ms") + slack_ms).alias("late"))


def latency_report(runs: DataFrame, by: str, repetition: str, value: str, warm_ups: int) -> DataFrame:
    """Middle and 95th percentile by kind without the first repetitions."""
    return runs.where(F.col(repetition) > warm_ups).groupBy(by).agg(F.count("*").alias("n"), F.percentile(value, F.lit(0.5)).alias("p50"), F.percentile(value, F.lit(0.95)).alias("p95"))


def held_out_clips(clips: DataFrame, label: str, clip: str) -> DataFrame:
    """clips with the last of each label as test, if the label has two or more."""
    last = clips.groupBy(label).agg(F.max(clip).alias("_last"), F.count("*").alias("_n"))
    return clips.join(last, label).withColumn("is_test", (F.col(clip) == F.col("_last")) & (F.col("_n") >= 2)).drop("_last", "_n")


def last_threshold(log: DataFrame, by: str, note: Column, order: str, value: str, default: float = 0.5) -> DataFrame:
    """The value of the last matching entry, else the default."""
    return log.groupBy(by).agg(F.coalesce(F.max_by(value, F.when(note, F.col(order))), F.lit(default)).alias("threshold"))


def changes(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the row before it."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("before", before).where(F.col("before").isNotNull() & (F.col("before") != F.col(value)))


def composition_faults(cases: DataFrame, by: str, wanted: DataFrame) -> DataFrame:
    """Categories whose share of all cases is outside [low, high], or that have none (A21). wanted has the category, low and high."""
    total = cases.agg(F.count("*").alias("total"))
    counts = cases.groupBy(by).agg(F.count("*").alias("n"))
    joined = wanted.join(counts, by, "left").crossJoin(F.broadcast(total)).withColumn("share", F.coalesce("n", F.lit(0)) / F.col("total"))
    return joined.where(F.col("n").isNull() | (F.col("share") < F.col("low")) | (F.col("share") > F.col("high"))).select(by, "n", "share")


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Edit distance of two sequences of any length, by the bit-parallel columns of Myers and Hyyrö.

    The longer side is a column of bits in one integer, and the shorter side is walked, so a step
    handles a whole column.
    """
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    n, wanted, places = len(a), set(b), {}
    for i, x in enumerate(a):
        if x in wanted:
            if x not in places:
                places[x] = bytearray(n // 8 + 1)
            places[x][i >> 3] |= 1 << (i & 7)
    masks = {x: int.from_bytes(v, "little") for x, v in places.items()}
    full, last = (1 << n) - 1, 1 << n >> 1
    more, less, distance = full, 0, n
    for x in b:
        equal = masks.get(x, 0)
        diagonal = (((equal & more) + more) ^ more) | equal | less
        up, down = less | (full & ~(diagonal | more)), more & diagonal
        distance += bool(up & last) - bool(down & last)
        up, down = (up << 1 | 1) & full, down << 1 & full
        more, less = down | (full & ~(diagonal | up)), up & diagonal
    return distance


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, reference, hypothesis = batch.columns
        out = []
        for a, b in zip(reference, hypothesis, strict=True):
            a, b = a.as_py(), b.as_py()
            out.append((None if a is None or b is None else edit_distance(a, b), None if a is None else len(a), None if b is None else len(b)))
        distance, n, m = (pa.array([x[k] for x in out], pa.int32()) for k in range(3))
        yield pa.RecordBatch.from_arrays([key, distance, n, m], names=["key", "distance", "n", "m"])


def error_rates(pairs: DataFrame, key: str, reference: str, hypothesis: str, out: str) -> DataFrame:
    """key and the edit distance of two whole texts or token arrays over the reference's length; for an empty one 0 if both are, else 1; null for a null side.

    The distances are found in Python in the tasks: the Column expressions of functions.text walk
    the distance table cell by cell, which suits short utterances only.
    """
    kind = pairs.schema[key].dataType.simpleString()
    read = pairs.select(key, reference, hypothesis).mapInArrow(_distances, f"key {kind}, distance int, n int, m int")
    empty = F.when(F.col("m") == 0, 0.0).when(F.col("m") > 0, 1.0)
    return read.select(F.col("key").alias(key), F.when(F.col("n") == 0, empty).otherwise(F.col("distance") / F.col("n")).alias(out))
