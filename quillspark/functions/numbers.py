"""Ratios, percentiles, levels and hashes, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate(part: Column, whole: Column) -> Column:
    """A ratio that is 0 over nothing (A4)."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def per_hour(count: Column, seconds: Column) -> Column:
    """Events an hour; infinite over no time."""
    return F.when(seconds <= 0, F.lit(float("inf"))).otherwise(F.try_divide(count.cast("double"), seconds / 3600.0))


def per_hour_or_null(count: Column, seconds: Column) -> Column:
    """Events an hour; null over no time."""
    return F.when(seconds > 0, count / (seconds / 3600.0))


def percentile(value: Column, q: float) -> Column:
    """By linear interpolation; 0 over nothing (A5)."""
    return F.coalesce(F.percentile(value, F.lit(q)), F.lit(0.0))


def upper_medians(rows: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Of each group the value at half the count, not interpolated (A6). Equal values are counted first, and a running sum finds the place, so no group is held whole."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    within = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("_total"))
    placed = counts.withColumn("_until", F.sum("_n").over(within))
    placed = placed.join(totals, by) if by else placed.crossJoin(F.broadcast(totals))
    return placed.where(F.col("_until") > F.floor(F.col("_total") / 2)).groupBy(*by).agg(F.min(value).alias(out))


def sigmoid(x: Column) -> Column:
    """The logistic function, stable for either sign."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def gain(decibels: Column, ceiling: float = 24.0) -> Column:
    """A factor from decibels, limited above; 1 if not finite."""
    finite = decibels.isNotNull() & ~F.isnan(decibels) & (F.abs(decibels) < float("inf"))
    return F.when(finite, F.pow(F.lit(10.0), F.least(decibels, F.lit(ceiling)) / 20)).otherwise(F.lit(1.0))


def decibels(rms: Column, floor: float = -120.0) -> Column:
    """Level of a root mean square against full scale, limited below."""
    return F.when(rms > 0, F.greatest(20 * F.log10(rms), F.lit(floor))).otherwise(F.lit(floor))


def rms(samples: Column) -> Column:
    """Root mean square of an array."""
    total = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) > 0, F.sqrt(total / F.size(samples))).otherwise(F.lit(0.0))


def stable_fraction(key: Column, seed: int) -> Column:
    """The first 32 bits of the SHA-256 of "seed:key" as a fraction."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967295.0


def fingerprint(columns: list[Column]) -> Column:
    """SHA-256 of a group's rows whatever their order: of the sorted digests of the rows."""
    row = F.sha2(F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns)), 256)
    return F.sha2(F.array_join(F.sort_array(F.collect_list(row)), ""), 256)


def ordered_fingerprint(columns: list[Column], order: list[Column]) -> Column:
    """SHA-256 of a group's rows in an order: of their digests one after the other, so that it changes with the order."""
    row = F.sha2(F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns)), 256)
    placed = F.array_sort(F.collect_list(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), row.alias("digest"))))
    return F.sha2(F.array_join(F.transform(placed, lambda x: x["digest"]), ""), 256)
