"""How five document filters interact: what each removes under all 120 orders of applying them.

A document's mask says which filters it fails. An order has five steps, so all orders have 600,
and a mask decides each step's outcome. A mask's outcomes are packed into one wide integer with a
field for each step, so adding two such integers adds all 600 counters at once. A field has 64
bits and counts documents, so it can't overflow into the next below 2^64 of them.

Spark computes the masks and counts equal ones; a part has 128 counts at most, whatever its
size, and its integers are summed weighted by them.

Nulls: a null text counts as empty and a null lang as the part ''. A row without doc_id is
identical to no smaller id and has no labels. A doc_id that labels has several times is good or
toxic if any of its rows is. Rows with the same doc_id count one by one, and none of them is
smaller than another. An empty table has no parts.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ORDERS = ["".join(o) for o in permutations(FILTERS)]
STEPS = len(ORDERS) * len(FILTERS)
FIELD_BYTES = 8
OUTCOMES = ("kept", "removed", "redundant", "unique_fails")
SCHEMA = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def text_fails(text: Column) -> Column:
    """Bits of the filters that a text alone decides: A is 1, B is 2, C is 4, D is 8."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    upper = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    count = F.aggregate(  # both sizes from one split
        F.array(words), F.struct(F.lit(0).alias("n"), F.lit(0).alias("d")), lambda _, w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d"))
    )
    fails = F.aggregate(F.array(count), F.lit(0), lambda _, c: F.when(c["n"] < 100, 1).otherwise(0) + F.when(100 * c["d"] < 80 * c["n"], 2).otherwise(0))
    return fails + F.when(100 * upper > 10 * F.length(text), 4).otherwise(0) + F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0)


def mask_counts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic and n: how many documents of the part have that mask and these labels.

    Texts are compared by SHA-256. Rows are counted by all that matters before anything meets;
    the smallest doc_id of a text meets the counts by text and doc_id, so a text that a third of
    all documents share is no hot key.
    """
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.col("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text_fails(F.col("text")).alias("mask"))
    rows = rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.coalesce(F.max(F.expr("quality = 1")), F.lit(False)).alias("good"), F.coalesce(F.max(F.expr("toxic = 1")), F.lit(False)).alias("toxic"))
    rows = rows.join(marks, "doc_id", "left").fillna(False, ["good", "toxic"])
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    rows = rows.join(first, ["digest", "doc_id"], "left")
    copy = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 16).otherwise(0)
    return rows.groupBy("part", (F.col("mask") + copy).alias("mask"), "good", "toxic").agg(F.sum("n").alias("n"))


@lru_cache(maxsize=1)
def packed() -> dict[str, list[int]]:
    """For each outcome and mask the integer with a 1 in the field of every step that has the outcome."""
    table: dict[str, list[int]] = {o: [] for o in OUTCOMES}
    for mask in range(1 << len(FILTERS)):
        sums = dict.fromkeys(OUTCOMES, 0)
        for k, order in enumerate(ORDERS):
            gone = False
            for step, name in enumerate(order):
                bit = 1 << FILTERS.index(name)
                field = 1 << (8 * FIELD_BYTES * (k * len(FILTERS) + step))
                if mask & bit:
                    sums["redundant" if gone else "removed"] += field
                    gone = True
                if not gone:
                    sums["kept"] += field
                if mask == bit:
                    sums["unique_fails"] += field
        for o in OUTCOMES:
            table[o].append(sums[o])
    return table


def unpack(total: int) -> np.ndarray:
    """The 600 fields of a packed integer."""
    return np.frombuffer(total.to_bytes(STEPS * FIELD_BYTES, "little"), "<u8").astype(np.int64)


def _part(key: tuple, counts: pd.DataFrame) -> pd.DataFrame:
    """All 600 rows of a part from its counts by mask and labels."""
    table = packed()
    totals = {o: 0 for o in (*OUTCOMES, "good_lost", "toxic_lost")}
    for mask, good, toxic, n in zip(counts["mask"].tolist(), counts["good"].tolist(), counts["toxic"].tolist(), counts["n"].tolist(), strict=True):
        for o in OUTCOMES:
            totals[o] += n * table[o][mask]
        totals["good_lost"] += good * n * table["removed"][mask]
        totals["toxic_lost"] += toxic * n * table["removed"][mask]
    out = pd.DataFrame({"part": key[0], "filter_order": np.repeat(ORDERS, len(FILTERS)), "step": np.tile(np.arange(1, 6, dtype=np.int32), len(ORDERS))} | {o: unpack(t) for o, t in totals.items()})
    own = pd.Series([o[s] for o in ORDERS for s in range(len(FILTERS))])
    out["shapley"] = out["removed"].groupby(own).transform("sum")
    return out


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order and step."""
    return mask_counts(documents, labels).groupBy("part").applyInPandas(_part, SCHEMA)


def op12(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(documents, labels)


SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM docs),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w),
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, FALSE)] AS f
  FROM words LEFT JOIN marks USING (doc_id)
), counts AS (SELECT part, good, toxic, f, count(*) AS n FROM fails GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 3, 4, 5]) AS i),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS o
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), steps AS (SELECT filter_order, o, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
outcomes AS (
  SELECT part, filter_order, step, o[step] AS own, n, good, toxic, f[o[step]] AS failing,
    list_bool_or([FALSE] || list_transform(o[1:step - 1], lambda x: f[x])) AS gone,
    len(list_filter(f, lambda x: x)) = 1 AS single
  FROM counts, steps
), rows AS (
  SELECT part, filter_order, step, own,
    CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND NOT failing), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND failing), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (WHERE gone AND failing), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (WHERE failing AND single), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND failing AND good), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND failing AND toxic), 0) AS BIGINT) AS toxic_lost
  FROM outcomes GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM rows
"""
