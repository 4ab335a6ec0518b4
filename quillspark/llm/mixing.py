"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its share of a budget by weight, but no more than a number of epochs; the
excess goes to the others by weight until none is above. A document's key is the logarithm of a
uniform number, a hash of its doc_id, over its quality weight; keys are sorted within the
source, and sizes summed in that order. Whole epochs come first, then the documents whose sum
lies within what is left of the target.

No source is sorted as a whole: sums by source and slice of the key locate the slice where the
target ends, a second cut locates it within that, and only the documents of that part are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import Written

WORD = r"[^\x20\x09-\x0D]+"
#: Source weights by code point order of the name, null last, repeating.
WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST_EPOCHS = 2
SEED = 29
#: Slices of a source's keys, and of one of its slices.
SLICES = 4096
#: Rows of the table of sources that go to every task; beyond, it is joined by shuffle.
LISTED_SOURCES = 10_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, epochs: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size and target, from one row for each source with source and source_size.

    With the sources ordered by cap over weight, those before some place are at their cap and the
    others share the rest by weight: the place is the first whose own share is below its cap.
    """
    ordered = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    listed = F.array(*(F.lit(float(w)) for w in weights))
    ordered = ordered.withColumn("weight", F.get(listed, F.pmod("place", F.lit(len(weights)))))
    ordered = ordered.withColumn("cap", F.col("source_size") * float(epochs))
    by = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    every, before = Window.partitionBy(), by.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(every) * budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    ordered = ordered.withColumn("level", rest / open_weight)
    full = F.col("cap") <= F.col("level") * F.col("weight")
    ordered = ordered.withColumn("level", F.min(F.when(~full, F.struct(F.col("cap") / F.col("weight"), "place", "level"))).over(every)["level"])
    target = F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return ordered.select("source", "source_size", target.alias("target"))


def _uniform(*cols: str) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(*cols, F.lit(SEED)), 11).cast("double") + 0.5) / float(1 << 53)


def mix(docs: DataFrame, quality: DataFrame | None = None, budget: float = BUDGET, weights: tuple[int, ...] = WEIGHTS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every document, and the columns named in keep.

    docs has doc_id, source and text; other columns are ignored, and keep has none of these names. size is the text's number of
    words, 0 for null. quality has doc_id and a positive weight; documents without one have 1, and
    several of a doc_id are averaged. copies: how often the mix holds the document; taken: its
    words in it. A source without words has target 0 and none of its documents is taken beyond
    whole epochs of nothing. A null source is a source. Rows that share doc_id and text, or
    have no doc_id and one text, are documents of their own that get one key. An empty table gives no rows.
    """
    slim = docs.select(F.col("doc_id"), F.col("source"), n_words(F.col("text")).alias("size"), _uniform("doc_id", "text").alias("uniform"), *keep)
    if quality is not None:
        rated = quality.where("weight > 0").groupBy("doc_id").agg(F.avg("weight").alias("weight"))
        slim = slim.join(rated, "doc_id", "left")
    else:
        slim = slim.withColumn("weight", F.lit(1.0))
    # u ** (1 / w), largest first, is the order of -ln(u) / w, smallest first; 1 - exp(-x) spreads that over slices
    key = -F.log(F.col("uniform")) / F.coalesce("weight", F.lit(1.0))
    slim = slim.withColumn("key", key).drop("weight", "uniform")
    fine = -F.expm1(-F.col("key")) * SLICES
    slim = slim.withColumn("coarse", F.floor(fine).cast("int")).withColumn("fine", F.floor((fine - F.floor(fine)) * SLICES).cast("int"))
    rows = Written(slim, "sizes").df

    passing = [Written(rows.groupBy("source", "coarse").agg(F.sum("size").alias("words")), "cells")]
    cells = passing[0].df
    passing.append(Written(targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget), "targets"))
    shares = passing[-1].df
    few = shares.count() <= LISTED_SOURCES
    shares = shares.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    shares = shares.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))

    def same(a: DataFrame, b: DataFrame, *more: str) -> Column:
        on = a["source"].eqNullSafe(b["source"])
        for k in more:
            on = on & (a[k] == b[k])
        return on

    def edge(parts: DataFrame, by: str, keep: list[str]) -> DataFrame:
        """Of each source the part where its rest ends, and the words before it."""
        w = Window.partitionBy("source").orderBy(by)
        parts = parts.withColumn("until", F.sum("words").over(w)).withColumn("before", F.col("until") - F.col("words"))
        return parts.where("before < rest AND rest <= until").select("source", *keep, by, F.col("before"))

    def listed(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df

    left = cells.join(listed(shares.select(F.col("source").alias("s"), "rest")), F.col("source").eqNullSafe(F.col("s"))).drop("s").where("rest > 0")
    passing.append(Written(edge(left, "coarse", ["rest"]), "edge"))
    one = passing[-1].df
    inner = rows.join(listed(one), same(rows, one, "coarse")).select(rows["source"], rows["coarse"], "fine", "size", (F.col("rest") - F.col("before")).alias("rest"), F.col("before").alias("base"))
    inner = inner.groupBy("source", "coarse", "rest", "base", "fine").agg(F.sum("size").alias("words"))
    passing.append(Written(edge(inner, "fine", ["coarse", "rest", "base"]).select("source", "coarse", "fine", (F.col("base") + F.col("before")).alias("before")), "edge"))
    two = passing[-1].df

    ends = two.select(F.col("source").alias("s"), F.col("coarse").alias("end_coarse"), F.col("fine").alias("end_fine"), F.col("before"))
    known = Written(shares.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "shares").df
    for x in passing:
        x.drop()
    out = rows.join(listed(known), same(rows, known)).drop(known["source"])
    here = (F.col("coarse") == F.col("end_coarse")) & (F.col("fine") == F.col("end_fine"))
    early = F.coalesce((F.col("coarse") < F.col("end_coarse")) | ((F.col("coarse") == F.col("end_coarse")) & (F.col("fine") < F.col("end_fine"))), F.lit(False))
    at_end = out.where(here)
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size")
    upto = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("before")
    at_end = at_end.withColumn("more", (upto - F.col("size") / 2 <= F.col("rest")).cast("long"))
    others = out.where(~F.coalesce(here, F.lit(False))).withColumn("more", early.cast("long"))
    both = others.unionByName(at_end).withColumn("copies", F.col("epochs") + F.col("more"))
    return both.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *keep)


def quality_weights(labels: DataFrame) -> DataFrame:
    """Weight 2 for documents labelled good, 0.5 for those labelled bad."""
    return labels.where("quality IS NOT NULL").select("doc_id", F.when(F.col("quality") > 0, 2.0).otherwise(0.5).alias("weight"))


def op2(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return mix(docs, quality_weights(labels)).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")
