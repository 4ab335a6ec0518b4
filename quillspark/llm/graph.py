"""Distributed connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quillspark.llm.common import Written


def components(edges: DataFrame, most_rounds: int = 60) -> Written:
    """Each node that has an edge, and its component's smallest node, as (node, component).

    edges has two long columns a and b; null ends and loops are ignored, and edges may repeat.
    Alternates two steps, each of which is a grouped minimum and an equi-join: every node hands
    its larger neighbours to the smallest node around it, then its smaller ones. The number of
    edges never grows, the rounds are about logarithmic in a component's size, and every round
    is written to the shared folder.
    """
    a, b = F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    state, seen = _written(edges.where("a <> b").select(a, b).distinct())
    for _ in range(most_rounds):
        both = state.df.selectExpr("hi AS u", "lo AS v").unionByName(state.df.selectExpr("lo AS u", "hi AS v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
        large = both.where("v > u").join(least, "u").selectExpr("v AS hi", "m AS lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(least, "hi")
        small = joined.selectExpr("hi", "m AS lo").unionByName(joined.where("lo <> m").selectExpr("lo AS hi", "m AS lo"))
        new, now = _written(small.distinct())
        state.drop()
        state = new
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = state.df.selectExpr("lo AS node", "lo AS component").distinct()
    out = Written(state.df.selectExpr("hi AS node", "lo AS component").unionByName(roots), "components")
    state.drop()
    return out


def _written(edges: DataFrame) -> tuple[Written, tuple]:
    """The edges as a written table, and their number and the sum of their hashes, counted on the way."""
    seen = Observation()
    table = Written(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("digest")), "edges")
    return table, (seen.get["n"], seen.get["digest"])
