"""Shared prefixes against comparing all pairs."""

import random

from pyspark.sql import functions as F

from quillspark.operators import prefixes


def shared(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def test_against_all_pairs(spark):
    rng = random.Random(3)
    common = [rng.choice("abc") for _ in range(70)]
    make = lambda: (common[: rng.randrange(71)] if rng.random() < 0.7 else []) + [rng.choice(["a", "b", "c", None, ""]) for _ in range(rng.randrange(8))]
    prompts, cache = [(i, make()) for i in range(80)] + [(98, []), (99, None)], [(i, make()) for i in range(60)] + [(70, []), (71, None), (72, common)]
    frame = lambda rows: spark.createDataFrame(rows, "id int, tokens array<string>").repartition(3)
    got = {r.id: (r.length, r.cached) for r in prefixes.shared_prefix(frame(prompts), frame(cache), "id", "tokens").collect()}
    for i, p in prompts:
        best = max(shared(p or [], c or []) for _, c in cache)
        assert got[i] == (best, min(j for j, c in cache if shared(p or [], c or []) == best) if best else None), i
    df = prefixes.longest_checkpoint(frame(prompts), frame(cache), "id", "tokens", 60)
    got = {r.id: (r.length, r.checkpoint) for r in df.collect()}
    for i, p in prompts:
        fit = [(len(c), -j) for j, c in cache if c and len(c) <= 60 and (p or [])[: len(c)] == c]
        assert got[i] == ((max(fit)[0], -max(fit)[1]) if fit else (0, None)), i
    assert "Nested" not in df._jdf.queryExecution().toString() and "Cartesian" not in df._jdf.queryExecution().toString()


def test_empty_and_markers(spark):
    none = spark.createDataFrame([], "id int, tokens array<string>")
    one = spark.createDataFrame([(1, ["a"])], "id int, tokens array<string>")
    assert prefixes.shared_prefix(none, one, "id", "tokens").count() == 0 and [tuple(r) for r in prefixes.shared_prefix(one, none, "id", "tokens").collect()] == [(1, 0, None)]
    rows = [("a b c a b".split(), "a b".split(), 3), ("a".split(), "a b".split(), None), ([], ["a"], None), ("a a a".split(), "a a".split(), 1), ("x".split(), [], None)]
    df = spark.createDataFrame([(i, t, m) for i, (t, m, _) in enumerate(rows)], "i int, t array<string>, m array<string>")
    assert {r.i: r.p for r in df.select("i", prefixes.last_marker(F.col("t"), F.col("m")).alias("p")).collect()} == {i: w for i, (*_, w) in enumerate(rows)}
