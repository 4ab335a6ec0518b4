"""Operators on small hand-made rows: bounds, ties, nulls, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import numbers as N
from quillspark.functions import text as X
from quillspark.operators import corpus, detection, evaluation, lexical, traces


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def value(spark, column, **given):
    names = list(given)
    df = spark.createDataFrame([tuple(given.values())], ", ".join(f"{n} {'array<string>' if isinstance(v, list) else 'string' if isinstance(v, str) or v is None else 'double'}" for n, v in given.items()))
    assert names == df.columns
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    "text, plain",
    [
        ("Please can you turn ON the light’s fan for me for me", "turn on the light s fan"),
        ("", ""),
        ("?!", ""),
        ("tell me please", "tell me please"[8:]),
        ("Éteins la lampe", "teins la lampe"),
    ],
)
def test_normalize_utterance(spark, text, plain):
    assert value(spark, X.normalize_utterance(F.col("t")), t=text) == plain


@pytest.mark.parametrize("token, one", [("batteries", "battery"), ("switches", "switch"), ("lights", "light"), ("glass", "glass"), ("ies", "ies"), ("es", "es")])
def test_singular(spark, token, one):
    assert value(spark, X.singular(F.col("t")), t=token) == one


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_word_error_rate(spark):
    rng = random.Random(3)
    pairs = [([], []), ([], ["a"]), (["a"], [])] + [([rng.choice("abc") for _ in range(rng.randrange(7))], [rng.choice("abc") for _ in range(rng.randrange(7))]) for _ in range(30)]
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    for r in df.select("a", "b", X.word_error_rate(F.col("a"), F.col("b")).alias("w")).collect():
        expected = (0.0 if not r.b else 1.0) if not r.a else edit(r.a, r.b) / len(r.a)
        assert r.w == pytest.approx(expected), (r.a, r.b)


def test_phrase_in(spark):
    assert value(spark, X.phrase_in(F.col("p"), F.col("w")), p=["b", "c"], w=["a", "b", "c"])
    assert not value(spark, X.phrase_in(F.col("p"), F.col("w")), p=["b", "c"], w=["b", "x", "c"])
    assert not value(spark, X.phrase_in(F.col("p"), F.col("w")), p=[], w=["b"])


def test_ratio_policies(spark):
    zero = spark.createDataFrame([(3.0, 0.0)], "n double, d double")
    got = zero.select(N.rate(F.col("n"), F.col("d")), N.per_hour(F.col("n"), F.col("d")), N.per_hour_or_null(F.col("n"), F.col("d"))).first()
    assert tuple(got) == (0.0, float("inf"), None)


@pytest.mark.parametrize("values, middle", [([1.0], 1.0), ([1.0, 2.0], 2.0), ([3.0, 1.0, 2.0], 2.0), ([4.0, 1.0, 2.0, 3.0], 3.0)])
def test_upper_median(spark, values, middle):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert N.upper_medians(df, [], "x", "middle").first()[0] == middle


def test_weak_cap_in_slices(spark):
    """The first weak rows by order up to a share of all, whatever the slices."""
    from quillspark.operators import corpus

    data = [(i * i, i % 3 == 0) for i in range(40)]
    rows = spark.createDataFrame(data, "id bigint, weak boolean")
    for share, slices in ((0.1, 3), (0.25, 4096), (0.0, 1), (2.0, 7)):
        want = [i for i, w in data if not w] + [i for i, w in data if w][: max(1, int(40 * share))]
        assert sorted(r.id for r in corpus.capped_weak(rows, F.col("weak"), "id", share, slices).collect()) == sorted(want)


def fires(times, gap):
    out = []
    for t in sorted(set(times)):
        if not out or t - out[-1] >= gap:
            out.append(t)
    return out


@pytest.mark.parametrize("bucket", [7, 40, 1000])
def test_refractory_equals_loop(spark, bucket):
    rng = random.Random(bucket)
    data = [(s, rng.randrange(400)) for s in range(6) for _ in range(rng.randrange(60))] + [(9, 0), (9, 10), (9, 19), (9, 20)]
    got = detection.refractory(spark.createDataFrame(data, "stream int, idx bigint"), "stream", "idx", 10, bucket)
    assert rows(got, "stream", "idx") == sorted(((s, t) for s in {d[0] for d in data} for t in fires([x for k, x in data if k == s], 10)), key=repr)


def test_refractory_empty(spark):
    assert detection.refractory(spark.createDataFrame([], "stream int, idx bigint"), "stream", "idx", 10).count() == 0


def test_interval_bounds(spark):
    points = spark.createDataFrame([("a", t) for t in (9, 10, 15, 20, 21)] + [("b", 15)], "k string, idx bigint")
    spans = spark.createDataFrame([("a", "s", 10, 20)], "k string, span_id string, start bigint, end bigint")
    assert rows(detection.outside_intervals(points, spans, "k", "idx", 4), "k", "idx") == [("a", 21), ("a", 9), ("b", 15)]
    # strict on both sides: start < index and end > index - window
    assert rows(detection.overlapping(points, spans, "k", "idx", 1, 4), "k", "idx") == [("a", 15), ("a", 20)]
    anchors = spark.createDataFrame([("a", 15)], "k string, at bigint")
    assert rows(detection.near_points(anchors, points, "k", "idx", -5, 5), "idx") == [(10,), (15,), (20,)]


def test_window_grid(spark):
    df = spark.createDataFrame([("short", 9), ("equal", 10), ("long", 16)], "k string, n bigint")
    assert rows(detection.window_grid(df, "n", 10, 3), "k", "window_end") == [("equal", 10), ("long", 10), ("long", 13), ("long", 16)]
    chunks = spark.createDataFrame([("s", 4), ("s", 10), ("s", 11), ("s", 20)], "k string, e bigint")
    assert rows(detection.last_of_chunk(chunks, "k", "e", 10, 3), "e", "point", "lag") == [(10, 10, 0), (20, 19, 1)]


def cluster_loop(windows):
    open_ = []
    for s, e, score in sorted(windows):
        for c in open_:
            if c[1] < e and s < c[2]:
                c[4] += 1
                if score >= c[3]:
                    c[1:4] = [s, e, score]
                break
        else:
            open_.append([s, s, e, score, 1])
    return sorted(map(tuple, open_))


def test_clusters_equal_loop(spark):
    rng = random.Random(5)
    data = [("k", s, s + rng.randrange(1, 9), float(rng.randrange(4))) for s in (rng.randrange(80) for _ in range(50))] + [("t", 0, 5, 1.0), ("t", 5, 9, 1.0)]
    got = detection.clusters(spark.createDataFrame(data, "k string, s bigint, e bigint, x double"), "k", "s", "e", "x")
    for k in "kt":
        assert sorted(tuple(r)[1:] for r in got.collect() if r.k == k) == cluster_loop([d[1:] for d in data if d[0] == k])


def test_tri_state_success(spark):
    data = [(1, 1, "2024-01-01", True), (2, 2, None, False), (3, 3, "2024-01-03", None), (4, 4, "2024-01-04", False)]
    df = spark.createDataFrame(data, "trace_id int, seq int, started_at string, success boolean").withColumn("error_stage", F.lit("x"))
    assert rows(traces.list_traces(df, 9, only_failures=True), "trace_id") == [(2,), (4,)]
    assert rows(traces.list_traces(df, 9, start="2024-01-03", end="2024-01-04"), "trace_id") == [(3,), (4,)]
    assert rows(traces.retained(df, 3, "2024-01-04"), "trace_id") == [(2,), (4,)]


def test_nested_events(spark):
    t = spark.createDataFrame([(1,), (2,)], "id int")
    e = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (7, 1, "orphan")], "id int, seq int, x string")
    got = {r.id: [x.x for x in r.events] for r in traces.nest_events(t, e, "id", ["seq"], ["x"]).collect()}
    assert got == {1: ["a", "b"], 2: []}


def test_label_audit(spark):
    data = [("p1", "h", "positive"), ("p2", "h", "negative"), ("p3", "h", None), ("q1", "g", "positive"), ("q2", "g", None), ("n", None, "positive")]
    df = spark.createDataFrame(data, "path string, sha string, label string")
    assert rows(corpus.label_conflicts(df, "sha", "label"), "path") == [("p1",), ("p2",), ("p3",)]
    assert rows(corpus.duplicates(df, "sha", "path", F.col("path") == "p3"), "path", "retained_copy") == [("p1", "p3"), ("p2", "p3"), ("q2", "q1")]


def test_splits(spark):
    sessions = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "s string")
    held = spark.createDataFrame([("b",), ("c",)], "s string")
    assert dict(rows(corpus.assign_splits(sessions, "s", 1, 0.0, held), "s", "split")) == {"a": "train", "b": "holdout"}
    stored = spark.createDataFrame([("a", "eval"), ("b", "train"), ("d", "train")], "s string, split string")
    assert dict(rows(corpus.merge_splits(stored, sessions, "s", 1, 0.0, held), "s", "split")) == {"a": "eval", "b": "holdout", "c": "holdout", "d": "train"}


def test_bags(spark):
    e = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "z")], "c int, i string")
    a = spark.createDataFrame([(1, "y"), (1, "x"), (1, "x"), (3, "z")], "c int, i string")
    assert rows(evaluation.bag_comparison(e, a, "c", "i"), "c", "n_matched", "n_missing", "n_unexpected", "equal") == [(1, 3, 0, 0, True), (2, 0, 1, 0, False), (3, 0, 0, 1, False)]


def test_unique_owners(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2), (None, 3)], "label string, id int")
    assert rows(evaluation.unique_owners(df, "label", "id"), "label", "id") == [("a", 1)]


def test_history(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "assistant", "which? "), (1, 3, "user", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "done."), (2, 2, "user", "b"), (3, 0, "assistant", "hi"), (4, 0, "assistant", "ok;"), (4, 1, "user", "c")]
    df = spark.createDataFrame(turns, "c int, i int, role string, text string")
    assert rows(lexical.history(df, "c", "i"), "c", "i") == sorted([(1, 0), (1, 1), (1, 2), (1, 3), (2, 2), (3, 0), (4, 0), (4, 1)], key=repr)


def test_phrase_matches(spark):
    u = spark.createDataFrame([(1, "Turn on the Living-room lamp"), (2, "lamp in living"), (3, None)], "id int, utterance string")
    labels = spark.createDataFrame([("living room", "r"), ("lamp", "l"), ("", "none")], "label string, what string")
    assert rows(lexical.phrase_matches(u, labels, "id"), "id", "what") == [(1, "l"), (1, "r"), (2, "l")]


def test_closure(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 5)], "a int, b int")
    assert rows(lexical.closure(edges, "a", "b"), "a", "b") == [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (5, 5)]


def test_range_joins_use_no_nested_loop(spark):
    points = spark.range(10).selectExpr("id % 2 AS k", "id AS idx")
    spans = spark.range(10).selectExpr("id % 2 AS k", "id AS start", "id + 1 AS end")
    plan = detection.outside_intervals(points, spans, "k", "idx", 4)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_contracts(spark):
    from quillspark.operators import contracts

    tools = spark.createDataFrame([("t", ["a", "b"], ["a"], {"b": ["1", "2"]})], "tool string, allowed array<string>, required array<string>, choices map<string,array<string>>")
    calls = [(1, "t", {"a": "x"}), (2, "u", {}), (3, "t", {"c": "1"}), (4, "t", {"b": "1"}), (5, "t", {"a": "x", "b": "3"}), (6, "t", {"a": "x", "b": "2"})]
    got = contracts.first_violation(spark.createDataFrame(calls, "id int, tool string, args map<string,string>"), tools)
    assert dict(rows(got, "id", "violation")) == {1: None, 2: "unknown_tool", 3: "unexpected_argument", 4: "missing_argument", 5: "invalid_value", 6: None}
    texts = spark.createDataFrame([("f(a='x, y', n=-2)",), ("f()",), ("say f(a=1) now",), (None,)], "t string")
    call = contracts.parse_call(F.col("t"))
    assert [tuple(r) for r in texts.select(*call.values()).collect()] == [("f", ["a", "n"], ["x, y", "-2"]), ("f", [], []), (None, None, None), (None, None, None)]
    batches = [([("1", "f"), ("2", "f")],), ([("1", "f"), ("1", "g")],), ([("", "f")],), ([],)]
    df = spark.createDataFrame(batches, "b array<struct<id:string,name:string>>")
    assert [r[0] for r in df.select(contracts.well_formed(F.col("b"))).collect()] == [True, False, False, True]


def test_phones(spark):
    from quillspark.operators import metrics

    words = spark.createDataFrame([("abcdefg",), ("xyz",), ("",)], "p string")
    assert [r[0] for r in words.select(metrics.near_phrase(F.col("p"), F.lit("cdxf"))).collect()] == [True, False, False]
