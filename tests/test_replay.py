"""Cascades, runs, holds and capture context against loops in plain Python, and rows by hand."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import captures, contracts, detection, evaluation, metrics, traces


def cascade(rows, mine, detect, verify, gap):
    """One stream's gates, row by row: a veto starts no refractory time."""
    last, out = None, []
    for i, score, verifier in rows:
        if score < detect:
            gate = "below"
        elif last is not None and i - last < gap:
            gate = "refractory"
        elif verifier is None or verifier < verify:
            gate = "vetoed"
        else:
            gate, last = "fired", i
        out.append((i, score >= mine, gate))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_cascade_by_loop(spark, seed):
    rng = random.Random(seed)
    streams = {s: [(i, rng.random(), rng.choice([None, rng.random()])) for i in sorted(rng.sample(range(4000), 400))] for s in "ab"}
    df = spark.createDataFrame([(s, *r) for s, rows in streams.items() for r in rows], "k string, i bigint, s double, v double")
    got = detection.cascade(df, "k", "i", "s", "v", 0.3, 0.5, 0.4, 37)
    assert sorted((r.k, r.i, r.mined, r.gate) for r in got.collect()) == sorted((s, *r) for s, rows in streams.items() for r in cascade(rows, 0.3, 0.5, 0.4, 37))


def test_veto_and_exact_gap(spark):
    rows = [("a", 0, 0.9, 0.1), ("a", 5, 0.9, 0.9), ("a", 14, 0.9, 0.1), ("a", 15, 0.9, 0.9), ("a", 16, 0.5, None), ("a", 25, 0.5, None), ("a", 30, 0.4, 0.9)]
    got = detection.cascade(spark.createDataFrame(rows, "k string, i bigint, s double, v double"), "k", "i", "s", "v", 0.5, 0.5, 0.5, 10)
    assert [r.gate for r in got.orderBy("i").collect()] == ["vetoed", "fired", "refractory", "fired", "refractory", "vetoed", "below"]


def test_pipeline_runs(spark):
    events = [("full", "run-start", 1_000_000, None), ("full", "wake_word-end", 1_400_000, None), ("full", "stt-start", 2_000_000, None), ("full", "stt-vad-end", 3_500_500, None), ("full", "stt-end", 4_000_000, "on"), ("full", "stt-end", 4_500_000, "turn on")]
    events += [("deaf", "run-start", 0, None), ("deaf", "stt-start", 500_000, None), ("deaf", "stt-end", 400_000, "  ")]
    events += [("open", "run-start", 0, None), ("open", "stt-start", None, None), ("open", "stt-end", 9, "x")]
    got = {r.k: r for r in traces.pipeline_spans(spark.createDataFrame(events, "k string, type string, at bigint, text string"), "k", ["at"]).collect()}
    full, deaf, opened = got["full"], got["deaf"], got["open"]
    assert (full.wake_ms, full.speech_end_ms, full.upload_ms, full.stt_ms, full.vad, full.text_length, full.stt_success, full.error_type) == (400, 2500, 1500, 1000, True, 7, True, None)
    assert (deaf.upload_ms, deaf.stt_ms, deaf.vad, deaf.stt_success, deaf.error_type) == (None, 0, False, False, "stt_failed")
    assert (opened.stt_ms, opened.vad, opened.error_type) == (None, None, None)
    runs = spark.createDataFrame([("a", "s", 0), ("a", "end", 50), ("b", "s", 0), ("b", "end", 500), ("c", "s", 950)], "k string, kind string, at bigint")
    assert sorted(map(tuple, traces.finished(runs, "k", "kind", "at", "end", 1000, 100).collect())) == [("a", "complete", 50), ("b", "timeout", 100)]


def test_failures_close_open_spans(spark):
    spans = spark.createDataFrame([("t", 1, None, True), ("t", 2, 3, True), ("t", 4, 9, True), ("t", 6, 7, True), ("u", 1, None, True)], "k string, opened int, closed int, success boolean")
    failures = spark.createDataFrame([("t", 8), ("t", 5)], "k string, at int")
    got = traces.closed_spans(spans, failures, "k").orderBy("k", "opened").collect()
    assert [(r.opened, r.closed, r.success) for r in got] == [(1, 5, False), (2, 3, True), (4, 5, False), (6, 7, True), (1, None, True)]


def test_holds_and_context(spark):
    took, gave = spark.createDataFrame([(1, 0), (2, 0), (3, 50)], "id int, at bigint"), spark.createDataFrame([(1, 10), (2, 99), (3, 40)], "id int, at bigint")
    assert {r.id: r.until for r in captures.hold_spans(took, gave, "id", 30).collect()} == {1: 10, 2: 30, 3: 50}
    windows = spark.createDataFrame([("s", 1, 100, 120, 10), ("s", 2, 5, 25, 10), ("s", 3, 100, 120, 90), ("none", 4, 100, 120, 10)], "k string, id bigint, start bigint, end bigint, at bigint")
    chunks = spark.createDataFrame([("s", 125, 10), ("s", 131, 15), ("s", 400, 80)], "k string, end bigint, arrived bigint")
    got = captures.context_flags(windows, chunks, "k", 10, 10, 200, 5)
    assert {r.id: (r.pre_context_missing, r.post_context_missing) for r in got.collect()} == {1: (False, False), 2: (True, False), 3: (True, False), 4: (False, True)}


def test_small_pieces(spark, tmp_path):
    cases = spark.createDataFrame([("a", "c", "h", ["t"]), ("b", "d", "h", [])], "case_id string, category string, household string, tags array<string>")
    ids = lambda **k: sorted(r.case_id for r in evaluation.select_cases(cases, **k).collect())
    assert (ids(case_id="b", category="c"), ids(household="h"), ids(tag="t"), ids(household="g")) == (["b"], ["a", "b"], ["a"], [])
    phrases = spark.createDataFrame([("x", 0.0), ("x", 0.5), ("y", 0.0), ("y", 0.0)], "v string, e double")
    assert tuple(evaluation.variant_delta(evaluation.variant_summary(phrases, "v", "e"), "v", "x", "y").first()) == (-0.25, 1)
    empty = spark.createDataFrame([], "status string, category string, seconds double, activations array<int>")
    got = metrics.wake_evaluation(empty, ["b"], strict=True).first()
    assert (got.total, got.errors, got.background_seconds) == (0, 1, None)
    captures.write_commands(spark.createDataFrame([("a", True), ("b", False)], "id string, failed boolean"), str(tmp_path))
    assert [r.id for r in spark.read.json(f"{tmp_path}/failures").collect()] == ["a"] and spark.read.json(f"{tmp_path}/commands").count() == 2
    one = spark.createDataFrame([("{",), ('{"choices": []}',), ('{"choices": [{"message": {"content": "hi"}}]}',)], "e string")
    assert [r[0] for r in one.select(contracts.completion(F.col("e"))["content"]).collect()] == [None, None, "hi"]


@pytest.mark.parametrize(("folded", "step"), [(0, 3), (5, 40), (50, 1)])
def test_refractory_by_blocks(spark, folded, step):
    """Islands of any length, by blocks and folded, give what a loop gives; indices may be negative and repeat."""
    rng = random.Random(folded)
    streams = {s: sorted(rng.randrange(-9000, 9000) * step for _ in range(rng.choice([1, 40, 3000]))) for s in "abcd"} | {"dense": list(range(-500, 20000))}
    df = spark.createDataFrame([(s, i) for s, rows in streams.items() for i in rows] + [("a", None)], "k string, i bigint")
    got = {(r.k, r.i) for r in detection.refractory(df, "k", "i", 7, folded_rows=folded).collect()}
    want = set()
    for s, rows in streams.items():
        last = None
        for i in rows:
            if last is None or i - last >= 7:
                last = i
                want.add((s, i))
    assert got == want


def test_refractory_of_a_long_dense_stream(spark):
    """A million rows of one stream without a pause."""
    df = spark.range(1_000_000).selectExpr("'s' AS k", "id * 10 AS i")
    got = detection.refractory(df, "k", "i", 1003).agg(F.count("*").alias("n"), F.max("i").alias("last"), F.countDistinct("i").alias("d")).first()
    assert tuple(got) == (9901, 9900 * 1010, 9901)
