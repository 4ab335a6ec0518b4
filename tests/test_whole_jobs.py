"""Queries over whole texts and all rows, on small tables against brute force."""

import random
import re
from decimal import ROUND_HALF_UP, Decimal

import pytest

from quillspark.operators import evaluation
from quillspark.plans import catalogue


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def rate(a, b):
    return (1.0 if b else 0.0) if not a else edit(a, b) / len(a)


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    """Documents and benchmark texts of up to some hundred words, some equal up to a late word, with their folder."""
    rng = random.Random(7)
    words = lambda n: " ".join(rng.choice(["lamp", "Red", "é", "kitchen-2", "off", "...", "a"]) for _ in range(n))
    bench = {i: words(n) for i, n in enumerate([0, 3, 60, 150])} | {4: "!?"}
    docs = {i: words(rng.choice([0, 1, 20, 45, 90, 200])) for i in range(400) if i % 40 < 5}
    docs |= {47: f"{bench[2]} one word more", 43: bench[3] + " end", 2: bench[2], 4: "?!", 44: "words " * 60}
    path = tmp_path_factory.mktemp("texts")
    spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(bench.items()), "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs, bench, str(path)


def test_cer_of_whole_texts(spark, texts):
    docs, bench, path = texts
    plain = lambda t: re.sub("[^a-z0-9]+", " ", t.lower()).strip()
    got = {r.doc_id: r.cer for r in catalogue.QUERIES["cer"](spark, path).collect()}
    assert got == pytest.approx({i: rate(plain(t), plain(bench[i % 5])) for i, t in docs.items()})


def test_wer_of_whole_texts(spark, texts):
    docs, bench, path = texts
    tokens = lambda t: re.findall("[a-z0-9]+", t.lower())
    got = {r.doc_id: r.wer for r in catalogue.QUERIES["wer"](spark, path).collect()}
    assert got == pytest.approx({i: rate(tokens(t), tokens(bench[i % 5])) for i, t in docs.items()})
    assert got[47] == pytest.approx(edit(tokens(docs[47]), tokens(bench[2])) / len(tokens(docs[47]))) and got[47] > 0


def test_edit_distance():
    rng = random.Random(5)
    for most in [4] * 2000 + [70] * 60:
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(most))] for _ in range(2))
        assert evaluation.edit_distance(a, b) == edit(a, b), (a, b)


def test_offered_tools_of_all_customers(spark, tmp_path):
    customers = [(1, 0, "BUILDING"), (9, 0, "AUTOMOBILE"), (2, 1, "FURNITURE"), (18, 2, "HOUSEHOLD"), (4, 2, None), (5, 3, "BUILDING"), (6, 3, "MACHINERY")]
    spark.createDataFrame(customers, "c_custkey bigint, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    got = {tuple(r) for r in catalogue.QUERIES["offered_tools"](spark, str(tmp_path)).select("c_nationkey", "tool").collect()}
    assert got == {(0, "a"), (0, "b"), (1, "a"), (1, "c"), (2, "a"), (3, "a"), (3, "b"), (3, "c")}


def test_pooled_windows(spark):
    """Every window end of streams over several blocks, with vectors far from 0."""
    import numpy as np
    from pyspark.sql import functions as F

    from quillspark.operators import metrics

    rng = np.random.default_rng(1)
    streams = {k: rng.normal(1e4, 1.0, (n, 3)) for k, n in (("a", 1), ("b", 15), ("c", 100))}
    df = spark.createDataFrame([(k, i, v.tolist()) for k, x in streams.items() for i, v in enumerate(x)], "k string, p int, v array<double>").withColumn("block", F.lit(1)).repartition(3)
    got = {(r.k, r.p): r.pooled for r in metrics.pooled_windows(df, "k", "p", "v", 16, 10).collect()}
    assert len(got) == 116
    for (k, i), pooled in got.items():
        part = streams[k][max(i - 15, 0) : i + 1]
        assert np.abs(np.array(pooled) - np.concatenate([part.mean(0), part.std(0)])).max() < 1e-9


def test_near_targets(spark):
    """Several hundred targets against all pairs; the plan has no nested loop."""
    from quillspark.operators import metrics

    rng = random.Random(5)
    word = lambda a, b: "".join(rng.choice("abcdef") for _ in range(rng.randint(a, b)))
    words, targets = [(i, word(0, 9)) for i in range(150)] + [(999, None)], [word(2, 6) for _ in range(300)] + ["", None]
    df = metrics.near_targets(spark.createDataFrame(words, "k int, p string"), spark.createDataFrame([(t,) for t in targets], "t string"), "k", "p", "t")
    runs = lambda p: {p[i : i + n] for n in (3, 4, 5) for i in range(len(p) - n + 1)}
    want = {(k, t) for k, p in words if p for t in targets if t and any(edit(r, t) <= 1 for r in runs(p))}
    assert {tuple(r) for r in df.collect()} == want and len(want) > 1000
    plan = df._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_near_targets_of_equal_words(spark, monkeypatch):
    """Runs are made for distinct words and not broadcast; many pairs meet the words by a shuffle, with the same result."""
    from quillspark.operators import metrics

    words = spark.createDataFrame([(i, ["abcde", "bcd", "xy", None][i % 4]) for i in range(400)] + [(1, "abcde")], "k int, p string")
    targets = spark.createDataFrame([("abc",), ("bcde",), ("zzz",)], "t string")
    few = metrics.near_targets(words, targets, "k", "p", "t")
    assert "repartition" in few._jdf.queryExecution().toString().lower() and "explode" not in few._jdf.queryExecution().toString()
    monkeypatch.setattr(metrics, "LISTED_PAIRS", 0, raising=False)
    many = metrics.near_targets(words, targets, "k", "p", "t")
    assert "BroadcastHashJoin" not in many._jdf.queryExecution().executedPlan().toString()
    want = {(i, t) for i in range(400) for t in (("abc", "bcde"), ("bcde",), (), ())[i % 4]} | {(1, "abc")}
    got = [sorted(tuple(r) for r in df.collect()) for df in (few, many)]
    assert got == [sorted(want)] * 2


def test_ensemble_sums_in_the_order_of_events(spark, tmp_path):
    """Means that lie between two numbers of nine digits: the order of the sums decides, and is that of the events, however the table is cut."""
    rng = random.Random(11)
    rows = [(i, i % 500, rng.randrange(50000) / 100) for i in range(500 * 64)]
    sums = [0.0] * 500
    for _, user, value in rows:
        sums[user] += (value + 1) / 600
    want = {user: float(Decimal(repr(s / 64)).quantize(Decimal("1e-9"), ROUND_HALF_UP)) for user, s in enumerate(sums)}
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, value double")
    for name, dealt in (("some", df.repartition(8, "event_id")), ("sorted", df.coalesce(1).sortWithinPartitions("value"))):
        dealt.write.parquet(f"{tmp_path}/{name}/events.parquet")
        assert {r.user_id: r.by_mean for r in catalogue.QUERIES["ensemble_logit"](spark, f"{tmp_path}/{name}").collect()} == want
