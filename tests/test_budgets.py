"""Admission in rounds against reading the drafts one by one."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.operators import budgets
from quillspark.plans import catalogue

SCHEMA = "phase bigint, pos bigint, items array<struct<key:string,limit:int,late:boolean>>, cap int"


def one_by_one(drafts, seed):
    """Kept (phase, pos) by a loop."""
    used, kept = Counter(), set()
    for phase in sorted({d[0] for d in drafts}):
        before, own = used.copy(), []
        for _, pos, items, cap in sorted((d for d in drafts if d[0] == phase), key=lambda d: d[1]):
            items = [i for i in items or [] if i and i[0] is not None]
            if all((before if late else used)[k] < limit for k, limit, late in items):
                used.update(k for k, *_ in items)
                own.append((pos, items, cap))
        drawn = sorted(own, key=lambda d: (hashlib.sha256(f"{seed}|{phase}|{d[0]}".encode()).hexdigest(), d[0]))
        stay = {d[0] for i, d in enumerate(drawn) if d[2] is None or i < d[2]}
        for pos, items, _ in own:
            if pos in stay:
                kept.add((phase, pos))
            else:
                used.subtract(k for k, *_ in items)
    return kept


def drafts_of(rng, n, n_phases, n_keys):
    limits = {f"k{i}": rng.choice([1, 1, 2, 3, 40]) for i in range(n_keys)}
    caps = {p: rng.choice([None, 0, 2, 5, 30]) for p in range(n_phases)}
    out = []
    for pos in range(n):
        phase = rng.randrange(n_phases)
        keys = [rng.choice(list(limits)) if rng.random() < 0.7 else "k0" for _ in range(rng.randrange(4))]
        items = [(f"{k}@{phase // 2}" if rng.random() < 0.5 else k, limits[k], k == "k1") for k in keys] + ([(None, 1, False)] if rng.random() < 0.1 else [])
        out.append((phase, pos * 3 - 50, items if keys or pos % 2 else None, caps[phase]))
    return out


@pytest.mark.parametrize(("seed", "n", "n_phases", "n_keys", "block"), [(1, 120, 5, 10, 20), (2, 90, 1, 4, 1)])
def test_equals_one_by_one(spark, seed, n, n_phases, n_keys, block):
    drafts = drafts_of(random.Random(seed), n, n_phases, n_keys)
    df = spark.createDataFrame(drafts, SCHEMA).withColumns({"state": F.lit("x"), "kept": F.lit(1)}).repartition(3)
    found = budgets.admit(df, "s", block)
    assert {(r.phase, r.pos) for r in found.df.where("kept").collect()} == one_by_one(drafts, "s")
    assert found.df.count() == n and found.rounds <= 60


def test_rounds_follow_chains_not_size(spark):
    """Four thousand drafts of one key are settled in a few rounds."""
    df = spark.range(4000).select(F.lit(0).cast("bigint").alias("phase"), F.col("id").alias("pos"), F.array(budgets.item(F.lit("one"), 3), budgets.item(F.col("id") % 2000, 1)).alias("items"), F.lit(None).cast("int").alias("cap"))
    found = budgets.admit(df, block=100)
    assert [r.pos for r in found.df.where("kept").orderBy("pos").collect()] == [0, 1, 2] and found.rounds <= 4


def test_nothing_and_too_many_rounds(spark):
    empty = budgets.admit(spark.createDataFrame([], SCHEMA))
    assert empty.df.count() == 0 and empty.rounds == 0
    chain = [(0, i, [(f"k{i}", 1, False), (f"k{i + 1}", 1, False)], None) for i in range(8)]
    with pytest.raises(RuntimeError, match="1 rounds"):
        budgets.admit(spark.createDataFrame(chain, SCHEMA), most_rounds=1)
    assert sorted(r.pos for r in budgets.admit(spark.createDataFrame(chain, SCHEMA)).df.where("kept").collect()) == [0, 2, 4, 6]


def test_query_equals_one_by_one(spark):
    from quillspark.plans import called

    sf = "/root/testdata/sf0.001"
    drafts = called.drafts(spark, sf)
    want = one_by_one([(r.phase, r.pos, [tuple(i) for i in r["items"]], r.cap) for r in drafts.collect()], called.SEED)
    got = catalogue.QUERIES["admitted_cases"](spark, sf).collect()
    assert {(r.phase, r.pos) for r in got} == want and len(got) == len(want) > 20


def test_equal_drafts_go_on_as_often_as_they_can_be_admitted(spark):
    """A thousand drafts of six sets of items: only those that can be admitted go into the rounds, and the result stays that of the loop."""
    sets = [[("a", 1, False), ("b", 3, False)], [("b", 3, False)], [("c", 2, False), ("late", 1, True)], [("late", 1, True)], [("none", 0, False)], [("d", 40, False), ("d", 40, False), ("b", 3, False)]]
    rng = random.Random(6)
    drafts = [(rng.randrange(3), pos, rng.sample(s := rng.choice(sets[:3] + sets[4:]) if pos % 100 else sets[3], len(s)), 25) for pos in range(1000)]
    df = spark.createDataFrame(drafts, SCHEMA)
    left = budgets._in_question(df).groupBy("phase").count().collect()
    assert len(left) == 3 and all(r["count"] <= 1 + 3 + 2 + 3 + 10 for r in left)
    assert {(r.phase, r.pos) for r in budgets.admit(df, "s").df.where("kept").collect()} == one_by_one(drafts, "s")


def test_drafts_are_not_broadcast(spark):
    """However small their files are: the driver would have to hold them."""
    df = spark.createDataFrame(drafts_of(random.Random(3), 50, 2, 4), SCHEMA)
    states = budgets._in_question(df)
    live = states.select("phase", "pos", F.lit(0).alias("block"), "state", F.explode("items").alias("i")).select("phase", "pos", "block", "state", "i.*")
    plan = budgets._uses_before(live)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_a_long_chain_is_read_in_order(spark):
    """Two hundred drafts each of which waits for the one before, over ten phases: not a round for each."""
    chain = [(i // 20, i, [(f"k{i}", 1, False), (f"k{i + 1}", 1, False)], None) for i in range(200)]
    found = budgets.admit(spark.createDataFrame(chain, SCHEMA), most_rounds=4)
    assert sorted(r.pos for r in found.df.where("kept").collect()) == list(range(0, 200, 2))


@pytest.mark.parametrize(("seed", "n_phases", "in_order"), [(4, 5, 45), (5, 1, 30)])
def test_batches_of_whole_phases_and_of_parts_of_one(spark, monkeypatch, seed, n_phases, in_order):
    monkeypatch.setattr(budgets, "MUCH", 2)  # batches from the second round on
    drafts = drafts_of(random.Random(seed), 120, n_phases, 12)
    found = budgets.admit(spark.createDataFrame(drafts, SCHEMA), "s", block=20, in_order=in_order)
    assert {(r.phase, r.pos) for r in found.df.where("kept").collect()} == one_by_one(drafts, "s") and 2 < found.rounds < 9
