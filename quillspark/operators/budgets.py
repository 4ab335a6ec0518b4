"""Greedy admission of drafts under several budgets, as rounds of joins.

Read one by one, a draft is admitted if each of its keys has been used less often than its
limit; it then uses them all. Phases follow each other; when one is over, a seeded sample of its
admitted drafts stays and the rest give back what they used.

Here all drafts are judged at once, again and again. For each key of a draft there is a least
number of uses before it, by drafts that certainly count, and a most, with those that are still
open. Least at the limit rejects the draft; most below it for all keys admits it. Neither verdict
can change later, and the first open draft of all always gets one, so the rounds end with what
the reading one by one gives. Their number would follow the longest chain of drafts that wait for
each other, not the number of drafts.

Drafts of a phase with equal items are few at once: the first of them that is rejected is followed
by rejected ones alone, as within a phase uses only grow, and so is the one that uses up a key. So
no more of them than the least limit of a key that isn't late can be admitted, and only these first
ones go into the rounds.

Uses before a draft are sums by key, phase and block of positions, summed up over blocks and then
within a block, so a key that a third of all drafts have is no task of its own.

Rounds go on while they settle much. Chains are left then, of which a round settles a link each; they
are read one by one, IN_ORDER drafts at most in a task: the next whole phases, or the next drafts of
a phase with more. The uses by all that is settled already are summed up by Spark before. Such a
batch counts as a round.

A round's states are written as a table and read again, and meet their keys' sums and their verdicts by a
sort-merge join that is asked for: judged by the size of small files, drafts and their keys would be
broadcast, which the driver has to hold.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.tables import Written

#: A draft's state.
OPEN, ADMITTED, REJECTED, KEPT, GIVEN_BACK = range(5)
#: Kept drafts up to which each task gets them all.
LISTED = 100_000
#: Drafts that a task reads one by one at most.
IN_ORDER = 1 << 16
#: Least share of the open drafts that a round must settle for another one to follow.
MUCH = 0.5
COUNTED = {"kept": KEPT, "soon": ADMITTED, "open": OPEN}


@dataclass
class Admission:
    """df: the drafts with kept; rounds: how many it took."""

    df: DataFrame
    rounds: int


def item(key: Column, limit: int, late: bool = False) -> Column:
    """A key of a draft and how often it may be used; a late one sees earlier phases only, as they are after sampling."""
    return F.struct(key.cast("string").alias("key"), F.lit(limit).alias("limit"), F.lit(late).alias("late"))


def _uses_before(live: DataFrame) -> DataFrame:
    """The open rows of live (key, phase, pos, block, n, state) with the uses before each: in earlier blocks, earlier phases and its own block."""
    for name, state in COUNTED.items():
        live = live.withColumn(name, F.when(F.col("state") == state, F.col("n")).otherwise(0))
    sums = live.groupBy("key", "phase", "block").agg(*(F.sum(c).alias(c) for c in COUNTED), F.max(F.col("state") == OPEN).alias("wanted"))
    blocks = Window.partitionBy("key").orderBy("phase", "block").rowsBetween(Window.unboundedPreceding, -1)
    phases = Window.partitionBy("key").orderBy("phase").rangeBetween(Window.unboundedPreceding, -1)
    sums = sums.select("key", "phase", "block", "wanted", *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}_{at}") for c in COUNTED for at, w in (("block", blocks), ("phase", phases)))).where("wanted").drop("wanted")
    inside = Window.partitionBy("key", "phase", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = live.hint("merge").join(sums, ["key", "phase", "block"])
    return rows.withColumns({f"{c}_own": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in COUNTED}).where(F.col("state") == OPEN)


def _least() -> Column:
    """The uses before a row that nothing can take back."""
    return F.when(F.col("late"), F.col("kept_phase")).otherwise(F.expr("kept_block + kept_own + soon_block - soon_phase + soon_own"))


def _verdicts(uses: DataFrame) -> DataFrame:
    """phase, pos and the new state of the drafts whose keys settle it."""
    total = lambda at: sum((F.col(f"{c}_{at}") for c in COUNTED), F.lit(0))
    least = _least()
    most = F.when(F.col("late"), total("phase")).otherwise(total("block") + total("own"))
    found = uses.groupBy("phase", "pos").agg(F.max(least >= F.col("limit")).alias("no"), F.min(most < F.col("limit")).alias("yes"))
    return found.select("phase", "pos", F.when(F.col("no"), REJECTED).when(F.col("yes"), ADMITTED).otherwise(OPEN).alias("new"))


def _sampled(states: DataFrame, seed: str, most_cap: int | None) -> DataFrame:
    """states in which the phases without open drafts are over: of those admitted, cap stay, by a seeded hash of the position."""
    over = states.groupBy("phase").agg((F.max((F.col("state") == OPEN).cast("int")) == 0).alias("over")).where("over")
    ended = F.coalesce(F.col("over"), F.lit(False)) & (F.col("state") == ADMITTED)
    states = states.join(over, "phase", "left").withColumn("_ended", ended).drop("over")
    if most_cap is None:
        return states.withColumn("state", F.when(F.col("_ended"), KEPT).otherwise(F.col("state"))).drop("_ended")
    drawn = F.sha2(F.concat_ws("|", F.lit(seed), F.col("phase"), F.col("pos")), 256)
    place = F.row_number().over(Window.partitionBy("phase").orderBy("_h", "pos"))
    first = states.where("_ended AND cap IS NOT NULL").withColumn("_h", drawn).withColumn("_place", place).where(F.col("_place") <= most_cap).where("_place <= cap")
    states = states.join(first.select("phase", "pos", F.lit(True).alias("_first")), ["phase", "pos"], "left")
    stays = F.col("cap").isNull() | F.col("_first").isNotNull()
    return states.withColumn("state", F.when(F.col("_ended") & stays, KEPT).when(F.col("_ended"), GIVEN_BACK).otherwise(F.col("state"))).drop("_ended", "_first")


def _each(states: DataFrame, block: int) -> DataFrame:
    """A row for each key of a draft."""
    return states.select("phase", "pos", F.floor(F.col("pos") / block).alias("block"), "cap", "state", F.explode("items").alias("i")).select("phase", "pos", "block", "cap", "state", "i.*")


def _next(states: DataFrame, most: int) -> tuple[int, int, int | None]:
    """First and last phase of the next drafts to be read, at most so many that aren't settled; and for a part of one phase the position up to which."""
    unsettled = states.where(F.col("state").isin(OPEN, ADMITTED))
    phases = unsettled.groupBy("phase").count().orderBy("phase").limit(most)
    until = phases.withColumn("until", F.sum("count").over(Window.orderBy("phase")))
    at = until.agg(F.min("phase").alias("first"), F.max(F.when(F.col("until") <= most, F.col("phase"))).alias("last")).first()
    if at["last"] is not None:
        return at["first"], at["last"], None
    part = unsettled.where((F.col("phase") == at["first"]) & (F.col("state") == OPEN)).select("pos").orderBy("pos").limit(most)
    return at["first"], at["first"], part.agg(F.max("pos").alias("pos")).first().pos


def _read(seed: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Reads drafts in order, a row for each key with the uses before it that are settled (least); gives phase, pos and state of the open ones."""

    def read(batches):
        rows = (row for batch in batches for row in batch.to_pylist())
        stayed = Counter()
        for phase, drafts in groupby(rows, itemgetter("phase")):
            own, admitted, new = Counter(), [], []
            for pos, items in groupby(drafts, itemgetter("pos")):
                items = list(items)
                if items[0]["state"] == OPEN:
                    full = any(i["least"] + stayed[i["key"]] + (0 if i["late"] else own[i["key"]]) >= i["limit"] for i in items)
                    new.append((pos, REJECTED if full else ADMITTED))
                    if full:
                        continue
                    for i in items:
                        own[i["key"]] += i["n"]
                admitted.append((hashlib.sha256(f"{seed}|{phase}|{pos}".encode()).hexdigest(), pos, items))
            cap = admitted[0][2][0]["cap"] if admitted else None
            for _, _, items in admitted if cap is None else sorted(admitted, key=itemgetter(0, 1))[: max(cap, 0)]:
                for i in items:
                    stayed[i["key"]] += i["n"]
            if new:
                yield pa.RecordBatch.from_arrays([pa.array([phase] * len(new), pa.int64()), pa.array([p for p, _ in new], pa.int64()), pa.array([s for _, s in new], pa.int32())], ["phase", "pos", "new"])

    return read


def _verdicts_in_order(states: DataFrame, seed: str, block: int, most: int) -> DataFrame:
    """phase, pos and the new state of the next open drafts, read one by one in a task; of a phase read whole, those that will stay count for the later ones."""
    first, last, part = _next(states, most)
    ahead = states.where(F.col("phase") <= last)
    if part is not None:
        ahead = ahead.where((F.col("phase") < first) | (F.col("pos") <= part))
    rows = _uses_before(_each(ahead, block)).select("phase", "pos", "cap", "state", "key", "limit", "late", "n", _least().alias("least"))
    if part is None:
        admitted = ahead.where(F.col("state") == ADMITTED).select("phase", "pos", "cap", "state", F.explode_outer("items").alias("i"))
        rows = rows.unionByName(admitted.select("phase", "pos", "cap", "state", "i.key", "i.limit", "i.late", F.coalesce("i.n", F.lit(0)).alias("n"), F.lit(0).cast("bigint").alias("least")))
    return rows.repartition(1).sortWithinPartitions("phase", "pos").mapInArrow(_read(seed), "phase bigint, pos bigint, new int")


def _plain(drafts: DataFrame) -> DataFrame:
    """phase, pos, cap, the items with keys in an order of their own, and the least limit of those that aren't late."""
    items = F.array_sort(F.filter("items", lambda i: i["key"].isNotNull()))
    drafts = drafts.select("phase", "pos", F.col("cap").cast("int").alias("cap"), F.coalesce(items, F.array().cast(drafts.schema["items"].dataType)).alias("items"))
    return drafts.withColumn("_least", F.array_min(F.transform(F.filter("items", lambda i: ~i["late"]), lambda i: i["limit"])))


def _in_question(drafts: DataFrame) -> DataFrame:
    """phase, pos, cap, state and items (with n, how often a draft has it) of the drafts that can be admitted.

    Of drafts of a phase with equal items, the first ones: as many as the least limit of a key that isn't late.
    Drafts may be _plain() already: written as such, their items are made once.
    """
    drafts = drafts if "_least" in drafts.columns else _plain(drafts)
    most = drafts.agg(F.max("_least").alias("most")).first().most or 0
    place = F.row_number().over(Window.partitionBy("phase", "_same").orderBy("pos"))
    first = drafts.where("_least IS NOT NULL").withColumn("_same", F.sha2(F.to_json("items"), 256)).withColumn("_place", place)
    left = first.where(F.col("_place") <= most).where("_place <= _least").drop("_same", "_place").unionByName(drafts.where("_least IS NULL")).drop("_least")
    counted = F.transform(F.array_distinct("items"), lambda i: F.struct(i["key"].alias("key"), i["limit"].alias("limit"), i["late"].alias("late"), F.size(F.filter("items", lambda j: j == i)).alias("n")))
    return left.withColumns({"items": counted, "state": F.when(F.size("items") > 0, OPEN).otherwise(ADMITTED)})


def admit(drafts: DataFrame, seed: str = "", block: int = 1 << 16, most_rounds: int = 1000, in_order: int = IN_ORDER) -> Admission:
    """drafts with whether each is kept.

    drafts: phase and pos (integers, unique together; phases in order, positions in order within
    one), items (array of item()), cap (drafts of its phase that may stay, null for all; equal
    within a phase), and more columns. Null items and keys don't count, a key that a draft has
    twice is used twice. After most_rounds it stops with an error.
    """
    plain = Written(_plain(drafts), "drafts")
    most_cap = plain.df.agg(F.max("cap").alias("cap")).first().cap
    left = lambda states: Written(_sampled(states, seed, most_cap).where(F.col("state").isin(*COUNTED.values())), "admission")
    n_open = lambda written: written.df.where(F.col("state") == OPEN).count()
    written, rounds, much = left(_in_question(plain.df)), 0, True
    plain.drop()
    now = n_open(written)
    while now:
        if rounds == most_rounds:
            raise RuntimeError(f"admission did not settle in {most_rounds} rounds")
        new = _verdicts(_uses_before(_each(written.df, block))) if much else _verdicts_in_order(written.df, seed, block, in_order)
        states = written.df.join(new.hint("merge"), ["phase", "pos"], "left").withColumn("state", F.coalesce("new", "state")).drop("new")
        before, written = written, left(states)
        before.drop()
        was, now, rounds = now, n_open(written), rounds + 1
        much = much and was - now >= MUCH * was
    kept = written.df.select("phase", "pos", F.lit(True).alias("kept"))
    kept = F.broadcast(kept) if kept.count() <= LISTED else kept.hint("merge")
    return Admission(drafts.drop("kept").join(kept, ["phase", "pos"], "left").fillna(False, ["kept"]), rounds)
