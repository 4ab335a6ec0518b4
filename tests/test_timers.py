"""Operators with timers: loops, batches and streams cut at random into micro-batches, with a restart, say the same."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import metrics, traces
from quillspark.plans import called, catalogue
from quillspark.streaming import timers

S = 1_000_000
DELAY = 200


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, timers.ROCKSDB)
    yield
    spark.conf.set(name, before)


def both(spark, tmp_path, rows, schema, make, n=4):
    """The results of a batch and of a stream in n files, out of order by up to DELAY, stopped and restarted halfway; the last row only moves the watermark."""
    rng = random.Random(len(rows))
    key = schema.split(" ")[0]
    frame = lambda part: spark.createDataFrame(part, schema).withColumn("t", F.timestamp_seconds("s"))
    batch = sorted(map(tuple, make(frame(rows)).collect()), key=repr)
    late = sorted(rows, key=lambda r: r[1] + rng.random() * DELAY * 0.9)
    cuts = [0, *sorted(rng.sample(range(1, len(late)), n - 1)), len(late)]
    parts = [late[a:b] for a, b in zip(cuts, cuts[1:], strict=False)] + [[("zz" if isinstance(rows[0][0], str) else -1, 10**9, *rows[0][2:])]]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(frame(rows[:1]).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withWatermark("t", f"{DELAY} seconds")
    for half in (parts[: n // 2], parts[n // 2 :]):
        for part in half:
            frame(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = make(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(180)
    got = spark.read.parquet(f"{tmp_path}/out").where(~F.col(key).isin("zz", "-1"))
    return batch, sorted(map(tuple, got.collect()), key=repr)


def test_finished(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"r{i}", i * 37 + rng.randrange(d), k) for i in range(25) for d in [rng.choice([60, 119, 121, 180])] for k in ["x"] * rng.randrange(1, 4) + ["run-end"] * (i % 3 > 0)]
    make = lambda df: timers.finished(df, "k", "kind", "t", "run-end", 120 * S)
    batch, stream = both(spark, tmp_path, rows, "k string, s int, kind string", make)
    assert batch == stream
    events = spark.createDataFrame(rows, "k string, s int, kind string").withColumn("at", F.col("s").cast("long") * S)
    assert batch == sorted(map(tuple, traces.finished(events, "k", "kind", "at", "run-end", 10**16, 120 * S).collect()), key=repr)


def test_held_answers(spark, tmp_path):
    rng = random.Random(2)
    rows, schema = [(k, s, i, rng.random() < 0.5) for i, (k, s) in enumerate((k, s) for k in "ab" for s in sorted(rng.choices(range(6000), k=50)))], "k string, s int, id bigint, holds boolean"
    batch, stream = both(spark, tmp_path, rows, schema, lambda df: timers.held_answers(df, "k", "t", "id", "holds", 300 * S))
    assert batch == stream and len(batch) > 20
    df = spark.createDataFrame(rows, schema).withColumn("at", F.col("s").cast("long") * S)
    assert {r[1] for r in batch} == {r.id for r in metrics.within_hold(df, "k", "at", ["at", "id"], F.col("holds"), 300).collect()}


def hold_loop(rows, timeout):
    """All that happens to one thing, second by second."""
    held, out = {}, []
    for now in range(max(s for s, *_ in rows) + timeout + 2):
        for _, who, takes in sorted(r for r in rows if r[0] == now):
            n = lambda: sum(t is not None for t in held.values())
            if takes and who not in held:
                held[who] = now
                out.append((now * S, who, "taken", n(), False))
            elif not takes and held.pop(who, None) is not None:
                out.append((now * S, who, "released", n(), n() == 0))
        for who in sorted(w for w, t in held.items() if t is not None and t + timeout == now):
            held[who] = None
            n = sum(t is not None for t in held.values())
            out.append((now * S, who, "timeout", n, n == 0))
    return out


def test_holds(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, rng.randrange(900), rng.choice("uvw"), rng.random() < 0.6) for k in ("p", "q") for _ in range(80)]
    batch, stream = both(spark, tmp_path, rows, "k string, s int, who string, takes boolean", lambda df: timers.reference_holds(df, "k", "t", "who", "takes", 30 * S))
    want = sorted(((k, *x) for k in ("p", "q") for x in hold_loop([r[1:] for r in rows if r[0] == k], 30)), key=repr)
    assert batch == want and stream == want and {x[3] for x in want} == {"taken", "released", "timeout"}


def spool_loop(rows, caps, most, most_bytes):
    kept, out = [], []
    for at, id, kind, size in sorted(rows):
        gone = []
        while sum(k == kind for _, k, _ in kept) >= caps[kind] and any(k == kind for _, k, _ in kept):
            gone.append(kept.pop(next(i for i, r in enumerate(kept) if r[1] == kind)))
        while kept and (len(kept) >= most or sum(r[2] for r in kept) + size > most_bytes):
            gone.append(kept.pop(0))
        kept.append((id, kind, size))
        out += [(g[0], at, "evicted", id) for g in gone] + [(id, at, "admitted", None)]
    return out


def test_spool(spark, tmp_path):
    rng = random.Random(4)
    caps = {"a": 3, "b": 2, "c": 0}
    rows = [(k, rng.randrange(2000), i, rng.choice("aaabc"), rng.choice([10, 40, 90, 150])) for i, k in enumerate(rng.choices("pq", k=120))]
    batch, stream = both(spark, tmp_path, rows, "k string, s int, id bigint, kind string, size bigint", lambda df: timers.admitted(df, "k", "t", "id", "kind", "size", caps, 4, 200))
    want = sorted(((k, *x) for k in "pq" for x in spool_loop([(s * S, *r) for kk, s, *r in rows if kk == k], caps, 4, 200)), key=repr)
    assert batch == want and stream == want
    steady = {r[1] for r in want if r[3] == "admitted"} - {r[1] for r in want if r[3] == "evicted"}
    assert len(steady) <= 8 and any(r[3] == "evicted" for r in want)


def test_logs_of_events(spark):
    sf = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id", "unix_micros(CAST(ts AS timestamp)) AS at", "user_id", "event_type", "value").collect()
    kind = lambda e: e.event_type if e.event_type in called.CAPS else "view"
    import math

    want = [(k, *x) for k in range(20) for x in spool_loop([(e.at, e.event_id, kind(e), math.ceil(e.value)) for e in events if e.user_id % 20 == k], called.CAPS, called.MOST_RECORDS, called.MOST_BYTES)]
    assert sorted(map(tuple, catalogue.QUERIES["spool_log"](spark, sf).collect()), key=repr) == sorted(want, key=repr)
    log = catalogue.QUERIES["hold_log"](spark, sf).collect()
    taken, left = ({(r.thing, r.holder, r.at) for r in log if (r.change == "taken") == x} for x in (True, False))
    assert len(taken) == len(left) > 100 and sum(r.restored for r in log) >= 10


def test_cascade_keeps_repeated_rows(spark):
    from quillspark.operators import detection

    rows = [("a", 0, 0.9, 0.9), ("a", 0, 0.9, 0.9), ("a", 5, 0.9, 0.9), ("a", 0, 0.1, None), ("a", None, 0.9, 0.9)]
    got = detection.cascade(spark.createDataFrame(rows, "k string, i bigint, s double, v double"), "k", "i", "s", "v", 0.2, 0.5, 0.5, 10)
    assert sorted((r.i if r.i is not None else -1, r.gate) for r in got.collect()) == [(-1, "refractory"), (0, "below"), (0, "fired"), (0, "fired"), (5, "refractory")]
