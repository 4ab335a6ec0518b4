"""The upsert table against a dict, with crashes between writing and the ledger."""

import random

import pytest

from quillspark.streaming.upserts import UpsertTable

SCHEMA = "k bigint, at bigint, a string, b int"


def loop(rows, keep_for=None):
    out, seen = {}, max(r[1] for r in rows)
    for k, at, a, b in sorted(rows, key=lambda r: (r[1], r[2] or "", r[3] if r[3] is not None else -1)):
        old = out.get(k, (at, None, None))
        out[k] = (at, a if a is not None else old[1], b if b is not None else old[2])
    return {k: v for k, v in out.items() if keep_for is None or v[0] >= seen - keep_for}


def made(rng, n, offset):
    return [(rng.randrange(12), offset + i, rng.choice([None, "x", "y", "é"]), rng.choice([None, 1, 2, 3])) for i in range(n)]


def contents(table):
    return {r.k: (r.at, r.a, r.b) for r in table.read().collect()}


def test_batches_and_repeats(spark, tmp_path):
    rng = random.Random(1)
    table = UpsertTable(spark, f"file://{tmp_path}/t", SCHEMA, "k", "at", buckets=4)
    assert contents(table) == {}
    rows = []
    for number in range(3):
        rows += (new := made(rng, 15, number * 10))
        batch = spark.createDataFrame([*new, (None, 1, "n", 1), (1, None, "n", 1)], SCHEMA)
        assert table.apply(batch, number) and not table.apply(batch, number)
        assert contents(table) == loop(rows)


def test_expiry(spark, tmp_path):
    table = UpsertTable(spark, f"file://{tmp_path}/t", SCHEMA, "k", "at", buckets=3, keep_for=20)
    rows = [(1, 0, "x", 1), (2, 5, "x", 1)]
    table.apply(spark.createDataFrame(rows, SCHEMA), 0)
    table.apply(spark.createDataFrame([(2, 25, None, 2), (3, 26, "z", None)], SCHEMA), 1)
    assert contents(table) == {2: (25, "x", 2), 3: (26, "z", None)}
    table.apply(spark.createDataFrame([(k, 90, "q", 9) for k in range(4, 9)], SCHEMA), 2)
    assert set(contents(table)) == set(range(4, 9))


def test_crash_between_write_and_ledger(spark, tmp_path):
    """A stream that dies after a version is written, and once more, ends with what each row applied once gives."""
    rng = random.Random(2)
    rows = made(rng, 60, 0)
    (tmp_path / "in").mkdir()
    for i in range(3):
        spark.createDataFrame(rows[i * 20 : (i + 1) * 20], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    table = UpsertTable(spark, f"file://{tmp_path}/t", SCHEMA, "k", "at", buckets=4)
    crashes = iter([False, True, True, False, False, False])

    def crash():
        if next(crashes):
            raise OSError("killed")

    for expect in ("killed", "killed", None):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = table.sink(stream, f"{tmp_path}/state", crash).trigger(availableNow=True).start()
        if expect:
            with pytest.raises(Exception, match=expect):
                query.awaitTermination(120)
        else:
            query.awaitTermination(120)
    assert contents(table) == loop(rows) and [x["batch"] for x in table.ledger()] == [0, 1, 2]
