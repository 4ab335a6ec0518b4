"""Readers on files made here, and streaming twins against their batch operators."""

import json
import random
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import detection
from quillspark.sources import audio, records
from quillspark.streaming import twins


def test_json_lines(spark, tmp_path):
    good = {"id": "a", "category": "c", "tags": ["x"], "household": "h", "utterance": "u", "expected": {"response_type": "action", "calls": []}, "provenance": {"source": "s"}}
    bad = good | {"id": "", "expected": {"response_type": "other"}, "tags": None}
    (tmp_path / "c.jsonl").write_text("\n".join(["", json.dumps(good), "   ", json.dumps(bad)]))
    cases = records.read_json_lines(spark, str(tmp_path / "c.jsonl"), records.CASE)
    assert [r.faults for r in records.case_faults(cases).collect()] == [["id", "tags", "response_type", "calls"]]
    assert records.repeated_ids([cases, cases.where("id = 'a'")], "id").first().id == "a"
    (tmp_path / "bad.jsonl").write_text("[1]\n{\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        records.read_json_lines(spark, str(tmp_path / "bad.jsonl"), records.CASE).collect()
    assert records.read_json_lines(spark, str(tmp_path / "bad.jsonl"), records.CASE, strict=False).where("id IS NOT NULL").count() == 0


def test_record_folders(spark, tmp_path):
    for name, content in {"r1": '{"capture_id": "c1", "score": 0.5, "fired": true}', "r2": "{}", "r3": "{broken"}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "record.json").write_text(content)
    got = {r.capture_id: (r.score, r.fired, r.sample_end) for r in records.read_records(spark, str(tmp_path)).collect()}
    assert got == {"c1": (0.5, True, 0), "r2": (0.0, False, 0)}


def test_spools_of_all_layouts(spark, tmp_path):
    """Records before events, events where no record is readable, sidecars beside sounds; malformed files are told."""
    put = lambda name, text: ((tmp_path / name).parent.mkdir(parents=True, exist_ok=True), (tmp_path / name).write_text(text))
    put("a/records/r1/record.json", '{"capture_id": "c1", "score": 0.5}')
    put("a/records/r2/record.json", "{broken")
    put("a/events/e1/record.json", '{"event_id": "old"}')
    for name, text in {"x.wav": "RIFF", "x.json": '{"fired": true}', "y.wav": "RIFF", "y.json": "[", "alone.json": "{}", "z.wav": "RIFF"}.items():
        put(f"a/{name}", text)
    put("b/records/r1/record.json", "nothing")
    put("b/events/e1/record.json", '{"event_id": "old"}')
    put("b/events/e2/record.json", "{}")
    put("c/note.txt", "")
    found = {}
    for name in "abc":
        rows, bad = records.read_spool(spark, str(tmp_path / name))
        found[name] = sorted((r.capture_id, r.score, r.fired) for r in rows.collect()), sorted("/".join(r.path.split("/")[-2:]) for r in bad.collect())
    assert found == {
        "a": ([("c1", 0.5, False), ("x", 0.0, True)], ["a/y.json", "r2/record.json"]),
        "b": ([("e2", 0.0, False), ("old", 0.0, False)], ["r1/record.json"]),
        "c": ([], []),
    }


def test_transcripts(spark):
    lines = spark.createDataFrame([("c", 1, "u1 HELLO THERE", 5), ("c", 2, "u2", 7), ("d", 1, "u3 X", 2)], "chapter string, n int, value string, n_samples bigint")
    got = sorted(tuple(r) for r in records.transcripts(lines, "chapter", "n").collect())
    assert got == [("c", "u1", 0, 5, "HELLO THERE"), ("c", "u2", 5, 12, ""), ("d", "u3", 0, 2, "X")]


def test_merge_drain_hashes(spark, tmp_path):
    o = spark.createDataFrame([("a", 1, "x", None), ("a", 2, None, "y"), ("a", 3, "z", None)], "id string, seq int, p string, q string")
    assert tuple(records.merged_outcomes(o, ["id"], "seq", ["p", "q"]).first()) == ("a", "z", "y")
    acks = spark.createDataFrame([("a", "2024-01-02"), ("b", "2023-01-01")], "id string, verified_utc string")
    left, young = records.drained(spark.createDataFrame([("a",), ("c",)], "id string"), acks, "id", F.lit("2024-01-01"))
    assert [r.id for r in left.collect()] == ["c"] and [r.id for r in young.collect()] == ["a"]
    files = spark.createDataFrame([("p", bytearray(b"x")), ("q", bytearray(b"y"))], "path string, content binary")
    want = spark.createDataFrame([("p", "00"), ("r", "00"), ("q", None)], "path string, sha256 string")
    assert sorted((r.path, r.reason) for r in records.failed_hashes(files, want).collect()) == [("p", "mismatch"), ("r", "missing")]
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    one = records.write_snapshot(rows, str(tmp_path), ["k", "v"])
    assert one == records.write_snapshot(rows.orderBy(F.desc("k")), str(tmp_path), ["v", "k"])
    assert [r.value for r in records.canonical_lines(rows, ["v", "k"]).collect()] == ['{"k":1,"v":"a"}', '{"k":2}']


def test_wav(spark, tmp_path):
    x = (np.sin(np.arange(800) / 5) * 20000).astype("<i2")
    for name, rate, channels in (("a.wav", 16000, 1), ("b.wav", 8000, 2), ("c.wav", 11025, 1)):
        with wave.open(str(tmp_path / name), "wb") as f:
            f.setnchannels(channels)
            f.setsampwidth(2)
            f.setframerate(rate)
            f.writeframes(np.repeat(x, channels).tobytes())
    (tmp_path / "d.wav").write_bytes(b"RIFF")
    got = {r.path[-5:]: r for r in audio.read_wav(spark, str(tmp_path)).withColumn("fault", audio.wav_fault()).collect()}
    assert np.allclose(got["a.wav"].samples, x / 32768) and len(got["b.wav"].samples) == 1600
    assert [got[k].fault for k in ("a.wav", "b.wav", "c.wav", "d.wav")] == [None, None, "rate not supported", "unreadable"]


def run(query, name):
    q = query.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)


def test_streaming_refractory_equals_batch(spark, tmp_path):
    rng = random.Random(7)
    data = sorted((rng.randrange(300), s) for s in range(3) for _ in range(60))
    for i in range(3):
        part = data[i * 60 : (i + 1) * 60]
        spark.createDataFrame([(s, t) for t, s in part], "stream int, idx bigint").coalesce(1).write.mode("append").parquet(str(tmp_path))
    batch = spark.read.parquet(str(tmp_path))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path))
    run(twins.refractory(stream, "stream", "idx", 10), "fires")
    got = sorted(map(tuple, spark.sql("SELECT stream, idx FROM fires").collect()))
    assert got == sorted(map(tuple, detection.refractory(batch, "stream", "idx", 10).select("stream", "idx").collect()))


def test_streaming_windows(spark, tmp_path):
    spark.sql("SELECT timestamp '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id * 7) AS t, id % 2 AS k, CAST(id AS DOUBLE) AS score, CASE WHEN id = 99 THEN 'run-end' ELSE 'x' END AS kind FROM range(100)").write.parquet(f"{tmp_path}/in")
    batch = spark.read.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")
    run(twins.tumbling_best(stream, "t", "k", "score", "1 minute", "0 seconds"), "best")
    want = {(r.start, r.k): (r.best, r.n) for r in batch.groupBy(F.window("t", "1 minute"), "k").agg(F.max("score").alias("best"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), "k", "best", "n").collect()}
    got = {(r.start, r.k): (r.best, r.n) for r in spark.sql("SELECT * FROM best").collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(got) >= len(want) - 2


def test_streaming_finished_traces(spark, tmp_path):
    """A trace closes when it was quiet for a while, and tells whether its end came."""
    rows = [("a", 0, "x"), ("a", 20, "run-end"), ("b", 5, "x"), ("b", 30, "x"), ("late", 4000, "x")]
    spark.createDataFrame(rows, "k string, s int, kind string").selectExpr("k", "timestamp_seconds(s) AS t", "kind").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, t timestamp, kind string").parquet(f"{tmp_path}/in")
    run(twins.finished_traces(stream, "t", "k", "kind", "run-end", "1 minute", "0 seconds"), "finished")
    assert sorted((r.k, r.n_events, r.completed) for r in spark.sql("SELECT * FROM finished").collect()) == [("a", 2, True), ("b", 2, False)]


def test_streaming_context(spark, tmp_path):
    """Audio after a detection meets it; without any the detection comes alone once the watermark has passed."""
    put = lambda rows, columns, name: spark.createDataFrame(rows, "k string, s int").selectExpr("k", f"timestamp_seconds(s) AS {columns}").coalesce(1).write.parquet(f"{tmp_path}/{name}")
    put([("a", 10), ("b", 20), ("z", 9000)], "t", "d")
    put([("a", 12), ("a", 300), ("z", 9100)], "audio_time", "a")
    read = lambda schema, name: spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}")
    run(twins.with_context(read("k string, t timestamp", "d"), read("k string, audio_time timestamp", "a"), "k", "t", "10 seconds", "0 seconds"), "context")
    got = sorted((r.k, r.post_context_missing) for r in spark.sql("SELECT * FROM context WHERE k <> 'z'").collect())
    assert got == [("a", False), ("b", True)]
