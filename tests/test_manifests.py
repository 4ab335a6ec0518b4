"""Readers of manifests and their faults, on files written by the tests."""

import json

from pyspark.sql import functions as F

from quillspark.sources import manifests


def put(folder, **files):
    for name, text in files.items():
        path = folder / name.replace("__", "/").replace("_json", ".json").replace("_yaml", ".yaml").replace("_wav", ".wav")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text if isinstance(text, str) else json.dumps(text))
    return str(folder)


def test_homes(spark, tmp_path):
    home = {"home_id": "a", "satellite_area": "Kitchen", "areas": {"Kitchen": ["cook"]}, "entities": [{"name": "Lamp", "domain": "light", "area": None}]}
    homes = manifests.read_homes(spark, put(tmp_path, a_json=home, b_json=home | {"own_area": "Hall", "area_aliases": {}}))
    got = {r.stem: r for r in homes.collect()}
    assert got["a"].own_area == "Kitchen" and got["a"].area_aliases == {"Kitchen": ["cook"]} and got["a"].entities[0].name == "Lamp"
    assert got["b"].own_area == "Hall" and got["b"].area_aliases == {}
    assert [r.home_id for r in manifests.misnamed_homes(homes).collect()] == ["a"]


def test_suites(spark, tmp_path):
    path = put(tmp_path, one_yaml='name: one\n# note\ncases:\n  - a\n  - "b"\n\n  - a\nother:\n  - z\n', two_yaml="name: two\ncases:\n")
    suites = manifests.read_suites(spark, path)
    assert sorted(map(tuple, suites.collect())) == [("one", 0, "a"), ("one", 1, "b"), ("one", 2, "a")]
    faults = manifests.suite_faults(suites, manifests.read_documents(spark, path, "*.yaml"), spark.createDataFrame([("a",)], "case_id string"))
    assert sorted(map(tuple, faults.collect()), key=repr) == sorted([("two", None, "empty"), ("one", "a", "duplicate"), ("one", "b", "unknown")], key=repr)


def test_gates(spark, tmp_path):
    text = """version: 3
suites:
  first:
    min_overall_pass_rate: 0.7
    category_min_pass_rate:
      media: 0.6
    max_rates:
      false_action_rate: 0.2
    zero_tolerance_flags:
      - wrong_domain
  second:
    version: 4
    min_overall_pass_rate: 1
"""
    got = sorted(map(tuple, manifests.read_gates(spark, put(tmp_path, gates_yaml=text)).collect()))
    assert got == [
        ("first", "category_min", "media", 0.6, "3"), ("first", "max_rate", "false_action_rate", 0.2, "3"), ("first", "min_overall", "overall_pass_rate", 0.7, "3"),
        ("first", "zero_flag", "wrong_domain", 0.0, "3"), ("second", "min_overall", "overall_pass_rate", 1.0, "4"),
    ]


def test_sessions_and_seeds(spark, tmp_path):
    path = put(tmp_path, s1__session_json={"session_id": "s1", "sample_rate": 16000}, s2__session_json="{broken", s3__session_json={"notes": "x"}, positive__a_wav="x", negative__b_wav="y", other__c_wav="z")
    assert [r.session_id for r in manifests.read_sessions(spark, path).collect()] == ["s1"]
    assert sorted(r.label for r in manifests.read_seeds(spark, path).collect()) == ["negative", "positive"]


def test_traces(spark, tmp_path):
    store = {"interactions": [{"trace_id": "t", "success": "true"}, {"trace_id": "u"}], "events": [{"trace_id": "t", "stage": "b"}, {"trace_id": "x"}, {"stage": "none"}, {"trace_id": "t", "stage": "a"}]}
    got = {r.trace_id: [json.loads(e)["stage"] for e in r.events] for r in manifests.read_traces(spark, put(tmp_path / "in", store_json=store, none_json={"events": []})).collect()}
    assert got == {"t": ["b", "a"], "u": []}
    summaries, events = spark.createDataFrame([("t",)], "trace_id string"), spark.createDataFrame([("t", 1), ("x", 2)], "trace_id string, n int")
    manifests.write_traces(summaries, events, str(tmp_path / "out"))
    assert [r.n for r in spark.read.json(str(tmp_path / "out/events")).collect()] == [1]


def test_wake_cases_commands_and_tools(spark, tmp_path):
    cases = {"version": "2", "cases": [{"id": "a", "category": "positive", "audio": "a.wav", "promotion_required": True}, {"id": "b", "category": "odd"}, {"id": "b", "category": "positive", "audio": "b.wav"}]}
    read = manifests.read_wake_cases(spark, put(tmp_path / "w", cases_json=cases))
    assert sorted((r.id, r.version, r.promotion_required) for r in read.collect()) == [("a", "2", True), ("b", "2", False), ("b", "2", False)]
    assert sorted(tuple(r.faults) for r in manifests.wake_case_faults(read, ["positive"]).collect()) == [("category", "audio", "repeated"), ("repeated",)]
    commands = manifests.read_commands(spark, put(tmp_path / "c", commands_json={"commands": [{"id": "1", "text": "x"}]}))
    assert [(r.id, r.text, r.entity) for r in commands.collect()] == [("1", "x", None)]
    tools = manifests.read_tools(spark, put(tmp_path / "t", tools_json={"tools": [{"name": "on", "description": "d", "parameters": {"type": "object"}}, {"name": "bad"}]}))
    assert sorted((r.name, r.parameters) for r in tools.collect()) == [("bad", None), ("on", '{"type":"object"}')] or {r.name for r in tools.collect()} == {"bad", "on"}
    assert [r.name for r in manifests.tool_faults(tools).collect()] == ["bad"]


def test_sinks(spark, tmp_path):
    outcomes = spark.createDataFrame([("a", True), ("b", False)], "case_id string, passed boolean")
    manifests.write_run(outcomes, outcomes.agg(F.count("*").alias("total")), {"suite": "s", "model": "m"}, str(tmp_path / "run"))
    assert spark.read.json(str(tmp_path / "run/summary")).first().total == 2 and spark.read.json(str(tmp_path / "run/metadata")).first().model == "m"
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    assert manifests.differing_lines(lines("a", "a", "b"), lines("b", "a", "a")).count() == 0
    assert sorted(map(tuple, manifests.differing_lines(lines("a", "a"), lines("a", "c")).collect())) == [("a", "rendered"), ("c", "stored")]
    entries = spark.createDataFrame([("p1", True), ("p2", False), ("p3", False)], "path string, pin boolean")
    states = manifests.cleaned(entries, spark.createDataFrame([("p1", "remove"), ("p2", "quarantine")], "path string, action string"), "path", F.col("pin"))
    assert {r.path: r.state for r in states.collect()} == {"p1": "kept", "p2": "quarantined", "p3": "kept"}
    clips = spark.createDataFrame([("a", "wake", "x", bytearray(b"1")), ("b", "miss", None, bytearray(b"2"))], "id string, kind string, label string, content binary")
    manifest = {r.id: r for r in manifests.write_classes(clips, str(tmp_path / "classes"), "kind", "content").collect()}
    assert manifest["b"].needs_verification and not manifest["a"].needs_verification and manifest["a"].sha256.startswith("6b86b273")
    assert spark.read.parquet(str(tmp_path / "classes")).count() == 2
    files = clips.select(F.col("id").alias("path"), "content")
    assert manifests.fileset_digest(files) == manifests.fileset_digest(files.orderBy(F.desc("path"))) != manifests.fileset_digest(files.where("path = 'a'"))
