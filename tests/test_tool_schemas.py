"""Canonical schemas, fingerprints and envelopes against a walk over parsed JSON, and by hand."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from quillspark.operators import tool_schemas


def tidied(x, role=""):
    """The document without what says nothing, keys sorted."""
    if isinstance(x, list):
        return [tidied(v) for v in x]
    if not isinstance(x, dict):
        return x
    out = {}
    for k in sorted(x):
        v = x[k]
        if role != "props":
            useless = [role == "top" and k == "$schema", isinstance(role, tuple) and k == "title" and v == role[0], k == "description" and isinstance(v, str) and not v.strip()]
            if any(useless):
                continue
        inner = ""
        if role == "props":
            inner = (k,)
        elif isinstance(v, dict) and k in ("properties", "parameters"):
            inner = {"properties": "props", "parameters": "top"}[k]
        elif isinstance(v, dict) and k == "function" and isinstance(v.get("name"), str):
            inner = (v["name"],)
        out[k] = sorted(v) if k == "required" and isinstance(v, list) else tidied(v, inner)
    return out


def random_document(rng, depth):
    keys = ["properties", "required", "title", "description", "$schema", "function", "parameters", "name", "items", "é\"k", "title2"]
    kind = rng.randrange(3) if depth else 2
    if kind == 0:
        out = {}
        for k in rng.sample(keys, rng.randrange(6)):
            out[k] = [rng.choice(["b", "a", "é", "z\"q"]) for _ in range(3)] if k == "required" else rng.choice([" \n", "", "items", "say"]) if k in ("title", "description") and rng.random() < 0.8 else random_document(rng, depth - 1)
        return out
    if kind == 1:
        return [random_document(rng, depth - 1) for _ in range(rng.randrange(3))]
    return rng.choice(["items", "name", "", 3, -7, True, None, 2.5, "x y", "/<é😀\t"])


def test_random_documents(spark):
    rng = random.Random(6)
    docs = [random_document(rng, 5) for _ in range(1500)]
    dump = lambda x: json.dumps(x, separators=(",", ":"), ensure_ascii=False)
    df = spark.createDataFrame([(i, json.dumps(d, indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5)) for i, d in enumerate(docs)], "i int, t string").repartition(4)
    got = {r.i: r.c for r in df.select("i", tool_schemas.canonical(F.col("t"), tidy=True, top=True).alias("c")).collect()}
    wrong = [(docs[i], got[i]) for i in got if json.loads(got[i]) != tidied(docs[i], "top") or got[i] != dump(json.loads(got[i]))]
    assert wrong[:2] == []
    for i, d in enumerate(docs):
        assert got[i] == dump(tidied(d, "top")), d


def tool(name, required=("mode", "name"), **more):
    return {"type": "function", "function": {"name": name, "parameters": {"type": "object", "required": list(required), "properties": {"mode": {"type": "string", "enum": ["auto", "off"]}, "name": {"type": "string", "minLength": 1}}}, **more}}


def scrambled(x):
    return {k: scrambled(x[k]) for k in reversed(x)} if isinstance(x, dict) else x


def test_fingerprints(spark):
    """Neither the order of keys, tools and required names nor white space changes a fingerprint; any value does."""
    a, b = tool("Alpha"), tool("Beta", description="Second tool.")
    sets = {"one": [a, b], "two": [scrambled(tool("Beta", ("name", "mode"), description="Second tool.")), scrambled(a)], "other": [a, tool("Beta", description="Changed.")], "fewer": [a]}
    rows = [(k, json.dumps(t, indent=2 if k == "two" else None)) for k, ts in sets.items() for t in ts]
    got = {r.k: r.fingerprint for r in tool_schemas.fingerprint(spark.createDataFrame(rows, "k string, t string"), "k", "t").collect()}
    text = json.dumps([tidied(json.loads(json.dumps(t))) for t in (a, b)], separators=(",", ":"), ensure_ascii=False)
    assert got["one"] == got["two"] == "sha256:" + hashlib.sha256(text.encode()).hexdigest() and len(set(got.values())) == 3


def test_envelopes(spark):
    ok = tool("a")
    cases = [
        ([ok, tool("b")], None), ([], None), ([ok, 3], "Tool entry at index 1 must be an object"), ([{**ok, "type": "x"}], "Tool entry at index 0 must have type 'function'"), ([{"type": "function"}], "Tool entry at index 0 must include a function object"),
        ([tool("a b")], "Tool entry at index 0 has an invalid function name"), ([tool("x" * 65)], "Tool entry at index 0 has an invalid function name"), ([{"type": "function", "function": {"name": 3}}], "Tool entry at index 0 has an invalid function name"),
        ([ok, tool("b"), ok], "Duplicate function name 'a' in compiled tool envelope"), ([{"type": "function", "function": {"name": "a", "parameters": []}}], "Tool 'a' must have parameters with type 'object'"), ({}, "tools must be a JSON array"),
    ]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)] + [(99, "[")], "i int, t string")
    got = {r.i: r.f for r in df.select("i", tool_schemas.envelope_fault(F.col("t")).alias("f")).collect()}
    assert got == {i: w for i, (_, w) in enumerate(cases)} | {99: "tools must be a JSON array"}


def test_odd_texts(spark):
    df = spark.createDataFrame([("[" * 100_000,), ("[[[]]]",), ("no",), (None,), ('{"a":1.0,"a":2.50}',)], "t string")
    assert [r.c for r in df.select(tool_schemas.canonical(F.col("t")).alias("c")).collect()] == [None, "[[[]]]", None, None, '{"a":2.5}']
