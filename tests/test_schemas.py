"""Schema checks of calls against a plain walk over the parsed JSON."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import schemas

DEEP = {"type": "array", "items": {"type": "array", "items": {"anyOf": [{"type": "integer", "minimum": 2}, {"type": "array", "items": {"enum": ["x", 3, None]}}]}}}
TOOLS = {
    "deep": {"properties": {"a": DEEP, "b": {"type": "number", "maximum": 4.5}, "it's": {"type": "boolean"}}, "required": ["a"]},
    "open": {"properties": {"domain": {"anyOf": [{"type": "string"}, {"type": "array", "items": {"type": "string"}}]}, "v": {"enum": ["low", 1, [1, {"k": 2}]]}, "o": {"type": "object"}, "n": {"minimum": 0}}},
    "groups": {"properties": {k: {} for k in "pqr"}, "anyOf": [{"required": ["p"]}, {"required": ["q", "r"]}]},
    "none": {},
}


def wrong(schema, value, path):
    """What is wrong with a value, by the rules as the survey states them."""
    if "anyOf" in schema and "type" not in schema:
        return f"{path} matches none of the allowed shapes" if all(wrong(o, value, path) for o in schema["anyOf"]) else None
    kinds = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}
    if (t := schema.get("type")) and (not isinstance(value, kinds[t]) or isinstance(value, bool) and t != "boolean"):
        return f"{path} must be {t}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{path} must be one of {schema['enum']}"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            return f"{path} is below {schema['minimum']}"
        if value > schema.get("maximum", value):
            return f"{path} is above {schema['maximum']}"
    each = enumerate(value) if isinstance(value, list) and "items" in schema else ()
    return next((e for i, v in each if (e := wrong(schema["items"], v, f"{path}[{i}]"))), None)


def checks(tool, args):
    p = TOOLS[tool]
    props = p.get("properties", {})
    extra, gone = sorted(set(args) - set(props)), sorted(set(p.get("required", [])) - set(args))
    groups = [g["required"] for g in p.get("anyOf", [])]
    mismatch = f"missing required argument(s): {gone}" if gone else f"needs one of the argument sets {groups}" if groups and not any(set(g) <= set(args) for g in groups) else None
    value = next((e for k, v in args.items() if k in props and (e := wrong(props[k], v, k))), None)
    return f"unexpected argument(s): {extra}" if extra else None, mismatch, value


def violation(tool, text, exposed):
    if tool not in TOOLS:
        return "unknown_tool", f"tool {tool} is not offered"
    args = json.loads(text) if text else None
    if not isinstance(args, dict):
        return "invalid_arguments", "arguments must be an object"
    extra, mismatch, value = checks(tool, args)
    if extra or mismatch:
        return "schema_mismatch", extra or mismatch
    if value:
        return "invalid_arguments", value
    named = args.get("domain", [])
    hidden = [d for d in (named if isinstance(named, list) else [named]) if d not in exposed]
    return ("invalid_arguments", f"domain(s) {hidden} are not exposed") if hidden else (None, None)


def random_value(rng, depth=3):
    kind = rng.randrange(9 if depth else 6)
    if kind > 5:
        return [random_value(rng, depth - 1) for _ in range(rng.randrange(4))]
    return [rng.choice(["x", "low", "é\"'", "light"]), rng.randrange(-2, 6), rng.choice([2.5, 1e3, 0.25, 4.5]), rng.random() < 0.5, None, rng.choice([{"k": 2}, {}, {"k": [1]}])][kind]


@pytest.fixture(scope="module")
def made():
    rng = random.Random(4)
    names = ["a", "b", "it's", "domain", "v", "o", "n", "p", "q", "r", "zz"]
    rows = []
    for i in range(3000):
        tool = rng.choice([*TOOLS, *TOOLS, "other"])
        own = list(TOOLS.get(tool, {}).get("properties", {})) or names
        args = {k: random_value(rng) for k in rng.sample(own, rng.randrange(len(own) + 1)) + ([rng.choice(names)] if rng.random() < 0.2 else [])}
        if tool == "deep" and rng.random() < 0.5:
            args["a"] = [[rng.choice([2, 5, ["x", 3, None]])] * 2, []]
        rows.append((i, tool, json.dumps(args, indent=rng.choice([None, 1]))))
    return [*rows, (-1, "deep", None), (-2, "deep", "[]"), (-3, "open", '{"v":[1,{"k":2}]}'), (-4, "open", '{"domain":"light"}'), (-5, "open", '{"domain":["tv","x"]}'), (-6, None, "{}"), (-7, "none", "{}")]


def test_violations(spark, made):
    df = spark.createDataFrame(made, "id int, tool string, arguments string").withColumns({"exposed": F.array(F.lit("light"), F.lit("tv")), "message": F.lit(1)})
    got = {r.id: (r.code, r.message) for r in schemas.check_calls(df, TOOLS, "exposed").collect()}
    want = {i: violation(t, a, ["light", "tv"]) for i, t, a in made}
    assert {i: (got[i], want[i], [m for m in made if m[0] == i]) for i in got if got[i] != want[i]} == {} and len(got) == len(want)
    assert len({m for _, m in want.values()}) > 40


def test_failures(spark, made):
    df = spark.createDataFrame(made, "id int, tool string, arguments string")
    for r in schemas.argument_failures(df, TOOLS).collect():
        if r.tool not in TOOLS:
            want = None
        elif not r.arguments or not isinstance(json.loads(r.arguments), dict):
            want = "invalid_arguments"
        else:
            extra, mismatch, value = checks(r.tool, json.loads(r.arguments))
            want = "schema_mismatch" if extra else "invalid_arguments" if value else "schema_mismatch" if mismatch else None
        assert r.failure == want, r


def test_arguments_with_repeated_or_broken_text(spark):
    df = spark.createDataFrame([("open", '{"n":1,"n":2}'), ("open", "{"), ("open", '{"n":-12345678901234567890}')], "tool string, arguments string")
    assert [r.message for r in schemas.check_calls(df, TOOLS).collect()] == ["arguments must be an object"] * 2 + ["n is below 0"]
    assert "Python" not in (plan := schemas.check_calls(df, TOOLS)._jdf.queryExecution().toString()) and "Arrow" not in plan


def test_no_calls(spark):
    assert schemas.check_calls(spark.createDataFrame([], "tool string, arguments string"), {}).count() == 0
