"""Steps that must not grow faster than their input: plans, and results against slower readings."""

import json
import random

from pyspark.sql import functions as F

from quillspark.operators import grounding, schemas, tool_schemas


def test_calls_are_not_dealt_out_by_word(spark):
    """A call's own labels are scored where the call is; texts meet phrases once each."""
    rng = random.Random(3)
    word = lambda: rng.choice(["lamp", "lmp", "the", "light", "ring", "rng", "bolt", "colt", "tv", "o'neil"])
    rows = [(i, " ".join(word() for _ in range(rng.randrange(5))), [" ".join(word() for _ in range(rng.randrange(3))) for _ in range(rng.randrange(3))]) for i in range(300)] + [(999, None, ["lamp"])]
    df = spark.createDataFrame(rows, "k int, text string, labels array<string>")
    supports = grounding.label_supports(df.select("k", F.col("k").alias("group"), "text"), df.select(F.col("k").alias("group"), F.lit(0).alias("owner"), F.explode("labels").alias("label")), ["k"])
    want = {r.k: r.support for r in supports.groupBy("k").agg(F.max("full").alias("support")).collect()}
    got = {r.k: r.s for r in df.select("k", grounding.own_support(F.col("text"), F.col("labels")).alias("s")).collect()}
    assert len(want) > 40 and all(abs((got[i] or 0.0) - want.get(i, 0.0)) < 1e-12 for i, *_ in rows)

    entities = df.where("size(labels) > 0").select(F.lit(1).alias("home"), F.col("k").alias("entity_id"), F.col("k").alias("rank"), F.get("labels", F.lit(0)).alias("name"), "labels", F.lit("light").alias("domain"), F.lit("hall").alias("area"))
    areas = spark.createDataFrame([(1, "hall", "bolt ring", 0)], "home int, area string, phrase string, rank int")
    calls = df.select(F.col("k").alias("call"), F.lit(1).alias("home"), F.lit("a__b").alias("tool"), F.get("labels", F.lit(0)).alias("name"), F.lit("hall").alias("area"), "text", F.lit(None).cast("string").alias("satellite_area"))
    found = grounding.grounded(calls, entities, areas, "call")
    assert found.count() == len(rows) and "hashpartitioning(call" not in found._jdf.queryExecution().executedPlan().toString()


def test_envelopes_as_rows(spark):
    """Rows of tools against the text of the whole envelope, which is the one at most that a test can hold."""
    rng = random.Random(4)

    def tool():
        name = rng.choice(["a", "b", "c", "d", "e", "f", "g", "h", "x y", 3])
        odd = rng.random()
        if odd < 0.05:
            return rng.choice([3, {"type": "x"}, {"type": "function"}, "text", None])
        return {"type": "function", "function": {"name": name, "parameters": {"type": "object"} if odd < 0.9 else []}}

    rows = [(e, rng.randrange(4), json.dumps(tool())) for e in range(150) for _ in range(rng.randrange(1, 7))] + [(999, 0, "[")]
    df = spark.createDataFrame(rows, "e int, i int, t string").repartition(3)
    got = {r.e: r.fault for r in tool_schemas.envelope_faults(df, "e", "i", "t").collect()}
    texts = [(e, "[" + ",".join(t for _, _, t in sorted(r for r in rows if r[0] == e)) + "]") for e in got]
    want = {r.e: r.f for r in spark.createDataFrame(texts, "e int, t string").select("e", tool_schemas.envelope_fault(F.col("t")).alias("f")).collect()}
    assert got == want and len(set(want.values())) > 12 and None in want.values()
    plan = tool_schemas.envelope_faults(df, "e", "i", "t")._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan


def test_a_schema_reads_each_kind_once(spark):
    """A value's kind is worked out once, not for every rule that asks for it."""
    schema = {"properties": {"a": {"type": "integer", "minimum": 1, "maximum": 5, "enum": [1, 2, "x"]}}}
    calls = spark.createDataFrame([("t", '{"a":7}'), ("t", '{"a":2}'), ("t", "[")], "tool string, arguments string")
    found = schemas.check_calls(calls, {"t": schema})
    assert [r.message for r in found.collect()] == ["a must be one of [1, 2, 'x']", None, "arguments must be an object"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("schema_of_variant") + plan.count("schemaOfVariant") <= 2 and plan.lower().count("parsejson") + plan.count("try_parse_json") <= 2


def test_holds_of_many_holders():
    """Two hundred thousand changes of as many holders at once: a look at all of them for each would take hours."""
    from quillspark.streaming.timers import Holds, advance

    n = 100_000
    rows = [(i, {"h": i, "t": True}) for i in range(n)] + [(n + i, {"h": i, "t": False}) for i in range(n)]
    out = list(advance(Holds({}, "h", "t", n + n // 2), rows))
    assert len(out) == 2 * n and out[n - 1][3] == n and out[-1][2:] == ("released", 0, True)
    again = Holds({"b": 5, "a": 5, "c": 9, "d": None}, "h", "t", 3)  # what a stream's state holds
    assert [again.deadline(), *again.due(5), again.deadline()] == [5, (5, "a", "timeout", 2, False), (5, "b", "timeout", 1, False), 9] and again.state == {"a": None, "b": None, "c": 9, "d": None}


def test_spans_work_out_their_words_once(spark):
    from quillspark.functions import text as X

    assert X.sub_spans(X.tokens(F.col("t")), 3)._jc.toString().count("regexp_extract_all") == 1


def test_prefixes_come_in_parts(spark, monkeypatch):
    import pyarrow as pa

    from quillspark.operators import prefixes

    rng = random.Random(2)
    rows = [[rng.randrange(9) for _ in range(rng.choice([0, 1, 5, 30]))] for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(rows, pa.list_(pa.int64()))], ["id", "tokens"])
    whole = pa.Table.from_batches(prefixes._rolled(iter([batch]), False))
    monkeypatch.setattr(prefixes, "CHUNK_TOKENS", 16)
    parts = list(prefixes._rolled(iter([batch]), False))
    assert pa.Table.from_batches(parts).equals(whole.combine_chunks()) or pa.Table.from_batches(parts).to_pylist() == whole.to_pylist()
    assert max(p.num_rows for p in parts) == 30 and len(parts) > 20
    df = spark.createDataFrame([(i, list(map(str, r))) for i, r in enumerate(rows)], "i int, t array<string>")
    found = prefixes.longest_checkpoint(df, df, "i", "t", 5)
    assert {r.i: r.length for r in found.collect()}[next(i for i, r in enumerate(rows) if len(r) == 5)] == 5
    assert "slice(t" in found._jdf.queryExecution().analyzed().toString()


def test_calls_meet_few_tools_without_shuffle(spark):
    from quillspark.operators import contracts

    tools = spark.createDataFrame([("a", ["x"], ["x"], {})], "tool string, allowed array<string>, required array<string>, choices map<string,array<string>>")
    calls = spark.range(50).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("tool"), F.create_map(F.lit("x"), F.lit("1")).alias("args"))
    found = contracts.first_violation(calls, tools)
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString() and found.where("violation IS NULL").count() == 25


def test_every_trusted_text_counts(spark, monkeypatch):
    """More trusted texts than go to every task: they meet the texts by a shuffle, and none is left out."""
    import numpy as np

    from quillspark.llm import quality

    docs = spark.createDataFrame([(i, f"text {i} " * (i % 5)) for i in range(60)] + [(None, "no id")], "doc_id bigint, text string")
    trusted = docs.where("doc_id % 2 = 0 OR doc_id IS NULL").select("doc_id")
    want = quality.ratios(docs, trusted)
    monkeypatch.setattr(quality, "LISTED_IDS", 3)
    monkeypatch.setattr(quality, "TRUSTED_ROWS", 3, raising=False)
    assert np.array_equal(want, quality.ratios(docs, trusted)) and want.any()


def test_only_the_root_class_is_weighed():
    """What the main slot and the template rest on goes on; no row is made that nothing reads."""
    import pyarrow as pa

    from quillspark.llm import html_template as H

    source = "<div><p>one</p><p>two</p></div>"
    tokens = list(dict.fromkeys(H.Page(source).sequence))
    batch = pa.RecordBatch.from_pylist([{"host": "h", "html": source, "tokens": tokens, "classes": [7 * (i % 2) for i in range(len(tokens))]}])
    rows = [r for b in H._weigh(iter([batch])) for r in b.to_pylist()]
    assert {r["key"] for r in rows if not r["slot"]} == {0} and any(r["slot"] for r in rows)


def test_kinds_of_call_tokens_are_worked_out_once(spark):
    from quillspark.operators import call_texts

    text = call_texts.parse_calls(F.col("t"))._jc.toString()
    assert text.count("regexp_extract_all") == 1 and len(text) < 12_000


def test_closure_of_cycles_and_chains(spark):
    """Against a walk; a chain's pairs are found once a round, not by every place where it can be cut."""
    from quillspark.operators import lexical

    rng = random.Random(8)
    for edges in ([(rng.randrange(14), rng.randrange(14)) for _ in range(16)], [(i, i + 1) for i in range(21)], [(1, 1)], []):
        want, grown = set(), set(edges)
        while grown - want:
            want |= grown
            grown = want | {(a, d) for a, b in want for c, d in edges if b == c}
        got = [tuple(r) for r in lexical.closure(spark.createDataFrame([*edges, (None, 1)], "a int, b int"), "a", "b").collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_bags_in_one_pass(spark):
    from quillspark.operators import evaluation

    a, b = (spark.createDataFrame(x, "c int, i string") for x in ([(1, "x"), (1, "x"), (2, None), (None, "y")], [(1, "x"), (3, "z"), (1, "w"), (2, None), (None, "y")]))
    found = evaluation.bag_comparison(a, b, "c", "i")
    assert {tuple(r) for r in found.collect()} == {(1, 1, 1, 1, False), (3, 0, 0, 1, False), (2, 0, 1, 1, False), (None, 0, 1, 1, False)}
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
