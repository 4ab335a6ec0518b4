"""Queries of scored tool calls: orders are cases, their lines expected and actual calls, suppliers the entities of five homes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import scoring
from quillspark.plans.lenses import table
from quillspark.plans.registry import query

_TYPES, _DOMAINS = ["action", "status", "clarification", "refusal"], ["light", "switch", "script", "fan"]
_TOOLS = [scoring.TURN_ON, "intent__HassTurnOff", scoring.RELATIVE_VOLUME, scoring.LIVE_CONTEXT]
_TEXTS = ["Which one did you mean, lamp one or lamp two?", "I can't find that.", "Done.", None, "There’s no such device. Which one?"]


def _pick(values: list, number):
    """One of a few values by a number's remainder."""
    return F.get(F.array(*map(F.lit, values)), F.pmod(number, F.lit(len(values))).cast("int"))


def _homes(spark, sf_dir):
    """Entities of five homes, and what the home before each shows as context."""
    suppliers = table(spark, sf_dir, "supplier")
    domain = _pick(_DOMAINS, F.col("s_suppkey"))
    entities = suppliers.select(
        (F.col("s_nationkey") % 5).alias("household"), F.col("s_suppkey").alias("place"), F.concat_ws(".", domain, F.col("s_suppkey").cast("string")).alias("entity_id"),
        F.col("s_name").alias("name"), F.array(F.concat(F.lit("Unit "), (F.col("s_suppkey") % 7).cast("string"))).alias("aliases"), domain.alias("domain"), F.concat(F.lit("area "), (F.col("s_suppkey") % 3).cast("string")).alias("area"),
    )
    context = suppliers.where("s_suppkey % 2 = 0").select(((F.col("s_nationkey") + 1) % 5).alias("household"), F.col("s_name").alias("name"))
    return entities, context


def _cases(spark, sf_dir):
    key = F.col("o_orderkey")
    names = table(spark, sf_dir, "supplier").select("s_suppkey", F.array(F.struct(F.col("s_name").alias("name"), F.lit("area 1").alias("area"), F.lit("light").alias("domain"))).alias("forbidden"))
    cases = table(spark, sf_dir, "orders").select(
        key.alias("case_id"), (F.col("o_custkey") % 5).alias("household"), _pick(_TYPES, key).alias("expected_type"), _pick(_TEXTS, key).alias("text"), F.when(key % 53 == 0, "no JSON").alias("parse_error"),
        F.when(key % 47 == 0, F.array(F.lit("unknown_tool"))).when(key % 43 == 0, F.array(F.lit("schema_mismatch"))).otherwise(F.array().cast("array<string>")).alias("violations"),
        F.array(F.lit("Lamp One"), F.when(key % 3 == 0, "Lamp Three").otherwise("Lamp Two")).alias("candidates"), (key % 10).alias("s_suppkey"),
        F.concat(F.lit("area "), (key % 3).cast("string")).alias("target_area"), F.when(key % 2 == 0, "satellite").otherwise("explicit").alias("area_source"),
    )
    return cases.join(names, "s_suppkey", "left").drop("s_suppkey")


def _call(tool, name, area, step, domains):
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in (("name", name), ("area", area), ("volume_step", step))))
    args = F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))
    return F.struct(tool.alias("tool"), args.alias("args"), domains.alias("domains")).cast(scoring.CALL)


def _calls(spark, sf_dir):
    """Expected and actual calls from the lines of an order."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey")
    order, tool = F.col("l_orderkey"), _pick(_TOOLS, F.col("l_partkey"))
    switches, moves = F.col("l_partkey") % 4 < 2, F.col("l_partkey") % 4 == 2
    area = F.when(switches & (F.col("l_quantity") > 20), F.concat(F.lit("area "), (order % 3).cast("string")))
    domains = F.when(switches & (F.col("l_discount") >= 0.05), F.array(_pick(_DOMAINS, F.col("l_suppkey"))))
    up = F.col("l_quantity") > 25
    wanted = _call(tool, F.col("s_name"), area, F.when(moves, F.when(up, "up").otherwise("down")), domains)
    name = F.when(F.col("l_linestatus") == "O", F.lower("s_name")).otherwise(F.col("s_name"))
    made = _call(tool, name, F.when(F.col("l_returnflag") != "A", area), F.when(moves, F.when(up, "10").otherwise("-5")), F.when(F.col("l_tax") < 0.04, domains))
    rows = lines.select(order.alias("case_id"), F.col("l_linenumber").alias("pos"), "l_returnflag", wanted.alias("wanted"), made.alias("made"))
    expected = rows.where("case_id % 4 < 2").select("case_id", "pos", F.col("wanted").alias("call"))
    return expected, rows.where("case_id % 6 <> 0 AND NOT (l_returnflag = 'R' AND pos = 3)").select("case_id", "pos", F.col("made").alias("call"))


def _scores(spark, sf_dir):
    return scoring.score(_cases(spark, sf_dir), *_calls(spark, sf_dir), *_homes(spark, sf_dir))


def _listed(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def _key(name: str, area: str, step: str, domains: str) -> str:
    """SQL of a call's canonical key."""
    return f"""CASE WHEN tool = '{scoring.TURN_ON}' AND {area} IS NULL AND {step} IS NULL AND own_id LIKE 'script.%' AND ({domains} IS NULL OR {domains} = 'script') THEN 'script ' || substr(own_id, 8)
ELSE concat_ws('|', tool, CASE WHEN tool <> '{scoring.LIVE_CONTEXT}' AND own_id IS NOT NULL THEN '@' || own_id ELSE {name} END, coalesce({area}, '-'), coalesce({step}, '-'),
coalesce(CASE WHEN tool <> '{scoring.LIVE_CONTEXT}' AND {domains} = own_domain THEN NULL ELSE {domains} END, '-')) END"""


_TURNED = "CASE a_step WHEN '10' THEN 'up' WHEN '-5' THEN 'down' END"
_QUIET = f"tool = '{scoring.LIVE_CONTEXT}'"
_SCORES = f"""WITH RECURSIVE
e AS (SELECT s_nationkey % 5 AS household, s_suppkey AS place, {_listed(_DOMAINS)}[s_suppkey % 4 + 1] AS domain, {_listed(_DOMAINS)}[s_suppkey % 4 + 1] || '.' || s_suppkey AS entity_id, s_name AS name, 'Unit ' || (s_suppkey % 7) AS alias, 'area ' || (s_suppkey % 3) AS area FROM supplier),
l AS (SELECT household, lower(label) AS label, CASE WHEN min(entity_id) = max(entity_id) THEN min(entity_id) END AS own_id, CASE WHEN min(place) = max(place) THEN arg_min(domain, place) END AS own_domain, arg_min(domain, place) AS known_domain,
  min(place) AS place, count(*) AS n FROM (SELECT household, place, entity_id, domain, unnest([name, alias]) AS label FROM e) GROUP BY 1, 2),
x AS (SELECT DISTINCT (s_nationkey + 1) % 5 AS household, lower(s_name) AS label FROM supplier WHERE s_suppkey % 2 = 0),
c AS (SELECT o_orderkey AS case_id, o_custkey % 5 AS household, {_listed(_TYPES)}[o_orderkey % 4 + 1] AS kind, {_listed([t and t.replace("’", "'") for t in _TEXTS])}[o_orderkey % 5 + 1] AS text, 'area ' || (o_orderkey % 3) AS target_area,
  CASE WHEN o_orderkey % 2 = 0 THEN 'satellite' ELSE 'explicit' END AS area_source, s_name AS forbidden FROM orders LEFT JOIN supplier ON s_suppkey = o_orderkey % 10),
r AS (SELECT l_orderkey AS case_id, l_linenumber AS pos, l_returnflag, {_listed(_TOOLS)}[l_partkey % 4 + 1] AS tool, s_name AS name, CASE WHEN l_partkey % 4 < 2 AND l_quantity > 20 THEN 'area ' || (l_orderkey % 3) END AS area,
  CASE WHEN l_partkey % 4 = 2 THEN CASE WHEN l_quantity > 25 THEN 'up' ELSE 'down' END END AS step, CASE WHEN l_partkey % 4 < 2 AND l_discount >= 0.05 THEN {_listed(_DOMAINS)}[l_suppkey % 4 + 1] END AS domains,
  CASE WHEN l_linestatus = 'O' THEN lower(s_name) ELSE s_name END AS a_name, CASE WHEN l_returnflag <> 'A' THEN area END AS a_area, CASE step WHEN 'up' THEN '10' WHEN 'down' THEN '-5' END AS a_step, CASE WHEN l_tax < 0.04 THEN domains END AS a_domains
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
j AS (SELECT r.*, c.household, kind, target_area, area_source, forbidden, own_id, own_domain, known_domain, x.label IS NOT NULL AND known_domain IS NULL AS shown FROM r JOIN c ON c.case_id = r.case_id
  LEFT JOIN l ON l.household = c.household AND l.label = lower(r.name) LEFT JOIN x ON x.household = c.household AND x.label = lower(r.name)),
w AS (SELECT case_id, list({_key("name", "area", "step", "domains")}) AS keys, count(*) AS n, CASE WHEN count(*) = 1 THEN min(lower(name)) END AS wanted FROM j WHERE case_id % 4 < 2 GROUP BY case_id),
a AS (SELECT *, [{_key("a_name", "a_area", "a_step", "a_domains")}] || CASE WHEN tool <> '{scoring.LIVE_CONTEXT}' AND a_area IS NULL AND area_source = 'satellite' THEN [{_key("a_name", "target_area", "a_step", "a_domains")}] ELSE [] END
  || CASE WHEN a_step IS NOT NULL THEN [{_key("a_name", "a_area", _TURNED, "a_domains")}] ELSE [] END || CASE WHEN a_step IS NOT NULL AND a_area IS NULL AND area_source = 'satellite' THEN [{_key("a_name", "target_area", _TURNED, "a_domains")}] ELSE [] END AS forms
  FROM j WHERE case_id % 6 <> 0 AND NOT (l_returnflag = 'R' AND pos = 3)),
t AS (SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY pos, forms, tool) AS i, forms FROM a),
m AS (SELECT c.case_id, CAST(0 AS BIGINT) AS i, coalesce(keys, []) AS remaining, CAST(0 AS BIGINT) AS missed FROM c LEFT JOIN w USING (case_id) UNION ALL
  SELECT case_id, i, CASE WHEN hit IS NULL THEN remaining ELSE list_concat(remaining[1:list_position(remaining, hit) - 1], remaining[list_position(remaining, hit) + 1:]) END, missed + CAST(hit IS NULL AS BIGINT)
  FROM (SELECT t.case_id, t.i, remaining, missed, list_filter(forms, lambda f: list_contains(remaining, f))[1] AS hit FROM m JOIN t ON t.case_id = m.case_id AND t.i = m.i + 1)),
d AS (SELECT case_id, arg_max(missed, i) AS missed, arg_max(len(remaining), i) AS n_left, max(i) AS n_calls FROM m GROUP BY case_id),
g AS (SELECT a.case_id, bool_and({_QUIET}) AND bool_and(coalesce(q.n = 1 AND lower(a_name) IN (lower(e.name), lower(e.alias)), false)) AS lookups_ok,
  bool_or(kind = 'clarification' AND NOT {_QUIET}) AS f1, bool_or(kind = 'refusal') AS f2, bool_or(kind = 'status' AND NOT {_QUIET}) AS f3, bool_or(NOT {_QUIET} AND lower(a_name) = lower(forbidden)) AS f4,
  bool_or(NOT {_QUIET} AND a_area <> target_area) AS f5, bool_or(a.known_domain <> a_domains) AS f6, bool_or(NOT {_QUIET} AND shown) AS f7
  FROM a LEFT JOIN w ON w.case_id = a.case_id LEFT JOIN l AS q ON q.household = a.household AND q.label = w.wanted LEFT JOIN e ON e.household = q.household AND e.place = q.place GROUP BY a.case_id),
s AS (SELECT c.case_id, list_filter([CASE WHEN f1 THEN 'action_on_ambiguity' END, CASE WHEN f4 THEN 'excluded_entity_affected' END, CASE WHEN f3 THEN 'status_state_change' END, CASE WHEN f2 THEN 'tool_call_on_unavailable' END,
  CASE WHEN f6 THEN 'wrong_domain' END, CASE WHEN f5 THEN 'wrong_target_area' END, CASE WHEN f7 THEN 'context_entity_targeted' END], lambda f: f IS NOT NULL) AS flags,
  CASE WHEN c.case_id % 53 = 0 THEN 'malformed_output' WHEN c.case_id % 47 = 0 THEN 'unknown_tool' WHEN c.case_id % 43 = 0 THEN 'invalid_arguments'
  WHEN n_calls > 0 THEN CASE WHEN kind NOT IN ('action', 'status') THEN 'unexpected_tool_call' WHEN missed = 0 AND n_left = 0 THEN CASE WHEN n > 1 THEN 'valid_multi_tool_call' ELSE 'valid_tool_call' END
    WHEN kind = 'status' AND lookups_ok THEN 'valid_tool_call' WHEN missed = 0 THEN 'missing_tool_call' ELSE 'unexpected_tool_call' END
  WHEN kind IN ('action', 'status') THEN 'missing_tool_call'
  WHEN kind = 'clarification' THEN CASE WHEN contains(coalesce(text, ''), '?') AND contains(lower(text), 'lamp one') AND contains(lower(text), CASE WHEN c.case_id % 3 = 0 THEN 'lamp three' ELSE 'lamp two' END) THEN 'valid_clarification' ELSE 'wrong_response_type' END
  WHEN c.case_id % 5 = 1 THEN 'valid_refusal' ELSE 'wrong_response_type' END AS outcome
  FROM c JOIN d USING (case_id) LEFT JOIN w USING (case_id) LEFT JOIN g USING (case_id)),
z AS (SELECT case_id, outcome, array_to_string(list_sort(flags), ',') AS flags, outcome IN ({_listed(scoring.PASSING)[1:-1]}) AND len(flags) = 0 AS passed FROM s)
"""


@query(_SCORES + "SELECT * FROM z")
def scored_cases(spark, sf_dir):
    return _scores(spark, sf_dir).withColumn("flags", F.array_join(F.array_sort("flags"), ","))


@query(_SCORES + "SELECT outcome, count(*) AS n, count(*) FILTER (WHERE passed) AS n_passed FROM z GROUP BY outcome")
def outcome_counts(spark, sf_dir):
    return _scores(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n"), F.count_if("passed").alias("n_passed"))


@query(
    "SELECT conv_id, turn, contains(t, '?') AND regexp_matches(t, '(?i)\\b(which|did you mean|do you mean|could you specify|can you specify|please specify|clarify)\\b') AS asks,"
    " contains(lower(t), 'the') AS holds FROM (SELECT conv_id, turn, trim(coalesce(text, '')) AS t FROM conversations)"
)
def reply_cues(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", scoring.is_clarification(F.col("text")).alias("asks"), F.contains(F.lower("text"), F.lit("the")).alias("holds"))
