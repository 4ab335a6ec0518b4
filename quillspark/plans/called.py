"""Queries of schema checks, admission under budgets, call texts and operators with timers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import numbers as N
from quillspark.functions.text import normalize_utterance, tokens
from quillspark.operators import budgets, call_texts, evaluation, metrics, prefixes, schemas, tool_schemas
from quillspark.plans.lenses import HOUR, table
from quillspark.plans.registry import query
from quillspark.streaming import timers

#: Parameters of the tools that lines call by their return flag; R is offered to nobody.
_GRID = {"type": "array", "items": {"type": "array", "items": {"type": "array", "items": {"type": "integer", "maximum": 8}}}}
TOOLS = {
    "A": {"properties": {"level": {"type": "integer", "minimum": 3, "maximum": 45}, "mode": {"enum": ["O"]}, "grid": _GRID}, "required": ["mode", "level"]},
    "N": {"properties": {"level": {"anyOf": [{"type": "integer", "maximum": 40}, {"type": "string", "enum": ["low"]}]}, "mode": {"type": "string"}, "grid": _GRID}, "anyOf": [{"required": ["mode"]}, {"required": ["grid", "level"]}]},
}


def calls(spark, sf_dir):
    """lineitem: a call for each line, whose arguments come from its columns; the level is a text, true, a fraction or an integer."""
    line = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("int").cast("string")
    level = F.when(F.col("l_quantity") % 7 == 0, F.concat(F.lit('"'), F.when(F.col("l_quantity") % 2 == 0, "low").otherwise("high"), F.lit('"'))).when(F.col("l_quantity") % 11 == 0, "true").when(F.col("l_discount") > 0.085, F.concat(q, F.lit(".5"))).otherwise(q)
    grid = F.concat(F.lit("[[[1],[2, "), F.col("l_linenumber").cast("string"), F.lit("]],[],[["), (F.col("l_partkey") % 10).cast("string"), F.lit("]]]"))
    parts = F.concat_ws(
        ", ",
        F.when(F.col("l_partkey") % 4 > 0, F.concat(F.lit('"grid":'), grid)),
        F.when(F.col("l_suppkey") % 6 > 0, F.concat(F.lit('"level": '), level)),
        F.when(F.col("l_linenumber") > 1, F.concat(F.lit('"mode" :"'), F.col("l_linestatus"), F.lit('"'))),
        F.when(F.col("l_suppkey") % 9 == 0, F.lit('"extra":{"a":[1]}')),
    )
    text = F.when(F.col("l_suppkey") % 31 == 0, F.lit("[1]")).otherwise(F.concat(F.lit("{"), parts, F.lit("}")))
    return line.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("tool"), text.alias("arguments"))


_CALLED = """WITH c AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag AS tool, l_linestatus AS mode, CAST(l_quantity AS INTEGER) AS q, l_discount > 0.085 AND l_quantity % 7 <> 0 AND l_quantity % 11 <> 0 AS fraction,
    l_partkey % 4 > 0 AS has_grid, l_suppkey % 6 > 0 AS has_level, l_linenumber > 1 AS has_mode, l_suppkey % 9 = 0 AS has_extra, l_suppkey % 31 = 0 AS no_object FROM lineitem
), v AS (
  SELECT *, CASE WHEN NOT has_grid THEN NULL WHEN l_linenumber > 8 THEN 'grid[0][1][1] is above 8' WHEN l_partkey % 10 > 8 THEN 'grid[2][0][0] is above 8' END AS bad_grid,
    CASE WHEN NOT has_level THEN NULL
      WHEN tool = 'A' AND (q % 7 = 0 OR q % 11 = 0 OR fraction) THEN 'level must be integer' WHEN tool = 'A' AND q < 3 THEN 'level is below 3' WHEN tool = 'A' AND q > 45 THEN 'level is above 45'
      WHEN tool = 'N' AND NOT (q % 7 = 0 AND q % 2 = 0 OR q % 7 <> 0 AND q % 11 <> 0 AND NOT fraction AND q <= 40) THEN 'level matches none of the allowed shapes' END AS bad_level,
    CASE WHEN has_mode AND tool = 'A' AND mode <> 'O' THEN 'mode must be one of [''O'']' END AS bad_mode,
    CASE WHEN has_extra THEN 'unexpected argument(s): [''extra'']' END AS unexpected,
    CASE WHEN tool = 'A' AND NOT (has_level AND has_mode) THEN 'missing required argument(s): [' || concat_ws(', ', CASE WHEN NOT has_level THEN '''level''' END, CASE WHEN NOT has_mode THEN '''mode''' END) || ']'
      WHEN tool = 'N' AND NOT (has_mode OR has_grid AND has_level) THEN 'needs one of the argument sets [[''mode''], [''grid'', ''level'']]' END AS missing FROM c
)"""


@query(
    f"""{_CALLED} SELECT l_orderkey, l_linenumber, l_partkey,
  CASE WHEN tool NOT IN ('A', 'N') THEN 'unknown_tool' WHEN no_object THEN 'invalid_arguments' WHEN unexpected IS NOT NULL OR missing IS NOT NULL THEN 'schema_mismatch' WHEN coalesce(bad_grid, bad_level, bad_mode) IS NOT NULL THEN 'invalid_arguments' END AS code,
  CASE WHEN tool NOT IN ('A', 'N') THEN 'tool ' || tool || ' is not offered' WHEN no_object THEN 'arguments must be an object' ELSE coalesce(unexpected, missing, bad_grid, bad_level, bad_mode) END AS message FROM v"""
)
def call_violations(spark, sf_dir):
    return schemas.check_calls(calls(spark, sf_dir), TOOLS).select("l_orderkey", "l_linenumber", "l_partkey", "code", "message")


@query(
    f"""{_CALLED} SELECT l_orderkey, l_linenumber, l_partkey,
  CASE WHEN tool NOT IN ('A', 'N') THEN NULL WHEN no_object THEN 'invalid_arguments' WHEN unexpected IS NOT NULL THEN 'schema_mismatch' WHEN coalesce(bad_grid, bad_level, bad_mode) IS NOT NULL THEN 'invalid_arguments' WHEN missing IS NOT NULL THEN 'schema_mismatch' END AS failure FROM v"""
)
def call_failures(spark, sf_dir):
    return schemas.argument_failures(calls(spark, sf_dir), TOOLS).select("l_orderkey", "l_linenumber", "l_partkey", "failure")


@query(
    r"""SELECT p_partkey, pos, CASE pos WHEN 1 THEN 'set_level' ELSE 'stop' || p_size END AS name,
CASE pos WHEN 1 THEN '{"name":"' || p_name || '''s, \"' || p_brand || '\"","levels":[' || p_size || ',[-' || p_partkey || ',[]],true],"at":null}' ELSE '{"why":"it''s (' || p_type || ')"}' END AS arguments
FROM part, (VALUES (1), (2)) t(pos) WHERE p_partkey % 5 > 0"""
)
def text_calls(spark, sf_dir):
    """part: a text of two calls for each, with lists in lists and quotes in quotes; every fifth text lacks a bracket."""
    text = F.format_string("[set_level(name='%s's, \"%s\"', levels=[%03d, [-%d,[ ]],True], at=None) ,\tstop%d(why=\"it's (%s)\")]", "p_name", "p_brand", "p_size", "p_partkey", "p_size", "p_type")
    text = F.when(F.col("p_partkey") % 5 > 0, text).otherwise(F.replace(text, F.lit("[ ]"), F.lit("[")))
    part = table(spark, sf_dir, "part").repartition(spark.sparkContext.defaultParallelism)  # texts take long to read, and may come in one small file
    calls = part.select("p_partkey", F.posexplode(call_texts.parse_calls(text)).alias("pos", "call"))
    return calls.select("p_partkey", (F.col("pos") + 1).alias("pos"), "call.name", "call.arguments")


SEED = "v1"
#: What drafts say of a part, by place.
TEMPLATES = ("Turn on the {name}", "please turn on the {name}", "Is the {name} on for me?")


def drafts(spark, sf_dir):
    """part: a draft for each part and template; a home for each brand, five categories of each home by size.

    An utterance comes once in a home, a type twice, and an answer (name and category) once in all
    homes; of each home's category 12 stay.
    """
    home, category = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("bigint"), F.col("p_size").cast("bigint") % 5
    part = table(spark, sf_dir, "part").repartition(spark.sparkContext.defaultParallelism)  # items take long to make, and parts may come in one small file
    part = part.select("*", home.alias("home"), category.alias("category"), F.posexplode(F.array(*map(F.lit, TEMPLATES))).alias("place", "template"))
    part = part.withColumn("utterance", F.replace("template", F.lit("{name}"), F.col("p_name")))
    items = F.array(
        budgets.item(F.concat_ws("|", F.lit("said"), "home", normalize_utterance(F.col("utterance"))), 1),
        budgets.item(F.concat_ws("|", F.lit("near"), "home", "p_type", "place"), 2),
        budgets.item(F.concat_ws("|", F.lit("answer"), "p_name", "category"), 1, late=True),
    )
    return part.select((F.col("home") * 5 + F.col("category")).alias("phase"), (F.col("p_partkey") * 3 + F.col("place")).alias("pos"), items.alias("items"), F.lit(12).alias("cap"), "p_brand", "utterance")


@query()
def admitted_cases(spark, sf_dir):
    found = budgets.admit(drafts(spark, sf_dir), SEED)
    return found.df.where("kept").select("phase", "pos", "p_brand", "utterance")


# -- state and timers, over the events of each user as one whole stream -----------------------


@query(
    f"""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS m, event_type = 'purchase' AS last FROM events),
runs AS (SELECT user_id, min(m) AS began FROM e GROUP BY user_id UNION ALL
  SELECT r.user_id, (SELECT min(e.m) FROM e WHERE e.user_id = r.user_id AND e.m > r.began + {2 * HOUR}) FROM runs r WHERE r.began IS NOT NULL),
ends AS (SELECT r.user_id, r.began, min(e.m) AS ended FROM runs r LEFT JOIN e ON e.user_id = r.user_id AND e.last AND e.m BETWEEN r.began AND r.began + {HOUR} WHERE r.began IS NOT NULL GROUP BY ALL)
SELECT user_id, CASE WHEN ended IS NULL THEN 'timeout' ELSE 'complete' END AS state, CAST(coalesce(ended, began + {HOUR}) AS BIGINT) AS "at" FROM ends"""
)
def ended_runs(spark, sf_dir):
    return timers.finished(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "purchase", HOUR)


@query(
    f"""SELECT user_id, event_id AS answer, m AS "at", question FROM (SELECT user_id, event_id, epoch_us(ts) AS m, lag(event_id) OVER w AS question, lag(event_type = 'click') OVER w AS holds, lag(epoch_us(ts)) OVER w AS asked
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE holds AND m - asked <= {HOUR}"""
)
def answered_questions(spark, sf_dir):
    turns = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("event_type") == "click").alias("holds"))
    return timers.held_answers(turns, "user_id", "ts", "event_id", "holds", HOUR)


@query()
def hold_log(spark, sf_dir):
    """Ten things that users take with a view and release with anything else."""
    changes = table(spark, sf_dir, "events").select((F.col("event_id") % 10).alias("thing"), "ts", "user_id", (F.col("event_type") == "view").alias("takes"))
    return timers.reference_holds(changes, "thing", "ts", "user_id", "takes", HOUR)


#: Records of each class, records and bytes that a spool may hold.
CAPS, MOST_RECORDS, MOST_BYTES = {"view": 5, "click": 3, "purchase": 4, "error": 2}, 10, 900


@query()
def spool_log(spark, sf_dir):
    """A spool for each of 20 groups of users, a class for each kind of event."""
    kind = F.when(F.col("event_type").isin(list(CAPS)), F.col("event_type")).otherwise("view")
    records = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("spool"), "ts", "event_id", kind.alias("kind"), F.ceil("value").alias("size"))
    return timers.admitted(records, "spool", "ts", "event_id", "kind", "size", CAPS, MOST_RECORDS, MOST_BYTES)


# -- prefixes ---------------------------------------------------------------------------------

_PROMPTS = """w AS (SELECT conv_id, regexp_extract_all(lower(string_agg(role || ' ' || coalesce(text, ''), ' ' ORDER BY turn, role, text)), '[a-z0-9]+') AS w FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, l AS length, array_to_string(w[1:l], ' ') AS prefix, len(w) AS n FROM (SELECT conv_id, w, unnest(range(1, len(w) + 1)) AS l FROM w))"""


def _prompts(spark, sf_dir):
    """conversations: the words of each as one sequence."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text", F.concat(F.col("role"), F.lit(" "), F.coalesce("text", F.lit(""))).alias("said"))))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(tokens(F.array_join(F.transform(turns, lambda t: t["said"]), " ")).alias("words"))


@query(
    f"""WITH {_PROMPTS}, i AS (SELECT prefix, min(conv_id) AS conv_id FROM p WHERE conv_id % 3 > 0 GROUP BY prefix)
SELECT w.conv_id, coalesce(max(p.length), 0) AS length, arg_max(p.cached, p.length) AS cached FROM w LEFT JOIN (SELECT p.conv_id, p.length, i.conv_id AS cached FROM p JOIN i USING (prefix)) p ON p.conv_id = w.conv_id WHERE w.conv_id % 3 = 0 GROUP BY w.conv_id"""
)
def shared_prefixes(spark, sf_dir):
    """Every third conversation against all others."""
    every = _prompts(spark, sf_dir)
    return prefixes.shared_prefix(every.where("conv_id % 3 = 0"), every.where("conv_id % 3 > 0"), "conv_id", "words")


@query(
    f"""WITH {_PROMPTS}, i AS (SELECT prefix, min(conv_id) AS conv_id FROM p WHERE length = least(n, 3 + conv_id % 40) AND length <= 30 GROUP BY prefix)
SELECT w.conv_id, coalesce(max(p.length), 0) AS length, arg_max(p.checkpoint, p.length) AS checkpoint FROM w LEFT JOIN (SELECT p.conv_id, p.length, i.conv_id AS checkpoint FROM p JOIN i USING (prefix)) p ON p.conv_id = w.conv_id GROUP BY w.conv_id"""
)
def checkpoints_met(spark, sf_dir):
    """A checkpoint after the first 3 to 42 words of each conversation; those of 30 words at most count."""
    every = _prompts(spark, sf_dir)
    saved = every.select("conv_id", F.slice("words", 1, (F.col("conv_id") % 40 + 3).cast("int")).alias("words"))
    return prefixes.longest_checkpoint(every, saved, "conv_id", "words", 30)


@query(f"WITH {_PROMPTS} SELECT conv_id, len(w) - 1 - list_position(list_reverse(list_transform(range(1, len(w)), lambda i: w[i] = 'user' AND w[i + 1] = 'the')), TRUE) AS place FROM w")
def last_markers(spark, sf_dir):
    return _prompts(spark, sf_dir).select("conv_id", prefixes.last_marker(F.col("words"), F.array(F.lit("user"), F.lit("the"))).cast("bigint").alias("place"))


# -- tool schemas -----------------------------------------------------------------------------


def _tools(spark, sf_dir):
    """part: a tool for each part, with keys, required names and white space in an order that its key tells."""
    fields = ['"type": "object"', '"required":["mode",\n "level"]', '"$schema":"x"', '"properties":{"mode":{"title":"mode","enum":["b","a"]},"level":{"title":"Level","description":" ","type":"integer"}}']
    parameters = F.array_join(F.when(F.col("p_partkey") % 2 == 0, F.array(*map(F.lit, fields))).otherwise(F.array(*map(F.lit, reversed(fields)))), " , ")
    text = F.format_string('{"type":"function","function":{"parameters":{%s},"name":"%s","description":"size %d"}}', parameters, F.concat(F.lit("set_"), F.col("p_partkey") % 50), "p_size")
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", text.alias("tool"))


_TIDY = """'{"function":{"description":"size ' || p_size || '","name":"set_' || (p_partkey % 50) || '","parameters":{{{0}"properties":{{"level":{{{1}"title":"Level","type":"integer"}},"mode":{{"enum":["b","a"]{2}}}}},"required":["level","mode"],"type":"object"}}}},"type":"function"}}'""".replace('{"function":{"description"', '{{"function":{{"description"')


@query(f"SELECT p_partkey, {_TIDY.format('', '', '')} AS tool FROM part")
def tidy_schemas(spark, sf_dir):
    return _tools(spark, sf_dir).select("p_partkey", tool_schemas.canonical(F.col("tool"), tidy=True).alias("tool"))


_RAW = _TIDY.format('"$schema":"x",', '"description":" ",', ',"title":"mode"')


@query(f"SELECT p_brand, 'sha256:' || sha256('[' || string_agg(tool, ',' ORDER BY name, tool) || ']') AS fingerprint FROM (SELECT p_brand, 'set_' || (p_partkey % 50) AS name, {_RAW} AS tool FROM part) GROUP BY p_brand")
def schema_fingerprints(spark, sf_dir):
    return tool_schemas.fingerprint(_tools(spark, sf_dir), "p_brand", "tool")


@query(
    """WITH t AS (SELECT p_brand, p_partkey % 50 AS k, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, row_number() OVER (PARTITION BY p_brand, p_partkey % 50 ORDER BY p_partkey) AS seen FROM part)
SELECT p_brand, arg_min('Duplicate function name ''set_' || k || ''' in compiled tool envelope', i) FILTER (WHERE seen > 1) AS fault FROM t GROUP BY p_brand"""
)
def envelope_faults(spark, sf_dir):
    return tool_schemas.envelope_faults(_tools(spark, sf_dir), "p_brand", "p_partkey", "tool")


# -- pooling, digests and rates ---------------------------------------------------------------


@query(
    """WITH r AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS place, embedding FROM embeddings),
e AS (SELECT label, place, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM r),
w AS (SELECT label, place, i, avg(x) OVER w AS mean, stddev_pop(x) OVER w AS deviation FROM e WINDOW w AS (PARTITION BY label, i ORDER BY place ROWS BETWEEN 15 PRECEDING AND CURRENT ROW))
SELECT label, place, sum(mean * i) AS means, sum(deviation * i) AS deviations FROM w GROUP BY label, place"""
)
def pooled_features(spark, sf_dir):
    """embeddings: a stream for each label; of each window's pooled vector the sums of means and of deviations, weighted by dimension."""
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    pooled = metrics.pooled_windows(table(spark, sf_dir, "embeddings").withColumn("place", place), "label", "place", "embedding", 16, 64)
    half = F.size("pooled") / 2
    total = lambda first: F.aggregate(F.transform(F.slice("pooled", (first + 1).cast("int"), half.cast("int")), lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return pooled.select("label", "place", total(F.lit(0)).alias("means"), total(half).alias("deviations"))


@query("SELECT l_orderkey, sha256(string_agg(d, '' ORDER BY l_linenumber, l_partkey, l_suppkey)) AS fingerprint FROM (SELECT *, sha256(l_partkey || chr(31) || l_suppkey) AS d FROM lineitem) GROUP BY l_orderkey")
def fingerprint_in_order(spark, sf_dir):
    digest = N.ordered_fingerprint([F.col("l_partkey"), F.col("l_suppkey")], [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey")])
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(digest.alias("fingerprint"))


@query(
    """SELECT user_id, n_false, seconds, CASE WHEN seconds > 0 THEN n_false / (seconds / 3600.0) END AS per_hour
FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS n_false, sum(CASE WHEN event_type = 'purchase' THEN 0.0 ELSE value END) AS seconds FROM events GROUP BY user_id)"""
)
def false_rate_without_phrases(spark, sf_dir):
    """Errors of a user by the hours of all that isn't a purchase."""
    spent = F.when(F.col("event_type") == "purchase", 0.0).otherwise(F.col("value"))
    sums = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("n_false"), F.sum(spent).alias("seconds"))
    return sums.select("*", N.per_hour_or_null(F.col("n_false"), F.col("seconds")).alias("per_hour"))


@query(
    """WITH s AS (SELECT o_orderpriority AS variant, avg(e) AS mean_error, count(*) FILTER (WHERE e = 0) AS n_exact FROM (SELECT o_orderpriority, (o_orderkey % 7) / 10.0 AS e FROM orders) GROUP BY 1)
SELECT b.mean_error - a.mean_error AS delta_mean_error, b.n_exact - a.n_exact AS delta_n_exact FROM s a, s b WHERE a.variant LIKE '1%' AND b.variant LIKE '2%'"""
)
def variant_deltas(spark, sf_dir):
    phrases = table(spark, sf_dir, "orders").select(F.substring("o_orderpriority", 1, 1).alias("variant"), ((F.col("o_orderkey") % 7) / 10).alias("error"))
    return evaluation.variant_delta(evaluation.variant_summary(phrases, "variant", "error"), "variant", "1", "2")


_SOUNDS = "replace(lower(p_name), ' ', '')"


@query(
    f"""WITH w AS (SELECT p_partkey, {_SOUNDS} AS s FROM part), t AS (SELECT DISTINCT substr(s, 3, 3 + p_partkey % 3) AS target FROM w WHERE p_partkey % 7 = 0 AND length(s) >= 3),
r AS (SELECT DISTINCT p_partkey, substr(s, i, n) AS run FROM (SELECT p_partkey, s, unnest(range(1, length(s) + 1)) AS i FROM w), (VALUES (3), (4), (5)) k(n) WHERE i + n - 1 <= length(s)),
d AS (SELECT run, target FROM (SELECT DISTINCT run FROM r), t WHERE target <> '' AND levenshtein(run, target) <= 1)
SELECT p_partkey, count(DISTINCT target) AS n_targets, min(target) AS first FROM r JOIN d USING (run) GROUP BY p_partkey"""
)
def near_sounds(spark, sf_dir):
    """part: names as sounds, a letter each; targets of three to five sounds from every seventh part."""
    words = table(spark, sf_dir, "part").select("p_partkey", F.replace(F.lower("p_name"), F.lit(" "), F.lit("")).alias("sounds"))
    targets = words.where("p_partkey % 7 = 0 AND length(sounds) >= 3").select(F.col("sounds").substr(F.lit(3), (F.col("p_partkey") % 3 + 3).cast("int")).alias("target"))
    near = metrics.near_targets(words, targets, "p_partkey", "sounds", "target")
    return near.groupBy("p_partkey").agg(F.count("*").alias("n_targets"), F.min("target").alias("first"))
