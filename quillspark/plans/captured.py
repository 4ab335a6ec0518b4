"""Queries of capture records: events are captures, customers their sessions, orders commands that name them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import captures, detection, metrics
from quillspark.plans.lenses import DETECT, HOUR, micros, table
from quillspark.plans.registry import query

_LABEL = "CASE event_id % 5 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'unsure' END"
_CAPTURES = f"(SELECT event_id, user_id, ts, event_type, value, {_LABEL} AS label, CASE WHEN event_id % 3 <> 0 THEN ts END AS labeled_at FROM events)"


def _captures(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value", F.expr(_LABEL).alias("label"), F.expr("CASE WHEN event_id % 3 <> 0 THEN ts END").alias("labeled_at"))


@query("SELECT o_orderkey, (SELECT arg_max(l_partkey, (l_linenumber, l_partkey)) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A') AS transcript FROM orders")
def capture_transcripts(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    outcomes = lines.select(F.col("l_orderkey").alias("o_orderkey"), F.struct("l_linenumber", "l_partkey").alias("at"), F.when(F.col("l_returnflag") == "A", "stt").otherwise("wake").alias("kind"), F.col("l_partkey").alias("transcript"))
    return captures.with_transcripts(table(spark, sf_dir, "orders").select("o_orderkey"), outcomes, "o_orderkey", "at")


@query(
    """WITH k AS (SELECT o_orderkey AS command_id, CASE WHEN o_orderkey % 4 > 0 THEN o_custkey * 7 END AS capture FROM orders)
SELECT command_id, capture, CASE WHEN capture IS NULL THEN 'without_capture' WHEN event_id IS NULL THEN 'unknown_capture' ELSE 'linked' END AS state FROM k LEFT JOIN events ON event_id = capture
UNION ALL SELECT NULL, event_id, 'unused' FROM events WHERE event_id NOT IN (SELECT capture FROM k WHERE capture IS NOT NULL)"""
)
def capture_links(spark, sf_dir):
    commands = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("command_id"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_custkey") * 7).alias("wake"))
    return captures.link_audit(commands, _captures(spark, sf_dir), "wake", "event_id")


@query(f"SELECT event_id, user_id, label, CASE WHEN user_id % 3 = 0 THEN 'eval' ELSE 'train' END AS split FROM {_CAPTURES} WHERE label IN ('positive', 'negative') AND labeled_at IS NOT NULL AND user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def split_examples(spark, sf_dir):
    splits = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"), F.expr("CASE WHEN c_custkey % 3 = 0 THEN 'eval' ELSE 'train' END").alias("split"))
    return captures.session_examples(_captures(spark, sf_dir), splits, "user_id", ["positive", "negative"]).select("event_id", "user_id", "label", "split")


@query("SELECT event_id, user_id, c_mktsegment FROM events LEFT JOIN customer ON c_custkey = user_id AND c_acctbal > 0")
def capture_sessions(spark, sf_dir):
    sessions = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return captures.with_sessions(_captures(spark, sf_dir), sessions, "user_id", ["c_mktsegment"]).select("event_id", "user_id", "c_mktsegment")


@query(f"SELECT event_id, value, greatest((SELECT count(*) FROM {_CAPTURES} WHERE label IS NULL) - 40, 0) AS n_more FROM {_CAPTURES} WHERE label IS NULL ORDER BY value DESC, event_id LIMIT 40")
def unreviewed_listing(spark, sf_dir):
    return captures.listing(_captures(spark, sf_dir), "value", "event_id", 40, unreviewed=True).select("event_id", "value", "n_more")


@query(
    f"SELECT stream, idx, score FROM (SELECT user_id AS stream, epoch_us(ts) AS idx, value AS score FROM events WHERE value >= 50 QUALIFY row_number() OVER (PARTITION BY user_id, epoch_us(ts) // {HOUR} ORDER BY value DESC, ts) = 1) ORDER BY score DESC, stream DESC, idx DESC LIMIT 300"
)
def hard_negatives(spark, sf_dir):
    scores = table(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), micros("ts").alias("idx"), F.col("value").alias("score"))
    return captures.capped_best(scores, "stream", "idx", "score", HOUR, 50.0, 300).select("stream", "idx", "score")


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size > 25, length(n), lower(n), n) AS place FROM (SELECT *, p_name || ' ' || p_partkey AS n FROM part)")
def review_places(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("group"), (F.col("p_size") > 25).alias("suspect"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"))
    return captures.review_order(names, "suspect", "name").select("p_partkey", F.col("place").cast("long").alias("place"))


@query("SELECT event_id, value FROM events WHERE value > 60 ORDER BY sha256('s|' || event_id), event_id LIMIT 100")
def loud_slices(spark, sf_dir):
    return captures.loud_slices(table(spark, sf_dir, "events"), "value", "event_id", 60.0, "s", 100).select("event_id", "value")


@query("SELECT origin, count(*) AS n, count(a) AS n_a, count(b) AS n_b FROM (SELECT 'spool' AS origin, event_id AS a, NULL AS b FROM events UNION ALL SELECT 'seed', p_partkey, p_size FROM part UNION ALL SELECT 'corpus', NULL, s_suppkey FROM supplier) GROUP BY origin")
def pooled_sources(spark, sf_dir):
    spool = table(spark, sf_dir, "events").select(F.col("event_id").alias("a"))
    seed = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"), F.col("p_size").cast("long").alias("b"))
    corpus = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("b"))
    return captures.pooled({"spool": spool, "seed": seed, "corpus": corpus}).groupBy("origin").agg(F.count("*").alias("n"), F.count("a").alias("n_a"), F.count("b").alias("n_b"))


@query("SELECT p_partkey, p_brand, p_name FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) <= 2")
def near_duplicate_budget(spark, sf_dir):
    return captures.within_budget(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name"), ["p_brand", "p_name"], "p_partkey", 2)


@query(
    """SELECT count(*) FILTER (WHERE f AND s) AS n_wake, count(*) FILTER (WHERE f AND NOT s) AS n_false_positive, count(*) FILTER (WHERE NOT f AND s) AS n_missed_wake, count(*) FILTER (WHERE NOT f AND NOT s) AS n_near_miss,
(max(epoch_us(ts)) - min(epoch_us(ts))) / 3600000000 AS span_hours, count(*) FILTER (WHERE f AND NOT s) / count(*) FILTER (WHERE f) AS false_share FROM (SELECT ts, value >= 150 AS f, event_type = 'purchase' AS s FROM events)"""
)
def class_report(spark, sf_dir):
    return captures.class_report(_captures(spark, sf_dir), F.col("value") >= 150, F.col("event_type") == "purchase", micros("ts"))


@query(
    f"SELECT event_type, count(*) FILTER (WHERE label = 'positive') AS n_positive, count(*) FILTER (WHERE label = 'negative') AS n_negative, count(*) FILTER (WHERE label IS NULL) AS n_unlabelled, count(*) FILTER (WHERE label = 'positive' AND labeled_at IS NULL) AS n_automatic_positive FROM {_CAPTURES} GROUP BY event_type"
)
def label_audit(spark, sf_dir):
    return captures.label_audit(_captures(spark, sf_dir), "event_type")


@query("SELECT p_brand, coalesce(a, 0) AS n_sources, coalesce(b, 0) AS n_features FROM (SELECT p_brand, count(*) AS a FROM part GROUP BY p_brand) FULL JOIN (SELECT p_brand, count(*) AS b FROM part WHERE p_size < 50 GROUP BY p_brand) USING (p_brand) WHERE coalesce(a, 0) <> coalesce(b, 0)")
def count_mismatches(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return captures.count_mismatches(parts, parts.where("p_size < 50"), "p_brand")


@query(
    f"""WITH g AS (SELECT o_custkey * 3 AS event_id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS new, max(o_orderdate) AS given FROM orders GROUP BY 1)
SELECT c.event_id, CASE WHEN g.event_id IS NULL THEN label ELSE new END AS label, CASE WHEN g.event_id IS NULL THEN labeled_at ELSE given END AS labeled_at FROM {_CAPTURES} c LEFT JOIN g USING (event_id)"""
)
def relabelled(spark, sf_dir):
    log = table(spark, sf_dir, "orders").select((F.col("o_custkey") * 3).alias("event_id"), F.col("o_orderstatus").alias("label"), F.col("o_orderdate").alias("labeled_at"), "o_orderkey")
    return captures.relabelled(_captures(spark, sf_dir), log, "event_id", ["labeled_at", "o_orderkey"]).select("event_id", "label", "labeled_at")


@query("SELECT event_id, greatest(i - 5000, 0) AS first, least(i + 2000, 4000000) AS last FROM (SELECT event_id, CAST(floor(value * 10000) AS BIGINT) AS i FROM events)")
def context_bounds(spark, sf_dir):
    at = F.floor(F.col("value") * 10000)
    first, last = captures.context_bounds(at, at, 5000, 2000, F.lit(4_000_000).cast("long"))
    return table(spark, sf_dir, "events").select("event_id", first.alias("first"), last.alias("last"))


_RULES = """CASE WHEN l IN ('positive', 'negative') THEN 'trusted_manual' WHEN event_id % 11 = 0 THEN 'homophone_ambiguous' WHEN event_id % 13 = 0 THEN 'clipping' WHEN event_id % 17 = 0 THEN 'empty_asr' WHEN event_id % 19 = 0 THEN 'teacher_disagreement'
WHEN peak < 100 THEN 'quiet_window' WHEN peak >= 8000 AND event_type = 'view' THEN 'uncertain_alignment' WHEN peak >= 5000 THEN 'no_automatic_positive' ELSE 'conservative_negative' END"""


@query(
    f"""SELECT event_id, CASE reason WHEN 'trusted_manual' THEN l WHEN 'quiet_window' THEN 'negative' WHEN 'conservative_negative' THEN 'negative' END AS label, reason
FROM (SELECT *, {_RULES} AS reason FROM (SELECT *, {_LABEL} AS l, value * 50 AS peak FROM events))"""
)
def taught_labels(spark, sf_dir):
    rows, each = _captures(spark, sf_dir), lambda n: F.col("event_id") % n == 0
    got = captures.teacher(F.col("label"), each(11), each(13), each(17), each(19), F.col("value") * 50, F.col("event_type") == "view", ["positive", "negative"])
    return rows.select("event_id", got["label"].alias("label"), got["reason"].alias("reason"))


@query(
    """WITH w AS (SELECT event_id, user_id, epoch_us(ts) AS m, CAST(floor(value * 1000) AS BIGINT) AS s FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, CAST(floor(value * 1000) AS BIGINT) + 9000 AS e, epoch_us(ts) AS m FROM events WHERE event_type <> 'purchase'),
r AS (SELECT w.event_id, any_value(s) AS s, coalesce(max(e) FILTER (WHERE c.m <= w.m), 0) AS now, coalesce(max(e) FILTER (WHERE c.m <= w.m + 86400000000), 0) AS late FROM w LEFT JOIN c USING (user_id) GROUP BY w.event_id)
SELECT event_id, greatest(s - 3000, 0) < now - 200000 OR s < 3000 AS pre_context_missing, late < s + 2000 + 5000 AS post_context_missing FROM r"""
)
def context_flags(spark, sf_dir):
    rows = _captures(spark, sf_dir).select("event_id", "user_id", "event_type", micros("ts").alias("at"), F.floor(F.col("value") * 1000).alias("s"))
    windows = rows.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("id"), F.col("s").alias("start"), (F.col("s") + 2000).alias("end"), "at")
    chunks = rows.where("event_type <> 'purchase'").select("user_id", (F.col("s") + 9000).alias("end"), F.col("at").alias("arrived"))
    return captures.context_flags(windows, chunks, "user_id", 3000, 5000, 200_000, 86_400_000_000).select(F.col("id").alias("event_id"), "pre_context_missing", "post_context_missing")


@query(
    "SELECT event_id, greatest(least(coalesce(r, m + 3600000000), m + 3600000000), m) AS until FROM (SELECT event_id, epoch_us(ts) AS m FROM events WHERE event_type = 'click')"
    " LEFT JOIN (SELECT event_id - 1 AS event_id, min(epoch_us(ts)) AS r FROM events GROUP BY 1) USING (event_id)"
)
def hold_spans(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", micros("ts").alias("at"))
    spans = captures.hold_spans(rows.where("event_type = 'click'").select("event_id", "at"), rows.select((F.col("event_id") - 1).alias("event_id"), "at"), "event_id", HOUR)
    return spans.select("event_id", "until")


@query(
    f"""WITH RECURSIVE h AS (SELECT DISTINCT user_id AS stream, epoch_us(ts) AS idx FROM events WHERE value >= {DETECT}),
f AS (SELECT stream, min(idx) AS idx FROM h GROUP BY stream UNION ALL SELECT f.stream, (SELECT min(h.idx) FROM h WHERE h.stream = f.stream AND h.idx >= f.idx + {HOUR}) FROM f WHERE f.idx IS NOT NULL)
SELECT user_id AS stream, count(*) AS n_windows, max(value) AS best, (SELECT count(idx) FROM f WHERE f.stream = user_id) AS n_activations FROM events GROUP BY user_id"""
)
def replayed_sessions(spark, sf_dir):
    windows = table(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), micros("ts").alias("idx"), F.col("value").alias("score"))
    return detection.replay(windows, "stream", "idx", "score", DETECT, HOUR)


@query("SELECT p_partkey, len(list_filter(range(1, greatest(length(p_name) - 2, 1) + 1), lambda i: levenshtein(substr(p_name, i, 3), 'ring') <= 1)) + len(list_filter(range(1, greatest(length(p_name) - 3, 1) + 1), lambda i: levenshtein(substr(p_name, i, 4), 'ring') <= 1)) + len(list_filter(range(1, greatest(length(p_name) - 4, 1) + 1), lambda i: levenshtein(substr(p_name, i, 5), 'ring') <= 1)) > 0 AS near FROM part")
def near_phrases(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", metrics.near_phrase(F.col("p_name"), F.lit("ring")).alias("near"))


@query(
    r"""SELECT p_partkey, trim(regexp_replace(lower(regexp_replace(p_name || '-' || p_brand || '!', '[^\w\s'']', ' ', 'g')), '\s+', ' ', 'g')) AS loose, regexp_replace(lower(p_brand), '[^a-z'']', '', 'g') AS letters,
CASE WHEN p_size > 25 THEN p_type ELSE p_name || chr(10) || p_type END AS rest, 'Area context:' || chr(10) || 'satellite_area: ' || p_brand || chr(10) || 'target_area: ' || CASE WHEN p_size > 25 THEN 'none' ELSE p_name END || chr(10) || 'target_area_source: none' AS area,
p_size % 2 = 0 AS literal FROM part"""
)
def rendered_texts(spark, sf_dir):
    name, brand, kind, big = F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.col("p_size") > 25
    text = F.concat_ws("\n", F.when(big, F.concat(F.lit("Area: "), name)).otherwise(name), kind)
    labels = F.array(F.array().cast("array<string>"), F.when(F.col("p_size") % 2 == 0, F.array(F.lit("zebra"), name)).otherwise(F.array(F.lit("zebra"))))
    return table(spark, sf_dir, "part").select(
        "p_partkey", X.loose_words(F.concat(name, F.lit("-"), brand, F.lit("!"))).alias("loose"), X.letter_word(brand).alias("letters"), X.without_lines(text, ["Area:", "Room:"]).alias("rest"),
        X.area_lines(brand, F.when(~big, name), F.lit("none")).alias("area"), X.literal(F.concat(F.lit("please dim the "), name, F.lit(" for me")), labels).alias("literal"),
    )


@query("""SELECT p_partkey, 'dim ' || p_name || '|{"calls":["' || p_type || '"],"candidates":["a","b"],"response_type":"' || p_brand || '"}' AS key FROM part""")
def answer_keys(spark, sf_dir):
    key = X.answer_key(F.concat(F.lit("Please dim "), F.col("p_name")), F.col("p_brand"), F.array("p_type"), F.array(F.lit("b"), F.lit("a")), F.lit(None).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", key.alias("key"))
