"""All queries of the engine by name, with their DuckDB counterparts.

Each query reads the star-schema tables through a lens of quillspark.plans.lenses, over whole tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import numbers as N
from quillspark.functions import text as X
from quillspark.operators import contracts, corpus, detection, evaluation, lexical, metrics, traces
from quillspark.plans import called, captured, lenses, replayed, scored  # noqa: F401 - four of them register their queries
from quillspark.plans.lenses import DETECT, HALF_HOUR, HOUR, MINE, table
from quillspark.plans.registry import ORACLES, QUERIES, query  # noqa: F401

FLAGSHIP = "false_activations_per_hour"


TRACES = "(SELECT event_id AS trace_id, event_id AS seq, ts AS started_at, user_id AS agent, event_type AS error_stage, value AS total_ms, CASE WHEN event_type = 'error' THEN false WHEN event_type <> 'view' THEN true END AS success FROM events)"
SCORES = "(SELECT event_id, user_id AS stream, epoch_us(ts) AS idx, value AS score, event_type FROM events)"


# -- traces -----------------------------------------------------------------------------------


@query(f"SELECT * FROM {TRACES} WHERE success = false ORDER BY seq DESC LIMIT 100")
def trace_list_failures(spark, sf_dir):
    return traces.list_traces(lenses.traces(spark, sf_dir), 100, only_failures=True)


@query(f"SELECT * FROM {TRACES} WHERE error_stage = 'click' AND started_at >= TIMESTAMP '2024-01-05' AND started_at <= TIMESTAMP '2024-01-20' ORDER BY seq DESC LIMIT 200")
def trace_list_window(spark, sf_dir):
    start, end = (F.lit(d).cast("timestamp_ntz") for d in ("2024-01-05", "2024-01-20"))
    return traces.list_traces(lenses.traces(spark, sf_dir), 200, error_stage="click", start=start, end=end)


@query(f"SELECT * FROM (SELECT * FROM {TRACES} QUALIFY row_number() OVER (PARTITION BY agent ORDER BY seq DESC) <= 20) ORDER BY started_at DESC NULLS LAST, seq DESC LIMIT 20")
def trace_merge_topn(spark, sf_dir):
    return traces.merged_newest(lenses.traces(spark, sf_dir), "agent", 20)


@query(f"SELECT * FROM {TRACES} WHERE trace_id = 77")
def trace_get(spark, sf_dir):
    return traces.get_trace(lenses.traces(spark, sf_dir), 77)


@query(
    "SELECT o_orderkey, count(l_orderkey) AS n_events, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey), '') AS line"
    " FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey"
)
def trace_nest_events(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    events = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    nested = traces.nest_events(orders, events, "o_orderkey", ["l_linenumber"], ["l_partkey"])
    line = F.array_join(F.transform("events", lambda e: F.concat_ws(":", e["l_linenumber"].cast("string"), e["l_partkey"].cast("string"))), ",")
    return nested.select("o_orderkey", F.size("events").cast("long").alias("n_events"), line.alias("line"))


@query("SELECT l_orderkey, " + ", ".join(f"sum(l_quantity) FILTER (WHERE l_returnflag || l_linestatus = '{s}') AS {s}_ms" for s in ("AF", "NF", "NO", "RF")) + " FROM lineitem GROUP BY l_orderkey")
def trace_stage_pivot(spark, sf_dir):
    spans = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("stage"), "l_quantity")
    return traces.stage_sums(spans, "l_orderkey", "stage", "l_quantity", ["AF", "NF", "NO", "RF"])


@query(f"SELECT * FROM (SELECT * FROM {TRACES} ORDER BY seq DESC LIMIT 500) WHERE started_at IS NULL OR started_at >= TIMESTAMP '2024-01-10'")
def trace_retention(spark, sf_dir):
    return traces.retained(lenses.traces(spark, sf_dir), 500, F.lit("2024-01-10").cast("timestamp_ntz"))


@query(f"SELECT agent, arg_min(trace_id, seq) AS trace_id, arg_min(total_ms, seq) AS total_ms, count(*) AS n_failures FROM {TRACES} WHERE success = false GROUP BY agent")
def trace_first_failure(spark, sf_dir):
    return traces.first_failures(lenses.traces(spark, sf_dir), "agent", "seq", F.col("success").eqNullSafe(F.lit(False)), ["trace_id", "total_ms"])


@query(f"SELECT agent, error_stage, arg_max(trace_id, seq) AS trace_id, arg_max(total_ms, seq) AS total_ms FROM {TRACES} GROUP BY agent, error_stage")
def trace_latest_by_type(spark, sf_dir):
    return traces.latest_by_type(lenses.traces(spark, sf_dir), "agent", "error_stage", ["seq"], ["trace_id", "total_ms"])


@query(f"SELECT agent, arg_max(total_ms, seq) AS total_ms, count(*) AS n_events FROM {TRACES} GROUP BY agent")
def trace_total(spark, sf_dir):
    return traces.totals(lenses.traces(spark, sf_dir), "agent", "seq", "total_ms")


@query(
    "SELECT user_id, CASE WHEN a IS NULL OR b IS NULL THEN NULL ELSE greatest(CAST(round_even((b - a) / 1000.0, 0) AS BIGINT), 0) END AS duration_ms FROM"
    " (SELECT user_id, min(epoch_us(ts)) FILTER (WHERE event_type = 'view') AS a, min(epoch_us(ts)) FILTER (WHERE event_type = 'purchase') AS b FROM events GROUP BY user_id)"
)
def trace_span_duration(spark, sf_dir):
    found = traces.span_durations(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "view", "purchase")
    ends = table(spark, sf_dir, "events").groupBy("user_id").agg((F.count_if(F.col("event_type") == "view") > 0).alias("v"), (F.count_if(F.col("event_type") == "purchase") > 0).alias("p"))
    return found.join(ends, "user_id").select("user_id", F.when(F.col("v") & F.col("p"), F.col("duration_ms")).alias("duration_ms"))


@query(f"SELECT error_stage AS kind, count(*) AS n, arg_max(trace_id, seq) AS trace_id, arg_max(agent, seq) AS agent FROM {TRACES} WHERE success = false GROUP BY error_stage")
def failure_counters(spark, sf_dir):
    failed = lenses.traces(spark, sf_dir).where(F.col("success").eqNullSafe(F.lit(False)))
    return traces.failure_counters(failed, F.col("error_stage"), "seq", ["trace_id", "agent"])


@query(f"SELECT trace_id, seq, started_at, CAST(NULL AS BIGINT) AS agent, CASE WHEN error_stage IS NOT NULL THEN '**REDACTED**' END AS error_stage, total_ms, success FROM {TRACES}")
def redacted_export(spark, sf_dir):
    return traces.redacted(lenses.traces(spark, sf_dir), ["agent"], ["error_stage"])


# -- detection --------------------------------------------------------------------------------

_FIRES = f"""hits AS (SELECT DISTINCT stream, idx FROM {SCORES} WHERE score >= {{least}} AND event_type <> 'purchase'),
fires AS (SELECT stream, min(idx) AS idx FROM hits GROUP BY stream
  UNION ALL SELECT f.stream, (SELECT min(h.idx) FROM hits h WHERE h.stream = f.stream AND h.idx >= f.idx + {HOUR}) FROM fires f WHERE f.idx IS NOT NULL)"""


@query(
    f"""WITH RECURSIVE {_FIRES.format(least=DETECT)},
outside AS (SELECT * FROM fires f WHERE idx IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {SCORES} p WHERE p.event_type = 'purchase' AND p.stream = f.stream AND f.idx BETWEEN p.idx - {HALF_HOUR} AND p.idx + {HALF_HOUR})),
spans AS (SELECT stream, (max(idx) - min(idx)) / 1e6 AS seconds FROM {SCORES} GROUP BY stream)
SELECT s.stream, CAST(count(o.idx) AS BIGINT) AS n_false, seconds, CASE WHEN seconds <= 0 THEN CAST('inf' AS DOUBLE) ELSE count(o.idx) / (seconds / 3600.0) END AS per_hour
FROM spans s LEFT JOIN outside o USING (stream) GROUP BY s.stream, seconds"""
)
def false_activations_per_hour(spark, sf_dir):
    """Detections after refractory suppression that no positive interval holds, by the hours of the stream."""
    scores = lenses.scores(spark, sf_dir)
    hits = scores.where((F.col("score") >= DETECT) & (F.col("event_type") != "purchase"))
    fires = detection.refractory(hits, "stream", "idx", HOUR)
    false = detection.outside_intervals(fires, lenses.positives(scores), "stream", "idx", HOUR).groupBy("stream").agg(F.count("*").alias("n"))
    spans = scores.groupBy("stream").agg(((F.max("idx") - F.min("idx")) / 1e6).alias("seconds"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return spans.join(false, "stream", "left").select("stream", n.alias("n_false"), "seconds", N.per_hour(n, F.col("seconds")).alias("per_hour"))


@query(
    "WITH RECURSIVE "
    + ",\n".join(_FIRES.format(least=t).replace("hits", f"hits{i}").replace("fires", f"fires{i}") for i, t in enumerate((100, 150, 200)))
    + "\nSELECT * FROM ("
    + " UNION ALL ".join(f"SELECT CAST({t} AS DOUBLE) AS threshold, count(idx) AS n_fires FROM fires{i}" for i, t in enumerate((100, 150, 200)))
    + ")"
)
def refractory_fires_by_threshold(spark, sf_dir):
    scores, out = lenses.scores(spark, sf_dir).where("event_type <> 'purchase'"), None
    for t in (100.0, 150.0, 200.0):
        one = detection.refractory(scores.where(F.col("score") >= t), "stream", "idx", HOUR).agg(F.lit(t).alias("threshold"), F.count("*").alias("n_fires"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    f"""WITH spans AS (SELECT stream, max(idx) - min(idx) AS n FROM {SCORES} GROUP BY stream)
SELECT stream, unnest(range({6 * HOUR}, n + 1, {3 * HOUR})) AS window_end FROM spans WHERE n >= {6 * HOUR}"""
)
def sliding_windows_grid(spark, sf_dir):
    spans = lenses.scores(spark, sf_dir).groupBy("stream").agg((F.max("idx") - F.min("idx")).alias("n"))
    return detection.window_grid(spans, "n", 6 * HOUR, 3 * HOUR).select("stream", "window_end")


@query(
    f"""WITH points AS (SELECT stream, idx - min(idx) OVER (PARTITION BY stream) AS e FROM {SCORES}),
grid AS (SELECT stream, e, CASE WHEN e >= {6 * HOUR} THEN ((e - {6 * HOUR}) // {3 * HOUR}) * {3 * HOUR} + {6 * HOUR} END AS point FROM points),
lagged AS (SELECT *, lag(point) OVER (PARTITION BY stream ORDER BY e) AS before FROM grid)
SELECT stream, e, point, e - point AS lag FROM lagged WHERE point IS NOT NULL AND (before IS NULL OR point > before)"""
)
def sliding_windows_emitted(spark, sf_dir):
    scores = lenses.scores(spark, sf_dir)
    first = scores.groupBy("stream").agg(F.min("idx").alias("zero"))
    chunks = scores.join(first, "stream").select("stream", (F.col("idx") - F.col("zero")).alias("e"))
    return detection.last_of_chunk(chunks, "stream", "e", 6 * HOUR, 3 * HOUR)


@query(f"SELECT stream, idx // {24 * HOUR} AS bucket, arg_max(idx, (score, -idx)) AS idx, max(score) AS score FROM {SCORES} WHERE score >= 50 GROUP BY ALL")
def tumbling_argmax(spark, sf_dir):
    return detection.bucket_best(lenses.scores(spark, sf_dir), "stream", "idx", "score", 24 * HOUR, 50.0)


_NEW_CLUSTER = "{'first': w.s, 's': w.s, 'e': w.e, 'score': w.score, 'n': CAST(1 AS BIGINT)}"
_GROWN = "CASE WHEN w.score >= x.score THEN {'first': x.first, 's': w.s, 'e': w.e, 'score': w.score, 'n': x.n + 1} ELSE {'first': x.first, 's': x.s, 'e': x.e, 'score': x.score, 'n': x.n + 1} END"


@query(
    f"""WITH RECURSIVE w AS (SELECT stream, idx - {HOUR} AS s, idx AS e, score, row_number() OVER (PARTITION BY stream ORDER BY idx, score) AS k FROM {SCORES} WHERE score >= {MINE}),
t AS (SELECT DISTINCT stream, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT("first" BIGINT, s BIGINT, e BIGINT, score DOUBLE, n BIGINT)[]) AS c FROM w UNION ALL
SELECT t.stream, w.k, CASE WHEN hit > 0 THEN list_transform(c, lambda x, i: CASE WHEN i = hit THEN {_GROWN} ELSE x END) ELSE list_append(c, {_NEW_CLUSTER}) END
FROM t JOIN w ON w.stream = t.stream AND w.k = t.k + 1, LATERAL (SELECT coalesce(list_position(list_transform(t.c, lambda x: x.s < w.e AND w.s < x.e), true), 0) AS hit)),
g AS (SELECT stream, unnest(arg_max(c, k)) AS c FROM t GROUP BY stream)
SELECT stream, c.first AS first_start, c.s AS start, c.e AS "end", c.score AS score, c.n AS n_windows FROM g"""
)
def cluster_overlaps(spark, sf_dir):
    windows = lenses.scores(spark, sf_dir).where(F.col("score") >= MINE).select("stream", (F.col("idx") - HOUR).alias("s"), F.col("idx").alias("e"), "score")
    return detection.clusters(windows, "stream", "s", "e", "score")


@query(
    f"""SELECT d.stream, d.event_id, p.event_id AS span_id FROM {SCORES} d JOIN {SCORES} p ON d.stream = p.stream AND p.event_type = 'purchase'
WHERE d.score >= {DETECT} AND p.idx - {HALF_HOUR} < d.idx AND p.idx + {HALF_HOUR} > d.idx - {HOUR}"""
)
def context_interval_join(spark, sf_dir):
    scores = lenses.scores(spark, sf_dir)
    spans = scores.where("event_type = 'purchase'").select("stream", F.col("event_id").alias("span_id"), (F.col("idx") - HALF_HOUR).alias("start"), (F.col("idx") + HALF_HOUR).alias("end"))
    return detection.overlapping(scores.where(F.col("score") >= DETECT), spans, "stream", "idx", HOUR, 2 * HOUR).select("stream", "event_id", "span_id")


@query(f"SELECT a.event_id AS anchor, count(*) AS n_points, max(p.score) AS best FROM {SCORES} a JOIN {SCORES} p ON a.stream = p.stream AND p.idx - a.idx BETWEEN {-6 * HOUR} AND {2 * HOUR} WHERE a.score >= {DETECT} GROUP BY a.event_id")
def score_trace_range(spark, sf_dir):
    scores = lenses.scores(spark, sf_dir)
    anchors = scores.where(F.col("score") >= DETECT).select("stream", F.col("event_id").alias("anchor"), F.col("idx").alias("at"))
    pairs = detection.near_points(anchors, scores.select("stream", "idx", "score"), "stream", "idx", -6 * HOUR, 2 * HOUR)
    return pairs.groupBy("anchor").agg(F.count("*").alias("n_points"), F.max("score").alias("best"))


@query(
    f"""SELECT d.stream, d.event_id, d.idx, b.idx + {HALF_HOUR} AS boundary, coalesce(d.idx <= b.idx + {HALF_HOUR}, false) AS stale
FROM (SELECT * FROM {SCORES} WHERE event_type <> 'purchase') d ASOF LEFT JOIN (SELECT * FROM {SCORES} WHERE event_type = 'purchase') b ON d.stream = b.stream AND d.event_id >= b.event_id"""
)
def stale_detection_asof(spark, sf_dir):
    scores = lenses.scores(spark, sf_dir)
    boundaries = scores.where("event_type = 'purchase'").select("stream", "event_id", (F.col("idx") + HALF_HOUR).alias("boundary"))
    return detection.stale(scores.where("event_type <> 'purchase'"), boundaries, "stream", "idx", "event_id")


@query(
    f"""SELECT *, held = 0 AND delta < 0 AS restored FROM (SELECT stream, event_id, delta, CAST(sum(delta) OVER (PARTITION BY stream ORDER BY idx, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS held
FROM (SELECT *, CASE WHEN event_type = 'click' THEN 1 ELSE -1 END AS delta FROM {SCORES} WHERE event_type IN ('click', 'view')))"""
)
def hold_refcount(spark, sf_dir):
    delta = F.when(F.col("event_type") == "click", 1).otherwise(-1)
    changes = lenses.scores(spark, sf_dir).where("event_type IN ('click', 'view')").withColumn("delta", delta)
    return detection.holds(changes, "stream", ["idx", "event_id"], "delta").select("stream", "event_id", "delta", "held", "restored")


@query(
    f"""WITH kept AS (SELECT * FROM {SCORES} QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY idx DESC, event_id DESC) <= 400),
placed AS (SELECT *, row_number() OVER (ORDER BY idx DESC, event_id DESC) AS place, sum(score) OVER (ORDER BY idx DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS until FROM kept)
SELECT event_id, event_type FROM placed WHERE place <= 1000 AND until <= 30000.005"""
)
def spool_class_cap(spark, sf_dir):
    kept = corpus.within_caps(lenses.scores(spark, sf_dir), "event_type", ["idx", "event_id"], "score", 400, 1000, 30000.005)
    return kept.select("event_id", "event_type")


_FRACTION = "CAST(('0x' || substr(sha256('7:' || CAST({key} AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967295.0"


@query(
    f"SELECT coalesce(kind, 'dropped') AS kind, count(*) AS n FROM (SELECT CASE WHEN score >= {DETECT} THEN 'detection' WHEN score >= {MINE} THEN 'near_threshold' WHEN {_FRACTION.format(key='event_id')} < 0.1 THEN 'below_threshold' END AS kind FROM {SCORES}) GROUP BY ALL"
)
def sampling_class_counts(spark, sf_dir):
    kind = detection.sampling_class(F.col("score"), N.stable_fraction(F.col("event_id"), 7), DETECT, MINE, 0.1)
    return lenses.scores(spark, sf_dir).groupBy(F.coalesce(kind, F.lit("dropped")).alias("kind")).agg(F.count("*").alias("n"))


@query(f"SELECT event_type, t AS threshold, count(*) FILTER (WHERE score >= t) AS n_hits FROM {SCORES}, (SELECT unnest([50.0, 100.0, 150.0, 200.0]::DOUBLE[]) AS t) GROUP BY ALL")
def threshold_sweep(spark, sf_dir):
    return detection.threshold_sweep(lenses.scores(spark, sf_dir), "score", [50, 100, 150, 200], ["event_type"])


@query(f"SELECT event_type, percentile_cont AS p50, p95 FROM (SELECT event_type, quantile_cont(score, 0.5) AS percentile_cont, quantile_cont(score, 0.95) AS p95 FROM {SCORES} GROUP BY event_type)")
def percentiles(spark, sf_dir):
    return lenses.scores(spark, sf_dir).groupBy("event_type").agg(N.percentile(F.col("score"), 0.5).alias("p50"), N.percentile(F.col("score"), 0.95).alias("p95"))


@query(f"SELECT event_type, list_sort(list(score))[count(*) // 2 + 1] AS middle FROM {SCORES} GROUP BY event_type")
def upper_medians(spark, sf_dir):
    return N.upper_medians(lenses.scores(spark, sf_dir), ["event_type"], "score", "middle")


@query(f"SELECT event_type AS variant, avg(e) AS mean_error, quantile_cont(e, 0.5) AS p50, quantile_cont(e, 0.95) AS p95, count(*) FILTER (WHERE e = 0) AS n_exact FROM (SELECT event_type, floor(score / 100) AS e FROM {SCORES}) GROUP BY event_type")
def variant_summary(spark, sf_dir):
    phrases = lenses.scores(spark, sf_dir).select(F.col("event_type").alias("variant"), F.floor(F.col("score") / 100).cast("double").alias("e"))
    return evaluation.variant_summary(phrases, "variant", "e")


@query(f"SELECT event_type, greatest(-12.0, least(24.0, quantile_cont(50.0 - score, 0.5)))::DOUBLE AS gain FROM {SCORES} GROUP BY event_type")
def gain_recommendation(spark, sf_dir):
    return lenses.scores(spark, sf_dir).groupBy("event_type").agg(evaluation.gain_recommendation(F.col("score"), 50.0).alias("gain"))


# -- corpus -----------------------------------------------------------------------------------


@query(f"SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'holdout' WHEN {_FRACTION.format(key='doc_id')} < 0.15 THEN 'eval' ELSE 'train' END AS split FROM (SELECT DISTINCT doc_id FROM labels)")
def session_split(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return corpus.assign_splits(labels, "doc_id", 7, 0.15, labels.where("doc_id % 17 = 0"))


@query(
    f"""WITH stored AS (SELECT DISTINCT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'eval' ELSE 'train' END AS split FROM labels WHERE doc_id % 2 = 0),
ids AS (SELECT DISTINCT doc_id FROM labels)
SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'holdout' ELSE coalesce(s.split, CASE WHEN {_FRACTION.format(key='doc_id')} < 0.15 THEN 'eval' ELSE 'train' END) END AS split FROM ids LEFT JOIN stored s USING (doc_id)"""
)
def split_merge(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id").distinct()
    stored = labels.where("doc_id % 2 = 0").withColumn("split", F.when(F.col("doc_id") % 3 == 0, "eval").otherwise("train"))
    return corpus.merge_splits(stored, labels, "doc_id", 7, 0.15, labels.where("doc_id % 17 = 0"))


@query("SELECT text FROM (SELECT DISTINCT text FROM documents WHERE doc_id % 5 <> 0) INTERSECT SELECT text FROM documents WHERE doc_id % 5 = 0")
def split_leak_check(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return corpus.leaking(docs.where("doc_id % 5 <> 0"), docs.where("doc_id % 5 = 0"), "text")


@query("SELECT doc_id, source FROM documents WHERE source NOT IN (SELECT DISTINCT source FROM documents WHERE doc_id % 97 = 0)")
def holdout_anti(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return corpus.without(docs, docs.where("doc_id % 97 = 0"), "source").select("doc_id", "source")


_HASHED = "(SELECT d.doc_id, sha256(d.text) AS digest, source || '/' || lpad(CAST(d.doc_id AS VARCHAR), 9, '0') AS path, CASE l.quality WHEN 1 THEN 'positive' WHEN 0 THEN 'negative' END AS label, d.doc_id % 13 = 0 AS pinned FROM documents d LEFT JOIN labels l USING (doc_id))"


def _hashed(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    path = F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"))
    label = F.when(F.col("quality") == 1, "positive").when(F.col("quality") == 0, "negative")
    return docs.join(labels, "doc_id", "left").select("doc_id", F.sha2("text", 256).alias("digest"), path.alias("path"), label.alias("label"), (F.col("doc_id") % 13 == 0).alias("pinned"))


_ENTRIES = "(SELECT p_partkey, sha256(p_name || p_brand) AS digest, CASE WHEN p_size % 5 > 0 THEN CASE WHEN p_size % 9 = 0 THEN 'positive' ELSE 'negative' END END AS label FROM part)"


@query(f"SELECT p_partkey, digest, label FROM {_ENTRIES} WHERE digest IN (SELECT digest FROM {_ENTRIES} WHERE label IS NOT NULL GROUP BY digest HAVING count(DISTINCT label) > 1)")
def label_conflicts(spark, sf_dir):
    label = F.when(F.col("p_size") % 5 > 0, F.when(F.col("p_size") % 9 == 0, "positive").otherwise("negative"))
    entries = table(spark, sf_dir, "part").select("p_partkey", F.sha2(F.concat("p_name", "p_brand"), 256).alias("digest"), label.alias("label"))
    return corpus.label_conflicts(entries, "digest", "label").select("p_partkey", "digest", "label")


@query(f"SELECT doc_id, path, retained_copy FROM (SELECT *, first_value(path) OVER (PARTITION BY digest ORDER BY NOT pinned, path) AS retained_copy FROM {_HASHED}) WHERE path <> retained_copy AND NOT pinned")
def duplicate_priority(spark, sf_dir):
    return corpus.duplicates(_hashed(spark, sf_dir), "digest", "path", F.col("pinned")).select("doc_id", "path", "retained_copy")


@query(f"SELECT coalesce(label, 'unknown') AS label, count(*) AS n, count(DISTINCT digest) AS n_distinct, count(*) FILTER (WHERE pinned) AS n_pinned FROM {_HASHED} GROUP BY ALL")
def inventory_counts(spark, sf_dir):
    return _hashed(spark, sf_dir).groupBy(F.coalesce("label", F.lit("unknown")).alias("label")).agg(F.count("*").alias("n"), F.countDistinct("digest").alias("n_distinct"), F.count_if("pinned").alias("n_pinned"))


@query("SELECT count(*) FILTER (WHERE quality = 1) AS available, count(*) FILTER (WHERE quality = 0) AS missing, count(*) FILTER (WHERE quality IS NULL) AS unknown FROM documents LEFT JOIN labels USING (doc_id)")
def capture_quality_counts(spark, sf_dir):
    both = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return both.agg(F.count_if(F.col("quality") == 1).alias("available"), F.count_if(F.col("quality") == 0).alias("missing"), F.count_if(F.col("quality").isNull()).alias("unknown"))


@query(f"SELECT event_type, rank, event_id, score FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY score DESC, event_id) AS rank FROM {SCORES}) WHERE rank <= 15")
def top_per_class(spark, sf_dir):
    top = corpus.top_per_class(lenses.scores(spark, sf_dir), "event_type", "score", "event_id", 15)
    return top.select("event_type", F.col("rank").cast("long").alias("rank"), "event_id", "score")


@query(f"SELECT count(*) AS n, count(*) FILTER (WHERE score >= {DETECT}) AS n_fired, count(*) FILTER (WHERE score >= {MINE} AND score < {DETECT}) AS n_near, count(event_type) AS n_labelled, min(score) AS least, max(score) AS most, quantile_cont(score, 0.5) AS middle FROM {SCORES}")
def spool_summary(spark, sf_dir):
    s = F.col("score")
    return corpus.spool_summary(lenses.scores(spark, sf_dir), s >= DETECT, (s >= MINE) & (s < DETECT), "event_type", "score")


@query(f"SELECT CASE WHEN score >= {DETECT} THEN CASE WHEN event_type = 'purchase' THEN 'wake' ELSE 'false_positive' END WHEN event_type = 'purchase' THEN 'missed_wake' ELSE 'near_miss' END AS kind, count(*) AS n FROM {SCORES} GROUP BY ALL")
def fired_said_matrix(spark, sf_dir):
    kind = corpus.fired_said(F.col("score") >= DETECT, F.col("event_type") == "purchase")
    return lenses.scores(spark, sf_dir).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


_PHRASE, _TERMS = "OF THE", ["OTHER OF", "OF", "THEN", "THERE", "AND"]
_TERM = r"\b(" + "|".join(_TERMS) + r")\b"


@query(
    f"""SELECT doc_id, CASE WHEN regexp_matches(u, '\\b{_PHRASE}\\b') THEN 'excluded' WHEN regexp_matches(u, '{_TERM}') THEN 'hard_negative' ELSE 'false_positive' END AS kind,
CASE WHEN regexp_matches(u, '\\b{_PHRASE}\\b') THEN '{_PHRASE}' ELSE array_to_string(list_sort(list_distinct(regexp_extract_all(u, '{_TERM}'))), ',') END AS terms
FROM (SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')) AS u FROM documents)"""
)
def transcript_classes(spark, sf_dir):
    plain = F.regexp_replace("text", "[^A-Za-z]+", " ")
    kind, terms = corpus.transcript_class(plain, _PHRASE, _TERMS), corpus.transcript_terms(plain, _PHRASE, _TERMS)
    return table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"), F.array_join(terms, ",").alias("terms"))


@query("SELECT doc_id, source FROM documents ORDER BY sha256('v1|' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 250")
def seeded_sample(spark, sf_dir):
    return corpus.sample_by_hash(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", "v1", 250)


@query(
    """WITH allowed AS (SELECT greatest(CAST(floor(count(*) * 0.1) AS BIGINT), 1) AS n FROM labels)
SELECT doc_id FROM labels WHERE quality <> 0 UNION ALL SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM labels WHERE quality = 0), allowed WHERE r <= n"""
)
def weak_negative_cap(spark, sf_dir):
    return corpus.capped_weak(table(spark, sf_dir, "labels").select("doc_id", "quality"), F.col("quality") == 0, "doc_id", 0.1).select("doc_id")


_NORMAL = r"""regexp_replace(regexp_replace(trim(regexp_replace(lower(replace(text, '’', '''')), '[^a-z0-9]+', ' ', 'g')), '^(?:(?:please|can you|could you|tell me) )+', ''), '(?: for me)+$', '')"""


@query(f"SELECT doc_id FROM documents WHERE {_NORMAL} NOT IN (SELECT {_NORMAL} FROM benchmark)")
def contamination_anti(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", X.normalize_utterance(F.col("text")).alias("plain"))
    known = table(spark, sf_dir, "benchmark").select(X.normalize_utterance(F.col("text")).alias("plain"))
    return corpus.without(docs, known, "plain").select("doc_id")


@query(f"SELECT source, min(doc_id) AS doc_id, count(*) AS n FROM (SELECT *, {_NORMAL} AS plain FROM documents) GROUP BY source, plain")
def normalized_dups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(X.normalize_utterance(F.col("text")), 256).alias("plain"))
    n = docs.groupBy("source", "plain").agg(F.count("*").alias("n"))
    return corpus.first_seen(docs, ["source", "plain"], "doc_id").join(n, ["source", "plain"]).select("source", "doc_id", "n")


@query("SELECT l_orderkey, sha256(string_agg(d, '' ORDER BY d)) AS fingerprint FROM (SELECT l_orderkey, sha256(l_partkey || chr(31) || l_suppkey || chr(31) || l_linenumber) AS d FROM lineitem) GROUP BY l_orderkey")
def fingerprint_order_free(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(N.fingerprint([F.col(c) for c in ("l_partkey", "l_suppkey", "l_linenumber")]).alias("fingerprint"))


# -- evaluation -------------------------------------------------------------------------------

_RESULTS = """(SELECT o_orderkey AS case_id, c_mktsegment AS category, CASE o_orderstatus WHEN 'O' THEN 'action' WHEN 'P' THEN 'clarification' ELSE 'refusal' END AS expected_type,
CASE o_orderkey % 10 WHEN 0 THEN 'malformed_output' WHEN 1 THEN 'unknown_tool' WHEN 2 THEN 'invalid_arguments' ELSE 'correct' END AS outcome, o_orderkey % 10 > 2 AS passed, o_orderkey % 3 AS n_calls,
list_filter([CASE WHEN o_totalprice > 400000 THEN 'transport_error' END, CASE WHEN o_orderpriority LIKE '1%' THEN 'unsafe_action' END], lambda x: x IS NOT NULL) AS flags
FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _ratio(part: str, whole: str) -> str:
    return f"coalesce(count(*) FILTER (WHERE ({whole}) AND ({part})) / nullif(count(*) FILTER (WHERE {whole}), 0), 0.0)"


_ACTS, _QUIET = "expected_type IN ('action', 'status')", "expected_type IN ('clarification', 'refusal')"
_SUMMARY = f"""SELECT count(*) AS total, count(*) FILTER (WHERE passed) AS passed, {_ratio('passed', 'true')} AS overall_pass_rate, {_ratio('passed', _ACTS)} AS action_execution_accuracy, {_ratio('n_calls > 0', _QUIET)} AS false_action_rate,
{_ratio('passed', "expected_type = 'clarification'")} AS clarification_accuracy, {_ratio('passed', "expected_type = 'refusal'")} AS refusal_accuracy,
{_ratio("outcome = 'malformed_output'", 'true')} AS malformed_output_rate, {_ratio("outcome = 'unknown_tool'", 'true')} AS unknown_tool_rate, {_ratio("outcome = 'invalid_arguments'", 'true')} AS invalid_argument_rate FROM {_RESULTS}"""


@query(_SUMMARY)
def eval_summary(spark, sf_dir):
    return evaluation.summarize(lenses.results(spark, sf_dir))


@query(f"SELECT category, count(*) AS n, {_ratio('passed', 'true')} AS pass_rate FROM {_RESULTS} GROUP BY category")
def category_pass_rate(spark, sf_dir):
    return evaluation.category_rates(lenses.results(spark, sf_dir))


@query(f"SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM {_RESULTS} UNION ALL SELECT 'malformed_treated_as_abstention' FROM {_RESULTS} WHERE passed AND outcome = 'malformed_output') GROUP BY flag")
def flag_histogram(spark, sf_dir):
    return evaluation.flag_counts(lenses.results(spark, sf_dir))


_GATES = [("min_overall", "overall_pass_rate", 0.9), ("category_min", "BUILDING", 0.7), ("category_min", "MACHINERY", 0.5), ("category_min", "ABSENT", 0.1), ("max_rate", "false_action_rate", 0.5), ("max_rate", "unknown_tool_rate", 0.2), ("zero_flag", "unsafe_action", 0.0), ("zero_flag", "never_seen", 0.0)]


@query(
    f"""WITH gates(kind, key, bound) AS (VALUES {', '.join(f"('{k}', '{n}', {b}::DOUBLE)" for k, n, b in _GATES)}), summary AS ({_SUMMARY}),
rates AS (UNPIVOT (SELECT COLUMNS('.*_(rate|accuracy)')::DOUBLE FROM summary) ON COLUMNS(*) INTO NAME key VALUE value),
vals AS (SELECT 'min_overall' AS kind, key, value FROM rates WHERE key = 'overall_pass_rate' UNION ALL SELECT 'max_rate', key, value FROM rates
UNION ALL SELECT 'category_min', category, {_ratio('passed', 'true')}::DOUBLE FROM {_RESULTS} GROUP BY category
UNION ALL SELECT 'zero_flag', flag, count(*)::DOUBLE FROM (SELECT unnest(flags) AS flag FROM {_RESULTS}) GROUP BY flag)
SELECT kind, key, bound, value FROM gates LEFT JOIN vals USING (kind, key) WHERE (kind IN ('min_overall', 'category_min') AND value < bound) OR (kind = 'category_min' AND value IS NULL) OR (kind = 'max_rate' AND value > bound) OR (kind = 'zero_flag' AND value > 0)"""
)
def gate_failures(spark, sf_dir):
    results = lenses.results(spark, sf_dir)
    gates = spark.createDataFrame(_GATES, "kind string, key string, bound double")
    return evaluation.failed_gates(evaluation.summarize(results), evaluation.category_rates(results), evaluation.flag_counts(results), gates)


@query(f"SELECT * EXCLUDE (flags) FROM {_RESULTS} WHERE category = 'BUILDING' AND list_contains(flags, 'unsafe_action')")
def case_select(spark, sf_dir):
    return evaluation.select_cases(lenses.results(spark, sf_dir).withColumnRenamed("flags", "tags"), category="BUILDING", tag="unsafe_action").drop("tags")


@query(f"SELECT pos, case_id, category FROM {_RESULTS} JOIN (SELECT DISTINCT l_orderkey AS case_id, l_orderkey * 7 % 1000 AS pos FROM lineitem WHERE l_orderkey % 11 = 0) USING (case_id)")
def suite_lookup(spark, sf_dir):
    suite = table(spark, sf_dir, "lineitem").where("l_orderkey % 11 = 0").select(F.col("l_orderkey").alias("case_id"), (F.col("l_orderkey") * 7 % 1000).alias("pos")).distinct()
    return evaluation.select_cases(lenses.results(spark, sf_dir), suite).select("pos", "case_id", "category")


@query("SELECT label, min(p_partkey) AS p_partkey FROM (SELECT lower(p_name || ' ' || p_brand || ' ' || p_size) AS label, p_partkey FROM part) GROUP BY label HAVING count(DISTINCT p_partkey) = 1")
def unique_owner_ids(spark, sf_dir):
    label = F.lower(F.concat_ws(" ", "p_name", "p_brand", F.col("p_size").cast("string")))
    return evaluation.unique_owners(table(spark, sf_dir, "part").withColumn("label", label), "label", "p_partkey")


@query("SELECT label, min(p_brand) AS p_brand, min(p_type) AS p_type FROM (SELECT DISTINCT lower(p_name) || '/' || p_size AS label, p_brand, p_type FROM part) GROUP BY label HAVING count(*) = 1")
def unique_owner_pairs(spark, sf_dir):
    label = F.concat(F.lower("p_name"), F.lit("/"), F.col("p_size").cast("string"))
    return evaluation.unique_owners(table(spark, sf_dir, "part").withColumn("label", label), "label", "p_brand", "p_type")


@query("SELECT c_name AS label, min(c_custkey) AS c_custkey FROM customer GROUP BY c_name HAVING count(*) = 1")
def unique_owner_names(spark, sf_dir):
    return evaluation.unique_owners(table(spark, sf_dir, "customer").withColumn("label", F.col("c_name")), "label", "c_custkey")


@query("SELECT lower(p_name) AS label, arg_min(p_brand, p_partkey) AS p_brand FROM part GROUP BY lower(p_name)")
def first_owner_labels(spark, sf_dir):
    return evaluation.first_owners(table(spark, sf_dir, "part").withColumn("label", F.lower("p_name")), "label", "p_brand", "p_partkey")


@query(
    """WITH e AS (SELECT l_orderkey AS case_id, l_partkey % 50 AS item, count(*) AS e FROM lineitem GROUP BY ALL), a AS (SELECT l_orderkey + 1 AS case_id, l_partkey % 50 AS item, count(*) AS a FROM lineitem GROUP BY ALL),
b AS (SELECT case_id, coalesce(e, 0) AS e, coalesce(a, 0) AS a FROM e FULL JOIN a USING (case_id, item)),
s AS (SELECT case_id, sum(least(e, a))::BIGINT AS n_matched, sum(greatest(e - a, 0))::BIGINT AS n_missing, sum(greatest(a - e, 0))::BIGINT AS n_unexpected FROM b GROUP BY case_id)
SELECT *, n_missing = 0 AND n_unexpected = 0 AS equal FROM s"""
)
def bag_equality(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), (F.col("l_partkey") % 50).alias("item"))
    return evaluation.bag_comparison(lines, lines.withColumn("case_id", F.col("case_id") + 1), "case_id", "item")


_QUALIFY = "CASE WHEN n % 11 = 0 OR recall + 1e-9 < 0.55 OR fa > least(1.0, 0.02) + 1e-9 THEN 'rejected' WHEN n < 160 OR hours < 150 OR fa > 0.02 THEN 'insufficient_evidence' WHEN recall <= 0.58 THEN 'evaluated' ELSE 'qualified' END"
_GROUPS = "SELECT o_custkey % 400 AS candidate, count(*) AS n, avg((o_orderkey % 10 > 3)::INT) AS recall, sum(o_totalprice) / 3600.0 AS hours, count(*) FILTER (WHERE o_totalprice > 480000) / (sum(o_totalprice) / 3600.0) AS fa FROM orders GROUP BY ALL"


@query(f"SELECT candidate, {_QUALIFY} AS status FROM ({_GROUPS})")
def qualification_status(spark, sf_dir):
    orders, price = table(spark, sf_dir, "orders"), F.col("o_totalprice")
    groups = orders.groupBy((F.col("o_custkey") % 400).alias("candidate")).agg(
        F.count("*").alias("n"), F.avg((F.col("o_orderkey") % 10 > 3).cast("int")).alias("recall"), F.sum(price).alias("seconds"), F.count_if(price > 480000).alias("false")
    )
    c = {"stopped": F.col("n") % 11 == 0, "empty": F.col("n") == 0, "recall": F.col("recall"), "baseline_recall": F.lit(0.55), "fa_per_hour": N.per_hour(F.col("false"), F.col("seconds")), "baseline_fa": F.lit(1.0), "late": F.lit(False), "failed": F.lit(0), "feasible": F.col("n") >= 160, "background_seconds": F.col("seconds")}
    status = evaluation.qualification(c)
    better = F.when((status == "qualified") & (F.col("recall") <= 0.58), "evaluated").otherwise(status)
    return groups.select("candidate", better.alias("status"))


# -- lexical ----------------------------------------------------------------------------------


@query("SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 4 = 0 THEN 'own' END, n_name) AS resolved_area FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def area_chain(spark, sf_dir):
    entities = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 4 == 0, "own").alias("own"), F.col("s_nationkey").alias("n_nationkey"))
    return lexical.chained_area(entities, table(spark, sf_dir, "nation"), "own", "n_nationkey", "n_name").select("s_suppkey", "resolved_area")


_TOKENS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
_PADDED = "' ' || array_to_string(" + _TOKENS + ", ' ') || ' '"


@query(
    f"""WITH labels AS (SELECT DISTINCT t[1] AS label, t[2] AS domain FROM (SELECT [w, d] AS t FROM (SELECT unnest(['the', 'of', 'der', 'die', 'la', 'is the', 'of the', 'in der']) AS w, unnest(['light', 'fan', 'light', 'cover', 'lock', 'fan', 'scene', 'todo']) AS d))),
hits AS (SELECT DISTINCT doc_id, domain FROM documents, labels WHERE contains({_PADDED.format('text')}, ' ' || label || ' ')),
s AS (SELECT doc_id, count(*) AS n, min(domain) AS a, count(*) FILTER (WHERE domain IN ('light', 'fan', 'cover', 'lock')) AS k, min(domain) FILTER (WHERE domain IN ('light', 'fan', 'cover', 'lock')) AS b FROM hits GROUP BY doc_id)
SELECT doc_id, CASE WHEN n = 1 THEN a WHEN k = 1 THEN b END AS domain_hint FROM s"""
)
def domain_hint(spark, sf_dir):
    labels = [("the", "light"), ("of", "fan"), ("der", "light"), ("die", "cover"), ("la", "lock"), ("is the", "fan"), ("of the", "scene"), ("in der", "todo")]
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("utterance"))
    matches = lexical.phrase_matches(docs, spark.createDataFrame(labels, "label string, domain string"), "doc_id")
    return lexical.domain_hints(matches, "doc_id", "domain", ["light", "fan", "cover", "lock"])


@query(
    """WITH current AS (SELECT conv_id, max(turn) AS cur FROM conversations WHERE role = 'user' GROUP BY conv_id),
before AS (SELECT c.*, cur FROM conversations c JOIN current USING (conv_id) WHERE turn < cur),
reply AS (SELECT conv_id, max(turn) AS rt, regexp_matches(trim(arg_max(text, turn)), '[?;？]$') AS asks FROM before WHERE role = 'assistant' GROUP BY conv_id),
earlier AS (SELECT b.conv_id, max(turn) AS et FROM before b JOIN reply r ON b.conv_id = r.conv_id WHERE role = 'user' AND turn < rt GROUP BY b.conv_id),
starts AS (SELECT conv_id, CASE WHEN coalesce(asks, false) THEN coalesce(et, rt) ELSE cur END AS start FROM current LEFT JOIN reply USING (conv_id) LEFT JOIN earlier USING (conv_id))
SELECT conv_id, turn, role FROM conversations LEFT JOIN starts USING (conv_id) WHERE start IS NULL OR turn >= start OR role = 'system'"""
)
def history_slice(spark, sf_dir):
    return lexical.history(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role")


_RANKED = "(SELECT p_brand AS k, p_name AS name, max(p_retailprice / 2100.0) AS s FROM part GROUP BY ALL)"


@query(
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s DESC, name) AS r FROM {_RANKED}), t AS (SELECT k, max(name) FILTER (WHERE r = 1) AS n1, max(s) FILTER (WHERE r = 1) AS s1, max(name) FILTER (WHERE r = 2) AS n2, max(s) FILTER (WHERE r = 2) AS s2 FROM r WHERE r <= 2 GROUP BY k)
SELECT k, CASE WHEN s1 >= 0.5 AND (s2 IS NULL OR s1 - s2 >= 0.1) THEN n1 WHEN s1 >= 0.5 AND s2 >= 0.5 THEN n1 || '|' || n2 END AS chosen FROM t"""
)
def clarify_options(spark, sf_dir):
    options = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("k"), F.col("p_name").alias("name")).agg(F.max(F.col("p_retailprice") / 2100.0).alias("s"))
    return lexical.best_two(options, "k", "name", "s")


@query("SELECT p_brand AS k, CASE WHEN count(*) = 1 THEN min(p_name) END AS best FROM (SELECT p_brand, p_name, p_size, max(p_size) OVER (PARTITION BY p_brand) AS m FROM part) WHERE p_size = m GROUP BY p_brand")
def strict_best_option(spark, sf_dir):
    return lexical.strict_best(table(spark, sf_dir, "part").select(F.col("p_brand").alias("k"), "p_name", "p_size"), "k", "p_name", "p_size")


@query("WITH RECURSIVE e AS (SELECT p_partkey AS child, p_partkey // 2 AS parent FROM part WHERE p_partkey > 1), c AS (SELECT child, parent FROM e UNION SELECT c.child, e.parent FROM c JOIN e ON c.parent = e.child) SELECT child, parent FROM c")
def dependency_closure(spark, sf_dir):
    edges = table(spark, sf_dir, "part").where("p_partkey > 1").select(F.col("p_partkey").alias("child"), F.expr("p_partkey DIV 2").alias("parent"))
    return lexical.closure(edges, "child", "parent")


@query(
    """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\\s]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\\s]+'), 1) AS pos FROM documents),
n AS (SELECT *, regexp_replace(lower(word), '[^a-z'']', '', 'g') AS p FROM w), l AS (SELECT *, lead(p) OVER (PARTITION BY doc_id ORDER BY pos) AS q FROM n)
SELECT doc_id, pos AS span_start, pos + 2 AS span_end FROM l WHERE p = 'of' AND q = 'the'"""
)
def phrase_spans(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^\s]+"), F.lit(0))).alias("p", "word"))
    words = words.withColumn("pos", (F.col("p") + 1).cast("long")).withColumn("end", F.col("pos") + 1)
    return lexical.phrase_spans(words, "doc_id", "pos", "word", "pos", "end", ["of", "the"])


_PLAIN = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


def _paired(spark, sf_dir):
    """Each document with a text of the benchmark, whose items take turns."""
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("other"))
    size = F.broadcast(bench.agg(F.count("*").alias("size")))
    return docs.crossJoin(size).join(bench, F.col("doc_id") % F.col("size") == F.col("item_id")).select("doc_id", "text", "other")


@query(f"SELECT doc_id, CASE WHEN length(a) = 0 THEN CASE WHEN length(b) = 0 THEN 0.0 ELSE 1.0 END ELSE levenshtein(a, b) / length(a) END AS cer FROM (SELECT doc_id, {_PLAIN.format('d.text')} AS a, {_PLAIN.format('b.text')} AS b FROM documents d JOIN benchmark b ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id)")
def cer(spark, sf_dir):
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    pairs = _paired(spark, sf_dir).select("doc_id", plain("text").alias("a"), plain("other").alias("b"))
    return evaluation.error_rates(pairs, "doc_id", "a", "b", "cer")


@query()
def wer(spark, sf_dir):
    pairs = _paired(spark, sf_dir).select("doc_id", X.tokens(F.col("text")).alias("a"), X.tokens(F.col("other")).alias("b"))
    return evaluation.error_rates(pairs, "doc_id", "a", "b", "wer")


@query(
    """WITH t AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w, lead(regexp_extract_all(lower(text), '[a-z0-9'']+')) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
SELECT conv_id, turn, len(w) > 0 AND NOT coalesce(list_contains(n[1:2], w[1]), false) AS missing FROM t"""
)
def missing_first_word(spark, sf_dir):
    from pyspark.sql import Window

    w = X.tokens(F.col("text"), True)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", w.alias("w"), F.lead(w).over(Window.partitionBy("conv_id").orderBy("turn")).alias("n"))
    return turns.select("conv_id", "turn", X.missing_first_word(F.col("w"), F.col("n")).alias("missing"))


# -- vectors and properties -------------------------------------------------------------------


@query("SELECT label, pos, avg(x) AS mean, stddev_pop(x) AS deviation FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY label, pos")
def embedding_pool(spark, sf_dir):
    each = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("p", "x"))
    return each.groupBy("label", F.col("p").cast("long").alias("pos")).agg(F.avg(F.col("x").cast("double")).alias("mean"), F.stddev_pop(F.col("x").cast("double")).alias("deviation"))


@query("SELECT vec_id, round(CASE WHEN z >= 0 THEN 1 / (1 + exp(-z)) ELSE exp(z) / (1 + exp(z)) END, 9) AS score FROM (SELECT vec_id, list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * (i % 5 - 2))) AS z FROM embeddings)")
def logistic_score(spark, sf_dir):
    z = F.aggregate(F.transform("embedding", lambda x, i: x.cast("double") * ((i + 1) % 5 - 2)), F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(N.sigmoid(z), 9).alias("score"))


@query("SELECT user_id, round(1 / (1 + exp(-avg(ln(p / (1 - p))))), 9) AS by_logit, round(avg(p), 9) AS by_mean FROM (SELECT user_id, (value + 1) / 600 AS p FROM events) GROUP BY user_id")
def ensemble_logit(spark, sf_dir):
    """A sum of doubles depends on its order: each user's are added up event by event, whatever tasks the table is cut into."""
    from pyspark.sql import Window

    p = table(spark, sf_dir, "events").select("user_id", "event_id", ((F.col("value") + 1) / 600).alias("p"))
    order = Window.partitionBy("user_id").orderBy("event_id", "p")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    means = p.select("user_id", F.avg(N.logit(F.col("p"))).over(so_far).alias("logit"), F.avg("p").over(so_far).alias("mean"), F.lead(F.lit(True)).over(order).isNull().alias("last"))
    return means.where("last").select("user_id", F.round(N.sigmoid(F.col("logit")), 9).alias("by_logit"), F.round("mean", 9).alias("by_mean"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)), 9) AS rms, round(greatest(20 * log10(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding))), -120.0), 6) AS level FROM embeddings")
def signal_levels(spark, sf_dir):
    level = N.rms(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(level, 9).alias("rms"), F.round(N.decibels(level), 6).alias("level"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT b.bin, count(*) AS n, avg((value >= 150)::INT) AS hit_rate FROM events, (VALUES (0, 0.0, 25.0), (1, 25.0, 75.0), (2, 75.0, 150.0), (3, 150.0, 1e300)) b(bin, lo, hi) WHERE value >= lo AND value < hi GROUP BY b.bin")
def threshold_bins(spark, sf_dir):
    v = F.col("value")
    which = F.when((v >= 0) & (v < 25), 0).when((v >= 25) & (v < 75), 1).when((v >= 75) & (v < 150), 2).when(v >= 150, 3)
    return table(spark, sf_dir, "events").where(which.isNotNull()).groupBy(which.alias("bin")).agg(F.count("*").alias("n"), F.avg((v >= 150).cast("int")).alias("hit_rate"))


# -- calls and catalogues ---------------------------------------------------------------------


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'unknown_tool' WHEN l_quantity > 45 THEN 'unexpected_argument'
WHEN l_returnflag = 'N' AND l_quantity < 5 THEN 'missing_argument' WHEN l_quantity >= 5 AND l_linestatus NOT IN ('O') AND l_returnflag = 'N' THEN 'invalid_value' END AS violation FROM lineitem"""
)
def contract_check(spark, sf_dir):
    lines, none = table(spark, sf_dir, "lineitem"), F.create_map().cast("map<string,string>")
    q = F.col("l_quantity")
    args = F.map_concat(F.create_map(F.lit("level"), q.cast("string")), F.when(q >= 5, F.create_map(F.lit("mode"), F.col("l_linestatus"))).otherwise(none), F.when(q > 45, F.create_map(F.lit("extra"), F.lit("1"))).otherwise(none))
    calls = lines.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("tool"), args.alias("args"))
    tools = spark.createDataFrame([("A", ["level", "mode"], ["level"], {}), ("N", ["level", "mode"], ["level", "mode"], {"mode": ["O"]})], "tool string, allowed array<string>, required array<string>, choices map<string,array<string>>")
    return contracts.first_violation(calls, tools).select("l_orderkey", "l_linenumber", "violation")


@query("SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN 'set_' || p_size END AS name, CASE WHEN p_size % 7 <> 0 THEN 'name,size,shift' END AS keys, CASE WHEN p_size % 7 <> 0 THEN p_name || ',' || p_size || ',-' || p_partkey END AS vals FROM part")
def call_parse(spark, sf_dir):
    text = F.concat(F.lit("set_"), F.col("p_size").cast("string"), F.lit("(name='"), F.col("p_name"), F.lit("', size="), F.col("p_size").cast("string"), F.lit(", shift=-"), F.col("p_partkey").cast("string"), F.lit(")"))
    part = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 7 == 0, F.col("p_name")).otherwise(text).alias("t"))
    call = contracts.parse_call(F.col("t"))
    return part.select("p_partkey", call["name"].alias("name"), F.array_join(call["keys"], ",").alias("keys"), F.array_join(call["values"], ",").alias("vals"))


@query("""SELECT p_partkey, '{"brand":"' || p_brand || '","name":"' || p_name || '","size":"' || p_size || '"}' AS json FROM part""")
def canonical_json(spark, sf_dir):
    fields = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", contracts.canonical_json(fields).alias("json"))


@query("SELECT p_brand, string_agg(line, chr(10) ORDER BY line) AS lines FROM (SELECT DISTINCT p_brand, p_name || CASE WHEN p_type = p_name THEN '' ELSE ', ' || p_type END AS line FROM part WHERE p_size NOT IN (1, 2)) GROUP BY p_brand")
def exposed_entities(spark, sf_dir):
    entities = table(spark, sf_dir, "part").select("p_brand", F.col("p_name").alias("name"), F.array("p_type").alias("aliases"), F.col("p_size").cast("string").alias("domain"))
    return contracts.exposed(entities, ["1", "2"], "p_brand")


@query(
    """WITH o(tool, offer) AS (VALUES ('a', 'always'), ('b', 'domain:BUILDING'), ('c', 'domains:MACHINERY,FURNITURE'), ('d', 'todo')),
h AS (SELECT c_nationkey, list(DISTINCT c_mktsegment) AS ds FROM customer GROUP BY c_nationkey)
SELECT c_nationkey, tool FROM h, o WHERE offer = 'always' OR (offer = 'domain:BUILDING' AND list_contains(ds, 'BUILDING')) OR (offer LIKE 'domains:%' AND (list_contains(ds, 'MACHINERY') OR list_contains(ds, 'FURNITURE')))"""
)
def offered_tools(spark, sf_dir):
    homes = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.collect_set("c_mktsegment").alias("domains"))
    tools = [("a", "always"), ("b", "domain:BUILDING"), ("c", "domains:MACHINERY,FURNITURE"), ("d", "todo")]
    each = homes.withColumn("t", F.explode(F.array(*(F.struct(F.lit(t).alias("tool"), F.lit(o).alias("offer")) for t, o in tools))))
    return each.where(contracts.offered(F.col("t.offer"), F.col("domains"))).select("c_nationkey", F.col("t.tool").alias("tool"))


@query(
    f"""WITH t AS (SELECT unnest(['Turn on the {{name}}', 'please turn on the {{name}}', 'Is the {{name}} on for me?']) AS template),
m AS (SELECT p_brand, p_partkey, template, replace(template, '{{name}}', p_name) AS utterance FROM part, t), n AS (SELECT *, {_NORMAL.replace('replace(text', 'replace(utterance')} AS plain FROM m),
f AS (SELECT p_brand, plain, arg_min(utterance, (p_partkey, template)) AS utterance, arg_min(p_partkey, (p_partkey, template)) AS p_partkey FROM n GROUP BY ALL)
SELECT p_brand, p_partkey, utterance FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY sha256('v1|' || plain)) AS place FROM f WHERE plain NOT IN (SELECT {_NORMAL} FROM benchmark)) WHERE place <= 20"""
)
def generated_cases(spark, sf_dir):
    entities = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_name").alias("name"))
    templates = ["Turn on the {name}", "please turn on the {name}", "Is the {name} on for me?"]
    return contracts.generate_cases(entities, templates, table(spark, sf_dir, "benchmark"), "p_brand", "p_partkey", "v1", 20)


# -- more of evaluation -----------------------------------------------------------------------


@query(f"SELECT event_id AS case_id, score * 16 / 16000 * 1000.0 > 40 + 50.0 AS late FROM {SCORES} WHERE event_type <> 'view'")
def voice_timing(spark, sf_dir):
    scores = lenses.scores(spark, sf_dir)
    results = scores.select(F.col("event_id").alias("case_id"), (F.col("score") * 16).alias("detection_sample"))
    cases = scores.select(F.col("event_id").alias("case_id"), F.when(F.col("event_type") != "view", 40.0).alias("speech_end_ms"))
    return evaluation.late_cases(results, cases)


@query(f"SELECT event_type, count(*) AS n, quantile_cont(score, 0.5) AS p50, quantile_cont(score, 0.95) AS p95 FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY idx) AS rep FROM {SCORES}) WHERE rep > 3 GROUP BY event_type")
def latency_report(spark, sf_dir):
    runs = evaluation.case_numbers(lenses.scores(spark, sf_dir), ["stream"], "idx")
    return evaluation.latency_report(runs, "event_type", "number", "score", 3)


@query("SELECT s_nationkey, s_suppkey, s_suppkey = max(s_suppkey) OVER (PARTITION BY s_nationkey) AND count(*) OVER (PARTITION BY s_nationkey) >= 2 AS is_test FROM supplier")
def held_out_clips(spark, sf_dir):
    return evaluation.held_out_clips(table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey"), "s_nationkey", "s_suppkey")


@query("SELECT user_id, coalesce(arg_max(value, event_id) FILTER (WHERE event_type = 'purchase' AND value > 100), 0.5) AS threshold FROM events GROUP BY user_id")
def last_threshold(spark, sf_dir):
    return evaluation.last_threshold(table(spark, sf_dir, "events"), "user_id", (F.col("event_type") == "purchase") & (F.col("value") > 100), "event_id", "value")


@query(f"SELECT stream, event_id, before, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY stream ORDER BY idx, event_id) AS before FROM {SCORES}) WHERE before IS NOT NULL AND before <> event_type")
def state_changes(spark, sf_dir):
    return evaluation.changes(lenses.scores(spark, sf_dir), "stream", ["idx", "event_id"], "event_type").select("stream", "event_id", "before", "event_type")


@query(
    """WITH w(c_mktsegment, low, high) AS (VALUES ('BUILDING', 0.0, 0.15), ('MACHINERY', 0.1, 0.9), ('FURNITURE', 0.5, 0.9), ('NONE', 0.0, 1.0)), c AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY ALL)
SELECT c_mktsegment, n, share FROM (SELECT w.c_mktsegment, n, coalesce(n, 0) / (SELECT count(*) FROM customer) AS share, low, high FROM w LEFT JOIN c USING (c_mktsegment)) WHERE n IS NULL OR share < low OR share > high"""
)
def composition_faults(spark, sf_dir):
    wanted = spark.createDataFrame([("BUILDING", 0.0, 0.15), ("MACHINERY", 0.1, 0.9), ("FURNITURE", 0.5, 0.9), ("NONE", 0.0, 1.0)], "c_mktsegment string, low double, high double")
    return evaluation.composition_faults(table(spark, sf_dir, "customer"), "c_mktsegment", wanted)


# -- measures of detectors --------------------------------------------------------------------


@query(
    f"""WITH s AS (SELECT stream, stream % 7 AS g, count(*) FILTER (WHERE score >= {DETECT}) AS n, (max(idx) - min(idx)) / 1e6 AS seconds FROM {SCORES} GROUP BY stream)
SELECT g, count(*) AS n_sessions, CAST(sum(n) AS BIGINT) AS n, sum(seconds) AS seconds, sum(n) / (sum(seconds) / 3600.0) AS per_hour FROM s GROUP BY g"""
)
def pooled_rate(spark, sf_dir):
    sessions = lenses.scores(spark, sf_dir).groupBy("stream").agg(F.count_if(F.col("score") >= DETECT).alias("n"), ((F.max("idx") - F.min("idx")) / 1e6).alias("seconds"))
    return metrics.pooled_rate(sessions.withColumn("g", F.col("stream") % 7), ["g"], "n", "seconds")


@query(f"SELECT event_type, avg(ok::INT) AS recall, count(ok) AS n_checked FROM (SELECT event_type, CASE WHEN stream % 5 <> 0 THEN score >= 50 END AS ok FROM {SCORES}) GROUP BY event_type")
def category_recall(spark, sf_dir):
    results = lenses.scores(spark, sf_dir).withColumn("ok", F.when(F.col("stream") % 5 != 0, F.col("score") >= 50))
    return metrics.recall(results, "event_type", "ok")


@query(f"SELECT stream, event_type, max(score) AS best FROM {SCORES} GROUP BY ALL")
def best_of_clips(spark, sf_dir):
    return metrics.best_of_clips(lenses.scores(spark, sf_dir), ["stream", "event_type"], "score")


@query(f"SELECT sum(share) AS expected, count(*) AS n_clips FROM (SELECT stream, avg((score >= {MINE})::INT) AS share FROM {SCORES} GROUP BY stream)")
def expected_hits(spark, sf_dir):
    return metrics.expected_hits(lenses.scores(spark, sf_dir), "stream", "score", MINE)


@query(
    f"""WITH c AS (SELECT stream, row_number() OVER (PARTITION BY stream ORDER BY idx) AS cut, score, 1.0 + stream % 3 AS base FROM {SCORES}),
m AS (SELECT stream, min(cut) FILTER (WHERE score < 0.5 * base) AS miss FROM c GROUP BY stream),
l AS (SELECT c.stream, max(cut) AS lag FROM c JOIN m USING (stream) WHERE score >= 0.5 * base AND (miss IS NULL OR cut < miss) GROUP BY c.stream)
SELECT max(lag) AS low, min(lag) + 100 AS high, count(*) AS n_clips, max(lag) <= min(lag) + 100 AS feasible FROM l"""
)
def lag_window(spark, sf_dir):
    cuts = evaluation.case_numbers(lenses.scores(spark, sf_dir), ["stream"], "idx").select("stream", F.col("number").cast("long").alias("cut"), "score", (F.col("stream") % 3 + 1.0).alias("base"))
    return metrics.lag_window(cuts, "stream", "cut", "score", "base")


@query(f"SELECT stream, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM (SELECT *, max(score) OVER (PARTITION BY stream) AS top FROM {SCORES}) WHERE score >= top - 60 GROUP BY stream")
def active_frames(spark, sf_dir):
    return metrics.active_frames(lenses.scores(spark, sf_dir), "stream", "event_id", "score", 60.0)


@query(f"SELECT stream, event_id FROM (SELECT *, lag(event_type = 'view') OVER (PARTITION BY stream ORDER BY idx, event_id) AS held, lag(idx) OVER (PARTITION BY stream ORDER BY idx, event_id) AS came FROM {SCORES}) WHERE held AND idx - came <= 7200000000")
def held_clarifications(spark, sf_dir):
    return metrics.within_hold(lenses.scores(spark, sf_dir), "stream", "idx", ["idx", "event_id"], F.col("event_type") == "view", 7200).select("stream", "event_id")
