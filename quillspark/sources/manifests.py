"""Readers of homes, suites, gates, sessions, traces, seeds, commands and tool schemas, and run, class and trace sinks.

Small documents are read whole, one row for each file, and are taken apart by Spark's JSON and text
functions. A strict reader returns what breaks its rules as a table of its own, which must be empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOME = """home_id string, satellite_area string, areas map<string, array<string>>, area_aliases map<string, array<string>>,
entities array<struct<entity_id: string, name: string, aliases: array<string>, domain: string, device_class: string, area: string, floor: string, state: string>>,
context_entities array<struct<name: string, domain: string, area: string>>"""
SESSION = "session_id string, source_path string, sample_rate int, sample_count bigint, duration_seconds double, ingested_utc string, audio_sha256 string, notes string"
WAKE_CASE = "id string, category string, audio string, expect_detection boolean, promotion_required boolean, command_transcript string, expected_transcript string, speech_end_ms double, expect_missing_first_word boolean"
COMMAND = "id string, text string, entity string, difficulty string"
TRACE_STORE = "interactions array<map<string, string>>, events array<map<string, string>>"


def read_documents(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """file, stem and text of each file below a folder whose name fits a pattern."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    file = F.col("_metadata.file_path")
    return rows.select(file.alias("file"), F.regexp_extract(file, r"([^/]+)\.[^./]+$", 1).alias("stem"), F.col("value").alias("text"))


def _parsed(documents: DataFrame, schema: str) -> DataFrame:
    return documents.withColumn("d", F.from_json("text", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))


def read_homes(spark: SparkSession, path: str, own_area: str = "own_area") -> DataFrame:
    """Homes with defaults for the assistant's own area, in the field of that name, and for the aliases of areas."""
    homes = _parsed(read_documents(spark, path, "*.json"), f"{HOME}, {own_area} string").select("file", "stem", "d.*").drop("_bad")
    return homes.withColumns({own_area: F.coalesce(own_area, "satellite_area"), "area_aliases": F.coalesce("area_aliases", "areas")})


def misnamed_homes(homes: DataFrame) -> DataFrame:
    """Homes whose id isn't their file's name; must be empty."""
    return homes.where(~F.col("home_id").eqNullSafe(F.col("stem"))).select("file", "home_id")


def _lines(documents: DataFrame) -> DataFrame:
    """Each line of each document with its number, how far it is indented, its key and its value; blank lines and comments left out."""
    each = documents.select("stem", F.posexplode(F.split("text", r"\r?\n")).alias("number", "line")).where(F.col("line").rlike(r"^\s*[^\s#]"))
    item = r"^\s*-\s+(.*?)\s*$"
    value = F.when(F.col("line").rlike(item), F.regexp_extract("line", item, 1)).otherwise(F.regexp_extract("line", r"^[^:]*:\s*(.*?)\s*$", 1))
    key = F.when(~F.col("line").rlike(item), F.trim(F.regexp_extract("line", r"^\s*([^:]+):", 1)))
    return each.select("stem", "number", F.length(F.regexp_extract("line", r"^(\s*)", 1)).alias("indent"), key.alias("key"), F.regexp_replace(value, "^[\"']|[\"']$", "").alias("value"))


def read_suites(spark: SparkSession, path: str) -> DataFrame:
    """suite, pos and case_id from files with a list of ids under "cases:" (S5)."""
    lines = _lines(read_documents(spark, path, "*.yaml"))
    section = F.last(F.when((F.col("indent") == 0) & F.col("key").isNotNull(), F.col("key")), ignorenulls=True).over(Window.partitionBy("stem").orderBy("number"))
    items = lines.withColumn("section", section).where("section = 'cases' AND key IS NULL")
    return items.select(F.col("stem").alias("suite"), (F.row_number().over(Window.partitionBy("stem").orderBy("number")) - 1).alias("pos"), F.col("value").alias("case_id"))


def suite_faults(suites: DataFrame, documents: DataFrame, cases: DataFrame) -> DataFrame:
    """suite, case_id and fault of suites without cases, repeated ids and ids without a case; must be empty."""
    empty = documents.select(F.col("stem").alias("suite")).join(suites, "suite", "left_anti").select("suite", F.lit(None).cast("string").alias("case_id"), F.lit("empty").alias("fault"))
    again = suites.groupBy("suite", "case_id").agg(F.count("*").alias("n")).where("n > 1").select("suite", "case_id", F.lit("duplicate").alias("fault"))
    unknown = suites.join(cases.select("case_id"), "case_id", "left_anti").select("suite", "case_id", F.lit("unknown").alias("fault")).distinct()
    return empty.unionByName(again).unionByName(unknown)


def read_gates(spark: SparkSession, path: str) -> DataFrame:
    """suite, kind, key, bound and version of gates, with the file's version where a suite has none.

    Kinds: min_overall, category_min, max_rate and zero_flag, as operators.evaluation.failed_gates takes them.
    """
    lines = _lines(read_documents(spark, path, "*.yaml"))
    order = Window.partitionBy("stem").orderBy("number")
    at = lambda depth: F.last(F.when((F.col("indent") <= 2 * depth) & F.col("key").isNotNull(), F.when(F.col("indent") == 2 * depth, F.col("key")).otherwise("")), ignorenulls=True).over(order)
    rows = lines.withColumns({"top": at(0), "suite": at(1), "part": at(2)})
    version = F.max(F.when((F.col("indent") == 0) & (F.col("key") == "version"), F.col("value"))).over(Window.partitionBy("stem"))
    own = F.max(F.when((F.col("indent") == 4) & (F.col("key") == "version"), F.col("value"))).over(Window.partitionBy("stem", "top", "suite"))
    rows = rows.withColumn("version", F.coalesce(own, version)).where("top = 'suites' AND suite <> ''")
    kind = (
        F.when((F.col("part") == "min_overall_pass_rate") & (F.col("indent") == 4), "min_overall")
        .when((F.col("part") == "category_min_pass_rate") & (F.col("indent") == 6), "category_min")
        .when((F.col("part") == "max_rates") & (F.col("indent") == 6), "max_rate")
        .when((F.col("part") == "zero_tolerance_flags") & F.col("key").isNull(), "zero_flag")
    )
    key = F.when(F.col("kind") == "min_overall", "overall_pass_rate").when(F.col("kind") == "zero_flag", F.col("value")).otherwise(F.col("key"))
    bound = F.when(F.col("kind") == "zero_flag", 0.0).otherwise(F.col("value").try_cast("double"))
    return rows.withColumn("kind", kind).where("kind IS NOT NULL").select("suite", "kind", key.alias("key"), bound.alias("bound"), "version")


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Session manifests; a broken one, or one without an id, is left out."""
    return _parsed(read_documents(spark, path, "session.json"), SESSION).where("d._bad IS NULL AND d.session_id IS NOT NULL").select("file", "d.*").drop("_bad")


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """trace_id, summary and its events in order, from documents of two lists; what isn't an object of a list is left out."""
    stores = _parsed(read_documents(spark, path, "*.json"), TRACE_STORE).where("d.interactions IS NOT NULL")
    # an entry that isn't an object makes the whole document corrupt for the parser, but the list keeps the rest
    summaries = stores.select("file", F.posexplode("d.interactions").alias("pos", "summary")).where("summary IS NOT NULL").withColumn("trace_id", F.col("summary")["trace_id"])
    events = stores.select("file", F.posexplode("d.events").alias("n", "event")).where("event['trace_id'] IS NOT NULL").withColumn("trace_id", F.col("event")["trace_id"])
    nested = events.groupBy("file", "trace_id").agg(F.array_sort(F.collect_list(F.struct("n", F.to_json("event").alias("event")))).alias("events"))
    joined = summaries.join(nested, ["file", "trace_id"], "left")
    return joined.select("file", "pos", "trace_id", "summary", F.coalesce(F.transform("events", lambda e: e["event"]), F.array().cast("array<string>")).alias("events"))


def write_traces(summaries: DataFrame, events: DataFrame, path: str) -> None:
    """A trace store as two tables, of summaries and of their events (K6); retention is operators.traces.retained."""
    summaries.write.mode("overwrite").json(f"{path}/interactions")
    events.join(summaries.select("trace_id").distinct(), "trace_id", "left_semi").write.mode("overwrite").json(f"{path}/events")


def read_wake_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a manifest {version, cases} with its version; promotion is not required unless it says so."""
    rows = _parsed(read_documents(spark, path, "*.json"), f"version string, cases array<struct<{WAKE_CASE.replace(' string', ': string').replace(' boolean', ': boolean').replace(' double', ': double')}>>")
    return rows.select(F.col("d.version").alias("version"), F.explode("d.cases").alias("c")).select("version", "c.*").withColumn("promotion_required", F.coalesce("promotion_required", F.lit(False)))


def wake_case_faults(cases: DataFrame, categories: list[str]) -> DataFrame:
    """Cases with the rules they break: an id, a known category, an audio path, and no repeated id."""
    again = F.count("*").over(Window.partitionBy("id")) > 1
    rules = {"id": F.coalesce("id", F.lit("")) != "", "category": F.coalesce(F.col("category").isin(categories), F.lit(False)), "audio": F.coalesce("audio", F.lit("")) != "", "repeated": ~again}
    return cases.withColumn("faults", F.array_compact(F.array(*(F.when(~ok, F.lit(k)) for k, ok in rules.items())))).where(F.size("faults") > 0)


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """WAV files below folders positive and negative, with the label that the folder gives; content is read where it is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(path)
    return files.withColumn("label", F.regexp_extract("path", r"/(positive|negative)/[^/]+$", 1)).where("label <> ''")


def read_commands(spark: SparkSession, path: str) -> DataFrame:
    """Commands of documents {commands: [...]}."""
    schema = f"commands array<struct<{COMMAND.replace(' string', ': string')}>>"
    return _parsed(read_documents(spark, path, "*.json"), schema).select(F.explode("d.commands").alias("c")).select("c.*")


def read_tools(spark: SparkSession, path: str) -> DataFrame:
    """Tools of a locked schema: name, description, parameters as JSON, and the digest of the file."""
    documents = read_documents(spark, path, "*.json")
    tools = F.from_json(F.get_json_object("text", "$.tools"), "array<string>")
    each = documents.select(F.sha2("text", 256).alias("sha256"), F.explode(tools).alias("tool"))
    at = lambda p: F.get_json_object("tool", p)
    return each.select(at("$.name").alias("name"), at("$.description").alias("description"), at("$.parameters").alias("parameters"), "sha256")


def tool_faults(tools: DataFrame) -> DataFrame:
    """Tools without a name or parameters, or whose name repeats; must be empty."""
    counted = tools.withColumn("times", F.count("*").over(Window.partitionBy("name")))
    return counted.where("name IS NULL OR parameters IS NULL OR times > 1").select("name")


def write_run(outcomes: DataFrame, summary: DataFrame, metadata: dict[str, str], path: str) -> None:
    """An evaluation run: metadata, summary and outcomes as JSON lines in folders of their own (K1)."""
    meta = outcomes.sparkSession.range(1).select(*(F.lit(v).alias(k) for k, v in sorted(metadata.items())))
    for name, df in (("metadata", meta), ("summary", summary), ("outcomes", outcomes)):
        df.write.mode("overwrite").json(f"{path}/{name}")


def differing_lines(rendered: DataFrame, stored: DataFrame) -> DataFrame:
    """Lines on one side only, as often as that side has more of them; must be empty for a check to pass (K2)."""
    return rendered.exceptAll(stored).withColumn("side", F.lit("rendered")).unionByName(stored.exceptAll(rendered).withColumn("side", F.lit("stored")))


def cleaned(entries: DataFrame, manifest: DataFrame, path: str, pinned: Column) -> DataFrame:
    """entries with the state a cleanup manifest (path, action) gives them: quarantined, removed or kept; pinned ones are always kept (K9)."""
    joined = entries.join(manifest.select(path, "action").distinct(), path, "left")
    state = F.when(pinned, "kept").when(F.col("action") == "quarantine", "quarantined").when(F.col("action") == "remove", "removed").otherwise("kept")
    return joined.withColumn("state", state).drop("action")


def write_classes(rows: DataFrame, path: str, kind: str, content: str) -> DataFrame:
    """Writes a folder for each class, and returns a manifest with each row's digest and whether someone must still verify it."""
    rows.write.mode("overwrite").partitionBy(kind).parquet(path)
    return rows.select(kind, *(c for c in rows.columns if c not in (kind, content)), F.sha2(content, 256).alias("sha256"), F.col("label").isNull().alias("needs_verification"))


def fileset_digest(files: DataFrame) -> str:
    """A digest of a set of files (path, content), whatever their order: sums of the rows' digests, so no group is held together."""
    digest = F.sha2(F.concat(F.encode("path", "UTF-8"), F.unhex(F.lit("00")), F.col("content")), 256)
    parts = [F.sum(F.conv(F.substring(digest, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(5)]
    return files.agg(F.count("*").alias("n"), *parts).select(F.sha2(F.concat_ws("-", "n", *(F.coalesce(f"p{i}", F.lit(0)).cast("string") for i in range(5))), 256)).first()[0]
