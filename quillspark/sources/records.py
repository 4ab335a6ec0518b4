"""Readers and writers of cases, records, sessions and transcripts.

Strict readers fail on a bad row; lenient ones drop or default. Schemas are always given, never inferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CASE = """id string, category string, tags array<string>, household string, utterance string,
expected struct<response_type: string, calls: array<struct<name: string, arguments: string>>>, provenance struct<source: string, held_out: boolean>"""
RESPONSE_TYPES = ("action", "status", "clarification", "refusal")
RECORD = """capture_id string, event_id string, session_id string, provider string, score double, detect_threshold double, mine_threshold double,
fired boolean, sample_start bigint, sample_end bigint, label string, labeled_utc string, published_utc string"""


def read_json_lines(spark: SparkSession, path: str, schema: str | StructType, strict: bool = True) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped. A line that isn't an object of the schema fails, or is dropped if not strict."""
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    return spark.read.schema(schema).option("mode", mode).json(path)


def case_faults(cases: DataFrame) -> DataFrame:
    """Cases with the names of the rules they break."""
    rules = {
        "id": F.coalesce(F.col("id"), F.lit("")) != "",
        "utterance": F.col("utterance").isNotNull(),
        "tags": F.col("tags").isNotNull() & ~F.coalesce(F.exists("tags", lambda t: t.isNull()), F.lit(False)),
        "response_type": F.coalesce(F.col("expected.response_type").isin(*RESPONSE_TYPES), F.lit(False)),
        "calls": F.col("expected.calls").isNotNull(),
        "source": F.coalesce(F.col("provenance.source"), F.lit("")) != "",
    }
    faults = F.array_compact(F.array(*(F.when(~ok, F.lit(name)) for name, ok in rules.items())))
    return cases.withColumn("faults", faults).where(F.size("faults") > 0)


def repeated_ids(parts: list[DataFrame], key: str) -> DataFrame:
    """Ids that occur more than once in all parts together; must be empty (S3)."""
    ids = parts[0].select(key)
    for p in parts[1:]:
        ids = ids.unionByName(p.select(key))
    return ids.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def _raw(spark: SparkSession, root: str, pattern: str, recursive: bool) -> DataFrame:
    """JSON files, one record each, with path, and _bad where a file is malformed."""
    texts = spark.read.option("wholetext", True).option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).text(root)
    record = F.from_json("value", RECORD + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = texts.select("value", F.col("_metadata.file_path").alias("path"), record.alias("r"))
    bad = F.coalesce("r._bad", F.when(F.col("r").isNull(), F.col("value")))
    return rows.select(*(f"r.{c}" for c in StructType.fromDDL(RECORD).names), bad.alias("_bad"), "path")


def _filled(rows: DataFrame, fallback: Column) -> DataFrame:
    """Well-formed records with defaults for what is missing."""
    return rows.where("_bad IS NULL").drop("_bad").withColumns(
        {
            "capture_id": F.coalesce("capture_id", "event_id", fallback),
            "provider": F.coalesce("provider", F.lit("livekit")),
            "fired": F.coalesce("fired", F.lit(False)),
            **{c: F.coalesce(c, F.lit(0.0)) for c in ("score", "detect_threshold", "mine_threshold")},
            **{c: F.coalesce(c, F.lit(0).cast("long")) for c in ("sample_start", "sample_end")},
        }
    )


def read_records(spark: SparkSession, root: str) -> DataFrame:
    """Records in folders below root, with defaults for what is missing; unreadable ones are dropped."""
    return _filled(_raw(spark, root, "record.json", True), F.element_at(F.split("path", "/"), -2))


def _sidecars(spark: SparkSession, root: str) -> DataFrame:
    """JSON files right in root that stand beside a WAV file of their name, which must not be empty."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(root)
    stem = lambda path: F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    sounds = files.select(stem(F.col("path")).alias("stem")).distinct()
    return _raw(spark, root, "*.json", False).withColumn("stem", stem(F.col("path"))).join(sounds, "stem", "left_semi")


def read_spool(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """A spool's rows and its malformed files (path), old layouts included.

    Records are folders in records, or in events if there is no readable one; in the oldest layout
    a JSON file beside a WAV file of its name. A sidecar without an id is called by its name.
    """
    root = root.rstrip("/")

    def there(name: str) -> bool:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    none = spark.createDataFrame([], StructType([*StructType.fromDDL(RECORD + ", _bad string, path string").fields]))
    folders = {name: _raw(spark, f"{root}/{name}", "record.json", True) if there(name) else none for name in ("records", "events")}
    rows = _filled(folders["records"], F.element_at(F.split("path", "/"), -2))
    read = ["records"]
    if rows.isEmpty():
        rows, read = _filled(folders["events"], F.element_at(F.split("path", "/"), -2)), ["records", "events"]
    beside = _sidecars(spark, root)
    rows = rows.unionByName(_filled(beside, F.col("stem")).drop("stem"))
    bad = beside.where("_bad IS NOT NULL").select("path")
    for name in read:
        bad = bad.unionByName(folders[name].where("_bad IS NOT NULL").select("path"))
    return rows, bad


def transcripts(lines: DataFrame, chapter: str, order: str) -> DataFrame:
    """Lines "id text" with their samples (n_samples) to spans with cumulative offsets in the chapter."""
    w = Window.partitionBy(chapter).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("n_samples").over(w)
    parts = F.split("value", " ", 2)
    return lines.withColumn("end", end).select(chapter, parts[0].alias("utt_id"), (F.col("end") - F.col("n_samples")).alias("start"), "end", F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("text"))


def merged_outcomes(outcomes: DataFrame, keys: list[str], order: str, fields: list[str]) -> DataFrame:
    """One row for each key; each field has the latest value that isn't null (K4)."""
    return outcomes.groupBy(*keys).agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields))


def drained(records: DataFrame, acks: DataFrame, key: str, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """Records without an ack, and acks that are younger than the cutoff."""
    return records.join(acks.select(key), key, "left_anti"), acks.where(F.col("verified_utc") >= cutoff)


def failed_hashes(artifacts: DataFrame, expected: DataFrame) -> DataFrame:
    """Artifacts (path, content) whose SHA-256 isn't the expected one; without an expected one they pass."""
    actual = artifacts.select("path", F.sha2("content", 256).alias("actual"))
    joined = expected.where("sha256 IS NOT NULL").join(actual, "path", "left")
    reason = F.when(F.col("actual").isNull(), "missing").when(F.col("actual") != F.col("sha256"), "mismatch")
    return joined.withColumn("reason", reason).where("reason IS NOT NULL")


def canonical_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A JSON text for each row, with its columns in order of name and nulls left out (K2)."""
    return rows.select(F.to_json(F.struct(*sorted(columns))).alias("value"))


def write_snapshot(rows: DataFrame, root: str, columns: list[str]) -> str:
    """Writes rows under a folder named by their content, whatever their order, and returns it.

    Row digests are summed as numbers, so no group of rows is held together.
    """
    digest = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(columns))), 256)
    parts = [F.sum(F.conv(F.substring(digest, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(5)]
    row = rows.agg(F.count("*").alias("n"), *parts).select(F.sha2(F.concat_ws("-", "n", *(F.coalesce(f"p{i}", F.lit(0)).cast("string") for i in range(5))), 256)).first()
    path = f"{root.rstrip('/')}/{row[0]}"
    rows.select(*columns).write.mode("overwrite").json(path)
    return path
