"""Views that read the star-schema tables as traces, score streams, utterances, cases and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3_600_000_000
HALF_HOUR = HOUR // 2
DETECT, MINE = 150.0, 110.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: trace_id and seq are event_id, agent is user_id, stage is event_type; success is false for errors, null for views."""
    success = F.when(F.col("event_type") == "error", False).when(F.col("event_type") != "view", True)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("trace_id"), F.col("event_id").alias("seq"), F.col("ts").alias("started_at"), F.col("user_id").alias("agent"), F.col("event_type").alias("error_stage"), F.col("value").alias("total_ms"), success.alias("success")
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: a stream for each user, index in microseconds, score is value."""
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("stream"), micros("ts").alias("idx"), F.col("value").alias("score"), "event_type")


def positives(scores: DataFrame) -> DataFrame:
    """Half an hour around each purchase, both ends included."""
    return scores.where("event_type = 'purchase'").select("stream", (F.col("idx") - HALF_HOUR).alias("start"), (F.col("idx") + HALF_HOUR).alias("end"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders: a case each, with the customer's segment as category; status O acts, P asks, F refuses; flags by priority and price."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customers.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("category")), "o_custkey")
    kind = F.when(F.col("o_orderstatus") == "O", "action").when(F.col("o_orderstatus") == "P", "clarification").otherwise("refusal")
    number = F.pmod(F.col("o_orderkey"), F.lit(10))
    outcome = F.when(number == 0, "malformed_output").when(number == 1, "unknown_tool").when(number == 2, "invalid_arguments").otherwise("correct")
    flags = F.array_compact(F.array(F.when(F.col("o_totalprice") > 400000, "transport_error"), F.when(F.col("o_orderpriority").startswith("1"), "unsafe_action")))
    return joined.select(F.col("o_orderkey").alias("case_id"), "category", kind.alias("expected_type"), outcome.alias("outcome"), (number > 2).alias("passed"), F.pmod(F.col("o_orderkey"), F.lit(3)).alias("n_calls"), flags.alias("flags"))
