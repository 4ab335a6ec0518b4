"""Words to entities and domains, and conversation history."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.text import tokens


#: First tokens of labels up to which each task gets them all.
LISTED_HEADS = 1000


def phrase_matches(utterances: DataFrame, labels: DataFrame, key: str, text: str = "utterance", label: str = "label") -> DataFrame:
    """Distinct pairs of an utterance's key and a label whose tokens are a contiguous part of the utterance's (J19), with the label's columns.

    A label can only match where its first token stands, so both sides meet by that token instead of by a cross product. Each
    place of an utterance brings as many tokens as the longest label has, so the phrase is tested where the sides have met.
    """
    named = labels.withColumn("_phrase", tokens(F.col(label))).withColumn("_head", F.get("_phrase", F.lit(0))).where("_head IS NOT NULL")
    width = named.agg(F.max(F.size("_phrase"))).first()[0] or 1
    words = utterances.select(key, tokens(F.col(text)).alias("_words")).where(F.size("_words") > 0)
    heads = [r[0] for r in named.select("_head").distinct().limit(LISTED_HEADS + 1).collect()]
    places = F.sequence(F.lit(1), F.size("_words"))
    if len(heads) <= LISTED_HEADS:  # few first tokens are looked up where the text is; more meet the text by the join alone
        places = F.filter(places, lambda i: F.element_at("_words", i).isin(heads))
    runs = F.transform(places, lambda i: F.concat(F.array_join(F.slice("_words", i, width), " "), F.lit(" ")))
    each = words.select(key, F.explode(F.array_distinct(runs)).alias("_run")).withColumn("_head", F.substring_index("_run", " ", 1))
    met = each.join(named, "_head").where(F.startswith("_run", F.concat(F.array_join("_phrase", " "), F.lit(" "))))
    return met.select(key, *labels.columns).distinct()


def domain_hints(matches: DataFrame, key: str, domain: str, control: list[str]) -> DataFrame:
    """The only domain matched, or the only controllable one, else null (Q15)."""
    pairs = matches.select(key, domain).distinct()
    one = pairs.groupBy(key).agg(F.count("*").alias("n"), F.min(domain).alias("any"), F.count_if(F.col(domain).isin(control)).alias("k"), F.min(F.when(F.col(domain).isin(control), F.col(domain))).alias("some"))
    return one.select(key, F.when(F.col("n") == 1, F.col("any")).when(F.col("k") == 1, F.col("some")).alias("domain_hint"))


def chained_area(entities: DataFrame, devices: DataFrame, own: str, key: str, area: str) -> DataFrame:
    """entities with their own area, else their device's."""
    found = devices.select(F.col(key), F.col(area).alias("_device_area"))
    return entities.join(found, key, "left").withColumn("resolved_area", F.coalesce(F.col(own), F.col("_device_area"))).drop("_device_area")


def best_two(options: DataFrame, key: str, name: str, score: str) -> DataFrame:
    """The chosen options: the best if it scores 0.5 and leads by 0.1, else the best two if both score 0.5, else none."""
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(name))
    top = options.select(key, name, score, F.row_number().over(w).alias("r")).where("r <= 2")
    top = top.groupBy(key).agg(*(F.max(F.when(F.col("r") == i, F.col(c))).alias(f"{a}{i}") for i in (1, 2) for c, a in ((name, "n"), (score, "s"))))
    clear = (F.col("s1") >= 0.5) & (F.col("s2").isNull() | (F.col("s1") - F.col("s2") >= 0.1))
    both = (F.col("s1") >= 0.5) & (F.col("s2") >= 0.5)
    return top.select(key, F.when(clear, F.col("n1")).when(both, F.concat_ws("|", "n1", "n2")).alias("chosen"))


def strict_best(options: DataFrame, key: str, name: str, score: str) -> DataFrame:
    """The best option, or null if several share the best score."""
    best = options.groupBy(key).agg(F.max(score).alias("_best"))
    tied = options.join(best, key).where(F.col(score) == F.col("_best")).groupBy(key).agg(F.count("*").alias("n"), F.min(name).alias("name"))
    return tied.select(key, F.when(F.col("n") == 1, F.col("name")).alias("best"))


def asks(text: Column) -> Column:
    """Whether a text ends as a question."""
    return F.coalesce(F.trim(text), F.lit("")).rlike(r"[?;？]$")


def history(messages: DataFrame, key: str, order: str) -> DataFrame:
    """System rows, and the rows from the current user turn on; from the user turn before it if the assistant turn between ends as a question."""
    last = lambda df, role, name: df.where(F.col("role") == role).groupBy(key).agg(F.max(order).alias(name))
    current = last(messages, "user", "current")
    before = messages.join(current, key).where(F.col(order) < F.col("current"))
    reply = before.where("role = 'assistant'").groupBy(key).agg(F.max_by(F.struct(order, asks(F.col("text")).alias("asks")), order).alias("reply"))
    earlier = before.join(reply, key).where((F.col("role") == "user") & (F.col(order) < F.col(f"reply.{order}"))).groupBy(key).agg(F.max(order).alias("earlier"))
    starts = current.join(reply, key, "left").join(earlier, key, "left")
    start = F.when(F.coalesce("reply.asks", F.lit(False)), F.coalesce(F.col("earlier"), F.col(f"reply.{order}"))).otherwise(F.col("current"))
    starts = starts.select(key, start.alias("start"))
    return messages.join(starts, key, "left").where(F.col("start").isNull() | (F.col(order) >= F.col("start")) | (F.col("role") == "system")).drop("start")


def with_checkpoints(spark: SparkSession) -> None:
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quillspark-"))


def closure(edges: DataFrame, source: str, target: str, most_rounds: int = 64) -> DataFrame:
    """All pairs that edges join in one step or more (J21). Stops with an error if paths are still new after most_rounds doublings.

    A round joins the paths so far, of 2^i steps at most, to those of exactly 2^i steps, so a pair isn't found again by every
    place at which its path can be cut; only new pairs are written.
    Lineage is cut in the session's checkpoint folder; a local session without one gets its own, a cluster must name one.
    """
    with_checkpoints(edges.sparkSession)

    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.alias("a").join(b.alias("b"), F.col(f"a.{target}") == F.col(f"b.{source}")).select(F.col(f"a.{source}").alias(source), F.col(f"b.{target}").alias(target))

    paths = exact = edges.select(source, target).where(F.col(source).isNotNull() & F.col(target).isNotNull()).distinct().checkpoint()
    for _ in range(most_rounds):
        both = joined(paths, exact).withColumn("_old", F.lit(False)).unionByName(paths.withColumn("_old", F.lit(True)))
        new = both.groupBy(source, target).agg(F.max("_old").alias("_old")).where("NOT _old").select(F.col(source).alias(source), F.col(target).alias(target)).checkpoint()
        if new.isEmpty():
            return paths
        paths = paths.unionByName(new)
        exact = joined(exact, exact).groupBy(source, target).agg(F.count("*").alias("_n")).select(F.col(source).alias(source), F.col(target).alias(target)).checkpoint()
    raise RuntimeError(f"closure did not settle in {most_rounds} rounds")


def phrase_spans(words: DataFrame, key: str, order: str, word: str, start: str, end: str, phrase: list[str]) -> DataFrame:
    """Spans of consecutive words that spell a phrase: start of the first and end of the last."""
    plain = F.regexp_replace(F.lower(F.col(word)), "[^a-z']", "")
    w = Window.partitionBy(key).orderBy(order)
    rows = words.withColumn("_w", plain)
    hit = F.lit(True)
    for i, p in enumerate(phrase):
        hit = hit & (F.lead("_w", i).over(w) == p if i else F.col("_w") == p)
    rows = rows.withColumn("_hit", hit).withColumn("_end", F.lead(end, len(phrase) - 1).over(w) if len(phrase) > 1 else F.col(end))
    return rows.where("_hit").select(key, F.col(start).alias("span_start"), F.col("_end").alias("span_end"))
