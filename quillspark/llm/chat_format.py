"""Preference formatting: the longest common turn prefix once as prompt, and a pair of masked completions.

Chosen and rejected conversations are compared turn by turn: equal place, role and text. The
prefix ends before the first turn that differs or that one side lacks. It is rendered once; the
rest of each side is its completion, with the spans of the completion that a loss counts: the
text and end mark of assistant turns, not headers or other roles. All DataFrame functions; the
turns of a pair meet in one shuffle, and no more than one conversation is held together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The frame of a turn: a header with the role, and an end mark.
HEAD, TAIL = "<|{role}|>\n", "<|end|>\n"
TRAINED_ROLE = "assistant"


def _head(role: Column) -> Column:
    before, after = HEAD.split("{role}")
    return F.concat(F.lit(before), F.coalesce(role, F.lit("")), F.lit(after))


def _parts(turns: str, least: str) -> tuple[Column, Column]:
    """Rendered turns before and from a place."""
    return F.filter(turns, lambda t: t["place"] < F.col(least)), F.filter(turns, lambda t: t["place"] >= F.col(least))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(t["head"], t["body"])), "")


def _mask(turns: Column) -> Column:
    """start:end of trained parts of the rendered turns, comma-joined; code points, end exclusive."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, t: Column) -> Column:
        begin = s["at"] + F.length(t["head"])
        end = begin + F.length(t["body"])
        span = F.concat_ws(":", begin.cast("string"), end.cast("string"))
        out = F.when(t["role"] == TRAINED_ROLE, F.array_append(s["out"], span)).otherwise(s["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    return F.aggregate(turns, start, step, lambda s: F.array_join(s["out"], ","))


def format_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask and rejected_mask of every pair.

    Both sides have pair_id, turn, role and text; other columns are ignored. Turns count by their
    order of turn, then role and text, so gaps and repeated rows are turns like others. A null
    role or text is rendered as empty and equals a null alone. A side without turns has an empty
    completion; a pair whose sides are equal has empty completions and all turns as prompt. Rows
    with a null pair_id belong to no pair and are left out.
    """
    order = Window.partitionBy("side", "pair_id").orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.where("pair_id IS NOT NULL").select("pair_id", "turn", "role", "text", F.lit(name).alias("side"))

    turns = side(chosen, "c").unionByName(side(rejected, "r")).withColumn("place", F.row_number().over(order) - 1)
    body = F.concat(F.coalesce("text", F.lit("")), F.lit(TAIL))
    at = turns.select("pair_id", "place", "side", F.struct("place", F.coalesce("role", F.lit("")).alias("role"), _head(F.col("role")).alias("head"), body.alias("body")).alias("turn"), F.struct("role", "text").alias("same"))
    sides = at.groupBy("pair_id").agg(
        *(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("place", "same", "turn")))).alias(s) for s in "cr")
    )
    agree = F.zip_with("c", "r", lambda a, b: a["same"].eqNullSafe(b["same"]))
    differ = F.array_position(F.transform(agree, lambda x: F.coalesce(x, F.lit(False))), False)
    shared = F.when(differ > 0, differ - 1).otherwise(F.size(agree)).cast("int")
    sides = sides.withColumn("shared", shared).withColumns({s: F.transform(s, lambda x: x["turn"]) for s in "cr"})
    prompt, c = _parts("c", "shared")
    _, r = _parts("r", "shared")
    return sides.select("pair_id", F.col("shared").cast("long").alias("n_prompt_turns"), _text(prompt).alias("prompt"), _text(c).alias("chosen"), _text(r).alias("rejected"), _mask(c).alias("chosen_mask"), _mask(r).alias("rejected_mask"))


def reply_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen: each conversation up to its last assistant turn. Rejected: the same with the reply of the conversation that has the next conv_id, if any.

    A conversation without assistant turns is chosen whole against itself without its last turn.
    """
    turns = conversations.select(F.col("conv_id"), "turn", "role", "text")
    last = turns.groupBy("conv_id").agg(F.max(F.when(F.col("role") == TRAINED_ROLE, F.col("turn"))).alias("reply"), F.max("turn").alias("end"))
    last = last.select("conv_id", F.coalesce("reply", "end").alias("cut"))
    kept = turns.join(last, "conv_id").where("turn <= cut OR turn IS NULL OR cut IS NULL")
    chosen = kept.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    replies = kept.where((F.col("turn") == F.col("cut")) & (F.col("role") == TRAINED_ROLE)).groupBy("conv_id").agg(F.min("text").alias("text"))
    other = replies.select((F.col("conv_id") - 1).alias("conv_id"), "text")
    answer = last.join(other, "conv_id").select(F.col("conv_id").alias("pair_id"), F.col("cut").alias("turn"), F.lit(TRAINED_ROLE).alias("role"), "text")
    start = kept.where("turn < cut OR turn IS NULL OR cut IS NULL").select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    return chosen, start.unionByName(answer)


def op1(conversations: DataFrame) -> DataFrame:
    return format_pairs(*reply_pairs(conversations))


SQL = """
WITH last AS (
  SELECT conv_id, coalesce(max(turn) FILTER (WHERE role = 'assistant'), max(turn)) AS cut FROM conversations GROUP BY conv_id
), kept AS (
  SELECT c.conv_id, c.turn, c.role, c.text, l.cut FROM conversations c JOIN last l USING (conv_id) WHERE c.turn <= l.cut
), replies AS (
  SELECT conv_id, min(text) AS text FROM kept WHERE turn = cut AND role = 'assistant' GROUP BY conv_id
), sides AS (
  SELECT 'c' AS side, conv_id AS pair_id, turn, role, text FROM kept
  UNION ALL SELECT 'r', conv_id, turn, role, text FROM kept WHERE turn < cut
  UNION ALL SELECT 'r', l.conv_id, l.cut, 'assistant', r.text FROM last l JOIN replies r ON r.conv_id = l.conv_id + 1
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY side, pair_id ORDER BY turn, role, text) - 1 AS place,
    '<|' || role || '|>' || chr(10) AS head, text || '<|end|>' || chr(10) AS body FROM sides
), both_sides AS (
  SELECT pair_id, place, count(*) = 2 AND count(DISTINCT role) = 1 AND count(DISTINCT text) = 1 AS same FROM placed GROUP BY pair_id, place
), shared AS (
  SELECT pair_id, coalesce(min(place) FILTER (WHERE NOT same), count(*)) AS shared FROM both_sides GROUP BY pair_id
), spans AS (
  SELECT p.*, s.shared, sum(length(head) + length(body)) FILTER (WHERE place >= s.shared) OVER (PARTITION BY side, pair_id ORDER BY place) AS until
  FROM placed p JOIN shared s USING (pair_id)
)
SELECT pair_id, CAST(any_value(shared) AS BIGINT) AS n_prompt_turns,
  coalesce(string_agg(head || body, '' ORDER BY place) FILTER (WHERE side = 'c' AND place < shared), '') AS prompt,
  coalesce(string_agg(head || body, '' ORDER BY place) FILTER (WHERE side = 'c' AND place >= shared), '') AS chosen,
  coalesce(string_agg(head || body, '' ORDER BY place) FILTER (WHERE side = 'r' AND place >= shared), '') AS rejected,
  coalesce(string_agg((until - length(body)) || ':' || until, ',' ORDER BY place) FILTER (WHERE side = 'c' AND place >= shared AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg((until - length(body)) || ':' || until, ',' ORDER BY place) FILTER (WHERE side = 'r' AND place >= shared AND role = 'assistant'), '') AS rejected_mask
FROM spans GROUP BY pair_id
"""
