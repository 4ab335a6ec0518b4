"""Tool calls and catalogues: contract checks, simple call texts, offers and exposed entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import normalize_utterance

#: Tools up to which each task gets them all.
LISTED_TOOLS = 10_000


def canonical_json(fields: Column) -> Column:
    """A flat map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(fields))))


def first_violation(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """calls with the first rule they break, or null.

    calls: tool and args (map). tools: tool, allowed and required (arrays of names) and choices
    (map of names to arrays of values). Rules in order: unknown_tool, unexpected_argument,
    missing_argument, invalid_value.
    """
    if tools.limit(LISTED_TOOLS + 1).count() <= LISTED_TOOLS:  # by the join's key all calls of a tool would be one task's
        tools = F.broadcast(tools)
    joined = calls.join(tools.withColumn("_known", F.lit(True)), "tool", "left")
    names = F.map_keys("args")
    wrong = F.exists(F.map_entries("args"), lambda e: F.coalesce(~F.array_contains(F.try_element_at(F.col("choices"), e["key"]), e["value"]), F.lit(False)))
    rule = (
        F.when(F.col("_known").isNull(), "unknown_tool")
        .when(F.size(F.array_except(names, "allowed")) > 0, "unexpected_argument")
        .when(F.size(F.array_except("required", names)) > 0, "missing_argument")
        .when(wrong, "invalid_value")
    )
    return joined.withColumn("violation", rule).select(*calls.columns, "violation")


def parse_call(text: Column) -> dict[str, Column]:
    """Name and arguments of a call text like name(key='text', other=3); null for another text (H35, simple calls)."""
    body = r"^\s*([A-Za-z_][A-Za-z0-9_]*)\((.*)\)\s*$"
    pair = r"([A-Za-z_][A-Za-z0-9_]*)=('[^']*'|-?[0-9]+)"
    ok = text.rlike(body)
    inside = F.regexp_extract(text, body, 2)
    keys, values = (F.regexp_extract_all(inside, F.lit(pair), F.lit(i)) for i in (1, 2))
    plain = F.transform(values, lambda v: F.regexp_replace(v, "^'|'$", ""))
    return {"name": F.when(ok, F.regexp_extract(text, body, 1)), "keys": F.when(ok, keys), "values": F.when(ok, plain)}


def well_formed(batch: Column) -> Column:
    """Whether a batch of calls has names and ids that are not empty, and ids that don't repeat."""
    ids = F.transform(batch, lambda c: c["id"])
    filled = F.forall(batch, lambda c: (F.coalesce(c["id"], F.lit("")) != "") & (F.coalesce(c["name"], F.lit("")) != ""))
    return filled & (F.size(F.array_distinct(ids)) == F.size(ids))


def offered(offer: Column, domains: Column) -> Column:
    """Whether a tool with that offer (always, domain:x or domains:a,b) is offered to a home with these domains."""
    some = F.split(F.regexp_extract(offer, "^domains?:(.*)$", 1), ",")
    return (offer == "always") | (offer.rlike("^domains?:") & F.arrays_overlap(some, domains))


def selected(hint: Column, declared: Column, retained: Column) -> Column:
    """Whether a tool stays for a domain hint: without a hint all, else those that are retained, declare nothing or declare it."""
    return hint.isNull() | F.coalesce(retained, F.lit(False)) | declared.isNull() | F.array_contains(declared, hint)


def exposed(entities: DataFrame, hidden: list[str], area: str) -> DataFrame:
    """Names of the entities of an area, each with its aliases, in order; some domains are hidden."""
    names = F.array_join(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))), ", ")
    return entities.where(~F.col("domain").isin(hidden)).select(area, names.alias("names")).groupBy(area).agg(F.array_join(F.array_sort(F.collect_set("names")), "\n").alias("lines"))


def generate_cases(entities: DataFrame, templates: list[str], reviewed: DataFrame, household: str, key: str, seed: str, cap: int) -> DataFrame:
    """Utterances from templates and entities: normalized, the first of each household's kept, reviewed ones dropped, a seeded sample of cap for each household (Q5).

    The templates are a short list, so they are exploded where the entities are.
    """
    made = entities.withColumn("template", F.explode(F.array(*map(F.lit, templates))))
    made = made.withColumn("utterance", F.replace("template", F.lit("{name}"), F.col("name"))).withColumn("plain", normalize_utterance(F.col("utterance")))
    first = made.groupBy(household, "plain").agg(F.min_by(F.struct("utterance", key), F.struct(key, "template")).alias("f")).select(household, "plain", "f.*")
    known = reviewed.select(normalize_utterance(F.col("text")).alias("plain")).distinct()
    kept = first.join(known, "plain", "left_anti")
    kept = kept.withColumn("h", F.sha2(F.concat_ws("|", F.lit(seed), "plain"), 256))
    place = F.row_number().over(Window.partitionBy(household).orderBy("h"))
    return kept.withColumn("place", place).where(F.col("place") <= cap).select(household, key, "utterance")


def catalogue(tools: DataFrame, scripts: DataFrame, removed: DataFrame, home: str) -> DataFrame:
    """Offered tools and scripts of each home without those removed."""
    return tools.select(home, "tool").unionByName(scripts.select(home, "tool")).distinct().join(removed.select(home, "tool"), [home, "tool"], "left_anti")


def unknown_removals(tools: DataFrame, scripts: DataFrame, removed: DataFrame, home: str) -> DataFrame:
    """Removals of what a home doesn't have; must be empty."""
    return removed.select(home, "tool").distinct().join(tools.select(home, "tool").unionByName(scripts.select(home, "tool")), [home, "tool"], "left_anti")


def declared_domains(parameters: Column) -> Column:
    """The domains that a tool's parameter schema names: enum or const of the property, of its items, or null."""
    at = lambda path: F.get_json_object(parameters, path)
    listed = F.coalesce(at("$.properties.domain.enum"), at("$.properties.domain.items.enum"))
    one = F.coalesce(at("$.properties.domain.const"), at("$.properties.domain.items.const"))
    return F.coalesce(F.from_json(listed, "array<string>"), F.when(one.isNotNull(), F.array(one)))


def argument_fault(unexpected: Column, wrong_type: Column, missing: Column, wrong_value: Column) -> Column:
    """The first fault of a call's arguments: unexpected names, then a wrong type, then what is missing or out of range."""
    return F.when(unexpected, "unexpected_argument").when(wrong_type, "schema_mismatch").when(missing | wrong_value, "invalid_arguments")


def chat_messages(turns: DataFrame, key: str, order: str) -> DataFrame:
    """Role-tagged messages in order, with an empty system text left out and calls as JSON with sorted keys (P23). turns: key, order, role, text, tool, args."""
    filled = turns.where((F.col("role") != "system") | (F.trim(F.coalesce("text", F.lit(""))) != ""))
    call = F.when(F.col("tool").isNotNull(), F.to_json(F.struct(canonical_json(F.col("args")).alias("arguments"), F.col("tool").alias("name"))))
    message = F.struct(F.col(order).alias("pos"), "role", F.coalesce("text", F.lit("")).alias("content"), call.alias("call"))
    return filled.groupBy(key).agg(F.array_sort(F.collect_list(message)).alias("messages"))


def first_call(results: DataFrame, key: str, order: str, success: Column, keep: list[str]) -> DataFrame:
    """The first call of each turn, and the id of the first one that succeeded (P25)."""
    return results.groupBy(key).agg(F.min_by(F.struct(*keep), order).alias("_f"), F.min_by("target", F.when(success & F.col("target").isNotNull(), F.col(order))).alias("first_success")).select(key, "_f.*", "first_success")


def completion(envelope: Column) -> dict[str, Column]:
    """Content, calls and token usage of a completion as JSON; a broken envelope gives nulls."""
    kind = "struct<choices:array<struct<message:struct<content:string,tool_calls:array<struct<id:string,function:struct<name:string,arguments:string>>>>>>,usage:struct<prompt_tokens:bigint,completion_tokens:bigint>>"
    parsed = F.from_json(envelope, kind)
    message = F.get(parsed["choices"], F.lit(0))["message"]
    calls = F.transform(message["tool_calls"], lambda c: F.struct(c["function"]["name"].alias("name"), F.from_json(c["function"]["arguments"], "map<string,string>").alias("args")))
    return {"content": message["content"], "calls": calls, "prompt_tokens": parsed["usage"]["prompt_tokens"], "completion_tokens": parsed["usage"]["completion_tokens"]}


def edited(fields: Column, drop: list[str], override: dict[str, Column]) -> Column:
    """A map with its keys in order, some dropped and some set anew."""
    rest = F.map_filter(fields, lambda k, v: ~k.isin(drop + list(override)))
    both = F.map_concat(rest, F.create_map(*(x for k, v in override.items() for x in (F.lit(k), v)))) if override else rest
    return F.map_from_entries(F.array_sort(F.map_entries(both)))


def tagged_names(cases: DataFrame, tag: str) -> DataFrame:
    """All names that cases with a tag use."""
    return cases.where(F.array_contains("tags", tag)).select(F.explode("names").alias("name")).distinct()


def names_by_domain(entities: DataFrame, by: list[str], rank: list[str], name: str) -> DataFrame:
    """Names of each domain by rank, and whether there is just one."""
    ranked = F.array_sort(F.collect_list(F.struct(*rank, name)))
    grouped = entities.groupBy(*by).agg(F.transform(ranked, lambda x: x[name]).alias("names"))
    return grouped.withColumn("only_one", F.size("names") == 1)
