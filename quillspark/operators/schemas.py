"""JSON-schema checks of tool calls over VARIANT.

A schema is compiled to one Column expression, so a job has one expression for each distinct
schema and Spark evaluates it where the calls are; there is no Python on the way. Of a schema
these words count: type, enum, minimum, maximum, items, anyOf and, for arguments, properties
and required.

Arguments that are no JSON object, null among them, and objects with a repeated name are
faulty as a whole. An integer is a JSON number written without fraction; true and false are
no numbers, though in an enum they equal 1 and 0. Bounds are compared as doubles.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a type's name reads the kinds that kind() tells.
_KINDS = {"string": ["string"], "integer": ["integer"], "number": ["integer", "number"], "boolean": ["boolean"], "array": ["array"], "object": ["object"]}


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def kind(value: Column) -> Column:
    """null, boolean, integer, number, string, array or object of a variant; null if it is missing."""

    def of(schema: Column) -> Column:
        name = F.regexp_extract(schema, "^[A-Z]+", 0)
        return (
            F.when((name == "BIGINT") | schema.rlike(r"^DECIMAL\((19|[23][0-9]),0\)$"), "integer")  # integers beyond 64 bits are decimals
            .when(name.isin("DECIMAL", "DOUBLE", "FLOAT"), "number")
            .when(name == "VOID", "null")
            .otherwise(F.lower(name))
        )

    return bound(F.schema_of_variant(value), of)


def _literal_of(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _listed(value: Column, of: Column, choices: list[Any]) -> Column:
    """Whether a value is among the choices."""
    texts = [c for c in choices if isinstance(c, str)]
    numbers = [float(c) for c in choices if isinstance(c, (bool, int, float))]
    nested = [_literal_of(c) for c in choices if isinstance(c, (list, dict))]
    number = F.when(of == "boolean", F.try_variant_get(value, "$", "boolean").cast("double")).otherwise(F.try_variant_get(value, "$", "double"))
    found = F.lit(False)
    if texts:
        found = found | (of == "string") & F.try_variant_get(value, "$", "string").isin(texts)
    if numbers:
        found = found | of.isin("integer", "number", "boolean") & number.isin(numbers)
    if nested:
        found = found | of.isin("array", "object") & F.to_json(value).isin(nested)
    return found | (of == "null") if None in choices else found


def value_error(schema: Mapping[str, Any], value: Column, path: Column) -> Column:
    """The first thing wrong with a variant by a schema, null if nothing: type, enum, bounds, then items in order."""
    if "anyOf" in schema and "type" not in schema:
        options = [value_error(o, value, path) for o in schema["anyOf"] if isinstance(o, Mapping)]
        if not options:
            return F.lit(None).cast("string")
        none = options[0].isNotNull()
        for o in options[1:]:
            none = none & o.isNotNull()
        return F.when(none, F.concat(path, F.lit(" matches none of the allowed shapes")))
    return bound(value, lambda v: bound(kind(v), lambda of: _error(schema, v, of, path)))


def _error(schema: Mapping[str, Any], value: Column, of: Column, path: Column) -> Column:
    rules: list[tuple[Column, Column]] = []
    if schema.get("type") in _KINDS:
        rules.append((~of.isin(_KINDS[schema["type"]]), F.lit(f" must be {schema['type']}")))
    if "enum" in schema:
        rules.append((~_listed(value, of, schema["enum"]), F.lit(f" must be one of {schema['enum']}")))
    number = F.when(of.isin("integer", "number"), F.try_variant_get(value, "$", "double"))
    if "minimum" in schema:
        rules.append((number < schema["minimum"], F.lit(f" is below {schema['minimum']}")))
    if "maximum" in schema:
        rules.append((number > schema["maximum"], F.lit(f" is above {schema['maximum']}")))
    error = F.coalesce(*(F.when(wrong, F.concat(path, said)) for wrong, said in rules), F.lit(None).cast("string"))
    if isinstance(schema.get("items"), Mapping):
        each = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x, i: value_error(schema["items"], x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        error = F.coalesce(error, F.when(of == "array", _first(each)))
    return error


def _first(errors: Column) -> Column:
    return F.get(F.filter(errors, lambda e: e.isNotNull()), F.lit(0))


def _shown(names: Column) -> Column:
    """A list of texts as the messages show it: quoted by ', by " if a text holds ' alone."""

    def quoted(n: Column) -> Column:
        plain = F.replace(n, F.lit("\\"), F.lit("\\\\"))
        return F.when(n.contains("'") & ~n.contains('"'), F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))

    return F.concat(F.lit("["), F.array_join(F.transform(names, quoted), ", "), F.lit("]"))


def _property(arguments: Column, name: str) -> Column:
    return F.try_variant_get(arguments, f'$["{name}"]' if "'" in name else f"$['{name}']", "variant")


class _Checks:
    """What there is to say about the arguments (JSON text) of a call by its tool's parameters, each null if all is well."""

    def __init__(self, parameters: Mapping[str, Any], parsed: Column, names: Column):
        properties = parameters.get("properties") or {}
        self.no_object = F.when(parsed.isNull() | names.isNull(), "arguments must be an object")
        extra = F.array_sort(F.array_distinct(F.filter(names, lambda n: ~n.isin(list(properties))) if properties else names))
        self.unexpected = F.when(F.size(extra) > 0, F.concat(F.lit("unexpected argument(s): "), _shown(extra)))
        gone = F.array_except(F.array(*map(F.lit, sorted(set(parameters.get("required") or [])))).cast("array<string>"), names)
        self.missing = F.when(F.size(gone) > 0, F.concat(F.lit("missing required argument(s): "), _shown(gone)))
        groups = [o.get("required") or [] for o in parameters.get("anyOf") or [] if isinstance(o, Mapping)]
        none = F.lit(bool(groups))
        for g in groups:
            none = none & (F.size(F.array_except(F.array(*map(F.lit, g)).cast("array<string>"), names)) > 0)
        self.no_group = F.when(none, f"needs one of the argument sets {groups}")
        errors = {p: value_error(s, _property(parsed, p), F.lit(p)) for p, s in properties.items()}

        def of(name: Column) -> Column:
            found = F.lit(None).cast("string")
            for p, error in errors.items():
                found = F.when(name == p, error).otherwise(found)
            return found

        self.value = _first(F.transform(names, of))


def _by_schema(tools: Mapping[str, Mapping[str, Any]], tool: Column, make: Any) -> Column:
    """make(parameters) for the rows of each distinct schema, null for unknown tools."""
    names: dict[str, list[str]] = {}
    for name, parameters in tools.items():
        names.setdefault(_literal_of(parameters or {}), []).append(name)
    out = None
    for text, group in names.items():
        here = tool.isin(group)
        out = F.when(here, make(json.loads(text))) if out is None else out.when(here, make(json.loads(text)))
    return F.lit(None).cast("struct<code:string,message:string>") if out is None else out


def _parsed(calls: DataFrame) -> DataFrame:
    """calls with _parsed and _names, the arguments and their names, worked out once for all rules."""
    return calls.withColumns({"_parsed": F.try_parse_json("arguments"), "_names": F.json_object_keys("arguments")})


def _said(code: str, message: Column) -> Column:
    return F.when(message.isNotNull(), F.struct(F.lit(code).alias("code"), message.alias("message")))


def check_calls(calls: DataFrame, tools: Mapping[str, Mapping[str, Any]], exposed: str | None = None) -> DataFrame:
    """calls (tool, arguments as JSON text, and more) with code and message of the first rule that a call breaks, or nulls.

    tools: each tool's parameters. In order: unknown tool; arguments that are no object;
    unexpected, then missing names, then no complete set of anyOf (schema_mismatch); the first
    wrong value in the order of the call, then domains that aren't in the array column exposed
    (invalid_arguments). Columns code and message of calls are replaced.
    """
    tool = F.col("tool")
    unknown = F.when(tool.isNull() | ~tool.isin(list(tools)), F.concat(F.lit("tool "), F.coalesce(tool, F.lit("None")), F.lit(" is not offered")))

    def first(parameters: Mapping[str, Any]) -> Column:
        c = _Checks(parameters, F.col("_parsed"), F.col("_names"))
        mismatch = F.coalesce(c.unexpected, c.missing, c.no_group)
        return F.coalesce(_said("invalid_arguments", c.no_object), _said("schema_mismatch", mismatch), _said("invalid_arguments", c.value))

    found = F.coalesce(_said("unknown_tool", unknown), _by_schema(tools, tool, first))
    if exposed is not None:
        domain = F.try_variant_get(F.col("_parsed"), "$.domain", "variant")
        named = F.when(kind(domain) == "array", F.try_variant_get(domain, "$", "array<variant>")).when(domain.isNotNull(), F.array(domain))
        hidden = F.filter(F.transform(named, lambda d: F.struct((kind(d) == "string").alias("text"), F.coalesce(F.try_variant_get(d, "$", "string"), F.to_json(d)).alias("name"))), lambda d: ~(d["text"] & F.array_contains(exposed, d["name"])))
        message = F.concat(F.lit("domain(s) "), _shown(F.transform(hidden, lambda d: d["name"])), F.lit(" are not exposed"))
        found = F.coalesce(found, _said("invalid_arguments", F.when(F.col(exposed).isNotNull() & (F.size(hidden) > 0), message)))
    return _parsed(calls.drop("code", "message")).withColumn("_found", found).select(*(c for c in calls.columns if c not in ("code", "message")), F.col("_found.code").alias("code"), F.col("_found.message").alias("message"))


def argument_failures(calls: DataFrame, tools: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """calls of known tools with the code by which their arguments fail as a whole, or null.

    Names that the schema doesn't have come first (schema_mismatch). All else is looked at
    together: one wrong value anywhere makes it invalid_arguments, only names that are missing
    make it schema_mismatch. Unknown tools have no code.
    """

    def worst(parameters: Mapping[str, Any]) -> Column:
        c = _Checks(parameters, F.col("_parsed"), F.col("_names"))
        return F.coalesce(_said("invalid_arguments", c.no_object), _said("schema_mismatch", c.unexpected), _said("invalid_arguments", c.value), _said("schema_mismatch", F.coalesce(c.missing, c.no_group)))

    return _parsed(calls).withColumn("failure", _by_schema(tools, F.col("tool"), worst)["code"]).drop("_parsed", "_names")
