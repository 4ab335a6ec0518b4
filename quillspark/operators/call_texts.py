"""Call texts such as [turn(name='it's', levels=[1, [2]]), stop()] as names and JSON arguments.

A text is cut into tokens by one regular expression, each token is written as its piece of JSON,
and Spark's own JSON parser tells whether the pieces of a call fit. So brackets nest as deep as
they like, nothing recurses here and nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.operators.schemas import bound

#: A quote ends a text only before one of these; any other quote is part of it.
_CLOSES = r"(?=[,)\]}])"


def _quoted(q: str) -> str:
    return rf"{q}[^{q}]*+(?:{q}(?![,)\]}}])[^{q}]*+)*+{q}{_CLOSES}"


#: The last ones take what has no place at once, a text that isn't closed to the end, so that no part is searched again and again.
_TOKEN = "(?s)" + "|".join([_quoted("'"), _quoted('"'), "[A-Za-z][A-Za-z0-9_]*+\\(", "[A-Za-z_][A-Za-z0-9_]*+=", "[-0-9]++", "True", "False", "None", "\\s++", "[A-Za-z_][A-Za-z0-9_]*+", "['\"].*+", "."])
#: Ends of a call and of its name in what is joined; JSON never holds them as they are.
_END, _NAME = "\x01", "\x02"


def _kind(token: Column) -> Column:
    """A letter for each kind of token: C call, K key, V value, R right bracket of a call, M comma, B brackets of lists, Z what has no place."""
    first, n = token.substr(F.lit(1), F.lit(1)), F.length(token)
    return (
        F.when(first.isin("'", '"') & (n > 1), "V")
        .when(first.rlike("[-0-9]"), "V")
        .when(token.isin("True", "False", "None"), "V")
        .when(token.endswith("(") & (n > 1), "C")
        .when(token.endswith("=") & (n > 1), "K")
        .when(token == ")", "R")
        .when(token == ",", "M")
        .when(token.isin("[", "]"), "B")
        .otherwise("Z")
    )


def _json(token: Column, kind: Column) -> Column:
    n = F.length(token)
    value = (
        F.when(token == "True", "true").when(token == "False", "false").when(token == "None", "null")
        .when(token.rlike("^[-0-9]"), F.regexp_replace(token, "^(-?)0+(?=[0-9])", "$1"))
        .otherwise(bound(F.to_json(F.array(token.substr(F.lit(2), n - 2))), lambda x: x.substr(F.lit(2), F.length(x) - 2)))
    )
    return (
        F.when(kind == "V", value)
        .when(kind == "C", F.concat(token.substr(F.lit(1), n - 1), F.lit(_NAME + "{")))
        .when(kind == "K", F.concat(F.lit('"'), token.substr(F.lit(1), n - 1), F.lit('":')))
        .when(kind == "R", "}" + _END)
        .otherwise(token)
    )


def parse_calls(text: Column) -> Column:
    """The calls of a text in order, as an array of name and arguments (JSON text, in the order given); null if the text is malformed.

    A text is a call, several with commas between, or a list of these; an empty one has none. A
    call has a name and keyword arguments; a value is a text in single or double quotes, an
    integer, True, False, None or a list of values. A quote within a text is part of it unless
    one of , ) ] } follows; a backslash is a character like others. Brackets in texts don't
    count. A call that has an argument twice is malformed; so is a null text.
    """
    stripped = F.regexp_replace(text, r"^\s+|\s+$", "")
    listed = stripped.startswith("[") & stripped.endswith("]") & (F.length(stripped) > 1)
    body = F.when(listed, F.regexp_replace(stripped.substr(F.lit(2), F.length(stripped) - 2), r"^\s+|\s+$", "")).otherwise(stripped)
    tokens = F.filter(F.regexp_extract_all(body, F.lit(_TOKEN), F.lit(0)), lambda t: F.trim(F.regexp_replace(t, r"\s", "")) != "")

    def of(tokens: Column) -> Column:
        return bound(F.transform(tokens, lambda t: bound(_kind(t), lambda k: F.struct(k.alias("kind"), _json(t, k).alias("json")))), read)

    def read(typed: Column) -> Column:
        pieces = F.split(F.array_join(F.transform(typed, lambda x: x["json"]), ""), f"{_END},?")
        calls = F.transform(F.filter(pieces, lambda p: p != ""), lambda p: F.struct(F.substring_index(p, _NAME, 1).alias("name"), F.substring_index(p, _NAME, -1).alias("arguments")))
        return bound(F.array_join(F.transform(typed, lambda x: x["kind"]), ""), lambda kinds: bound(calls, lambda c: fitting(kinds, c)))

    def fitting(kinds: Column, calls: Column) -> Column:
        fits = ~F.contains(kinds, F.lit("VV")) & kinds.rlike("^(?:C[KVMB]*+R(?:MC[KVMB]*+R)*+M?)?$") & F.forall(calls, lambda c: F.try_parse_json(c["arguments"]).isNotNull())
        return F.when(fits, calls)

    return bound(tokens, of)
