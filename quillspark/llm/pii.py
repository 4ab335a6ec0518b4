"""Personal data: patterns of four base kinds, and contextual extraction bootstrapped from them.

Base kinds are found by regular expressions and checks. Their matches, and long hexadecimal keys,
are the seeds of the method: every seed, and every other word that looks like an identifier, is
an instance with two patterns, its two words before, and its words before and after. Seeds score
1. A pattern scores the mean of its known distinct instances' scores, drawn to 0 by one more and by
a twentieth for each unknown one. A pattern of high score with several known instances is trusted;
what it matches is known from then on, and scores as the best pattern that found it. Rounds of
joins go on until nothing new is found; identifiers in trusted patterns are then spans as well.
That holds for the keys too: a key in no trusted pattern, such as a checksum in prose, is none.

All of it is DataFrame functions: no text leaves the JVM, none is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Written

#: The base kinds in their order. Same matches as the plain expressions
#: email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+, ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+),
#: card [0-9]([\x20-]?[0-9])+ and phone \+[0-9][\x20().0-9-]+[0-9], but without trying a run of
#: characters again from each of its characters, and without recursion on long runs.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for at all.
HINTS = {"email": "@", "phone": "+"}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: A word of letters, digits, hyphens and underscores with two digits and six characters at least.
IDENTIFIER = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9][A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{6,}+"
KEY = r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$"
LEAST_SCORE = 0.75
LEAST_SUPPORT = 3
#: What an identifier not found so far counts against a pattern, where a seed counts 1 for it.
#: With none, seeds / (seeds + 1) would be the trust of any pattern, whatever else it matches;
#: so a pattern with many seeds is trusted up to 6.7 times as many others.
UNSEEN = 0.05
MOST_ROUNDS = 60
CONTEXT = 64
#: Items that a sweep gathers at a time, and code points of a piece of a text.
SWEEP = 128
BLOCK = 4096
_SPACE = r"[\x20\x09-\x0D]+"


def _matches(text: str, pattern: str, hint: str | None) -> tuple[Column, Column]:
    """The matches of a pattern and the texts between them, by the same search."""
    t, p = F.col(text), F.lit(pattern)
    found, gaps = F.regexp_extract_all(t, p, F.lit(0)), F.split(t, pattern, -1)
    if hint:
        some = F.contains(t, F.lit(hint))
        found, gaps = F.when(some, found).otherwise(F.array().cast("array<string>")), F.when(some, gaps).otherwise(F.array().cast("array<string>"))
    return found, gaps


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used, lambdas included."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _swept(items: Column, zero: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column]) -> Column:
    """emit(state, x) of each item in order, where state, an integer, is zero folded by step over the items before.

    A fold copies what it gathers at each step, so it gathers the states alone, first one for each
    block of items and then, block by block, one for each item; that keeps the time near to
    proportional to the items.
    """
    none = F.array().cast("array<int>")

    def of(all_: Column) -> Column:
        places = F.when(F.size(all_) > 0, F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / SWEEP).cast("int"))).otherwise(none)
        return _bound(F.transform(places, lambda i: F.slice(all_, i * SWEEP + 1, SWEEP)), blocks)

    def blocks(parts: Column) -> Column:
        starts = F.aggregate(parts, F.struct(zero.alias("s"), none.alias("out")), lambda a, part: F.struct(F.aggregate(part, a["s"], step).alias("s"), F.array_append(a["out"], a["s"]).alias("out")))["out"]
        return F.flatten(F.zip_with(parts, starts, block))

    def block(part: Column, start: Column) -> Column:
        states = F.aggregate(part, F.struct(start.alias("s"), none.alias("out")), lambda a, x: F.struct(step(a["s"], x).alias("s"), F.array_append(a["out"], a["s"]).alias("out")))["out"]
        return F.zip_with(part, states, lambda x, s: emit(s, x))

    return _bound(items, of)


def _places(kind: str) -> Column:
    """Structs of first code point, end and text of each match, from the columns that _matches gave."""
    pairs = F.zip_with(F.slice(F.col(f"{kind}_gaps"), 1, F.size(f"{kind}_found")), f"{kind}_found", lambda g, v: F.struct(F.length(g).alias("gap"), F.length(v).alias("own"), v.alias("value")))

    def span(at: Column, x: Column) -> Column:
        return F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["own"]).alias("end"), x["value"].alias("value"))

    return _swept(pairs, F.lit(0), lambda at, x: at + x["gap"] + x["own"], span)


def _blocks(text: Column) -> Column:
    """A text cut every BLOCK code points, since a place in a text is found by counting from its start."""
    return F.when(F.length(text) > BLOCK, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))).otherwise(F.array(text))


def _cut(blocks: Column, lo: Column, hi: Column) -> Column:
    """The code points from lo to hi of a text that _blocks has cut."""
    first, last = F.floor(lo / BLOCK).cast("int"), F.floor(hi / BLOCK).cast("int")
    ends = F.concat(F.get(blocks, first).substr(lo % BLOCK + 1, F.lit(BLOCK)), F.array_join(F.slice(blocks, first + 2, last - first - 1), ""), F.coalesce(F.get(blocks, last).substr(F.lit(1), hi % BLOCK), F.lit("")))
    return F.when(lo >= hi, "").when(first == last, F.get(blocks, first).substr(lo % BLOCK + 1, hi - lo)).otherwise(ends)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of a text pass the Luhn check."""
    digits = F.reverse(_digits(value))
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: _luhn_part(digits.substr(i, F.lit(1)).cast("int"), i))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _luhn_part(digit: Column, place: Column) -> Column:
    doubled = digit * 2
    return F.when(place % 2 == 1, digit).otherwise(F.when(doubled > 9, doubled - 9).otherwise(doubled))


def _valid(kind: str) -> Callable[[Column], Column]:
    """Of a struct with a match as value, whether it holds as one of its kind."""
    if kind == "ip":
        return lambda x: x["value"].rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    if kind == "card":
        return lambda x: F.length(_digits(x["value"])).between(13, 19) & luhn(x["value"])
    if kind == "phone":
        return lambda x: F.length(_digits(x["value"])).between(9, 15)
    return lambda x: F.lit(True)


def base_spans(docs: DataFrame) -> DataFrame:
    """docs with an array column for each base kind: structs of start, end (code points, end exclusive) and value."""
    cols = docs.columns
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    found = {k: _matches("text", p, HINTS.get(k)) for k, p in BASE.items()}
    docs = docs.select("*", *(c.alias(f"{k}_{n}") for k, pair in found.items() for c, n in zip(pair, ("found", "gaps"), strict=True)))
    return docs.select(*cols, *(F.filter(_places(k), _valid(k)).alias(k) for k in BASE))


def _instances(docs: DataFrame) -> Column:
    """Seeds and other identifiers of a text that base_spans has read; of these, the ones that overlap no span."""
    def event(at: str, base: int) -> Callable[[Column], Column]:
        return lambda x: F.struct(x[at].alias("at"), F.lit(base).alias("base"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"))

    # an identifier comes after the spans that begin before its end, and overlaps one if one of them ends after its start
    events = F.array_sort(F.concat(F.transform(F.concat(*(F.col(k) for k in BASE)), event("start", 1)), F.transform("id_places", event("end", 0))))

    def told(until: Column, x: Column) -> Column:
        base = x["base"] == 1
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lower(x["value"]).alias("value"), base.alias("base"), (base | x["value"].rlike(KEY)).alias("seed"), (base | (until <= x["start"])).alias("free"))

    swept = _swept(events, F.lit(0), lambda until, x: F.when(x["base"] == 1, F.greatest(until, x["end"])).otherwise(until), told)
    return F.filter(swept, lambda x: x["free"])


def _context(x: Column, blocks: Column) -> Column:
    first = F.greatest(x["start"] - CONTEXT, F.lit(0))
    left = F.lower(_cut(blocks, first, x["start"]))
    words = F.filter(F.split(F.regexp_replace(left, "[0-9]+", "0"), _SPACE), lambda w: w != "")
    right = F.regexp_extract(F.regexp_replace(F.lower(_cut(blocks, x["end"], x["end"] + CONTEXT)), "[0-9]+", "0"), r"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]*)", 1)

    def patterns(words: Column) -> Column:
        n = F.size(words)
        before = F.when(n >= 2, F.concat(F.lit("l:"), F.element_at(words, -2), F.lit(" "), F.element_at(words, -1)))
        around = F.when(n >= 1, F.concat(F.lit("b:"), F.element_at(words, -1), F.lit(" _ "), right))
        return F.array_compact(F.array(before, around))

    return _bound(words, patterns)


def _trusted(edges: DataFrame) -> DataFrame:
    """The trusted patterns of edges (pattern, value, seed).

    A value's score is the best trust among the patterns of the round that first found it, and
    stays. All that counts as support scores LEAST_SCORE or more, so a trusted pattern stays
    trusted, and a round that finds nothing new is the fixed point.
    """
    scores = Written(edges.select("value", F.lit(1.0).alias("score")).limit(0), "scores")
    for _ in range(MOST_ROUNDS):
        known = edges.join(scores.df, "value", "left").withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.col("score")))
        support = F.count("score")
        trust = F.round(F.sum("score") / (support + UNSEEN * (F.count("*") - support) + 1), 9)
        patterns = Written(known.groupBy("pattern").agg(support.alias("support"), trust.alias("trust")).where((F.col("support") >= LEAST_SUPPORT) & (F.col("trust") >= LEAST_SCORE)), "patterns")
        found = edges.where("NOT seed").join(patterns.df, "pattern").join(scores.df, "value", "left_anti").groupBy("value").agg(F.max("trust").alias("score"))
        new = Written(found, "scores")
        if new.df.isEmpty():
            for x in (new, scores):
                x.drop()
            return patterns.df
        both = Written(scores.df.unionByName(new.df), "scores")
        for x in (patterns, new, scores):
            x.drop()
        scores = both
    raise RuntimeError(f"patterns did not settle in {MOST_ROUNDS} rounds")


def find(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id, the arrays of base_spans and found, an array of the spans the method adds, of every document; if whole, its columns as doc.

    docs has doc_id and text; other columns don't count. Null texts count as empty. Repeated rows
    each keep theirs and count once as evidence. An empty table gives no rows.
    """
    more = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")] if whole else []
    read = base_spans(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more))
    ids, gaps = _matches("text", IDENTIFIER, None)
    read = read.withColumns({"id_found": ids, "id_gaps": gaps}).withColumn("id_places", _places("id"))
    read = read.withColumn("instances", _instances(read))
    read = read.withColumn("instances", _bound(_blocks(F.col("text")), lambda b: F.transform("instances", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), x["base"].alias("base"), x["seed"].alias("seed"), _context(x, b).alias("patterns")))))
    rows = Written(read.select(F.monotonically_increasing_id().alias("row"), "doc_id", *BASE, "instances", *(["doc"] if whole else [])), "spans").df

    each = rows.select("row", F.explode("instances").alias("i")).select("row", "i.*")
    edges = each.select("value", "seed", F.explode("patterns").alias("pattern"))
    edges = Written(edges.groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "edges")
    trusted = _trusted(edges.df).select("pattern")
    edges.drop()
    open_ = each.where("NOT base").select("row", "start", "end", "value", F.explode("patterns").alias("pattern"))
    new = open_.join(trusted, "pattern").select("row", "start", "end", "value").distinct()
    new = new.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "value"))).alias("found"))
    out = rows.join(new, "row", "left")
    found = F.coalesce("found", F.array().cast("array<struct<start:int,end:int,value:string>>"))
    return out.select("doc_id", *BASE, found.alias("found"), *(["doc"] if whole else []))


def _written(kind: str, column: str) -> Column:
    return F.transform(column, lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")))


def op8(docs: DataFrame) -> DataFrame:
    """The counts and digests of find's spans; n_patterns: spans that patterns alone found, n_spans: all of them."""
    found = find(docs)
    base = F.concat(*(_written(k, k) for k in BASE))
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, _written("id", "found")), ",").alias("spans"),
        F.size("found").cast("long").alias("n_patterns"),
        (F.size("found") + sum(F.size(k) for k in BASE)).cast("long").alias("n_spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of a text replaced by its kind in angle brackets, and n_chars, if there, renewed.

    Of overlapping spans the earlier and longer stays. Null texts stay null; rows may repeat and
    doc_id may be null.
    """
    found = find(docs, whole=True)
    tag = lambda kind: lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), F.lit(f"<{kind.upper()}>").alias("tag"))
    spans = F.array_sort(F.concat(*(F.transform(k, tag(k)) for k in BASE), F.transform("found", tag("id"))))
    plan = _swept(
        spans, F.lit(0), lambda at, x: F.when(x["start"] < at, at).otherwise(-x["back"]),
        lambda at, x: F.struct((x["start"] >= at).alias("keep"), at.alias("lo"), x["start"].alias("hi"), (-x["back"]).alias("end"), x["tag"].alias("tag")),
    )
    text = F.col("doc.text")

    def joined(blocks: Column) -> Column:
        pieces = F.transform("plan", lambda x: F.concat(_cut(blocks, x["lo"], x["hi"]), x["tag"]))
        return F.concat(F.array_join(pieces, ""), _cut(blocks, F.element_at("plan", -1)["end"], F.length(text)))

    new = F.when(F.size("plan") == 0, text).otherwise(_bound(_blocks(text), joined))
    out = found.select("doc", F.filter(plan, lambda x: x["keep"]).alias("plan")).select("doc", new.alias("new"))
    renewed = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        renewed["n_chars"] = F.length("new").cast(docs.schema["n_chars"].dataType)
    return out.select(*(renewed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))
