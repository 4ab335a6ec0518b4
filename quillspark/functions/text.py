"""Text functions of utterances and transcripts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_utterance(text: Column) -> Column:
    """Lower-case words of a-z and 0-9 joined by a space, without opening requests and a closing "for me" (H1)."""
    words = F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, "’", "'")), "[^a-z0-9]+", " "))
    opened = F.regexp_replace(words, "^(?:(?:please|can you|could you|tell me) )+", "")
    return F.regexp_replace(opened, "(?: for me)+$", "")


def tokens(text: Column, apostrophes: bool = False) -> Column:
    """Lower-case tokens of a-z and 0-9, with apostrophes if asked for (H2)."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+" if apostrophes else "[a-z0-9]+"), F.lit(0))


def tokens_without_possessive(text: Column) -> Column:
    return F.transform(tokens(text, True), lambda t: F.regexp_replace(t, "'s$", ""))


def padded(words: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def phrase_in(phrase: Column, words: Column) -> Column:
    """Whether one token array is a contiguous part of another; an empty one isn't."""
    return (F.size(phrase) > 0) & F.contains(padded(words), padded(phrase))


def squeeze(text: Column) -> Column:
    """Lower case with white space collapsed (H3)."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def singular(token: Column) -> Column:
    """A naive singular (H8)."""
    n = F.length(token)
    return (
        F.when((n > 4) & token.endswith("ies"), F.concat(token.substr(F.lit(1), n - 3), F.lit("y")))
        .when((n > 3) & token.endswith("es"), token.substr(F.lit(1), n - 2))
        .when((n > 3) & token.endswith("s") & ~token.endswith("ss"), token.substr(F.lit(1), n - 1))
        .otherwise(token)
    )


def names_domain(token: Column, domain: Column) -> Column:
    """Whether a token is a domain, a plural of it, or has it as singular (H8)."""
    return (token == domain) | (token == F.concat(domain, F.lit("s"))) | (token == F.concat(domain, F.lit("es"))) | (singular(token) == domain)


def character_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edit distance over the reference's length; for an empty one 0 if both are, else 1."""
    return F.when(F.length(reference) == 0, F.when(F.length(hypothesis) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(reference, hypothesis) / F.length(reference))


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edit distance of two token arrays over the reference's size.

    One row of the distance table is folded over the reference's tokens, each new row over the
    hypothesis's, so it stays in the JVM.
    """

    def next_row(row: Column, token: Column) -> Column:
        first = F.array(F.element_at(row, 1) + 1)
        cells = F.sequence(F.lit(1), F.size(hypothesis))

        def cell(out: Column, j: Column) -> Column:
            change = F.when(F.element_at(hypothesis, j) == token, 0).otherwise(1)
            best = F.least(F.element_at(row, j + 1) + 1, F.element_at(out, -1) + 1, F.element_at(row, j) + change)
            return F.array_append(out, best)

        return F.when(F.size(hypothesis) == 0, first).otherwise(F.aggregate(cells, first, cell))

    start = F.sequence(F.lit(0), F.size(hypothesis))
    distance = F.element_at(F.aggregate(reference, start, next_row), -1)
    return F.when(F.size(reference) == 0, F.when(F.size(hypothesis) == 0, 0.0).otherwise(1.0)).otherwise(distance / F.size(reference))


def missing_first_word(expected: Column, actual: Column) -> Column:
    """Whether the first expected word isn't among the first two actual ones."""
    return (F.size(expected) > 0) & ~F.coalesce(F.array_contains(F.slice(actual, 1, 2), F.get(expected, F.lit(0))), F.lit(False))


def transcript_matches(expected: Column, actual: Column) -> Column:
    """Equal or contained, after squeezing."""
    return F.contains(squeeze(actual), squeeze(expected))


def mentions(text: Column, word: Column) -> Column:
    """Whether a text holds a word as a whole token."""
    return phrase_in(tokens(word), tokens(text))


def slug(text: Column) -> Column:
    """Lower-case letters, digits and hyphens for a safe name."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def sub_spans(words: Column, widest: int | None = None) -> Column:
    """All contiguous parts of a token array, or those of some words at most, by their start and then shortest first."""
    most = lambda n, i: n - i + 1 if widest is None else F.least(n - i + 1, F.lit(widest))

    def spans(words: Column) -> Column:
        n = F.size(words)
        each = F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), most(n, i)), lambda k: F.slice(words, i, k)))
        return F.when(n > 0, F.flatten(each)).otherwise(F.array().cast("array<array<string>>"))

    return F.get(F.transform(F.array(words), spans), F.lit(0))  # the array is worked out once, not for every span


def last_name(qualified: Column, separator: str = "__") -> Column:
    """What follows the last separator."""
    return F.element_at(F.split(qualified, separator), -1)


def change_title(title: Column) -> dict[str, Column]:
    """Kind, scope, whether it breaks and subject of a title like kind(scope)!: subject; null for another one."""
    pattern = r"^([a-z]+)(?:\(([^()]+)\))?(!?): (\S.*)$"
    ok = title.rlike(pattern)
    part = lambda i: F.when(ok, F.regexp_extract(title, pattern, i))
    return {"kind": part(1), "scope": F.nullif(part(2), F.lit("")), "breaking": F.coalesce(part(3) == "!", F.lit(False)), "subject": part(4)}


def sentence_case(text: Column) -> Column:
    """A text with its first letter in upper case."""
    return F.concat(F.upper(text.substr(1, 1)), F.substring(text, 2, 1 << 30))


def number_article(number: Column) -> Column:
    """The article before a number: "an" before eight, eleven, eighteen and what begins with eight."""
    return F.when(number.cast("string").startswith("8") | number.isin(11, 18), "an").otherwise("a")


def is_plural(text: Column) -> Column:
    """Whether the last word ends in s, but not in a possessive."""
    last = F.element_at(F.split(F.trim(text), r"\s+"), -1)
    return last.endswith("s") & ~last.endswith("'s")


def loose_words(text: Column) -> Column:
    """Lower case with all but letters, digits, underscores, apostrophes and white space as a space (H3)."""
    return squeeze(F.regexp_replace(text, r"[^\w\s']", " "))


def letter_word(word: Column) -> Column:
    """A word's lower-case letters and apostrophes (H3)."""
    return F.regexp_replace(F.lower(word), "[^a-z']", "")


def without_lines(text: Column, patterns: list[str]) -> Column:
    """A text without the lines that begin with one of the patterns."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~line.rlike("^(?:" + "|".join(patterns) + ")")), "\n")


def area_lines(satellite: Column, target: Column, source: Column) -> Column:
    """The lines that tell a model about areas."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    some = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "none").otherwise(c)
    return F.concat_ws("\n", F.lit("Area context:"), line("satellite_area", some(satellite)), line("target_area", some(target)), line("target_area_source", source))


def heard(text: Column, label: Column) -> Column:
    """Whether a normalized utterance holds a normalized label as whole words."""
    framed = lambda c: F.concat(F.lit(" "), normalize_utterance(c), F.lit(" "))
    return F.contains(framed(text), framed(label))


def literal(text: Column, labels: Column) -> Column:
    """Whether an utterance says a label of every target that has some (H43). labels: an array of labels for each call."""
    return F.forall(labels, lambda some: (F.size(some) == 0) | F.exists(some, lambda one: heard(text, one)))


def answer_key(text: Column, kind: Column, calls: Column, candidates: Column, missing: Column) -> Column:
    """A key that cases with one utterance and one answer share."""
    answer = F.struct(calls.alias("calls"), F.array_sort(candidates).alias("candidates"), kind.alias("response_type"), missing.alias("unavailable"))
    return F.concat_ws("|", normalize_utterance(text), F.to_json(answer))
