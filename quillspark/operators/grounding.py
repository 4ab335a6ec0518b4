"""Areas and entities that an utterance names: greedy phrases, area resolution, similarity scores, grounding."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from quillspark.functions.text import tokens
from quillspark.operators.lexical import with_checkpoints

#: Texts with the areas they name up to which each task gets them all.
LISTED_TEXTS = 100_000
#: Words that tell no entity apart, and nouns with the domain they stand for.
GENERIC = ["the", "tv", "light", "lights", "lamp", "switch", "plug", "fan", "speaker", "volume"]
NOUN = {"light": "light", "lights": "light", "lamp": "light", "lamps": "light", "tv": "media_player", "fan": "fan", "volume": "media_player"}
#: Words that confirm, that decline, and that say neither.
YES = ["yes", "yeah", "yep", "yup", "sure", "correct", "ok", "okay"]
NO = ["no", "nope", "nah", "cancel", "neither", "never", "mind", "stop"]
FILLER = ["the", "it", "that", "one", "please", "do", "thanks", "thank", "you"]
LEAST_RATIO, SATELLITE_BONUS, GENERIC_SUPPORT, GROUNDED_SUPPORT = 0.6, 0.2, 0.3, 0.5
#: Tools whose calls need no name.
NAMELESS = ["GetLiveContext", "GetDateTime"]


def words(text: Column) -> Column:
    """Lower-case tokens of a-z, 0-9 and apostrophes, without a possessive ending."""
    return tokens(F.replace(F.lower(text), F.lit("'s"), F.lit("")), True)


def occurrences(utterances: DataFrame, phrases: DataFrame, key: str, text: str, phrase: str) -> DataFrame:
    """Every place of every phrase: the utterance's key, start, width and the phrase's columns.

    Both sides meet by the phrase's first token; the rest is tested where they have met.
    """
    said = utterances.select(key, words(F.col(text)).alias("_words"))
    heads = said.select(key, F.posexplode("_words").alias("start", "_head"), "_words")
    named = phrases.withColumn("_phrase", words(F.col(phrase))).withColumn("_head", F.get("_phrase", F.lit(0))).where("_head IS NOT NULL")
    met = heads.join(named, "_head").withColumn("width", F.size("_phrase"))
    return met.where(F.slice("_words", F.col("start") + 1, F.col("width")) == F.col("_phrase")).drop("_head", "_words", "_phrase")


def named_areas(utterances: DataFrame, areas: DataFrame, key: str, text: str) -> DataFrame:
    """key and areas: those an utterance names, in order of place, longest phrases first and none over another (H5).

    areas: area, phrase and rank, by which phrases of one length take their turn.
    """
    found = occurrences(utterances, areas, key, text, "phrase")
    kind = "array<struct<start:int,stop:int,area:string>>"

    def take(taken: Column, x: Column) -> Column:
        over = F.exists(taken, lambda t: (t["start"] < x["stop"]) & (x["start"] < t["stop"]))
        return F.when(over, taken).otherwise(F.array_append(taken, F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["area"].alias("area")))).cast(kind)

    order = F.struct((-F.col("width")).alias("w"), "rank", "start", (F.col("start") + F.col("width")).alias("stop"), "area")
    each = found.groupBy(key).agg(F.array_sort(F.collect_list(order)).alias("_all"))
    kept = F.array_sort(F.transform(F.aggregate("_all", F.array().cast(kind), take), lambda t: F.struct(t["start"], t["area"].alias("area"))))
    return each.select(key, F.array_distinct(F.transform(kept, lambda t: t["area"])).alias("areas"))


def resolved_area(utterances: DataFrame, named: DataFrame, key: str, satellite: str) -> DataFrame:
    """utterances with target_area and its source: explicit if one is named, multiple, satellite or none (H6)."""
    joined = utterances.join(named, key, "left")
    n = F.coalesce(F.size("areas"), F.lit(0))
    n = F.when(F.col("areas").isNull(), 0).otherwise(n)
    has = F.coalesce(F.col(satellite), F.lit("")) != ""
    target = F.when(n == 1, F.get("areas", F.lit(0))).when((n == 0) & has, F.col(satellite))
    source = F.when(n == 1, "explicit").when(n > 1, "multiple").when(has, "satellite").otherwise("none")
    return joined.withColumns({"target_area": target, "area_source": source}).drop("areas")


def longest_area(utterances: DataFrame, areas: DataFrame, key: str, text: str) -> DataFrame:
    """key and area: the one with the longest phrase in an utterance, of equal ones the first (H7)."""
    found = occurrences(utterances, areas, key, text, "phrase")
    return found.groupBy(key).agg(F.min_by("area", F.struct((-F.col("width")).alias("w"), "rank", "start")).alias("area"))


#: Characters from rare to frequent, so that few words share those looked at first.
_RARITY = "'0123456789qjzxvkwyfbghmpduclsntoirae"


def _letters(word: Column) -> Column:
    """A word's characters from rare to frequent, each with its number among equal ones."""
    n = F.length(word)
    rare = F.array_sort(F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.instr(F.lit(_RARITY), word.substr(i, F.lit(1))).alias("rank"), word.substr(i, F.lit(1)).alias("c"))))
    return F.transform(rare, lambda x, i: F.concat(x["c"], (i - F.array_position(rare, x) + 1).cast("string")))


@pandas_udf(DoubleType())
def _matching(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the characters in matching blocks, found longest first, over all characters; no built-in function finds such blocks."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def similar_words(own: DataFrame, heard: DataFrame) -> DataFrame:
    """a, b and ratio of all pairs of a word of own and one of heard (columns word) with a ratio of LEAST_RATIO or more.

    Words of m and n characters that reach it share LEAST_RATIO / 2 * (m + n) of them at least,
    hence 3 / 7 of the longer and of the shorter. So one of a word's rarest characters, all but
    3 / 7 and one more, is among the other's: words meet by these, and only distinct pairs that
    share enough characters are compared in full.
    """
    least = LEAST_RATIO / (2 - LEAST_RATIO)

    def keyed(words: DataFrame, name: str) -> DataFrame:
        words = words.select(F.col("word").alias(name)).where(F.length("word") > 0).distinct().withColumn(f"{name}_letters", _letters(F.col(name)))
        n = F.length(name)
        return words.withColumn("key", F.explode(F.slice(f"{name}_letters", 1, (n - F.ceil(n * least - 1e-9) + 1).cast("int"))))

    pairs = keyed(own, "a").join(keyed(heard, "b"), "key").drop("key")
    enough = 2 * F.size(F.array_intersect("a_letters", "b_letters")) >= LEAST_RATIO * (F.length("a") + F.length("b")) - 1e-9
    return pairs.where(enough).select("a", "b").distinct().withColumn("ratio", _matching("a", "b")).where(F.col("ratio") >= LEAST_RATIO)


@lru_cache(1 << 16)
def _alike(own: str, heard: str) -> float:
    """The ratio of two words, 0 if it is under LEAST_RATIO; pairs that share too few characters are not compared."""
    pair = SequenceMatcher(None, own, heard)
    if pair.real_quick_ratio() < LEAST_RATIO or pair.quick_ratio() < LEAST_RATIO:
        return 0.0
    ratio = pair.ratio()
    return ratio if ratio >= LEAST_RATIO else 0.0


@lru_cache(1 << 12)
def _best_support(said: str, labels: str) -> float:
    heard = set(said.split())
    telling = sorted(heard.difference(GENERIC, NOUN))
    best = 0.0
    for label in labels.split("\n"):
        own = label.split()
        named = [w for w in own if w not in GENERIC]
        if named:
            best = max(best, sum(max((_alike(w, h) for h in telling), default=0.0) for w in named) / len(named))
        elif heard.intersection(own):
            best = 1.0
    return best


@pandas_udf(DoubleType())
def _supports(said: pd.Series, labels: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _best_support(x, y) for x, y in zip(said, labels, strict=True)], dtype="float64")


def own_support(text: Column, labels: Column) -> Column:
    """The support that a text gives the best of its own few labels, as label_supports tells it (H9): 0 if it supports none, null without a text or labels.

    Here text and labels have met already, so no words are dealt out to find each other.
    """
    spelt = F.array_join(F.transform(labels, lambda x: F.array_join(_plain(x), " ")), "\n")
    return _supports(F.array_join(_plain(text), " "), spelt)


def _plain(text: Column) -> Column:
    return tokens(text, True)


def _tells(word: Column) -> Column:
    return ~word.isin(GENERIC)


def label_supports(said: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """keys of said, owner, label, full and weak: how well an utterance supports each label that it supports at all (H9).

    said: keys, group and text; labels: group, owner and label. A label's support is the mean, over its words
    that tell entities apart, of each one's best ratio to such a word of the utterance. A label of
    generic words alone has full support 1, and weak support GENERIC_SUPPORT, if one of them is said.
    """
    heard = said.select(*keys, "group", F.explode(F.array_distinct(_plain(F.col("text")))).alias("word"))
    own = labels.select("group", "owner", "label", F.explode(_plain(F.col("label"))).alias("word"))
    own = own.groupBy("group", "owner", "label", "word").agg(F.count("*").alias("times"))
    size = own.groupBy("group", "owner", "label").agg(F.sum(F.when(_tells(F.col("word")), F.col("times")).otherwise(0)).alias("size"))
    own = own.join(size, ["group", "owner", "label"])
    telling = heard.where(_tells(F.col("word")) & ~F.col("word").isin(list(NOUN)))
    alike = similar_words(own.where(_tells(F.col("word"))).select("word"), telling.select("word"))
    best = telling.join(alike, F.col("word") == F.col("b")).groupBy(*keys, "group", F.col("a").alias("word")).agg(F.max("ratio").alias("ratio"))
    met = best.join(own, ["group", "word"]).groupBy(*keys, "owner", "label", "size").agg(F.sum(F.col("ratio") * F.col("times")).alias("total"))
    full = met.select(*keys, "owner", "label", (F.col("total") / F.col("size")).alias("full")).withColumn("weak", F.col("full"))
    generic = heard.join(own.where("size = 0"), ["group", "word"]).select(*keys, "owner", "label").distinct()
    return full.unionByName(generic.withColumns({"full": F.lit(1.0), "weak": F.lit(GENERIC_SUPPORT)}))


def noun_phrases(said: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """keys of said, owner, label and phrase: the best ratio of a label to what stands before a noun, with its initial and as many words or one more."""
    names = labels.select("group", "owner", "label", F.filter(_plain(F.col("label")), _tells).alias("own")).where(F.size("own") > 0)
    names = names.select("group", "owner", "label", F.array_join("own", " ").alias("a"), F.explode(F.array(F.size("own"), F.size("own") + 1)).alias("width"), F.substring(F.col("own")[0], 1, 1).alias("initial"))
    at = said.select(*keys, "group", _plain(F.col("text")).alias("all")).select("*", F.posexplode("all").alias("place", "noun")).where(F.col("noun").isin(list(NOUN)))
    widest = names.groupBy("group").agg(F.max("width").alias("widest"))
    at = at.join(widest, "group").where("place > 0").withColumn("width", F.explode(F.sequence(F.lit(1), F.least("place", "widest"))))
    before = at.select(*keys, "group", "width", F.array_join(F.slice("all", F.col("place") - F.col("width") + 1, F.col("width")), " ").alias("b")).withColumn("initial", F.substring("b", 1, 1)).distinct()
    met = before.join(names, ["group", "width", "initial"])
    ratios = met.select("a", "b").distinct().withColumn("ratio", _matching("a", "b"))
    return met.join(ratios, ["a", "b"]).groupBy(*keys, "owner", "label").agg(F.max("ratio").alias("phrase"))


def entity_scores(utterances: DataFrame, entities: DataFrame, key: str, home: str, text: str) -> DataFrame:
    """key, entity_id, support and score of each entity of an utterance's home.

    entities: home, entity_id, labels (array) and area; utterances: key, home, text, room (the area
    named, or null) and satellite_area. An entity has its best label's support or phrase, and a
    bonus in the satellite's area if no room is named. Only words and phrases that may be alike
    meet; an entity that nothing supports has 0. Entities of a home with the same labels are
    scored once, and share the result.
    """
    said = utterances.select(key, F.col(home).alias("group"), F.col(text).alias("text"))
    alike = entities.select(F.col(home).alias("group"), "entity_id", "area", F.array_sort(F.array_distinct("labels")).alias("labels"))
    kinds = alike.select("group", "labels").distinct()
    labels = kinds.select("group", F.lit(0).alias("owner"), F.explode("labels").alias("label")).distinct()
    found = label_supports(said, labels, [key]).join(noun_phrases(said, labels, [key]), [key, "owner", "label"], "full_outer")
    found = found.join(said.select(key, "group"), key).join(kinds.withColumn("label", F.explode("labels")), ["group", "label"])
    found = found.groupBy(key, "group", "labels").agg(F.max("full").alias("support"), F.max(F.greatest("weak", "phrase")).alias("match"))
    each = utterances.select(key, F.col(home).alias("group"), "room", "satellite_area").join(kinds, "group").join(found, [key, "group", "labels"], "left")
    each = alike.join(each, (alike["group"] == each["group"]) & alike["labels"].eqNullSafe(each["labels"]))
    near = F.coalesce(F.col("room").isNull() & (F.col("area") == F.col("satellite_area")), F.lit(False))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return each.select(key, "entity_id", zero("support").alias("support"), (zero("match") + F.when(near, SATELLITE_BONUS).otherwise(0.0)).alias("score"))


def noun_match(said: Column, room: Column, area: Column, domain: Column, name: Column) -> Column:
    """Whether an utterance names an entity by its area and a noun of its domain; a lamp may be a switch (part of H12)."""
    nouns = F.filter(F.transform(said, lambda t: F.create_map(*(F.lit(x) for kv in NOUN.items() for x in kv))[t]), lambda d: d.isNotNull())
    lamp = (domain == "switch") & F.array_contains(nouns, "light") & (F.contains(F.lower(name), F.lit("lamp")) | F.contains(F.lower(name), F.lit("light")))
    return F.coalesce((F.lower(room) == F.lower(area)) & (F.array_contains(nouns, domain) | lamp), F.lit(False))


def _said_areas(texts: DataFrame, spoken: DataFrame, areas: DataFrame) -> DataFrame:
    """home, text, said (the areas of spoken whose phrases a text says) and room (of areas, the one with the longest phrase) of distinct texts.

    A text is met once however many calls have it. The result is written; a short one goes to all tasks.
    """
    with_checkpoints(texts.sparkSession)
    heads = texts.select("home", "text", _plain(F.col("text")).alias("_words")).select("home", "text", "_words", F.posexplode("_words").alias("_start", "_head"))
    spoken = spoken.withColumn("_phrase", _plain(F.col("phrase"))).withColumn("_head", F.get("_phrase", F.lit(0)))
    met = heads.join(spoken, ["home", "_head"]).where(F.slice("_words", F.col("_start") + 1, F.size("_phrase")) == F.col("_phrase"))
    met = met.join(areas.withColumn("_own", F.lit(True)), ["home", "area"], "left")
    longest = F.when(F.col("_own"), F.struct((-F.size("_phrase")).alias("w"), "rank"))
    found = met.groupBy("home", "text").agg(F.collect_set("area").alias("said"), F.min_by("area", longest).alias("room")).checkpoint()
    return F.broadcast(found) if found.count() <= LISTED_TEXTS else found


def grounded(calls: DataFrame, entities: DataFrame, areas: DataFrame, key: str) -> DataFrame:
    """key and grounded: whether the utterance of each call says what the call is about.

    calls: key, home, tool, name, area, text and satellite_area; key tells calls apart. entities:
    home, entity_id, rank, name, labels (array, the name among them), domain and area. areas: home,
    area, phrase (the area's name and its aliases, a row each) and rank.

    A call of a timer, or of a tool that asks for the time or the state, stands. A name must be a
    label of an entity: of the first such one a label must have half the support, or its area and
    a noun of its domain must be said. A name that is an area's must be said, and so must the
    area of a call without name, or be the satellite's. A name that nothing has doesn't stand; a
    call without name and area does.
    """
    plain = lambda c: F.lower(F.trim(c))
    calls = calls.select(key, "home", "tool", "name", "area", "text", "satellite_area")
    owners = entities.select("home", "rank", "entity_id", F.col("name").alias("entity_name"), "domain", F.col("area").alias("entity_area"), "labels", F.explode("labels").alias("_label"))
    owner = F.min_by(F.struct("entity_id", "entity_name", "domain", "entity_area", "labels"), "rank")
    owners = owners.groupBy("home", plain(F.col("_label")).alias("needle")).agg(owner.alias("e"))
    phrases = areas.select("home", "area", "phrase", "rank", plain(F.col("phrase")).alias("needle"))
    first = phrases.groupBy("home", "needle").agg(F.min_by("area", "rank").alias("named_area"))
    known = owners.join(first, ["home", "needle"], "full_outer")
    wanted = calls.withColumn("needle", plain(F.col("name"))).join(known, ["home", "needle"], "left")
    wanted = wanted.withColumn("target", F.when(F.col("name").isNull(), F.col("area")).otherwise(F.col("named_area")))

    own = calls.where("name IS NULL AND area IS NOT NULL").select("home", "area", F.col("area").alias("phrase"), F.lit(0).alias("rank")).distinct()
    spoken = phrases.drop("needle").unionByName(own)
    heard = _said_areas(calls.select("home", "text").distinct(), spoken, areas.select("home", "area").distinct())
    all_ = wanted.join(heard, ["home", "text"], "left")
    all_ = all_.withColumns({"uttered": F.when(F.array_contains("said", F.col("target")), True), "support": own_support(F.when(F.col("e").isNotNull(), F.col("text")), F.col("e.labels"))})
    bare = F.element_at(F.split("tool", "__"), -1)
    here = F.coalesce(F.col("uttered") | (F.lower("target") == F.lower("satellite_area")), F.col("uttered"), F.lit(False))
    noun = noun_match(_plain(F.col("text")), F.col("room"), F.col("e.entity_area"), F.col("e.domain"), F.col("e.entity_name"))
    stands = (
        F.when(bare.isin(NAMELESS) | F.contains(bare, F.lit("Timer")), True)
        .when(F.col("e").isNotNull(), F.coalesce(F.col("support") >= GROUNDED_SUPPORT, F.lit(False)) | noun)
        .when(F.col("target").isNotNull(), here)
        .otherwise(F.col("name").isNull())
    )
    return all_.select(key, stands.alias("grounded"))


def held_answers(turns: DataFrame, options: DataFrame, key: str, text: str) -> DataFrame:
    """key, cancelled and option of each turn that answers a held question.

    Only words that decline, and fillers, cancel. With one option, only words that confirm, and
    fillers, choose it. Else the option with the best support is chosen, if that is half at least and
    no other has as much. options: key, option and labels.
    """
    said = turns.select(key, _plain(F.col(text)).alias("said"))
    only = lambda lists: F.forall("said", lambda w: w.isin(lists))
    some = lambda lists: F.exists("said", lambda w: w.isin(lists))
    cancelled = (F.size("said") > 0) & only(YES + NO + FILLER) & some(NO) & ~some(YES)
    confirmed = some(YES) & only(YES + FILLER)
    labels = options.select(F.col(key).alias("group"), F.col("option").alias("owner"), F.explode("labels").alias("label"))
    found = label_supports(turns.select(key, F.col(key).alias("group"), F.col(text).alias("text")), labels, [key]).groupBy(key, F.col("owner").alias("option")).agg(F.max("full").alias("support"))
    best = turns.select(key).join(options.select(key, "option").distinct(), key).join(found, [key, "option"], "left").fillna(0.0, ["support"])
    ranked = best.groupBy(key).agg(F.max("support").alias("top"), F.max_by("option", "support").alias("first"), F.count("*").alias("n"))
    tied = best.join(ranked.select(key, "top"), key).where("support = top").groupBy(key).agg(F.count("*").alias("n_top"))
    out = said.join(ranked, key, "left").join(tied, key, "left")
    chosen = F.when((F.col("n") == 1) & confirmed, F.col("first")).when((F.col("top") >= 0.5) & (F.col("n_top") == 1), F.col("first"))
    return out.select(key, cancelled.alias("cancelled"), F.when(~cancelled, chosen).alias("option"))
