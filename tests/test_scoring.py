"""Scored tool calls and grounding scores against hand-built cases and plain Python."""

import difflib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.operators import grounding, scoring
from quillspark.plans import catalogue

CASES = "case_id bigint, household string, expected_type string, text string, parse_error string, violations array<string>, candidates array<string>, forbidden array<struct<name:string,area:string,domain:string>>, target_area string, area_source string"
CALLS = f"case_id bigint, pos int, call {scoring.CALL}"
ENTITIES = "household string, place int, entity_id string, name string, aliases array<string>, domain string, area string"
HOME = [
    ("h", 0, "light.a", "Ceiling Light", ["Main Light"], "light", "Kitchen"),
    ("h", 1, "switch.b", "Desk Lamp", ["Main Light"], "switch", "Office"),
    ("h", 2, "script.movie", "Movie Night", ["film"], "script", None),
    ("h", 3, "media_player.tv", "TV", None, "media_player", "Office"),
    ("h", 4, None, "Ghost", [], "fan", "Hall"),
]
CONTEXT = [("h", "Porch"), ("h", "TV"), ("g", "Ceiling Light")]
ON, OFF, VOLUME, LIVE = scoring.TURN_ON, "intent__HassTurnOff", scoring.RELATIVE_VOLUME, scoring.LIVE_CONTEXT


def scored(spark, cases, expected, calls):
    df = lambda rows, kind: spark.createDataFrame(rows, kind)
    out = scoring.score(df(cases, CASES), df(expected, CALLS), df(calls, CALLS), df(HOME, ENTITIES), df(CONTEXT, "household string, name string"))
    return {r.case_id: (r.outcome, sorted(r.flags), r.passed) for r in out.collect()}


def case(i, kind="action", text=None, parse_error=None, violations=(), candidates=(), forbidden=(), area=None, source=None, household="h"):
    return (i, household, kind, text, parse_error, list(violations), list(candidates), list(forbidden), area, source)


def call(tool, domains=None, **args):
    return (tool, args, domains)


#: Case, expected calls, calls made, and the outcome, flags and verdict.
BY_HAND = [
    (case(0), [call(ON, name="Ceiling Light")], [call(ON, name="ceiling light")], ("valid_tool_call", [], True)),
    (case(1), [call(ON, name="Main Light")], [call(ON, name="main light")], ("unexpected_tool_call", [], False)),  # two owners, so the text counts
    (case(2), [call(ON, name="Ceiling Light")], [call(ON, ["light"], name="Ceiling Light")], ("valid_tool_call", [], True)),  # the domain is implied
    (case(3), [call("movie")], [call(ON, ["script"], name="FILM")], ("valid_tool_call", [], True)),
    (case(4), [call(ON, name="Movie Night")], [call(ON, ["script"], name="FILM")], ("valid_tool_call", [], True)),
    (case(5, area="Kitchen", source="satellite"), [call(OFF, name="Lamp", area="Kitchen")], [call(OFF, name="Lamp")], ("valid_tool_call", [], True)),
    (case(6, area="Kitchen", source="explicit"), [call(OFF, name="Lamp", area="Kitchen")], [call(OFF, name="Lamp")], ("unexpected_tool_call", [], False)),
    (case(7), [call(VOLUME, name="TV", volume_step="up")], [call(VOLUME, name="tv", volume_step="10")], ("valid_tool_call", [], True)),
    (case(8), [call(VOLUME, name="TV", volume_step="up")], [call(VOLUME, name="tv", volume_step="0")], ("unexpected_tool_call", [], False)),
    (case(9, area="Office", source="satellite"), [call(VOLUME, name="TV", area="Office", volume_step="down")], [call(VOLUME, name="TV", volume_step="-5")], ("valid_tool_call", [], True)),
    (case(10), [call(ON, name="A"), call(ON, name="A")], [call(ON, name="A")], ("missing_tool_call", [], False)),
    (case(11), [call(ON, name="A"), call(ON, name="B")], [call(ON, name="B"), call(ON, name="A")], ("valid_multi_tool_call", [], True)),
    (case(12), [call(ON, name="A")], [], ("missing_tool_call", [], False)),
    (case(13, parse_error="x", violations=["unknown_tool"]), [call(ON, name="A")], [], ("malformed_output", [], False)),
    (case(14, violations=["a", "unknown_tool"]), [call(ON, name="A")], [], ("unknown_tool", [], False)),
    (case(15, violations=["a"]), [call(ON, name="A")], [], ("invalid_arguments", [], False)),
    (case(16, "status"), [call("q", name="TV")], [call(LIVE)], ("valid_tool_call", [], True)),
    (case(17, "status"), [call("q", name="TV")], [call(LIVE, ["media_player"], name="tv", area="office")], ("valid_tool_call", [], True)),
    (case(18, "status"), [call("q", name="TV")], [call(LIVE, name="Ghost")], ("unexpected_tool_call", [], False)),
    (case(19, "status"), [call("q", name="TV")], [call(LIVE), call(ON, name="TV")], ("unexpected_tool_call", ["status_state_change"], False)),
    (case(20, "clarification", "Which one?", candidates=["Ceiling Light", "Desk Lamp"]), [], [], ("wrong_response_type", [], False)),
    (case(21, "clarification", "Do you mean the ceiling light or the lamp?", candidates=["Ceiling Light", "Desk Lamp"]), [], [], ("valid_clarification", [], True)),
    (case(22, "clarification", "The one on the desk, or the other on the ceiling?", candidates=["Ceiling Light", "Desk Lamp"]), [], [], ("valid_clarification", [], True)),
    (case(23, "clarification", "Which one of them, lamp's or ceilings?", candidates=["Ceiling Light", "Desk Lamp"]), [], [], ("wrong_response_type", [], False)),
    (case(24, "clarification", "x"), [], [call(ON, name="TV")], ("unexpected_tool_call", ["action_on_ambiguity"], False)),
    (case(25, "refusal", "I can’t do that."), [], [], ("valid_refusal", [], True)),
    (case(26, "refusal", "There is no such lamp. Which one?"), [], [], ("wrong_response_type", [], False)),
    (case(27, "refusal"), [], [call(LIVE)], ("unexpected_tool_call", ["tool_call_on_unavailable"], False)),
    (case(28, forbidden=[("Desk Lamp", "Office", "switch")]), [call(OFF, area="Office")], [call(OFF, area="office")], ("unexpected_tool_call", ["excluded_entity_affected"], False)),
    (case(29, forbidden=[("Desk Lamp", "Office", "switch")]), [call(OFF, ["light"], area="Office")], [call(OFF, ["light"], area="Office")], ("valid_tool_call", [], True)),
    (case(30, area="Kitchen"), [call(OFF, area="Office")], [call(OFF, area="Office")], ("valid_tool_call", ["wrong_target_area"], False)),
    (case(31), [call(ON, ["fan"], name="TV")], [call(ON, ["fan"], name="TV")], ("valid_tool_call", ["wrong_domain"], False)),
    (case(32), [call(ON, name="Porch")], [call(ON, name="porch")], ("unexpected_tool_call", ["context_entity_targeted"], False)),
    (case(33, household="nowhere"), [call(ON, name="Porch")], [call(ON, name="Porch")], ("valid_tool_call", [], True)),
    (case(34), [call(ON, name="TV")], [call(LIVE, name="Porch"), call(ON, name="tv")], ("unexpected_tool_call", [], False)),
]


def test_scores_by_hand(spark):
    rows = lambda k: [(c[0], i, x) for c, *both, _ in BY_HAND for i, x in enumerate(both[k])]
    got = scored(spark, [c for c, *_ in BY_HAND], rows(0), rows(1))
    assert {i: got[i] for i in got} == {c[0]: want for c, _, _, want in BY_HAND}


def bags(expected, forms):
    """Greedy matching in plain Python: how many calls missed, and how many expected keys are left."""
    left, missed = list(expected), 0
    for options in forms:
        hit = next((o for o in options if o in left), None)
        if hit is None:
            missed += 1
        else:
            left.remove(hit)
    return missed, len(left)


def test_matching_by_brute_force(spark):
    rng = random.Random(3)
    rows = [([rng.choice("abc") for _ in range(rng.randrange(5))], [[rng.choice("abcd") for _ in range(rng.randrange(1, 4))] for _ in range(rng.randrange(5))]) for _ in range(300)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, e array<string>, f array<array<string>>")
    got = {r.i: (r.m.missed, r.m.left) for r in df.select("i", scoring.matched(F.col("e"), F.col("f")).alias("m")).collect()}
    assert got == {i: bags(*r) for i, r in enumerate(rows)}


def test_canonical_keys_are_json(spark):
    df = spark.createDataFrame([(call(ON, name="x", area="y"),)], f"call {scoring.CALL}")
    none = F.lit(None).cast("string")
    key = df.select(scoring.canonical(F.col("call"), none, none)).first()[0]
    assert json.loads(key)["tool"] == ON and [e["key"] for e in json.loads(key)["args"]] == ["area", "name"]


def test_grounding_scores(spark):
    """Against the definitions, with a mean over a label's words and the words before a noun."""
    words = lambda t: re.findall("[a-z0-9']+", t.lower())
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()

    def support(label, said, generic):
        own = [t for t in words(label) if t not in grounding.GENERIC]
        rest = [t for t in words(said) if t not in grounding.GENERIC and t not in grounding.NOUN]
        if not own:
            return generic if set(words(label)) & set(words(said)) else 0.0
        return sum(max([r for x in rest or [""] if (r := ratio(t, x)) >= 0.6], default=0.0) for t in own) / len(own)

    def before_noun(label, said):
        own, said, best = [t for t in words(label) if t not in grounding.GENERIC], words(said), 0.0
        for i, t in enumerate(said):
            for k in (len(own), len(own) + 1):
                part = " ".join(said[max(i - k, 0) : i])
                if own and t in grounding.NOUN and i >= k and part and part[0] == own[0][0]:
                    best = max(best, ratio(" ".join(own), part))
        return best

    said = [(0, "h", "turn on the kichen lamp please", None, "Office"), (1, "h", "the light", "Office", "Office"), (2, "h", "dim the desk's reading light", None, None), (3, "h", "", None, "Office"), (4, "g", "kitchen", None, None)]
    entities = [("h", "a", ["Kitchen Light", "lamp"], "Kitchen"), ("h", "b", ["Desk Lamp"], "Office"), ("h", "c", ["the light"], "Office"), ("h", "d", [""], None)]
    got = grounding.entity_scores(spark.createDataFrame(said, "k int, home string, text string, room string, satellite_area string"), spark.createDataFrame(entities, "home string, entity_id string, labels array<string>, area string"), "k", "home", "text")
    want = {}
    for k, home, text, room, satellite in said:
        for other, entity, labels, area in entities:
            if home == other:
                score = max(max(support(x, text, 0.3), before_noun(x, text)) for x in labels) + (0.2 if room is None and area and area == satellite else 0)
                want[k, entity] = (max(support(x, text, 1.0) for x in labels), score)
    assert {(r.k, r.entity_id): (r.support, r.score) for r in got.collect()} == {k: (pytest.approx(a), pytest.approx(b)) for k, (a, b) in want.items()}


def test_similar_words_miss_no_pair(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeex9'") for _ in range(rng.randint(1, 9)))
    own, heard = {word() for _ in range(150)} | {"kitchen"}, {word() for _ in range(150)} | {"kichen", "kitchens", "nekitch"}
    frame = lambda words: spark.createDataFrame([(w,) for w in [*words, "", *words]], "word string")
    got = {(r.a, r.b): r.ratio for r in grounding.similar_words(frame(own), frame(heard)).collect()}
    all_ = {(a, b): difflib.SequenceMatcher(None, a, b).ratio() for a in own for b in heard}
    assert got == {k: r for k, r in all_.items() if r >= 0.6} and len(got) > 300


def test_grounded_by_hand(spark):
    """Every branch: tools that need no name, entities by name, alias or area and noun, areas as names, areas alone, unknown names."""
    entities = [("h", 0, "Floor Lamp", ["Floor Lamp", "tall one"], "switch", "Den"), ("h", 1, "Sofa TV", ["Sofa TV"], "media_player", "Den"), ("h", 2, "floor lamp", ["floor lamp"], "light", "Attic"), ("h", 3, "Lamp", ["Lamp"], "light", None)]
    areas = [("h", "Den", "Den", 0), ("h", "Den", "living room", 0), ("h", "Attic", "Attic", 1), ("g", "Hall", "Hall", 0)]
    cases = [
        ("GetDateTime", "nothing", None, "what time", None, True), ("x__HassStartTimer", "pasta", None, "", None, True),
        ("t", " floor lamp ", None, "turn the flor lamp on", None, True), ("t", "Tall One", None, "the tall one", None, True), ("t", "Sofa TV", None, "turn it on", None, False),
        ("t", "Floor Lamp", None, "lights in the living room", None, True), ("t", "Floor Lamp", None, "lights in the attic", None, False), ("t", "Sofa TV", None, "the den tv", None, True),
        ("t", "Living Room", None, "off in the living room", None, True), ("t", "Attic", None, "off", None, False), ("t", "den", None, "off", "DEN", True),
        ("t", "Wick", "Den", "the den", None, False), ("t", None, "Attic", "the attic", None, True), ("t", None, "Attic", "the den", None, False), ("t", None, "attic", "off", "Attic", True),
        ("t", None, "Cellar", "in the cellar", None, True), ("t", None, "Hall", "attic", None, False), ("t", None, None, "off", None, True), ("t", "Lamp", None, "the lamp", None, True), ("t", "Lamp", None, "hospital", None, False),
    ]
    calls = spark.createDataFrame([(i, "h", *c[:5]) for i, c in enumerate(cases)], "k int, home string, tool string, name string, area string, text string, satellite_area string")
    homes = spark.createDataFrame([(h, f"e{r}", r, n, ls, d, a) for h, r, n, ls, d, a in entities], "home string, entity_id string, rank int, name string, labels array<string>, domain string, area string")
    got = {r.k: r.grounded for r in grounding.grounded(calls, homes, spark.createDataFrame(areas, "home string, area string, phrase string, rank int"), "k").collect()}
    assert {i: c for i, c in enumerate(cases) if got[i] != c[5]} == {} and len(got) == len(cases)


def test_grounded_query(spark):
    got = catalogue.QUERIES["grounded_calls"](spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").distinct().count()
    kinds = {r.grounded: r["count"] for r in got.groupBy("grounded").count().collect()}
    assert sum(kinds.values()) == n and min(kinds.values()) > n / 10


def test_areas_by_hand(spark):
    areas = spark.createDataFrame([("Living Room", "living room", 0), ("Living Room", "lounge", 1), ("Room", "room", 2), ("Office", "office", 3), ("Back Office", "back office", 4)], "area string, phrase string, rank int")
    said = ["lights in the living room", "the room and the office", "back office's lamp", "lounge, then living room", "nothing here", "Living Room Room office"]
    df = spark.createDataFrame([(i, t, "Hall" if i % 2 == 0 else None) for i, t in enumerate(said)], "k int, text string, satellite string")
    named = grounding.named_areas(df, areas, "k", "text")
    got = {r.k: (r.target_area, r.area_source) for r in grounding.resolved_area(df, named, "k", "satellite").collect()}
    assert {r.k: r.areas for r in named.collect()} == {0: ["Living Room"], 1: ["Room", "Office"], 2: ["Back Office"], 3: ["Living Room"], 5: ["Living Room", "Room", "Office"]}
    assert got == {0: ("Living Room", "explicit"), 1: (None, "multiple"), 2: ("Back Office", "explicit"), 3: ("Living Room", "explicit"), 4: ("Hall", "satellite"), 5: (None, "multiple")}
    assert {r.k: r.area for r in grounding.longest_area(df, areas, "k", "text").collect()} == {0: "Living Room", 1: "Room", 2: "Back Office", 3: "Living Room", 5: "Living Room"}


def test_held_answers(spark):
    turns = [(0, "yes please"), (1, "no thanks"), (2, "the desk one"), (3, "yes"), (4, "lamp"), (5, "no, yes"), (6, ""), (7, "the kitchen lamp, no")]
    options = [(0, "a", ["Desk Lamp"]), (1, "a", ["Desk Lamp"])] + [(i, o, [label]) for i in range(2, 8) for o, label in (("a", "Desk Lamp"), ("b", "Kitchen Lamp"))]
    got = grounding.held_answers(spark.createDataFrame(turns, "k int, text string"), spark.createDataFrame(options, "k int, option string, labels array<string>"), "k", "text")
    assert {r.k: (r.cancelled, r.option) for r in got.collect()} == {0: (False, "a"), 1: (True, None), 2: (False, "a"), 3: (False, None), 4: (False, None), 5: (False, None), 6: (False, None), 7: (False, "b")}


def test_a_call_is_looked_up_once_among_the_expected(spark):
    """The place of a call's form is found once in a step, not again for every expected key that may go."""
    found = scoring.matched(F.col("k"), F.col("t"))
    assert found._jc.toString().count("array_contains") == 1
    df = spark.createDataFrame([(["a", "b", "a"], [["x", "a"], ["a"], ["a", "b"], ["b"]]), (["a"], None), ([], [["a"]])], "k array<string>, t array<array<string>>")
    assert [r.m and tuple(r.m) for r in df.select(found.alias("m")).collect()] == [(1, 0), None, (1, 0)]
