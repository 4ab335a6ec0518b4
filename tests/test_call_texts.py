"""Call texts against a parser that reads character by character."""

import json
import random

from pyspark.sql import functions as F

from quillspark.operators import call_texts, schemas


class Wrong(Exception):
    pass


class Reader:
    """One character after the other."""

    def __init__(self, text):
        self.text, self.i = text, 0

    def peek(self):
        return self.text[self.i] if self.i < len(self.text) else ""

    def skip(self):
        while self.peek().isspace():
            self.i += 1

    def need(self, c):
        self.skip()
        if self.peek() != c:
            raise Wrong
        self.i += 1

    def word(self, digits="0123456789_"):
        start = self.i
        while self.peek() and (self.peek() in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_" or self.i > start and self.peek() in digits):
            self.i += 1
        return self.text[start : self.i]

    def many(self, item, end):
        self.skip()
        out = []
        while self.peek() != end or out:
            out.append(item())
            self.skip()
            if self.peek() == end:
                break
            self.need(",")
            self.skip()
        self.i += 1
        return out

    def value(self):
        self.skip()
        c = self.peek()
        if c in ("'", '"'):
            self.i += 1
            start = self.i
            while True:
                if not self.peek():
                    raise Wrong
                if self.peek() == c and self.text[self.i + 1 : self.i + 2] in (",", ")", "]", "}"):
                    break
                self.i += 1
            self.i += 1
            return self.text[start : self.i - 1]
        if c == "[":
            self.i += 1
            return self.many(self.value, "]")
        if c and c in "-0123456789":
            start = self.i
            while self.peek() and self.peek() in "-0123456789":
                self.i += 1
            try:
                return int(self.text[start : self.i])
            except ValueError:
                raise Wrong from None
        word = self.word("")
        if word not in ("True", "False", "None"):
            raise Wrong
        return {"True": True, "False": False, "None": None}[word]

    def argument(self):
        self.skip()
        key = self.word()
        if not key or self.peek() != "=":
            raise Wrong
        self.i += 1
        return key, self.value()

    def calls(self):
        out = []
        while True:
            self.skip()
            if not self.peek():
                return out
            name = self.word()
            if not name or name[0] == "_" or self.peek() != "(":
                raise Wrong
            self.i += 1
            args = self.many(self.argument, ")")
            if len(dict(args)) < len(args):
                raise Wrong
            out.append((name, args))
            self.skip()
            if self.peek():
                self.need(",")


def parsed(text):
    text = text.strip()
    if text.startswith("[") and text.endswith("]") and len(text) > 1:
        text = text[1:-1].strip()
    try:
        return Reader(text).calls()
    except Wrong:
        return None


def random_text(rng, depth=3):
    def value(d):
        kind = rng.randrange(6 if d else 4)
        if kind > 3:
            return "[" + rng.choice([",", " , "]).join(value(d - 1) for _ in range(rng.randrange(4))) + rng.choice(["]", " ]"])
        q = rng.choice("'\"")
        return [q + "".join(rng.choice(["a", "it's", ' "', "(", ")", "é\\", "\n", "[", "x, y", "\x01"]) for _ in range(rng.randrange(5))) + q, str(rng.choice([0, 7, -3, "007", "-00", 10**25])), rng.choice(["True", "False", "None"]), q + "plain" + q][kind]

    calls = [rng.choice(["f", "Turn_on2", "g"]) + "(" + ", ".join(f"{k}={rng.choice(['', ' '])}{value(depth)}" for k in rng.sample(["a", "b_1", "_c", "name"], rng.randrange(4))) + ")" for _ in range(rng.randrange(1, 4))]
    text = rng.choice([", ", ",", " ,\n"]).join(calls)
    text = rng.choice([text, f"[{text}]", f" [ {text} ] ", text + ","])
    for _ in range(rng.choice([0, 0, 0, 1, 2])):
        i = rng.randrange(len(text))
        text = text[:i] + rng.choice(["", ",", "'", ")", "]", "=", "(", "[", "1", " "]) + text[i + rng.randrange(2) :]
    return text


def test_random_texts(spark):
    rng = random.Random(9)
    texts = [random_text(rng) for _ in range(6000)] + ["", "[]", "[", "f", "f()", "f(1)", "f(a=g(b=1))", "_f()", "f(a=1,a=2)", "f(a=1.5)", "f(a=1-2)", "f(a=Truex)", "f() g()", ",f()", "f(),,g()", "f(a='it's, ok')", "f(a='x')y", "f(a={})"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    wrong, n = [], [0, 0]
    for r in df.select("i", "t", call_texts.parse_calls(df.t).alias("calls")).collect():
        want = parsed(r.t)
        got = None if r.calls is None else [(c.name, json.loads(c.arguments, object_pairs_hook=list)) for c in r.calls]
        n[want is None] += 1
        if got != want:
            wrong.append((r.t, got, want))
    assert wrong[:3] == [] and min(n) > 1000


def test_long_texts_and_nulls(spark):
    texts = ["f(a='" + "it's " * 50_000 + "')", "f(a=[" + "[" * 200 + "]" * 200 + "])", "f(a=[" + "1, " * 50_000 + "2])", None, "f(a='" + "x" * 300_000]
    got = [r.c for r in spark.createDataFrame([(t,) for t in texts], "t string").select(call_texts.parse_calls(F.col("t")).alias("c")).collect()]
    assert [c and c[0].name for c in got] == ["f", "f", "f", None, None] and len(json.loads(got[0][0].arguments)["a"]) == 250_000


def test_texts_are_checked_by_schema(spark):
    """A text goes through the parser to the schema check, in the order of its arguments."""
    df = spark.createDataFrame([("turn(z='q', level=[1, 'x'])",)], "t string").select(F.explode(call_texts.parse_calls(F.col("t"))).alias("c")).select(F.col("c.name").alias("tool"), "c.arguments")
    tools = {"turn": {"properties": {"level": {"type": "array", "items": {"type": "integer"}}, "z": {"type": "integer"}}}}
    assert schemas.check_calls(df, tools).first().message == "z must be integer"
