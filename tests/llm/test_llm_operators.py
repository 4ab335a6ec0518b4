"""Training-data operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import bpe, chat_format, embedding_dedup, graph, mixing, ngram_join, pii, quality, substring_dedup, token_counts, toxicity
from quillspark.llm.words import chunks, row_hashes, windows

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside; they must not clash.
EXTRA = ("key", "tag", "n", "entity", "component", "score", "size", "row", "found", "weight", "spans", "kept")


def texts(seed=1, n=60):
    """Random texts with exact and near copies, shared passages, nulls, blanks and odd characters."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    passage = " ".join(word() for _ in range(40))
    out = [None, "", "  \n ", "one", "one", "two words", "ONE", " ".join(["same"] * 90), "a\x0bb\tc\nd\x85e"]
    for _ in range(n):
        out.append(" ".join(word() for _ in range(rng.randint(1, 120))))
        kind = rng.random()
        if kind < 0.2:
            out.append(out[-1])
        elif kind < 0.45:
            w = out[-1].split(" ")
            w[rng.randrange(len(w))] = "zz"
            out.append(" ".join(w).upper() if rng.random() < 0.3 else " ".join(w))
        elif kind < 0.6:
            out.append(f"{out[-1]} {passage} {word()}")
    return out


def table(spark, some, extra=True):
    df = spark.createDataFrame([(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(some)], DOCS)
    return df.withColumns({c: F.lit("x") for c in EXTRA}) if extra else df


@pytest.fixture(scope="module")
def some():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, some):
    return table(spark, some)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark, some):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(0, len(some), 2)] + [(None, 1, 1), (2, None, None)], "doc_id bigint, quality int, toxic int")


def by_id(df, *cols):
    return {r.doc_id: tuple(r[c] for c in cols) for r in df.collect()}


# -- words ------------------------------------------------------------------------------------


def test_words_are_the_pattern(some):
    batch = pa.array(some)
    for c in chunks(batch, limit=50):
        for i in range(c.rows):
            got = [c.text(w).decode() for w in range(c.bounds[i], c.bounds[i + 1])]
            assert got == re.findall(r"[^\x20\x09-\x0D]+", some[c.first + i] or "")


def test_hash_depends_on_words_alone():
    a = next(iter(chunks(pa.array(["x yy zzz yy"]))))
    b = next(iter(chunks(pa.array(["pad pad", "yy  zzz\tyy"]))))
    assert (a.hashes()[1:] == b.hashes()[2:]).all()
    assert len(set(a.hashes().tolist())) == 3
    assert (windows(a.hashes(), 2)[1:] == windows(b.hashes(), 2)[2:]).all()
    assert len(row_hashes(a.hashes()[:3], 5)) == 1 and not len(row_hashes(a.hashes()[:0], 5))


def test_long_windows_in_blocks(monkeypatch):
    h = np.random.default_rng(1).integers(0, 1 << 62, 500).astype(np.uint64)
    whole = windows(h, 35)
    monkeypatch.setattr("quillspark.llm.words.BLOCK_WORDS", 64)
    assert (windows(h, 35) == whole).all()


# -- components -------------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(55)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7), (3, None)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).df.collect()}
    assert got == {x: top(x) for x in root}


# -- op1 --------------------------------------------------------------------------------------


def test_chat_prefix_and_masks(spark):
    c = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "é"), (1, 3, "user", "v"), (2, 0, "user", None), (3, 0, "user", "q")]
    r = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "no"), (2, 0, "user", None), (4, 0, "assistant", "alone")]
    schema = "pair_id bigint, turn bigint, role string, text string"
    sides = [spark.createDataFrame(x, schema).withColumns({"place": F.lit(1), "side": F.lit("c"), "head": F.lit("h")}) for x in (c, r)]
    got = {x.pair_id: x for x in chat_format.format_pairs(*sides).collect()}
    assert got[1].n_prompt_turns == 2 and got[1].prompt == "<|system|>\ns<|end|>\n<|user|>\nu<|end|>\n"
    assert got[1].chosen == "<|assistant|>\né<|end|>\n<|user|>\nv<|end|>\n" and got[1].rejected == "<|assistant|>\nno<|end|>\n"
    assert (got[1].chosen_mask, got[1].rejected_mask) == ("14:23", "14:24")
    assert got[1].chosen[14:23] == "é<|end|>\n"
    assert (got[2].n_prompt_turns, got[2].chosen, got[2].rejected) == (1, "", "")
    assert (got[3].prompt, got[3].rejected, got[4].chosen, got[4].rejected_mask) == ("", "", "", "14:27")
    assert chat_format.op1(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0
    nobody = spark.createDataFrame([(None, 0, "user", "x"), (5, 0, "user", "y")], schema)
    assert [x.pair_id for x in chat_format.format_pairs(nobody, nobody).collect()] == [5]


def test_empty_tables(spark, empty):
    """Operators that have no test of their own on an empty table."""
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert quality.op3(empty, labels).count() == toxicity.op7(empty, labels).count() == token_counts.op9(empty).count() == 0


# -- op2 --------------------------------------------------------------------------------------


def shares(sizes, budget=1.5):
    names = sorted(k for k in sizes if k is not None) + [k for k in sizes if k is None]
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(names)}
    rest, free, out = budget * sum(sizes.values()), set(names), {}
    while free:
        total = sum(weight[k] for k in free)
        over = {k for k in free if rest * weight[k] / total > 2 * sizes[k]}
        if not over:
            return out | {k: rest * weight[k] / total for k in free}
        out |= {k: 2.0 * sizes[k] for k in over}
        rest, free = rest - sum(out[k] for k in over), free - over
    return out


def test_mixing(spark, docs, some, labels):
    got = mixing.op2(docs, labels).collect()
    again = mixing.op2(docs.repartition(7), labels).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    assert len(got) == len(some)
    want = {}
    for i, t in enumerate(some):
        k = None if i % 7 == 0 else f"s{i % 3}"
        want[k] = want.get(k, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    targets = shares(want)
    for k in want:
        own = [r for r in got if r.source == k]
        assert own[0].source_size == want[k] and own[0].target == pytest.approx(targets[k])
        assert abs(sum(r.taken for r in own) - targets[k]) <= max(r.size for r in own)
    assert all(r.taken <= 2 * r.size for r in got)


def test_mixing_by_brute_force(spark):
    """The cut of each source's sorted keys, with whole epochs before it, document by document."""
    rng = random.Random(11)
    data = [(None if i % 11 == 0 else i, " ".join("w" * rng.randint(0, 30)), rng.choice("ab") if i % 5 else None) for i in range(500)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, source string")
    weight = {i: float(rng.choice([1, 4])) for i in range(0, 500, 3)}
    quality = spark.createDataFrame(list(weight.items()), "doc_id bigint, weight double")
    got = mixing.mix(docs, quality, budget=1.2, keep=("text",)).collect()
    uniform = {(r.doc_id, r.text, r.source): r.u for r in docs.select("*", mixing._uniform("doc_id", "text").alias("u")).collect()}
    for source in (None, "a", "b"):
        own = [r for r in got if r.source == source]
        epochs = int(own[0].target // own[0].source_size)
        rest, until, want = own[0].target - epochs * own[0].source_size, 0, {}
        for key, doc_id, size in sorted(((-np.log(uniform[r.doc_id, r.text, source]) / weight.get(r.doc_id, 1.0), r.doc_id or 0, r.size) for r in own)):
            until += size
            want.setdefault((key, doc_id, size), []).append((epochs + (until - size / 2 <= rest)) * size)
        taken = {}
        for r in own:
            taken.setdefault((-np.log(uniform[r.doc_id, r.text, source]) / weight.get(r.doc_id, 1.0), r.doc_id or 0, r.size), []).append(r.taken)
        assert {k: sorted(v) for k, v in taken.items()} == {k: sorted(v) for k, v in want.items()}


def test_mixing_prefers_good_documents(spark):
    n = 4000
    docs = spark.range(n).selectExpr("id AS doc_id", "'a b' AS text", "'s' AS source")
    other = spark.range(n, 3 * n).selectExpr("id AS doc_id", "'a b' AS text", "'t' AS source")
    weights = docs.selectExpr("doc_id", "CASE WHEN doc_id % 2 = 0 THEN 4.0 ELSE 1.0 END AS weight")
    got = mixing.mix(docs.unionByName(other), weights, budget=0.25).where("source = 's' AND copies > 0").collect()
    assert sum(r.doc_id % 2 == 0 for r in got) > 0.6 * len(got) > 0


@pytest.mark.parametrize("data", [[], [(1, None, None)], [(1, "a b", "x"), (1, "a b", "x"), (None, "c", "x")]])
def test_mixing_small(spark, data):
    got = mixing.mix(spark.createDataFrame(data, "doc_id bigint, text string, source string")).collect()
    assert len(got) == len(data) and all(r.taken <= 2 * r.size for r in got)


# -- op3 --------------------------------------------------------------------------------------


def test_quality(spark, docs, some, labels):
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    trusted = {r.doc_id for r in labels.where("quality = 1").collect()}
    want = quality.brute_force(some, [i in trusted for i in range(len(some))])
    assert by_id(quality.op3(docs, labels), *cols) == dict(enumerate(want))


def test_quality_lines():
    odd = [None, "", " \n\n ", "a\n a\na\n\na", "é|é <>\n\n", "x" * 3000, "a b c d e a b c d e f", "a\r\na\r\nb"]
    got = []
    for c in chunks(pa.array(odd), limit=20):
        m = quality.measures(c)
        got += list(zip(*(m[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True))
    assert got == [x[:5] for x in quality.brute_force(odd, [False] * len(odd))]


def test_quality_rejects_noise(spark):
    rng = random.Random(2)
    clean = [" ".join(rng.choice(["the", "house", "stands", "near", "an", "old", "river", "of", "light"]) + rng.choice(["", "s", "."]) for _ in range(60)) for _ in range(80)]
    noise = [" ".join(w + rng.choice(["***", "%%%"]) for w in t.upper().split()) for t in clean[:20]]
    docs = spark.createDataFrame(list(enumerate(clean + noise)), "doc_id bigint, text string")
    kept = by_id(quality.judge(docs, spark.range(40).withColumnRenamed("id", "doc_id")), "kept")
    assert all(kept[i][0] for i in range(80)) and not any(kept[i][0] for i in range(80, 100))


# -- op4 --------------------------------------------------------------------------------------


def test_ngram_join(spark, docs, some):
    got = by_id(ngram_join.op4(docs), "n_shingles", "component_id")
    assert got == ngram_join.brute_force(list(enumerate(some)))


@pytest.mark.parametrize(("block", "tokens", "direct"), [(4, 1 << 20, 1), (1024, 150, 2), (4, 150, 99)])
def test_ngram_join_in_blocks(spark, monkeypatch, block, tokens, direct):
    """Groups over several blocks: chains of near copies, most of which aren't similar to their leader."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", tokens)
    monkeypatch.setattr(ngram_join, "DIRECT_BLOCKS", direct)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    data = []
    for i in range(40):
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(60)] = f"x{rng.randrange(999)}"
        data.append((1000 - i, " ".join(w)))
    got = by_id(ngram_join.near_components(spark.createDataFrame(data, "doc_id bigint, text string")), "n_shingles", "component_id")
    assert got == ngram_join.brute_force(data)


def test_filters_lose_no_link():
    rng = np.random.default_rng(6)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        x = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.93], rng.integers(0, 1 << 62, int(rng.integers(0, 6))).astype(np.uint64)]))
        if len(y) and ngram_join.similar(x, y, (75, 100)):
            for seed in ngram_join.ORDERS:
                order = ngram_join._Filter([ngram_join.filter_values(s, seed).tobytes() for s in (x, y)], np.array([1]))
                need = ngram_join.least_shared(len(x), np.array([len(y)]))
                assert order.passing(0, np.array([1]), need).all()
                assert np.intersect1d(x[ngram_join.prefix(x, seed)], y[ngram_join.prefix(y, seed)]).size


def test_ngram_join_odd(spark, empty):
    assert ngram_join.op4(empty).count() == 0
    data = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (9, "A B C D E F"), (4, None)]
    got = sorted(map(tuple, ngram_join.op4(spark.createDataFrame(data, "doc_id bigint, text string")).collect()), key=repr)
    assert got == sorted([(None, 2, None), (5, 2, 5), (5, 2, 5), (9, 2, 5), (4, 0, 4)], key=repr)


def test_ngram_join_several_texts_of_one_id(spark):
    """A copy of one of a document's texts takes nothing from the links of its other text."""
    some = [" ".join(f"{c}{i}" for i in range(60)) for c in "ab"]
    near = some[1].replace("b30", "x")
    data = [(3, some[0]), (5, some[0]), (5, some[1]), (9, near), (9, near), (12, "other words of another text here")]
    got = sorted(map(tuple, ngram_join.op4(spark.createDataFrame(data, "doc_id bigint, text string")).collect()))
    assert got == [(3, 56, 3), (5, 56, 3), (5, 56, 3), (9, 56, 3), (9, 56, 3), (12, 2, 12)]


def test_drop_near_copies_keeps_other_texts(spark):
    long = " ".join(f"a{i}" for i in range(60))
    data = [(1, long, "y"), (1, long, "x"), (1, "short text", "z"), (2, long + " end", "z"), (None, long, "n"), (None, long, "n"), (7, None, "k")]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, _rest string")
    got = sorted(map(tuple, ngram_join.drop_near_copies(docs).collect()), key=repr)
    assert got == sorted([(1, long, "x"), (1, "short text", "z"), (None, long, "n"), (None, long, "n"), (7, None, "k")], key=repr)


# -- op5 --------------------------------------------------------------------------------------


def vectors(seed, n, size=16):
    rng = np.random.default_rng(seed)
    out = [(0, None), (1, [0.0] * size), (2, [None] + [1.0] * (size - 1)), (3, [float("nan")] * size), (4, [float("inf")] * size), (5, [1.0, 0.0])]
    for i in range(n):
        v = rng.standard_normal(size)
        out.append((10 + 2 * i, v.tolist()))
        out.append((11 + 2 * i, (v * 3 + rng.standard_normal(size) * rng.choice([0, 0.2, 0.6])).tolist()))
    return out


@pytest.mark.parametrize("block", [3, 1024])
def test_embedding_dedup(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(1)
    centre = rng.standard_normal(16)
    data = vectors(2, 60) + [(500 + i, (centre + rng.standard_normal(16) * 0.15).tolist()) for i in range(40)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>").withColumns({c: F.lit(1) for c in ("number", "code", "block", "x", "label")})
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.op5(df).collect()}
    want = embedding_dedup.brute_force(data)
    assert sum(v[0] for v in got.values()) >= 0.97 * sum(v[0] for v in want.values()) > 0
    assert all(got[i][0] <= want[i][0] for i in want)
    assert {i: v[1:] for i, v in got.items()} == {i: v[1:] for i, v in want.items()}


def test_embedding_odd(spark):
    assert embedding_dedup.op5(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
    got = embedding_dedup.op5(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 4.0]), (None, [1.0, 2.0])], "vec_id bigint, embedding array<float>")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, 1, 1, True), (2, 1, 1, False), (None, 0, None, None)], key=repr)


def test_embedding_many_equal_vectors(spark):
    """A group of equal vectors is one entity: each counts all others, and what is near them counts them all."""
    n, x = 20_000, [0.5, 0.25, -1.0]
    rows = spark.range(n).selectExpr("id + 10 AS vec_id", "array(0.5F, 0.25F, -1.0F) AS embedding")
    more = spark.createDataFrame([(1, [0.5, 0.25, -1.01]), (2, [0.0, 1.0, 0.0]), (3, x)], "vec_id bigint, embedding array<float>")
    got = embedding_dedup.op5(rows.unionByName(more))
    assert {(r.n_links, r.component_id) for r in got.where("vec_id >= 10").collect()} == {(n + 1, 1)}
    assert by_id(got.where("vec_id < 10").withColumnRenamed("vec_id", "doc_id"), "n_links", "component_id", "kept") == {1: (n + 1, 1, True), 2: (0, 2, True), 3: (n + 1, 1, False)}


def test_embedding_recall(spark):
    """Pairs just above the least cosine are found nearly all, and the sketches lose none of them."""
    rng = np.random.default_rng(4)
    a = rng.standard_normal((1500, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.standard_normal(a.shape)
    b -= (a * b).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    cosine = rng.uniform(0.951, 0.96, 1500)[:, None]
    pairs = np.stack([a, cosine * a + np.sqrt(1 - cosine**2) * b], 1).reshape(3000, 64)
    got = {r.vec_id: r.component_id for r in embedding_dedup.op5(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(pairs)], "vec_id bigint, embedding array<double>")).collect()}
    assert np.mean([got[2 * i + 1] == 2 * i for i in range(1500)]) >= 0.98
    signs = pairs @ embedding_dedup.planes(64, embedding_dedup.SKETCH_BITS) > 0
    assert (signs[::2] != signs[1::2]).sum(1).max() <= embedding_dedup.most_apart()


# -- op6 --------------------------------------------------------------------------------------


def test_substring_dedup(spark, docs, some):
    want = substring_dedup.brute_force(some)
    assert by_id(substring_dedup.op6(docs), "n_words", "n_removed", "kept_sha256") == dict(enumerate(want))
    assert sum(w[1] for w in want) > 500


def test_substring_dedup_in_batches(spark, some, monkeypatch):
    monkeypatch.setattr("quillspark.llm.common.ARROW_BATCH_ROWS", 3)
    want = substring_dedup.brute_force(some, 6)
    got = by_id(substring_dedup.remove_repeats(table(spark, some).repartition(5), 6).withColumn("h", F.sha2("kept_text", 256)), "n_words", "n_removed", "h")
    assert got == dict(enumerate(want))


@pytest.mark.parametrize("rows_of_a_batch", [7, 100_000])
def test_substring_dedup_whatever_the_batches(spark, monkeypatch, rows_of_a_batch):
    """A hundred thousand rows with passages that repeat far apart, under any batch size at the time of the action; some texts twice as rows."""
    monkeypatch.setattr("quillspark.llm.common.ARROW_BATCH_ROWS", 10**6)
    passage = " ".join(f"p{i}" for i in range(8))
    n = 100_000 if rows_of_a_batch > 7 else 300
    some = [f"a{i} b{i} {passage} c{i}" if i % (n // 50) == 0 else f"x{i} y{i} z{i}" for i in range(n)]
    df = spark.createDataFrame(pa.table({"doc_id": pa.array(range(n)), "text": some})).coalesce(1)
    made = substring_dedup.remove_repeats(df, 8)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_of_a_batch)
    try:
        got = made.where("n_removed > 0").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {r.doc_id for r in got} == set(range(0, n, n // 50)) and all(r.n_removed == 8 and "p" not in r.kept_text for r in got)


@pytest.mark.parametrize("bits", [1, 6])
def test_substring_dedup_with_colliding_hashes(spark, some, bits):
    """Windows whose first hashes collide are told apart by the second."""
    want = substring_dedup.brute_force(some, 6)
    got = by_id(substring_dedup.remove_repeats(table(spark, some).repartition(5), 6, bits).withColumn("h", F.sha2("kept_text", 256)), "n_words", "n_removed", "h")
    assert got == dict(enumerate(want))


def test_substring_dedup_odd(spark, empty):
    assert substring_dedup.op6(empty).count() == 0
    long = " ".join(f"w{i}" for i in range(400))
    data = [(None, long), (1, "x " * 300 + long), (1, "short"), (2, None)]
    got = substring_dedup.op6(spark.createDataFrame(data, "doc_id bigint, text string")).collect()
    want = substring_dedup.brute_force([t for _, t in data])
    assert sorted(tuple(r)[1:] for r in got) == sorted(want)


# -- op7 --------------------------------------------------------------------------------------


def test_toxicity_learns(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    data = []
    for i in range(500):
        w = [word() for _ in range(rng.randint(5, 150))]
        if toxic := i % 4 == 0:
            w[rng.randrange(len(w))] = rng.choice(["slughead", "Dunceling!", "oafish,"])
        data.append((i, " ".join(w), int(toxic)))
    docs = spark.createDataFrame([d[:2] for d in data] + [(900, None), (901, "")], "doc_id bigint, text string").withColumn("score", F.lit(1))
    labels = spark.createDataFrame([(d[0], d[2]) for d in data], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.op7(docs, labels).collect()}
    held = [d for d in data if zlib.crc32(str(d[0]).encode()) % 5 == 0]
    assert all(got[d[0]].held_out for d in held) and not any(got[d[0]].held_out for d in data if d not in held)
    assert sum(got[d[0]].predicted == d[2] for d in held) >= 0.95 * len(held)
    assert got[900].score == got[901].score == 0
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_toxicity_forward_by_loops():
    """Scores of windows against the network written out step by step, with shorter windows padded at their end."""
    rng = np.random.default_rng(1)
    net = toxicity.train(["a b c d"] * 4, [0, 1, 0, 1])
    w = net.weights = {k: (rng.standard_normal(v.shape) * 0.5).astype(np.float32) for k, v in net.weights.items()}
    n = toxicity.STATE
    x = np.vstack([rng.standard_normal((9, toxicity.WORD_SIZE + toxicity.CHAR_SIZE)), np.zeros((1, toxicity.WORD_SIZE + toxicity.CHAR_SIZE))]).astype(np.float32)
    index = rng.integers(0, 9, (6, 7))
    for i in range(6):
        index[i, 7 - i :] = 9
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def read(words, d):
        h, out = np.zeros(n), []
        for i in words:
            a = x[i] @ w[f"W{d}"] + w[f"b{d}"]
            zr = sigmoid(a[: 2 * n] + h @ w[f"U{d}"])
            c = np.tanh(a[2 * n :] + (zr[n:] * h) @ w[f"V{d}"])
            h = (1 - zr[:n]) * h + zr[:n] * c
            out.append(h)
        return out

    for row, got in zip(index, net.logits(x, index), strict=True):
        words = [i for i in row if i != 9]
        states = [np.concatenate(both) for both in zip(read(words, "f"), read(words[::-1], "b")[::-1], strict=True)]
        e = np.array([np.tanh(s @ w["A"]) @ w["a"] for s in states])
        share = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
        assert got == pytest.approx(sum(k * s for k, s in zip(share, states, strict=True)) @ w["o"] + w["c"][0], abs=1e-4)


def test_windows_hold_short_phrases():
    """Every run of up to WINDOW - STRIDE + 1 words lies whole in a window, wherever it starts."""
    size = toxicity.WINDOW_WORDS - toxicity.STRIDE_WORDS + 1
    rows, _ = toxicity.window_index(np.array([0, 200]), np.arange(200), 999)
    held = {tuple(r[i : i + size]) for r in rows.tolist() for i in range(len(r) - size + 1)}
    assert all(tuple(range(i, i + size)) in held for i in range(200 - size + 1))


def test_windows_cover_every_word():
    bounds = np.array([0, 0, 3, 3 + 24, 27 + 25, 52 + 200])
    windows_, text = toxicity.window_index(bounds, np.arange(252), 999)
    for i in range(5):
        seen = set(windows_[text == i].ravel().tolist()) - {999}
        assert seen == set(range(bounds[i], bounds[i + 1]))


def test_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.train(["a b c d"] * 4, [0, 1, 0, 1])
    net.weights = {k: rng.standard_normal(v.shape) * 0.4 for k, v in net.weights.items()}
    size = toxicity.WORD_SIZE + toxicity.CHAR_SIZE
    x = np.vstack([rng.standard_normal((9, size)), np.zeros((1, size))])
    index, label = rng.integers(0, 10, (5, 6)), np.array([0, 1, 1, 0, 1.0])

    def loss():
        gates = [x @ net.weights[f"W{d}"] + net.weights[f"b{d}"] for d in "fb"]
        z = net._forward(gates, index.T, 9)[0]
        return float((np.logaddexp(0, z) - label * z).mean())

    grad, _ = net.gradients(x, index, label, np.ones(5))
    for k in ("o", "a", "A", "Uf", "Vf", "Wf", "bf", "Ub", "Vb", "Wb", "bb", "c"):
        v = net.weights[k]
        i = tuple(rng.integers(0, n) for n in v.shape)
        v[i] += 1e-3
        up = loss()
        v[i] -= 2e-3
        down = loss()
        v[i] += 1e-3
        assert grad[k][i] == pytest.approx((up - down) / 2e-3, abs=2e-4), k


def test_toxicity_without_labels(spark, docs):
    got = toxicity.op7(docs, spark.createDataFrame([], "doc_id bigint, toxic int")).collect()
    assert len(got) == docs.count() and not any(r.predicted for r in got)


# -- op8 --------------------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    for k, p in PLAIN.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}.get(k, lambda: True)()
            if good:
                out.append(f"{k}:{m.start()}:{m.end()}")
    return out


ODD = [
    "a@b.c_d@e.f x@y", "a@b.c.d@e.f +1 (555) 555-1234 4785380592391139", "é 1.2.3.4.5.6.7.8 0001.2.3.255 256.1.1.1 1.2.3.999", "4111 1111-1111 1111 4111111111111111 1", "+1 2",
    "+12345678901234567890 ++1 222 333 4444)", "1 2 3 " * 3000, "a" * 20000 + "@b.c", "7" * 20000, None, "", "@@a@b.c@d.e a@-.-", "😀 a@b.co 😀 10.0.0.1", "+1 (23) 4 5 6 7 8 9 0-", "..%+@x.y",
]


def test_pii_base(spark):
    rng = random.Random(9)
    more = ["".join(rng.choice("a1.@+- ()_4") for _ in range(60)) for _ in range(300)]
    data = list(enumerate(ODD + more))
    df = spark.createDataFrame(data, "doc_id bigint, text string").withColumns({c: F.lit("x") for c in ("email", "card", "instances", "row", "found")})
    got = {r.doc_id: r for r in pii.op8(df).collect()}
    for i, t in data:
        want = base(t)
        counts = tuple(sum(x.startswith(k + ":") for x in want) for k in PLAIN)
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == counts, t
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert got[i].spans.split(",")[: len(want)] == want


def test_pii_bootstraps(spark):
    seeds = [f"please write to me at u{i}@mail.org today" for i in range(8)]
    data = list(enumerate([*seeds, "please write to me at user_2291_x today", "version 12345678 was the last one", "see token = \"" + "ab12" * 10 + "\" there"]))
    got = by_id(pii.op8(spark.createDataFrame(data, "doc_id bigint, text string")), "spans")
    assert got[8] == ("id:22:33",) and got[9] == ("",) and got[10] == ("",)


def test_pii_keys_need_a_pattern(spark):
    """Keys are reported where a pattern of several keys confirms them, not in prose."""
    keys = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(6)]
    data = list(enumerate([*(f'{"x" * i} token = "{k}" there' for i, k in enumerate(keys[:5])), f"commit {keys[5]} was reverted"]))
    got = by_id(pii.op8(spark.createDataFrame(data, "doc_id bigint, text string")), "spans", "n_patterns", "n_spans")
    assert [got[i] for i in range(6)] == [*((f"id:{i + 10}:{i + 50}", 1, 1) for i in range(5)), ("", 0, 0)]


def pattern_spans(some):
    """Spans that the method adds, from dicts, by the module's docstring."""
    instances = []
    for row, text in enumerate(t or "" for t in some):
        spans = [tuple(map(int, x.split(":")[1:])) for x in base(text)]
        ids = [m.span() for m in re.finditer(r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9][A-Za-z_-]*[0-9])[A-Za-z0-9_-]{6,}", text)]
        free = [s for s in ids if not any(a < s[1] and s[0] < b for a, b in spans)]
        for is_base, (lo, hi) in [*((True, x) for x in spans), *((False, x) for x in free)]:
            left = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[0-9]+", "0", text[max(0, lo - 64) : lo].lower())) if w]
            right = re.match(r"[\x20\x09-\x0D]*([^\x20\x09-\x0D]*)", re.sub("[0-9]+", "0", text[hi : hi + 64].lower()))[1]
            patterns = [f"l:{left[-2]} {left[-1]}"] if len(left) > 1 else []
            patterns += [f"b:{left[-1]} _ {right}"] if left else []
            seed = is_base or bool(re.fullmatch("[0-9a-f]{32,}|[0-9A-F]{32,}", text[lo:hi]))
            instances.append((row, lo, hi, text[lo:hi].lower(), is_base, seed, patterns))
    edges = {}
    for *_, value, _, seed, patterns in instances:
        for p in patterns:
            edges.setdefault(p, {})[value] = edges.get(p, {}).get(value, False) or seed
    scores, trusted = {}, {}
    while True:
        trusted = {}
        for p, values in edges.items():
            known = [1.0 if seed else scores[v] for v, seed in values.items() if seed or v in scores]
            trust = round(sum(known) / (len(known) + 0.05 * (len(values) - len(known)) + 1), 9)
            if len(known) >= 3 and trust >= 0.75:
                trusted[p] = trust
        new = {}
        for p, t in trusted.items():
            for v, seed in edges[p].items():
                if not seed and v not in scores:
                    new[v] = max(new.get(v, 0), t)
        if not new:
            break
        scores |= new
    out = {}
    for row, lo, hi, _, is_base, _, patterns in instances:
        if not is_base and any(p in trusted for p in patterns):
            out.setdefault(row, set()).add((lo, hi))
    return [",".join(f"id:{lo}:{hi}" for lo, hi in sorted(out.get(row, ()))) for row in range(len(some))]


@pytest.mark.parametrize("seed", [1, 2])
def test_pii_graph_by_brute_force(spark, seed):
    """Random texts with few context words, so that patterns chain, against scoring by dicts."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["mail", "id", "ref", "to", "é", "user:", "x"])
    things = [lambda: f"u{rng.randrange(30)}@m.org", lambda: f"10.0.0.{rng.randrange(30)}", lambda: f"acct-{rng.randrange(60) + 100}", lambda: f"n{rng.randrange(40) + 10000}", lambda: hashlib.md5(bytes([rng.randrange(20)])).hexdigest(), word, word, word]
    some = [" ".join(rng.choice(things)() for _ in range(rng.randrange(40))) for _ in range(60)] + [None, ""]
    want, got = pattern_spans(some), by_id(pii.op8(table(spark, some)), "spans", "n_patterns")
    added = [",".join(x for x in got[i][0].split(",") if x.startswith("id:")) for i in range(len(some))]
    assert added == want and sum(n for _, n in got.values()) == sum(len(x.split(",")) for x in want if x) > 5


def test_pii_settles(spark):
    say = lambda left, value: f"{left} {value} today"
    data = [say("please mail me at", f"u{i}@mail.org") for i in range(10)]
    more = [say("please mail me at", f"user_{i + 100}_x") for i in range(20)]
    hop = [say("login name is", f"user_{i + 100}_x") for i in range(20)] + [say("login name is", "acct-7781-q")]
    few = [say("order number was", f"v{i}@mail.org") for i in range(3)] + [say("order number was", f"{i + 10000000}") for i in range(40)]
    rows = [*data, *more, *hop, *few]
    got = by_id(pii.op8(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")), "spans")
    found = {i for i, (spans,) in got.items() if "id:" in spans}
    assert found == set(range(len(data), len(data) + len(more) + len(hop)))
    at = rows.index(hop[-1])
    assert got[at] == (f"id:{len('login name is ')}:{len('login name is acct-7781-q')}",)


def test_redact(spark, empty):
    docs = spark.createDataFrame([(1, "é mail a@b.co now 10.0.0.1", "en", "s", 0), (2, None, "en", "s", 0), (3, "clean", "en", "s", 5)], DOCS)
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(docs).collect()}
    assert got == {1: ("é mail <EMAIL> now <IP>", 23), 2: (None, None), 3: ("clean", 5)}
    twice = pii.redact(docs.unionByName(docs).withColumn("doc_id", F.lit(None).cast("long")))
    assert sorted(r.text for r in twice.collect() if r.text) == sorted(2 * ["clean", "é mail <EMAIL> now <IP>"])
    assert pii.op8(empty).count() == 0


def test_pii_is_native(docs, monkeypatch):
    """The plans of every table that op8 and redact write, and of their results, hold no Python."""
    plans, written = [], pii.Written

    def record(df, name):
        plans.append(df._jdf.queryExecution().toString())
        return written(df, name)

    monkeypatch.setattr(pii, "Written", record)
    for work in (pii.op8, pii.redact):
        plans.append(work(docs)._jdf.queryExecution().toString())
    assert len(plans) > 10 and not any(x in p for p in plans for x in ("Python", "Arrow", "Pandas"))


def test_pii_finds_withheld_seeds(spark, monkeypatch):
    """Half of the keys aren't seeds; their patterns, trusted for the other half, find them, and leave others alone."""
    rng = random.Random(12)
    keys = [f"{rng.randrange(16):x}" + "".join(rng.choice("0123456789abcdef") for _ in range(31)) for _ in range(40)]
    texts = [f"word{rng.randrange(10**6)} my access token: {k} and item x{rng.randrange(10**6)}y{i:04d} more" for i, k in enumerate(keys)]
    monkeypatch.setattr(pii, "KEY", r"^[0-7][0-9a-f]{31}$")
    got = {x.value for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect() for x in r.found}
    assert got == set(keys) and 10 < sum(k[0] in "89abcdef" for k in keys) < 30


def test_pii_of_a_text_with_many_matches(spark):
    """Tens of thousands of spans in one text, beyond ASCII, are found and replaced in reasonable time."""
    n = 20_000
    t = "é".join(f" mail user{i}@host{i % 7}.example.org or card 4111 1111 1111 1111 " for i in range(n))
    df = spark.createDataFrame([(1, t)], "doc_id bigint, text string")
    r = pii.op8(df).first()
    ends = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    cards = [(m.start(), m.end()) for m in re.finditer(r"4111 1111 1111 1111", t)]
    spans = ",".join([f"email:{a}:{b}" for a, b in ends] + [f"card:{a}:{b}" for a, b in cards])
    assert (r.n_email, r.n_card) == (n, n) and r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
    assert pii.redact(df).first().text == "é".join([" mail <EMAIL> or card <CARD> "] * n)


# -- op9 --------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [1, 8, 1000])
def test_token_counts(spark, tmp_path, block):
    rng = random.Random(block)
    files = {f"part-{i}": [rng.choice([0, 0, 1, 2, 3, 500]) for _ in range(n)] for i, n in enumerate((0, 1, 7, 100, 64, 333))}
    for k, ids in files.items():
        (tmp_path / k).write_bytes(np.array(ids, "<u2").tobytes())
    got = token_counts.count_tokens(token_counts.read_flat(spark, str(tmp_path)), block_tokens=block).collect()
    for k, ids in files.items():
        own = sorted((r for r in got if r.file.endswith(k)), key=lambda r: r.document)
        assert [r.document for r in own] == list(range(len(own)))
        assert [(r.first_token, r.n_tokens) for r in own] == token_counts.brute_force(ids)


def test_token_counts_of_documents(spark, docs, some, empty):
    got = by_id(token_counts.op9(docs), "n_tokens")
    assert got == {i: (len(re.findall(r"[^\x20\x09-\x0D]+", t or "")),) for i, t in enumerate(some)}
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, "x")], "doc_id bigint, text string")
    assert sorted((r.n_tokens for r in token_counts.op9(twice).collect())) == [1, 1, 2, 2]


# -- op10 -------------------------------------------------------------------------------------

TRICKY = [
    "Hello  World, it's é 12 <|endoftext|>x", "É x y\xa0z ﬁ İ Σς ΑΣ", "", "  ", "a‍b \u0000 c", "<|startoftext|><|endoftext|>", "x" * 3000, "<|endof text|>", "é́ a b \x1c\x1d q\u0085r  ", "'S 'LL it'D",
    "😀🎉 한국어 日本語 ١٢٣ ½", None, "a <|endoftext|> b", "<<|endoftext|>>", "́abc", "ǅ ß ẞ ŉ ﬆ Ⅷ", "don't you're I'm we'll he'd",
]


def test_bpe_equals_tokenizers(spark, some):
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.word_bpe_path()
    tok = tokenizers.Tokenizer.from_file(path)
    data = list(enumerate(TRICKY + some))
    df = spark.createDataFrame(data, "doc_id bigint, text string").withColumn("ids", F.lit("x"))
    got = by_id(bpe.encode(df, path), "n_tokens", "ids", "decoded")
    for i, t in data:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i][1], "<u4").tolist() == ids and got[i][0] == len(ids), t
        assert got[i][2] == tok.decode(ids, skip_special_tokens=False)
        assert bpe.vocabulary(path).decode(ids) == got[i][2]


def test_bpe_digests(spark, empty):
    r = bpe.op10(spark.createDataFrame([(1, None)], "doc_id bigint, text string")).first()
    nothing = hashlib.sha256(b"").hexdigest()
    assert tuple(r) == (1, 0, nothing, nothing)
    assert bpe.op10(empty).count() == 0
