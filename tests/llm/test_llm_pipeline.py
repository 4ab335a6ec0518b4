"""The corpus pipeline, stage by stage, on hand-made documents."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import mixing, ngram_join, queries

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    word = lambda: rng.choice(["the", "river", "old", "house", "stands", "light", "near", "green"]) + rng.choice(["", "s", "ed", "ing"]) + rng.choice("abcdefgh")
    data = [(i, " ".join(word() for _ in range(rng.randint(20, 60)))) for i in range(60)]
    data += [(100 + i, data[i][1]) for i in range(5)]
    data += [(200 + i, data[i][1] + " zz") for i in range(5)]
    data += [(300, "few words"), (301, None), (302, ""), (303, " ".join(f"{word()}***" for _ in range(40)).upper()), (304, data[9][1] + " mail me a@b.org")]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in data], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_rules"](spark, docs, folder)
    assert good.columns == docs.columns
    ids = {r.doc_id for r in good.collect()}
    assert set(range(60)) <= ids and not ids & {300, 301, 302, 303}
    one = stages["ngram_jaccard_join"](spark, good, folder)
    kept = sorted(r.doc_id for r in one.collect())
    want = ngram_join.brute_force([tuple(r) for r in good.select("doc_id", "text").collect()])
    assert kept == sorted(i for i, (_, c) in want.items() if i == c) and one.columns == docs.columns
    clean = stages["pii"](spark, one.unionByName(docs.where("doc_id = 304")), folder)
    assert clean.where("doc_id = 304").first().text.endswith("mail me <EMAIL>")
    mixed = stages["source_mixing"](spark, one, folder)
    plan = {r.doc_id: r.copies for r in mixing.mix(one, mixing.quality_weights(spark.read.parquet(f"{folder}/labels.parquet"))).collect()}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {k: v for k, v in plan.items() if v}
    assert mixed.columns == docs.columns


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 60


def test_odd_ids(spark, tmp_path):
    """Rows without an id, and rows that repeat one, go through all stages; only copies of identified rows go."""
    rng = random.Random(2)
    text = lambda: " ".join(rng.choice(["river", "house", "light", "green", "old"]) + rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(50))
    a, b, c = text(), text(), text()
    data = [(None, a, "s"), (None, a, "s"), (1, a, "s"), (1, a, "s"), (1, b, "t"), (2, a, None), (None, None, "t"), (3, c, "t")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in data], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 1, 0), (None, 1, 1), (2, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_rules"](spark, docs, str(tmp_path))
    assert good.count() == 7
    one = stages["ngram_jaccard_join"](spark, good, str(tmp_path))
    assert sorted(((r.doc_id, r.text) for r in one.collect()), key=repr) == sorted([(None, a), (None, a), (1, a), (1, b), (3, c)], key=repr)
    assert stages["pii"](spark, one, str(tmp_path)).count() == 5
    got = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").count().collect()
    assert {r.doc_id for r in got} <= {None, 1, 3} and sum(r["count"] for r in got) >= 5


def test_clashing_columns(spark, folder):
    """Columns named like those that operators use inside go through all stages but the last unchanged."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 40 OR doc_id >= 200")
    names = ["copies", "_row", "_copy", "_rest", "row", "doc", "size", "spans", "new", "kept", "a.b", "_doc_lang", "component_id"]
    docs = docs.select("*", *(F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")).alias(c) for c in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert docs.columns[5:] == names and docs.count() > 30, name
        assert all(r[c] == f"{c}-{r.doc_id}" for r in docs.collect() for c in names), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count()


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered(spark):
    assert [k.split("_")[0] for k in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]
