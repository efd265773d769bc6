"""Stages of the pipeline on rows with planted cases, and the whole of it."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from reelspark.llm.common import table

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    bench = table(spark, FOLDER, "benchmark").orderBy("item_id").limit(1).first().text
    rng = random.Random(1)
    say = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    shared, copy = say(55), say(150)
    planted = [(9001, copy), (9002, copy), (9003, copy + " end"), (9004, say(60) + " " + bench + " " + say(60)), (9005, say(100) + shared + say(100)), (9006, say(120) + shared), (9007, None), (9008, say(100))]
    more = spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in planted], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(more).withColumn("digest", F.lit(7))
    before = docs.count()
    ids = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        ids[name] = {r.doc_id: r for r in docs.collect()}
    assert len(ids["quality classifier"]) > 0.5 * before
    near, cut, clean = (ids[n] for n in ("n-gram Jaccard join", "suffix-array dedup", "benchmark decontamination"))
    assert 9001 in near and 9002 not in near and 9003 not in near
    assert shared not in cut[9005].text and shared not in cut[9006].text and cut[9005].n_chars == len(cut[9005].text)
    assert 9004 in cut and 9004 not in clean and {9001, 9005, 9008} <= set(clean)
    assert all(r.digest == 7 for r in clean.values())


def test_run(spark):
    found = corpus_pipeline.run(spark, FOLDER)
    assert found.where("length < 1 or offset < 0 or offset + length > 2048").count() == 0
    assert found.select("doc_id").distinct().count() > 50


def test_nothing(spark):
    docs = table(spark, FOLDER, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0
