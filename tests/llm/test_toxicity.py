from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import toxicity as T


def build(spark, n=900):
    """Toxic documents pair an insult with a group; each alone is clean, so a linear score cannot tell them."""
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        neutral = [f"w{rng.randrange(300)}" for _ in range(rng.randint(5, 60))]
        kind = i % 4
        extra = {0: [], 1: ["foul"], 2: ["group"], 3: ["foul", "group"]}[kind]
        text = neutral + extra
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(kind == 3)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_interactions_are_learnt_and_held_out_rows_agree(spark):
    docs, labels = build(spark)
    model = T.train(docs, labels)
    got = T.score(docs, model).join(labels.withColumnRenamed("doc_id", "id"), "id").select("score", "toxic", T.held_out("id").alias("held")).collect()
    held = [r for r in got if r.held]
    assert len(held) > 200
    right = [(r.score >= T.THRESHOLD) == bool(r.toxic) for r in held]
    assert np.mean(right) > 0.95


def xor(spark, n):
    """Toxic if exactly one of two words occurs: neither word alone tells anything."""
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        text = [f"w{rng.randrange(200)}" for _ in range(rng.randint(5, 60))]
        one, two = rng.random() < 0.5, rng.random() < 0.5
        text += ["foul"] * one + ["group"] * two
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(one != two)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("n", [600, 2000])
def test_words_that_matter_only_in_pairs(spark, n):
    docs, labels = xor(spark, n)
    model = T.train(docs, labels)
    got = T.score(docs, model).join(labels.withColumnRenamed("doc_id", "id"), "id").where(T.held_out("id")).collect()
    assert len(got) > 150 and np.mean([(r.score >= 0.5) == bool(r.toxic) for r in got]) >= 0.9


def test_margins_equal_the_plain_sum():
    rng = np.random.default_rng(3)
    model = T.FactorizationMachine(np.zeros(1), 0.3, rng.normal(size=40), rng.normal(size=(40, 5)))
    rows = [np.sort(rng.choice(40, size, replace=False)) for size in (0, 1, 7, 0, 40, 3)]
    want = [0.3 + sum(model.w[i] for i in r) + sum(model.v[i] @ model.v[j] for k, i in enumerate(r) for j in r[k + 1 :]) for r in rows]
    assert np.allclose(model.margins(np.concatenate(rows).astype(int), np.array([len(r) for r in rows])), want)


def test_a_repeated_id_is_one_row(spark):
    docs, labels = build(spark, 300)
    many = docs.unionByName(docs.where("doc_id in (0, 3)").crossJoin(spark.range(500).drop("id").withColumn("n", F.lit(1))).drop("n"))
    assert many.count() > 1000
    a, b = T.train(docs, labels), T.train(many, labels)
    assert np.array_equal(a.w, b.w) and np.array_equal(a.v, b.v)


def test_held_out_labels_are_not_read(spark):
    docs, labels = build(spark, 300)
    flipped = labels.withColumn("toxic", F.when(T.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = T.train(docs, labels), T.train(docs, flipped)
    assert a.w0 == b.w0 and np.array_equal(a.w, b.w) and np.array_equal(a.v, b.v)


def test_edge_rows(spark):
    docs, labels = build(spark, 300)
    model = T.train(docs, labels)
    odd = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, "", "y"), (3, "foul group " * 30000, "z"), (None, "w1", "q")], "doc_id long, text string, toxicity_score_ string")
    got = T.score(odd, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.id in (1, 2)}) == 1
    kept = T.drop_toxic(odd, model)
    assert kept.columns == ["doc_id", "text", "toxicity_score_"] and sorted(r.toxicity_score_ for r in kept.collect()) == ["q", "x", "x", "y"] and 3 not in [r.doc_id for r in kept.collect()] and kept.count() == 4
    none = T.train(docs, labels.where("false"))
    assert T.score(docs, none).where("score >= 0.7").count() == 0
    assert T.score(docs.where("false"), model).count() == 0
    voided = labels.withColumn("toxic", F.when(F.col("doc_id") % 2 == 0, F.col("toxic"))).unionByName(labels.withColumn("doc_id", F.lit(None).cast("long")))
    T.train(docs, voided.unionByName(labels.limit(10)))


def test_query(spark, sf):
    from skein.llm.entry import QUERIES

    out = QUERIES["op3_toxicity"](spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert set(out.columns) == {"doc_id", "held_out", "score", "predicted"}
    assert out.count() == docs.count() and out.where("predicted <> cast(score >= 0.7 as int)").count() == 0
