from __future__ import annotations

import random

import corpus_pipeline as pipeline

from skein.llm import simhash


def text(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_exactly_one_row_of_each_set(spark, documents):
    rng = random.Random(3)
    a, b, c = (text(rng, 80) for _ in range(3))
    rows = documents([(5, a), (5, a), (9, a), (5, b), (7, c), (7, c), (4, "alone"), (8, None), (8, None), (6, b)])
    nulls = [(None, a, "en", "s", 1), (None, "only here", "en", "s", 1), (None, "only here", "en", "s", 1)]
    rows = rows.unionByName(spark.createDataFrame(nulls, rows.schema))
    kept = simhash.keep_row(rows)
    want = [(5, a), (5, b), (7, c), (4, "alone"), (8, None), (None, "only here")]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str) and kept.columns == rows.columns
    assert simhash.keep_row(rows.where("false")).count() == 0
    assert sorted(r.doc_id for r in simhash.keep_row(documents([(2, a), (1, a), (3, b)])).collect()) == [1, 3]


def test_a_repeated_row_keeps_its_text_through_the_pipeline(spark, documents, folder):
    rng = random.Random(12)
    clean = [text(rng, 120) for _ in range(60)]
    toxic = [f"{text(rng, 40)} idiot {text(rng, 10)} scum moron {text(rng, 20)}" for _ in range(30)]
    docs = documents([*enumerate(clean + toxic), (0, clean[0]), (0, clean[0]), (1, clean[1])])
    labels = spark.createDataFrame([(i, 1, int(i >= 60)) for i in range(90)], "doc_id long, quality int, toxic int")
    where = folder(documents=docs, labels=labels, benchmark=spark.createDataFrame([(1, text(rng, 40))], "item_id long, text string"))
    assert sorted((r.doc_id, r.text) for r in pipeline.run(spark, where).collect()) == list(enumerate(clean))
