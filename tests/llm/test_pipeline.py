from __future__ import annotations

import random

import corpus_pipeline as pipeline
import helpers

from skein.llm import decontam, sentencepiece_ops, toxicity


def test_stages_do_what_they_say(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "simhash", "suffix_dedup", "decontamination", "sentencepiece"] and pipeline.ORACLE_SQL is None
    first = pipeline.drop_toxic(spark, docs, sf)
    scores = {r.id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    kept = {r.doc_id: r for r in first.collect()}
    assert first.columns == docs.columns and set(kept) == {i for i, s in scores.items() if s < toxicity.THRESHOLD}

    second = pipeline.one_of_each(spark, first, sf)
    prints = {i: helpers.fingerprint(r.text) for i, r in kept.items()}
    comp = helpers.components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    single = {r.doc_id: r for r in second.collect()}
    assert sorted(second.columns) == sorted(docs.columns) and set(single) == {i for i, c in comp.items() if i == c}

    third = pipeline.cut_repeats(spark, second, sf)
    ids = sorted(single)
    left = helpers.without_repeats([single[i].text.encode() for i in ids])
    got = {r.doc_id: r for r in third.collect()}
    assert {i: got[i].text for i in ids} == {i: x[3].decode("utf-8", "ignore") for i, x in zip(ids, left, strict=True)}
    assert all(r.n_chars == len(r.text) for r in got.values()) and third.columns == second.columns

    fourth = pipeline.drop_leaks(spark, third, sf)
    index = decontam.ItemIndex(*(list(x) for x in zip(*((r.item_id, r.text) for r in bench.collect()), strict=True)))
    clean = {i for i in got if not decontam.find(index, [got[i].text])}
    assert {r.doc_id for r in fourth.collect()} == clean and len(clean) < len(got)

    last = {r.doc_id: r for r in pipeline.to_tokens(spark, fourth, sf).collect()}
    model = sentencepiece_ops.model()
    assert set(last) == clean and all(r.text == got[i].text and r.ids == model.encode([r.text])[0].tolist() and r.n_tokens == len(r.ids) for i, r in last.items())
    whole = {r.doc_id: r.n_tokens for r in pipeline.run(spark, sf).collect()}
    assert whole == {i: r.n_tokens for i, r in last.items()}


def test_planted_cases(spark, documents, folder):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    clean = [text(120) for _ in range(300)]
    toxic = [f"{text(40)} idiot {text(10)} scum moron {text(20)}" for _ in range(60)]
    passage, item = text(70), text(40)
    texts = [*clean, *toxic, clean[0], clean[1], f"{text(60)} {passage} {text(60)}", f"{text(60)} {passage} {text(60)}", f"{text(50)} {item} {text(50)}"]
    n = len(clean)
    docs = documents(texts)
    labels = spark.createDataFrame([(i, 1, int(n <= i < n + 60)) for i in range(n + 60)], "doc_id long, quality int, toxic int")
    where = folder(documents=docs, labels=labels, benchmark=spark.createDataFrame([(1, item)], "item_id long, text string"))
    got = {r.doc_id: r.text for r in pipeline.run(spark, where).collect()}
    first = n + 60
    assert set(got) == set(range(n)) | {first + 2, first + 3}
    assert all(got[i] == clean[i] for i in range(n)) and all(passage not in got[i] for i in (first + 2, first + 3))


def test_empty_documents(spark, documents, folder):
    where = folder(documents=documents([]), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"), benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert pipeline.run(spark, where).count() == 0
