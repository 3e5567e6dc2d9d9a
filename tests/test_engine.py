from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from skein.operators import providers as P
from skein.operators.engine import DocumentIndex, Memory, build_context

TEXTS = {1: "Spark plans queries with Catalyst.\nTungsten runs them.", 2: "Cats chase mice in the garden.", 3: "A garden needs water.\nSpark plugs are for engines."}


def docs(spark, ids=TEXTS):
    return spark.createDataFrame([(i, f"d{i}", "text", TEXTS[i]) for i in ids], "doc_id long, doc_name string, doc_type string, text string")


def test_document_index(spark, tmp_path):
    index = DocumentIndex(spark, str(tmp_path), limit=6, overlap=0)
    assert index.search("anything").count() == 0
    index.add(docs(spark, [1, 2]))
    index.add(docs(spark, [2, 3]))
    assert index.documents().count() == 3
    assert index.search("catalyst queries", 2).first().doc_id == 1
    assert {r.doc_id for r in index.search("spark", 9, where=F.col("doc_id") != 1).collect()} == {3}
    index.delete([1])
    assert index.search("catalyst").count() == 0
    stats = {r.doc_type: r.documents for r in index.statistics().collect()}
    assert stats == {"text": 2, "all": 2}
    index.add_text("Catalyst is back", "note", 9)
    assert index.search("catalyst").first().doc_name == "note"
    index.clear()
    assert index.chunks.count() == 0


def test_generated_searches(spark, tmp_path):
    said = {"Write 3": "1. garden cats\n- mice\n1. garden cats", "Write a": "Mice run from cats."}
    generate = lambda prompt: next((v for k, v in said.items() if prompt.startswith(k)), "generated")
    index = DocumentIndex(spark, str(tmp_path), P.hashing_encoder(), generate, limit=30)
    index.add(docs(spark))
    assert P.query_variants(generate, "cats") == ["cats", "garden cats", "mice"]
    assert index.search_variants("cats", 2).first().doc_id == 2
    assert index.search_hypothetical("pets", 2).first().doc_id == 2
    assert index.search_expanded("cats", 3).first().doc_id == 2
    answer, evidence = index.answer("cats", 2)
    assert answer == "generated" and evidence[0].startswith("[1] Cats")
    assert index.search("cats").first().method == "hybrid"


def test_memory(spark, tmp_path):
    at = lambda d: datetime(2024, 1, d)
    rows = [
        ("a", "spark query plan", "working", 0.9, at(9), "s", None, None), ("b", "spark shuffle", "working", 0.8, at(9), "s", None, None), ("c", "old spark note", "episodic", 0.1, at(1), "t", None, None),
        ("d", "spark picture", "perceptual", None, at(9), "t", None, "x/cat.png"), ("e", "spark is an engine", "semantic", 0.9, None, "t", None, None), ("f", "spark is an engine", "semantic", 0.5, at(3), "t", None, None),
    ]
    m = Memory(spark, str(tmp_path), ttl_minutes=1e5)
    m.add(spark.createDataFrame(rows, Memory.SCHEMA))
    now = F.lit(at(10)).cast("timestamp_ntz")
    found = m.search("spark engine", now, 10).collect()
    assert {r.memory_id for r in found} == set("abcdef") and found[0].memory_id == "e"
    assert {r.memory_id for r in m.search("spark", now, 10, ["working"], session="s").collect()} == {"a", "b"}
    m.maintain(now, "mixed", 0.3, 5, similarity=0.9)
    assert {r.memory_id for r in m.rows.collect()} == set("abde")
    m.consolidate(0.7)
    left = m.rows.collect()
    assert len(left) == 3 and any(r.content == "spark query plan\nspark shuffle" and r.importance > 0.9 for r in left)


def test_build_context(spark):
    part = lambda texts: spark.createDataFrame([(t, None) for t in texts], "content string, ts timestamp_ntz")
    parts = {"system": part(["Be exact."]), "rag": part(["spark plans queries", "cats and mice", "spark " * 50]), "history": part(["we spoke of spark"])}
    out, stats = build_context("spark plans", parts, F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz"), 20, 500, 0.1)
    text = out.first().text
    assert "[Role & Policies]\nBe exact." in text and "[1] spark plans queries" in text and "- we spoke of spark" in text and "cats" not in text
    assert stats.first().packets == 2


def test_providers(spark):
    rows = spark.createDataFrame([("a b",), ("a b",), ("",), (None,)], "text string")
    got = P.embed(rows, P.hashing_encoder(8)).collect()
    assert got[0].embedding == got[1].embedding and len(got[0].embedding) == 8 and got[2].embedding is None and got[3].embedding is None
    assert P.embed(rows, None).where("embedding is not null").count() == 0
    assert P.ranking_of('ok [{"index": 1, "score": 7}, {"index": 1, "score": 0}, {"index": 9, "score": 1}, {"index": 0, "score": 0.2}]', 3) == [(1, 1.0), (0, 0.2)]
    assert P.ranking_of("none", 3) == P.ranking_of("[broken", 3) == []

    def down(query):
        raise OSError

    assert P.web_search([("a", down), ("b", lambda q: []), ("c", lambda q: [{"title": q, "link": "u"}])], "x") == [P.Found("x", "u", "", "c")]
    one = spark.createDataFrame([("x [{\"index\": 0, \"score\": 3}]", 1, "Permission denied")], "a string, code int, out string")
    r = one.select(P.json_rankings(F.col("a")).alias("j"), P.terminal_status(F.col("code"), F.col("out")).alias("s")).first()
    assert r.j[0].score == 1.0 and r.s == "refused"
    text = spark.createDataFrame([("", "a/red-cat.png", ["pet"], "image")], "c string, p string, l array<string>, m string")
    assert text.select(P.semantic_text(F.col("c"), F.col("p"), F.col("l"), F.col("m")).alias("t")).first().t == "red cat pet image"
    sizes = [r["count"] for r in P.batches(spark.range(0, 50, 1, 2)).groupBy("batch").count().collect()]
    assert sorted(sizes) == [5, 5, 10, 10, 10, 10]
