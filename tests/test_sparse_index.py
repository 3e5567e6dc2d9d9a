"""The stored index scores texts where they lie: no pair of a question and a text is shuffled."""

from __future__ import annotations

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from skein.operators import retrieval as R


@pytest.mark.parametrize("frequent", [5, 100_000])
def test_as_search_without_an_index(spark, tmp_path, monkeypatch, frequent):
    monkeypatch.setattr(R, "FREQUENT_TERMS", frequent)
    monkeypatch.setattr(R, "BROADCAST_ROWS", 30)  # several blocks of questions
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(60)], k=rng.randrange(0, 40))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, None)], "chunk_id long, text string").repartition(3)
    asked = spark.createDataFrame([(i, " ".join(rng.choices([*words, "unknown"], k=6))) for i in range(12)] + [(50, "nowhere"), (51, "")], "query_id long, text string")
    index = R.SparseIndex.build(docs, str(tmp_path))
    rows = lambda df: {(r.query_id, r.chunk_id): r.score for r in df.collect()}
    for raw in (False, True):
        want = rows(R.sparse_search(asked, docs, raw_document_tf=raw))
        assert rows(index.search(asked, raw_document_tf=raw)) == pytest.approx(want, abs=2e-6)
        best = rows(R.top_k(index.search(asked, raw_document_tf=raw, limit=5), 5))
        assert best == pytest.approx(rows(R.top_k(index.search(asked, raw_document_tf=raw), 5))) and len(best) == 60
    assert {r.id for r in index.postings.select("id").distinct().collect()} == {i for i, t in enumerate(texts) if t}


def test_no_pair_is_shuffled(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"a b{i % 7} c{i}") for i in range(50)], "chunk_id long, text string")
    index = R.SparseIndex.build(docs, str(tmp_path))
    plan = index.search(spark.createDataFrame([(1, "a b1"), (2, "c3")], "query_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def exchanged(df) -> list[str]:
    """The parts of a plan that lie below an exchange."""
    lines, found = df._jdf.queryExecution().executedPlan().toString().split("\n"), []
    for i, line in enumerate(lines):
        if "Exchange" in line:
            depth = re.search(r"[A-Z]", line).start()
            below = itertools.takewhile(lambda x: x.strip() and re.search(r"[A-Z]", x).start() > depth, lines[i + 1 :])
            found.append("\n".join(below))
    return found


def folder_of(spark, tmp_path, docs) -> str:
    spark.createDataFrame(docs, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a b1"), (2, "c3 b2"), (3, "a c7")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["sparse_tfidf_topk", "expanded_search"])
def test_texts_meet_their_lengths_where_they_lie(spark, tmp_path, name):
    """No text is moved to its length, in the index or in a search of it."""
    where = folder_of(spark, tmp_path, [(i, f"a b{i % 7} c{i}") for i in range(50)])
    found = entry.queries()[name](spark, where)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and not any("terms#" in x and "MapInArrow" not in x for x in exchanged(found))


def test_texts_are_stored_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"a b{i % 7} c{i}") for i in range(50)], "chunk_id long, text string").repartition(5)
    index = R.SparseIndex.build(docs, str(tmp_path))
    tables = [p for top in tmp_path.iterdir() for p in top.iterdir()]
    assert ["terms" in spark.read.parquet(str(p)).columns for p in tables].count(True) == 1
    assert index.texts.select("part").distinct().count() == 5 == len({r.part % 5 for r in index.texts.select(F.pmod(F.hash("part"), F.lit(5)).alias("part")).distinct().collect()})


def test_many_chosen_ids_move_no_text(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b{i % 7} c{i}" if i % 5 else "-") for i in range(80)], "chunk_id long, text string").repartition(5)
    asked = spark.createDataFrame([(1, "a b1"), (2, "c3")], "query_id long, text string")
    index = R.SparseIndex.build(docs, str(tmp_path))
    want = [tuple(r) for r in index.search(asked).where("chunk_id % 3 = 0").orderBy("query_id", "chunk_id").collect()]
    real = R.few
    monkeypatch.setattr(R, "few", lambda df, rows=0: df.columns != ["id"] and real(df))  # the ids are many
    got = index.search(asked, docs.select("chunk_id").where("chunk_id % 3 = 0"))
    assert sorted(tuple(r) for r in got.collect()) == want and want
    assert not any("terms#" in x for x in exchanged(got))


def test_a_text_sends_its_best_question_alone(spark, tmp_path):
    """Of texts with many questions only the best ones, and those equal when rounded, leave a batch; the best of each is the same."""
    docs = spark.createDataFrame([(i, f"a b{i % 7} c{i} d{i % 3}") for i in range(60)], "chunk_id long, text string").repartition(3)
    asked = spark.createDataFrame([(q, f"a b{q % 7} d{q % 3}") for q in range(42)], "query_id long, text string")  # each text is asked twice by the same words
    index = R.SparseIndex.build(docs, str(tmp_path))
    every, best = index.search(asked), index.search(asked, best=True)
    rows = lambda df: sorted(tuple(r) for r in R.best_of_each(df).collect())
    assert rows(best) == rows(every) and every.count() == 60 * 42 and best.count() == 60 * 2


def test_postings_as_their_sql(spark, tmp_path):
    """Rows without an id, a text or a word, and seldom terms; no text is moved."""
    import duckdb

    where = folder_of(spark, tmp_path, [(i, f"a b{i % 7} c{i} c{i}") for i in range(30)] + [(None, "a b1 c3"), (40, None), (41, "-"), (42, "")])
    found = entry.queries()["sparse_index"](spark, where)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{where}/documents.parquet/*.parquet')")
    want = con.execute(f"select id, term, unit, raw from ({entry.oracle_sql()['sparse_index']})").fetchall()
    got = sorted(tuple(r) for r in found.select("id", "term", "unit", "raw").collect())
    assert [r[:2] for r in got] == [r[:2] for r in sorted(want)] and len(want) == 90
    assert [r[2:] for r in got] == [pytest.approx(r[2:]) for r in sorted(want)]
    assert not any("terms#" in x and "Generate" not in x for x in exchanged(found))


def few_frequent(spark, monkeypatch):
    """Documents with many seldom terms."""
    monkeypatch.setattr(R, "FREQUENT_TERMS", 5)
    return spark.createDataFrame([(i, f"a a b{i % 7} c{i} d{i % 3} e{i // 2}") for i in range(60)] + [(70, None), (71, "-")], "chunk_id long, text string").repartition(5)


def test_lengths_of_an_index_shuffle_no_term(spark, tmp_path, monkeypatch):
    docs, lengths, real = few_frequent(spark, monkeypatch), [], R._by_part
    monkeypatch.setattr(R, "_by_part", lambda rows, value, parts: lengths.append(rows) or real(rows, value, parts))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index = R.SparseIndex.build(docs, str(tmp_path))
        plan = lengths[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "ShuffledHashJoin" in plan and "Bucketed: true" in plan
    assert not re.search(r"hashpartitioning\([^)]*term#", plan)  # of a text, a row for its frequent terms and one for the others
    of = lambda df: {tuple(r) for r in df.collect()}
    assert of(index.seldom.select("part", "term")) == of(index.texts.select("part", F.explode("terms").alias("term")).join(index.frequent, "term", "left_anti").select("part", "term"))
    assert of(index.seldom.select("term", "idf")) <= of(index.idf.select("term", "idf"))


def test_postings_shuffle_nothing(spark, tmp_path, monkeypatch):
    docs = few_frequent(spark, monkeypatch)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = R.SparseIndex.build(docs, f"{tmp_path}/few").postings
        plan = found._jdf.queryExecution().executedPlan().toString()
        rows = {(r.term, r.id): (r.tf, r.unit, r.raw) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "ShuffledHashJoin" in plan and "hashpartitioning" not in plan and spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
    monkeypatch.setattr(R, "FREQUENT_TERMS", 100_000)
    index = R.SparseIndex.build(docs, f"{tmp_path}/all")
    want = {(r.term, r.id): (r.tf, r.unit, r.raw) for r in index.postings.collect()}
    assert index.seldom is None and rows.keys() == want.keys() and len(rows) == 300
    assert all(rows[k] == pytest.approx(want[k]) for k in want)
