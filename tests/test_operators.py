from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from skein.operators import chunking as C
from skein.operators import context as X
from skein.operators import filters as P
from skein.operators import graph as G
from skein.operators import memory as M
from skein.operators import retrieval as R
from skein.operators import sqlgate as Q


def test_hybrid_merge_of_all_four_cases(spark):
    d = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.4)], "query_id int, chunk_id int, score double")
    s = spark.createDataFrame([(0, 1, 0.2), (0, 3, 0.9)], "query_id int, chunk_id int, score double")
    got = {r.chunk_id: (round(r.score, 4), r.method) for r in R.hybrid(d, s).collect()}
    assert got == {1: (0.41, "hybrid"), 2: (0.4, "embedding"), 3: (0.9, "tfidf")}


def test_fusion_and_merge(spark):
    rows = spark.createDataFrame([(0, 1, 0.9, "a"), (0, 2, 0.8, "a"), (1, 2, 0.7, "b"), (1, 3, 0.6, "b")], "query_id int, chunk_id int, score double, method string")
    got = {r.chunk_id: r.score for r in R.rank_fusion(rows).collect()}
    assert got == pytest.approx({1: 1 / 60, 2: 1 / 61 + 1 / 60, 3: 1 / 61})
    merged = {r.chunk_id: (round(r.score, 4), r.hits) for r in R.multi_query_merge(rows).collect()}
    assert merged == {1: (0.9, 1), 2: (0.92, 2), 3: (0.6, 1)}


def test_variants_and_rerank(spark):
    q = spark.createDataFrame([(1, "spark")], "query_id int, text string")
    more = spark.createDataFrame([(1, [" spark ", "", "catalyst"])], "query_id int, texts array<string>")
    assert [r.text for r in R.variants(q, more).orderBy("variant").collect()] == ["spark", "catalyst"]
    docs = spark.createDataFrame([(1, "spark engine"), (2, "spark spark fast"), (3, "nothing")], "chunk_id long, text string")
    first = R.coarse_to_fine("spark", docs, lambda texts: [len(t) for t in texts], fine=1).first()
    assert first.chunk_id == 2
    assert R.coarse_to_fine("spark", docs, None, fine=2).count() == 2


def memories(spark):
    at = lambda d: datetime(2024, 1, d)
    rows = [(i, f"note {i}", "episodic", i * 0.2, at(1 + i), "s1" if i < 2 else "s2", "text") for i in range(5)]
    return spark.createDataFrame(rows, "memory_id int, content string, memory_type string, importance double, ts timestamp_ntz, session_id string, modality string")


def test_forgetting(spark):
    m = memories(spark)
    now = F.lit(datetime(2024, 1, 10)).cast("timestamp_ntz")
    ids = lambda df: sorted(r.memory_id for r in df.collect())
    assert ids(M.forget(m, "importance", threshold=0.3)) == [2, 3, 4]
    assert ids(M.forget(m, "time", now, max_age_days=7)) == [2, 3, 4]
    assert ids(M.forget(m, "mixed", now, 0.1, 8)) == [1, 2, 3, 4]
    assert ids(M.forget(m, "capacity", capacity=2)) == [3, 4]
    assert ids(M.forget(m.withColumn("ts", F.lit(None).cast("timestamp_ntz")), "time", now)) == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError, match="unknown"):
        M.forget(m, "whim")


def test_dedup_keeps_the_better(spark):
    rows = [(1, "a b c d", 0.2), (2, "a b c d e", 0.9), (3, "x y z", 0.5), (4, "a b c d", 0.2)]
    df = spark.createDataFrame(rows, "memory_id int, content string, importance double")
    assert {(r.a, r.b) for r in M.similar_pairs(df, 0.8).collect()} == {(1, 2), (1, 4), (2, 4)}
    assert sorted(r.memory_id for r in M.drop_duplicates(df, 0.8).collect()) == [2, 3]


def test_prepare_and_upsert(spark):
    rows = spark.createDataFrame([("semantic", None, None, "a/b.png"), ("working", 3.0, None, None)], "memory_type string, importance double, modality string, file_path string")
    assert [(r.importance, r.modality) for r in M.prepare(rows).collect()] == [(0.9, "image"), (1.0, "text")]
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "k int, v string, t int")
    new = spark.createDataFrame([(1, "c", 1), (2, "d", 4), (3, "e", 1)], "k int, v string, t int")
    assert sorted((r.k, r.v) for r in M.upsert(old, new, "k", "t").collect()) == [(1, "c"), (2, "b"), (3, "e")]


def test_entities_and_graph(spark):
    m = spark.createDataFrame([(1, "Python使用Docker和数据库 by Alice"), (2, "Redis 缓存")], "memory_id int, content string")
    found = G.mentions(m)
    keys = {(r.memory_id, r.key) for r in found.collect()}
    assert {(1, "python"), (1, "docker"), (1, "alice"), (2, "redis")} <= keys
    assert G.cooccurrence(found).where("source = 'docker' and target = 'python'").count() == 1
    pattern = {(r.source, r.target, r.type) for r in G.pattern_relations(m, found).collect()}
    assert ("python", "docker", "uses") in pattern
    scores = {r.memory_id: r.score for r in G.graph_scores(spark.createDataFrame([("redis",)], "key string"), found, G.cooccurrence(found)).collect()}
    assert set(scores) == {2} and 0 < scores[2] <= 1
    types = spark.createDataFrame([("python",), ("Alice",), ("缓存",)], "n string").select(G.entity_type(F.col("n")).alias("t")).collect()
    assert [r.t for r in types] == ["language", "person", "concept"]
    triple = spark.createDataFrame([("缓存是组件",)], "t string").select(F.explode(G.dialogue_triples(F.col("t"))).alias("x")).first().x
    assert (triple.subject, triple.relation, triple.object) == ("缓存", "is_a", "组件")


def test_budgets(spark):
    rows = spark.createDataFrame([(1, i, s, t) for i, (s, t) in enumerate([(0.9, 5), (0.8, 9), (0.7, 3), (0.6, 4)])], "q int, id int, score double, tokens long")
    assert sorted(r.id for r in X.greedy_budget(rows, 12, "q", "id").collect()) == [0, 2, 3]
    assert sorted(r.id for r in X.prefix_budget(rows, 12, "q", [F.col("score").desc()]).collect()) == [0]


def test_compress():
    text = "\n\n".join(f"[{n}]\n" + "word " * 30 for n in ("Role & Policies", "Task", "Evidence", "Context"))
    out, changed, tokens = X.compress(text, 90)
    assert changed and tokens <= 90 and "[Task]\n" + ("word " * 30).strip() in out.replace("word \n", "word\n")
    assert X.compress("short", 90) == ("short", False, 1)
    assert X.count_tokens(X.truncate("a b c d e f g h", 4)) <= 4


def test_chunking():
    text = "First sentence here. " * 60 + "\n" + "短句。" * 300
    chunks = C.chunk_characters(text, 200, 20)
    assert all(len(c) <= 200 for c in chunks) and len(chunks) > 5
    assert all(w in "".join(chunks) for w in ("First sentence here.", "短句。"))
    assert C.chunk_characters("   ") == []
    long = "x" * 1000
    assert set("".join(C.chunk_characters(long, 100, 0))) == {"x"} and sum(map(len, C.chunk_characters(long, 100, 0))) >= 1000
    got = C.chunk_tokens(["a b c", "d e", "f g h i", "j " * 50], 6, 3)
    assert all(n <= 6 for _, n, _ in got) and got[0][0] == "a b c\n\nd e"
    assert "".join("".join(t.split()) for t, _, _ in got).count("j") >= 50
    assert C.cut_by_tokens("你好世界", 3) == ["你好", "世界"]
    with pytest.raises(ValueError, match="at least one"):
        C.chunk_tokens(["a"], 0, 0)


def test_metadata_filters(spark):
    rows = spark.createDataFrame([(1, '{"poi": "a", "tags": ["x", "y"]}'), (2, '{"poi": "b", "tags": ["y"], "n": null}'), (3, "broken"), (4, None)], "id int, m string")
    ids = lambda f: sorted(r.id for r in P.metadata_filter(rows, "m", f).collect())
    assert ids({"poi": "a"}) == [1]
    assert ids({"tags": ["x", "z"]}) == [1]
    assert ids({"tags": "y"}) == [1, 2]
    assert ids({"n": None}) == [1, 3, 4]  # a JSON null is there
    assert ids({}) == [1, 2, 3, 4]
    assert not P.meaningful({"a": None, "b": []}) and P.meaningful({"a": 0})


def test_policy(spark):
    calls = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("c", "x")], "role string, tool string")
    policies = spark.createDataFrame([("a", ["*"], ["y"]), ("b", ["z"], [])], "role string, allow array<string>, deny array<string>")
    got = {(r.role, r.tool): r.allowed for r in P.apply_policy(calls, policies).collect()}
    assert got == {("a", "x"): True, ("a", "y"): False, ("b", "x"): False, ("c", "x"): True}


@pytest.mark.parametrize(
    ("answer", "sql"),
    [
        ("select 1", "select 1 LIMIT 20"), ("```sql\nselect 1;\n```", "select 1 LIMIT 20"), ("Sure: SELECT a FROM t limit 5", "SELECT a FROM t limit 5"),
        ("select 'limit' as x", "select 'limit' as x LIMIT 20"), ("SHOW TABLES", "SHOW TABLES"), ("-- 无法回答", "-- 无法回答"),
    ],
)
def test_extract_sql(answer, sql):
    assert Q.extract_sql(answer) == sql


@pytest.mark.parametrize("sql", ["drop table x", "select 1; select 2", "with a as (select 1) insert into t select * from a", "", "delete from t"])
def test_refused_sql(spark, sql):
    with pytest.raises(ValueError, match="refused"):
        Q.run_sql(spark, sql)


def test_ask(spark):
    spark.createDataFrame([(1, "ann"), (2, "bob")], "id int, name string").createOrReplaceTempView("people")
    seen = []
    got = Q.ask(spark, "people names", lambda prompt: seen.append(prompt) or "SELECT name FROM people ORDER BY id", excluded=["secret"])
    assert [r.name for r in got.collect()] == ["ann", "bob"] and "people(" in seen[0]
    assert Q.run_sql(spark, "select name from people where id = :i", {"i": 2}).first().name == "bob"
    assert "订单" in Q.question_keywords("查询订单的数量")


@pytest.mark.parametrize("limit", [1 << 20, 40])
def test_dense_search_in_blocks(spark, monkeypatch, limit):
    """Blocks of queries change nothing; null, zero and shorter vectors resemble nothing."""
    from skein.operators import retrieval

    monkeypatch.setattr(retrieval, "VECTOR_BYTES", limit)
    q = {1: [1.0, 0.0], 2: [1.0, 1.0], 3: [0.0, -2.0], 4: [0.0, 0.0], 5: None}
    v = {10: [2.0, 0.0], 11: [1.0, 1.0], 12: [0.0, 3.0], 13: [0.0, 0.0], 14: None, 15: [1.0], 16: [-1.0, 0.5], 17: [1.0, None]}
    got = retrieval.dense_search(spark.createDataFrame(list(q.items()), "query_id int, vector array<double>"), spark.createDataFrame(list(v.items()), "chunk_id long, embedding array<float>"))
    root = round(0.5**0.5, 6)
    assert {(r.query_id, r.chunk_id): r.score for r in got.collect()} == {(1, 10): 1.0, (1, 11): root, (2, 10): root, (2, 11): 1.0, (2, 12): root}
