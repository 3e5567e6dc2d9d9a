from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from skein.operators import facades as A
from skein.operators import filters as P
from skein.operators import providers, tools
from skein.operators.engine import DocumentIndex, Memory
from skein.sources.store import Store
from skein.streaming import state as ST



def now_():
    return F.lit(datetime(2024, 1, 10)).cast("timestamp_ntz")


def test_retrieval_actions(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "cats.md").write_text("# Cats\nCats chase mice.\n# Dogs\nDogs bark.", encoding="utf-8")
    (tmp_path / "in" / "spark.txt").write_text("Spark plans queries with Catalyst.", encoding="utf-8")
    a = A.RetrievalActions(DocumentIndex(spark, str(tmp_path / "store"), providers.hashing_encoder(), lambda p: "mice and cats"))
    preview = a.run("convert", path=str(tmp_path / "in"))
    assert {(r.section, r.preview) for r in preview.collect()} >= {("Cats", "# Cats\nCats chase mice."), ("Dogs", "# Dogs\nDogs bark.")}
    assert a.run("add_file", path=str(tmp_path / "in")) == 2 and a.run("list").count() == 2
    a.run("add_text", text="A garden needs water", title="garden", doc_id=7)
    assert a.run("search", query="catalyst", top_k=500).first().doc_name == "spark.txt" and a.run("SEARCH", query="catalyst", top_k=0).count() == 1
    for name in ("search_mqe", "search_hyde", "search_expanded"):
        assert a.run(name, query="cats", top_k=2).first().doc_name == "cats.md"
    assert a.run("query", query="cats")[0] == "mice and cats"
    found, seconds = a.run("retrieve", query="cats", top_k=2)
    assert found.first().doc_name == "cats.md" and list(seconds) == ["phrasings", "search", "fusion"] and min(seconds.values()) >= 0
    plain, _ = a.retrieve("cats", 2, hybrid=False, variants=False, hypothetical=False)
    assert [r.doc_name for r in plain.collect()] == ["cats.md"]
    a.run("delete", doc_ids=[7])
    assert a.run("stats").where("doc_type = 'all'").first().documents == 2
    a.run("clear")
    assert a.run("list").count() == 0
    with pytest.raises(ValueError, match="add_file"):
        a.run("fly")
    registry = tools.Registry()
    registry.register(a.tool("rag"))
    assert registry.execute("rag", {"action": "list"}).output.count() == 0


def test_memory_actions(spark, tmp_path):
    store = Memory(spark, str(tmp_path), ttl_minutes=1e6)
    a = A.MemoryActions(store, now_(), lambda query, texts: [float(len(t)) for t in texts])
    one = a.run("add", content="spark plans queries", memory_type="semantic", importance=0.9)
    a.run("add", content="spark is fast and spark is wide and long", memory_type="episodic", session_id="s", memory_id="e1")
    a.run("add", content="cats", memory_type="working", importance=0.1, ts=datetime(2023, 1, 1))
    assert a.run("search", query="spark plans").first().memory_id == one and a.run("search", query="spark", session_id="s").count() == 1
    assert [r.memory_id for r in a.run("rerank", query="spark", limit=2).collect()] == ["e1", one]
    a.scorer = None
    assert a.run("rerank", query="plans queries", limit=1).first().memory_id == one
    assert {r.memory_type: r.n for r in a.run("stats").collect()} == {"semantic": 1, "episodic": 1, "working": 1, "all": 3}
    assert a.run("forget", strategy="mixed") == 1 and a.run("list", memory_type="working").count() == 0
    a.run("replace_all", rows=store.rows.where("memory_id = 'e1'").withColumn("memory_id", F.lit("e2")), memory_type="episodic")
    assert {r.memory_id for r in a.run("list").collect()} == {one, "e2"}
    a.run("delete", memory_ids=["e2"])
    assert a.run("list").count() == 1
    a.run("clear")
    assert a.run("list").count() == 0
    with pytest.raises(ValueError, match="working"):
        a.run("add", content="x", memory_type="nope")


def test_dialogue_memory(spark, tmp_path):
    d = A.DialogueMemory(A.MemoryActions(Memory(spark, str(tmp_path), 1e6), now_()), cadences={"consolidate": 2, "deepen": 4, "forget": 3})
    assert d.retrieve("spark") == "" and d.store("what is spark", "an engine", 0.8, "working") == []
    assert d.store("q two", "a two", 0.6, "working") == ["consolidate"]
    kinds = {r.content: (r.memory_type, round(r.importance, 2)) for r in d.actions.store.rows.collect()}
    assert kinds["what is spark"] == ("episodic", 0.8) and kinds["an engine"] == ("episodic", 0.9) and kinds["a two"] == ("episodic", 0.7)
    assert d.store("q three", "a three", 0.2) == ["forget"] and d.store("q four", "a four", 0.2) == ["consolidate", "deepen"]
    assert {r.memory_type for r in d.actions.store.rows.where("importance >= 0.8").collect()} == {"semantic"}
    assert d.retrieve("spark", 3).splitlines()[0] == "- what is spark" and d.retrieve("spark", 1) == "- what is spark"
    d.set_top_k(99), d.set_threshold(-3)
    assert (d.top_k, d.threshold) == (20, 0.0) and A.DialogueMemory(d.actions).cadences == {"consolidate": 5, "deepen": 20, "forget": 10}
    off = A.DialogueMemory(d.actions, enabled=False)
    assert off.store("a", "b") == [] and off.retrieve("spark") == ""


def test_semantic_store(spark, tmp_path):
    s = A.SemanticStore(Store(spark, str(tmp_path)), providers.hashing_encoder(8))
    rows = lambda *x: spark.createDataFrame(list(x), "memory_id string, content string")
    s.insert(rows(("a", "Python uses Numpy for Arrays"), ("b", "Kafka feeds Numpy"), ("a", "Python uses Numpy for Arrays")))
    s.insert(rows(("b", "something else"), ("c", "Arrays and Kafka")))
    assert s.tables.read("semantic").count() == 3 and s.tables.read("semantic").where("memory_id = 'b'").first().content == "Kafka feeds Numpy"
    assert s.tables.read("semantic").where("embedding is null").count() == 0
    edges = {(r.memory_id, r.source, r.target) for r in s.tables.read("edges").where("type = 'co_occurrence'").collect()}
    assert ("b", "kafka", "numpy") in edges and ("c", "arrays", "kafka") in edges
    assert s.related("Tell me of Kafka").first().memory_id in ("b", "c")
    s.rebuild(rows(("z", "Only Java here")))
    assert s.tables.read("semantic").count() == 1 and s.tables.read("mentions").where("memory_id <> 'z'").count() == 0


def test_sessions(spark):
    rows = spark.createDataFrame([("s", 1, "a"), ("s", 5, "b"), ("t", 4, "a"), ("u", 9, "b")], "sid string, at int, kind string")
    assert [(r.session, r.updated_at, r.messages) for r in A.sessions(rows, "sid", "at").collect()] == [("u", 9, 1), ("s", 5, 2), ("t", 4, 1)]
    assert [r.session for r in A.sessions(rows, "sid", "at", F.col("kind") == "a", 1).collect()] == ["t"]


def test_guarded():
    now = [0.0]

    @A.guarded(tools.Breaker(2, 10), lambda: now[0], lambda x: "later")
    def call(x):
        """Divides."""
        return 1 / x

    for _ in range(2):
        with pytest.raises(ZeroDivisionError):
            call(0)
    assert call(1) == "later" and call.__doc__ == "Divides."
    now[0] = 11
    assert call(1) == 1 and call(2) == 0.5

    @A.guarded(tools.Breaker(1, 10), lambda: now[0])
    def other():
        raise OSError

    with pytest.raises(OSError):
        other()
    with pytest.raises(RuntimeError, match="switched off"):
        other()


def test_policies(spark):
    p = A.Policies().allow("a", "x").allow("a", "y").deny("a", "y").allow_all("b").set("c", ["z"])
    calls = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "q"), ("c", "x"), ("d", "x")], "role string, tool string")
    assert {(r.role, r.tool): r.allowed for r in P.apply_policy(calls, p.table(spark)).collect()} == {("a", "x"): True, ("a", "y"): False, ("b", "q"): True, ("c", "x"): False, ("d", "x"): True}
    assert p.statistics() == {"roles": 3, "allowed": 4, "denied": 1} and "a" not in p.remove("a").rules and p.allow("c", "k", replace=True).rules["c"][0] == {"k"}


def test_search_registry():
    r = A.search_registry([("p", lambda q: [{"title": q, "url": "u"}])], lambda: 0.0)
    assert r.execute("search", {"query": "spark"}).output[0]["title"] == "spark" and r.execute("calculator", {"expression": "2 + 3"}).output == 5
    assert r.execute("time").output == "1970-01-01 00:00:00"


def test_invalidate():
    cached = {"note:1": "a", "note:2": "b", "list:x": "l", "summary": "s", "search:q": "found n-1 here", "search:r": "found n-2"}
    assert set(A.invalidate(cached, "n-1")) == {"note:1", "note:2", "search:r"} and set(A.invalidate(cached, "2")) == {"note:1", "search:q"}


def test_skills(spark):
    s = A.ActiveSkills(spark.createDataFrame([("b", "d", "B"), ("a", "d", "A")], "name string, description string, content string"))
    on = s.activate("b", "a")
    assert on.context().first().text == "## a\nA\n\n## b\nB" and on.deactivate("a").context().first().text == "## b\nB" and on.use("a").first().content == "A"
    with pytest.raises(ValueError, match="zzz"):
        s.activate("zzz")


def test_media(spark):
    rows = spark.createDataFrame([("a.png", b"12", "g"), ("b.png", b"3", "g"), ("c.png", b"", "h"), ("d.png", None, "h")], "path string, content binary, album string")
    model = lambda prompt, parts: f"{prompt}{sorted(len(p) for p in parts)}"
    assert {r.path: r.description for r in A.describe_media(rows, model, "see ").collect()} == {"a.png": "see [2]", "b.png": "see [1]", "c.png": "too large or empty", "d.png": "too large or empty"}
    assert {r.album: r.description for r in A.describe_media(rows, model, "see ", "album").collect()} == {"g": "see [1, 2]", "h": "too large or empty"}


@pytest.mark.parametrize("seed", range(3))
def test_disabled_calls_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), i, float(rng.randrange(400)), rng.choice(["ok", "fine", "错误：x", "工具执行失败: y", "【搜索不可用】", None][: 4 + seed])) for i in range(300)]
    got = {r.seq: r.refused for r in ST.disabled_calls(spark.createDataFrame(rows, "tool string, seq long, ts double, result string"), 3, 20.0).collect()}
    off, bad = {}, {}
    for tool, seq, ts, result in sorted(rows, key=lambda r: (r[2], r[1])):
        if tool in off and ts > off[tool] + 20:
            del off[tool]
            bad[tool] = 0
        assert got[seq] == (tool in off)
        if tool not in off:
            failed = bool(result) and result[0] in "错工【"
            bad[tool] = bad.get(tool, 0) + 1 if failed else 0
            if bad[tool] >= 3 or (failed and result[0] == "【"):
                off[tool] = ts
    assert any(got.values()) and not all(got.values())


def test_cache_stream_and_replay(spark, tmp_path):
    rng = random.Random(1)
    rows = [("c", i, float(i), rng.choice(["get", "get", "set", "update"]), f"k{rng.randrange(6)}", f"v{i}") for i in range(200)]
    schema = "cache string, seq long, ts double, op string, key string, value string"
    for k in range(4):
        spark.createDataFrame(rows[50 * k : 50 * k + 50], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = "cache_out"
    q = ST.cache_stream(stream, 3, 30.0, 10).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    cache, want = ST.ExpiringCache(3, 30.0, 10), {}
    for _, seq, ts, op, key, value in rows:
        if op == "get":
            want[seq] = cache.get(key, ts)
        else:
            getattr(cache, op)(key, value, ts)
    assert {r.seq: r.found for r in spark.table(name).collect()} == want and any(want.values())
    ops = spark.createDataFrame([r for r in rows if r[3] != "update"], schema)
    free = ST.ExpiringCache(10**6, 30.0, 10**6)
    wanted = {}
    for _, seq, ts, op, key, value in rows:
        if op == "get":
            wanted[seq] = free.get(key, ts)
        elif op == "set":
            free.set(key, value, ts)
    assert {r.seq: r.found for r in ST.cache_replay(ops, 30.0).collect()} == wanted
