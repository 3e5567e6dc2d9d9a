"""Entities are found once in a text, and pairs that can't repeat aren't made."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from skein.operators import graph as G


def test_names_are_evaluated_once(spark):
    rows = spark.createDataFrame([(1, "Redis and 'go' Paris"), (2, None), (3, ""), (4, "知识图谱使用图数据库 Paris")], "memory_id long, content string")
    found = G.mentions(rows)
    assert {(r.memory_id, r.key) for r in found.collect()} == {(1, "redis"), (1, "go"), (1, "paris"), (4, "知识图谱"), (4, "paris")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("「") == 1  # no filter that repeats the names' patterns


def test_counted_edges_without_rare_ends(spark, tmp_path):
    rng = random.Random(4)
    held = {m: {f"k{rng.randrange(12)}" for _ in range(rng.randrange(6))} | {f"only{m}"} for m in range(40)}
    found = spark.createDataFrame([(m, k, k) for m, keys in held.items() for k in keys], "memory_id long, key string, name string")
    counts = Counter(p for keys in held.values() for p in combinations(sorted(keys), 2))
    got = G.edge_counts(found, f"{tmp_path}/a")
    assert {(r.source, r.target): (r.n, r.weight) for r in got.collect()} == {p: (n, n / 2) for p, n in counts.items() if n > 1}
    every = G.edge_counts(found, f"{tmp_path}/b", least=1)
    assert {(r.source, r.target): r.n for r in every.collect()} == counts
    assert spark.read.parquet(f"{tmp_path}/a").where(F.col("key").startswith("only")).count() == 40
    assert "left_semi" in got._jdf.queryExecution().optimizedPlan().toString().lower().replace("leftsemi", "left_semi")


def test_edges_of_bounded_tasks(spark, monkeypatch):
    """What a task joins doesn't grow with the table: no shuffle after the one that deals the mentions."""
    monkeypatch.setattr(G, "TASK_MENTIONS", 10)
    found = spark.createDataFrame([(m, f"k{k}") for m in range(20) for k in range(m % 5)], "memory_id long, key string")
    edges = G.edges_at(G.dealt(found), spark.createDataFrame([("k0",)], "key string"))
    assert {(r.memory_id, r.source, r.target) for r in edges.collect()} == {(m, "k0", f"k{k}") for m in range(20) for k in range(1, m % 5)}
    assert G.dealt(found).rdd.getNumPartitions() == 4
