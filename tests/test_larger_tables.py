"""Queries whose faults show only once their tables have several partitions."""

from __future__ import annotations

import random

import __spark_entry__ as entry


def test_join_lateral_over_many_partitions(spark, tmp_path):
    rng = random.Random(1)
    orders = [(k, rng.randrange(50), float(rng.randrange(40))) for k in range(3000)]
    spark.createDataFrame([(c,) for c in range(60)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").repartition(7).write.parquet(f"{tmp_path}/orders.parquet")
    best: dict = {}
    for k, c, price in orders:
        best[c] = min(best.get(c, (1.0, 0)), (-price, k))
    out = entry.queries()["join_lateral"](spark, str(tmp_path))
    assert {r.c_custkey: r.o_orderkey for r in out.collect()} == {c: k for c, (_, k) in best.items()}
    # On one machine a shuffle happens to keep the order of a sort before it, so the plan itself is looked at: no global sort, whose order the next shuffle would lose.
    assert "rangepartitioning" not in out._jdf.queryExecution().executedPlan().toString()


def test_vector_recall_over_many_near_vectors(spark, tmp_path):
    """Many vectors around few centres are told apart by their codes alone before the exact scores."""
    import numpy as np

    rng = np.random.default_rng(2)
    x = (rng.normal(size=(4, 64))[rng.integers(0, 4, 20_000)] + 0.3 * rng.normal(size=(20_000, 64))).astype(float)
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert entry.queries()["vector_index_recall"](spark, str(tmp_path)).first().asDict() == {"queries": 400, "wanted": 4000, "recall_is_enough": True, "cells_are_left_out": True}


def test_join_range_compares_no_supplier_with_every_part(spark, tmp_path):
    balances = [-60.0, -50.0, -0.5, 0.0, 49.99, 50.0, 99.9, 100.0, 850.0, 900.5, 900.5, None]
    prices = [-50.0, -10.25, 0.0, 0.0, 49.99, 50.0, 50.01, 100.0, 149.9, 149.9, 150.0, 900.0, 949.5, None]
    spark.createDataFrame(list(enumerate(balances)), "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame(list(enumerate(prices)), "p_partkey long, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    out = entry.queries()["join_range"](spark, str(tmp_path))
    counts = {k: sum(p is not None and a <= p <= a + 50 for p in prices) for k, a in enumerate(balances) if a is not None}
    assert {r.s_suppkey: r.parts for r in out.collect()} == {k: n for k, n in counts.items() if n}
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_citation_context_moves_no_text(spark, sf):
    """The best rows go to the documents; texts, of any number, stay where they are."""
    plan = entry.queries()["citation_context"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
