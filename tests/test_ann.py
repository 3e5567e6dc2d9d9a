from __future__ import annotations

import numpy as np

from skein.operators import retrieval as R
from skein.operators.ann import Quantiser, VectorIndex, lloyd


def test_lloyd_and_codes():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.01, (50, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    centres = lloyd(x, 3)
    assert sorted(np.round(centres).astype(int).tolist()) == [[0, 0], [0, 5], [5, 5]]
    assert len(lloyd(np.ones((9, 2)), 4)) == 1
    v = rng.normal(size=(400, 12))
    made = Quantiser.fit(v, 8, 4, 64)
    cell, code = made.encode(v)
    back = made.cells[cell] + np.concatenate([b[code[:, s]] for s, b in enumerate(made.books)], axis=1)
    assert code.dtype == np.uint8 and ((back - v) ** 2).sum() < 0.5 * (v**2).sum()


def test_search(spark, tmp_path):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    data = [(i, (centres[i % 12] + rng.normal(scale=0.4, size=16)).tolist()) for i in range(900)]
    odd = [(2000, None), (2001, [0.0] * 16), (2002, [1.0] * 3), (2003, [None] * 16), (2004, [float("nan")] * 16), (None, [1.0] * 16)]
    vectors = spark.createDataFrame(data + odd, "chunk_id long, embedding array<double>").repartition(4)
    index = VectorIndex.build(vectors, str(tmp_path / "v"))
    assert index.rows.count() == 900 and len(index.quantiser.cells) == 30
    queries = spark.createDataFrame([(i, v) for i, v in data if i % 50 == 0] + [(999, [0.0] * 16), (998, [1.0, 2.0])], "query_id long, vector array<double>")
    want = {(r.query_id, r.chunk_id): r.score for r in R.top_k(R.dense_search(queries, vectors), 10).collect()}
    got = {(r.query_id, r.chunk_id): r.score for r in index.search(queries, 10, probes=8).collect()}
    shared = set(want) & set(got)
    assert len(shared) >= 0.9 * len({k for k in want if k[0] < 900}) and all(abs(want[k] - got[k]) < 2e-6 for k in shared)
    exact = {(r.query_id, r.chunk_id) for r in index.search(queries, 10).collect()}
    assert len(exact ^ {k for k in want if k[0] != 998}) <= 2
    assert index.search(queries.where("query_id = 999"), 5, probes=2).count() == 0
    few = index.candidates([0], R._units(np.array([data[0][1]])), 3, 10)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and few.select("cell").distinct().count() <= 3


def test_best_rows_leave_the_batch(spark):
    rng = np.random.default_rng(3)
    vectors = spark.createDataFrame([(i, rng.normal(size=4).round(1).tolist()) for i in range(500)], "chunk_id long, embedding array<double>").coalesce(1)
    queries = spark.createDataFrame([(i, rng.normal(size=4).round(1).tolist()) for i in range(9)], "query_id long, vector array<double>")
    every, cut = R.dense_search(queries, vectors), R.dense_search(queries, vectors, limit=5)
    rows = lambda df: sorted(tuple(r) for r in R.top_k(df, 5).collect())
    assert rows(every) == rows(cut) and cut.count() < 9 * 30 < every.count()


def test_what_a_task_keeps_is_bounded(spark, tmp_path, monkeypatch):
    """Tasks are as many as cores, and each keeps a query's best rows over all its files; scores are made in slices of queries."""
    from skein.operators import ann

    rng = np.random.default_rng(4)
    data = [(i, rng.normal(size=8).tolist()) for i in range(1200)]
    vectors = spark.createDataFrame(data, "chunk_id long, embedding array<double>").repartition(4)
    index = VectorIndex.build(vectors, str(tmp_path / "v"))
    ids = list(range(40))
    units = R._units(np.array([data[i][1] for i in ids]))
    cells = len(index.quantiser.cells)
    whole = {(r.query_id, r.id) for r in R.top_k(index.candidates(ids, units, cells, 10), 10, "near", tie="id").collect()}
    monkeypatch.setattr(ann, "SCORES", 500)
    found = index.candidates(ids, units, cells, 10)
    cores = spark.sparkContext.defaultParallelism
    assert found.rdd.getNumPartitions() <= cores and found.count() <= cores * len(ids) * 10
    assert {(r.query_id, r.id) for r in R.top_k(found, 10, "near", tie="id").collect()} == whole and len(whole) == 400
    monkeypatch.setattr(ann, "KEPT_ROWS", 100)
    queries = spark.createDataFrame([data[i] for i in ids[:12]], "query_id long, vector array<double>")
    assert index.search(queries, 3, cells, 20).count() == 36


def test_later_batches_send_only_better_rows(spark):
    rng = np.random.default_rng(5)
    vectors = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(6000)], "chunk_id long, embedding array<double>").coalesce(1)
    queries = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(9)], "query_id long, vector array<double>")
    every, cut = R.dense_search(queries, vectors), R.dense_search(queries, vectors, limit=5)
    rows = lambda df: sorted(tuple(r) for r in R.top_k(df, 5).collect())
    assert rows(every) == rows(cut) and cut.count() < 9 * 5 * 4
