from __future__ import annotations

import random
from collections import Counter
from math import comb

import helpers
import pytest
from pyspark.sql import functions as F

from skein.llm import fingerprints as P


def jaccard(a: Counter, b: Counter) -> float:
    keys = set(a) | set(b)
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys)


def test_collision_rate_is_generalised_jaccard(spark):
    rng = random.Random(8)
    word = lambda: f"t{min(int(rng.expovariate(0.05)), 200)}"
    pairs = []
    for _ in range(120):
        base = [word() for _ in range(rng.randint(5, 150))]
        other = base[: rng.randint(0, len(base))] + [word() for _ in range(rng.randint(0, 80))]
        pairs.append((" ".join(base), " ".join(other)))
    docs = spark.createDataFrame([x for i, (a, b) in enumerate(pairs) for x in ((2 * i, a), (2 * i + 1, b))], "doc_id long, text string")
    got = {r.id: r.samples for r in P.fingerprints(docs, samples=128).collect()}
    error = []
    for i, (a, b) in enumerate(pairs):
        bags = [Counter(t.lower().split() or [""]) for t in (a, b)]
        alike = sum(x == y for x, y in zip(got[2 * i], got[2 * i + 1], strict=True)) / 128
        error.append(alike - jaccard(*bags))
    assert abs(sum(error) / len(error)) < 0.02 and max(map(abs, error)) < 0.2


def test_query_columns(spark, documents, folder):
    texts = ["", None, "a", "one two", "Ein Wort über 日本 😀 x", "b " * 4001, "same text twice", "same text twice", " \n\t "]
    docs = documents([(10 * i - 20, t) for i, t in enumerate(texts)]).withColumn("part", F.lit(1)).withColumn("guest", F.lit(1))
    out = {r.doc_id: r for r in P.op5_fingerprints(spark, folder(documents=docs)).collect()}
    ids = sorted(out, reverse=True)
    text = {10 * i - 20: t or "" for i, t in enumerate(texts)}
    assert ids == sorted(text, reverse=True)
    prints = {}
    for k, i in enumerate(ids):
        t, following = text[i], text[ids[(k + 1) % len(ids)]]
        half = len(t) // 2
        assert out[i].n_chars == len(t) and out[i].edited_sha256 == helpers.sha((t[: len(t) - half] + following[:half]).encode())
        assert 0 <= out[i].near_edited <= 1 and prints.setdefault(" ".join(t.lower().split()), out[i].fingerprint) == out[i].fingerprint
    for k, i in enumerate(ids):
        following = out[ids[(k + 1) % len(ids)]]
        n = len(following.fingerprint) // 16
        alike = sum(out[i].fingerprint[16 * j : 16 * j + 16] == following.fingerprint[16 * j : 16 * j + 16] for j in range(n)) / n
        assert abs(out[i].near_next - alike) < 1e-9


def test_many_ranges_one_row_and_none(spark, documents, monkeypatch):
    monkeypatch.setattr(P, "ROWS_PER_RANGE", 7)
    rows = P.with_successors(documents([(3 * i, f"text {i}") for i in range(100)])).where("guest = 0").collect()
    assert len({r.part for r in rows}) > 5
    assert {(r.id, r.next_text) for r in rows} == {(3 * i, f"text {(i - 1) % 100}") for i in range(100)}
    assert P.with_successors(documents([(5, "alone")])).where("guest = 0").first().next_text == "alone"
    assert P.with_successors(documents([])).count() == 0
    twice = P.with_successors(documents([(1, "a"), (1, "a"), (2, "b")])).where("guest = 0").collect()
    assert sorted((r.id, r.next_text) for r in twice) == [(1, "a"), (1, "b"), (2, "a")]


@pytest.mark.parametrize(("rows", "fan"), [(7, 4096), (3, 4), (5, 5)])
def test_hot_ids_and_many_bounds(spark, documents, monkeypatch, rows, fan):
    """Ids that many rows share, null ones too, lie in several ranges; bounds found in two passes serve as well."""
    monkeypatch.setattr(P, "ROWS_PER_RANGE", rows)
    monkeypatch.setattr(P, "FAN", fan)
    given = [(i, f"t{i}") for i in range(0, 120, 3)] + [(50, f"hot {i}") for i in range(90)] + [(None, f"none {i}") for i in range(60)] + [(51, "hot again"), (50, "hot 1")]
    got = P.with_successors(documents(given)).where("guest = 0").collect()
    h = {r.text: r.h for r in documents(given).select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(given, key=lambda x: (x[0] is None, -(x[0] or 0), h[x[1]]))
    want = Counter((i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order))
    assert Counter((r.id, r.text, r.next_text) for r in got) == want
    parts = Counter((r.id, r.part) for r in got)
    assert max(parts.values()) < 45 and len([p for i, p in parts if i == 50]) > 3 and len([p for i, p in parts if i is None]) > 3


def test_binary_search(spark):
    rng = random.Random(4)
    values = sorted({rng.randrange(-50, 50) for _ in range(37)})
    keys = spark.range(-60, 60).select(F.col("id").alias("k"))
    for held in (values, values[:1], values[:8], [-(1 << 63), (1 << 62) + 1]):
        assert all(r.n == sum(v < r.k for v in held) for r in keys.select("k", P._below(held, F.col("k")).alias("n")).collect())
    many = list(range(0, 200_000, 2))
    assert spark.range(99_999, 100_001).select(P._below(many, F.col("id")).alias("n")).agg(F.max("n")).first()[0] == 50_000


def test_query_setting_on_real_texts(spark, sf):
    """With the query's own number of samples a likeness is one that as many draws at the generalised Jaccard similarity could give."""

    def tail(hits: int, p: float) -> float:
        chance = [comb(P.SAMPLES, k) * p**k * (1 - p) ** (P.SAMPLES - k) for k in range(P.SAMPLES + 1)]
        return min(sum(chance[: hits + 1]), sum(chance[hits:]))

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(texts, reverse=True)
    error = []
    for r in P.op5_fingerprints(spark, sf).collect():
        t, following = texts[r.doc_id], texts[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        half = len(t) // 2
        bags = [Counter(x.lower().split() or [""]) for x in (t, t[: len(t) - half] + following[:half], following)]
        for found, other in ((r.near_edited, bags[1]), (r.near_next, bags[2])):
            want = jaccard(bags[0], other)
            error.append(found - want)
            assert tail(round(found * P.SAMPLES), want) > 1e-7
    assert abs(sum(error) / len(error)) < 0.01 and (sum(e * e for e in error) / len(error)) ** 0.5 < 0.09


def test_no_python_in_the_plan(spark, sf):
    plan = P.op5_fingerprints(spark, sf)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
