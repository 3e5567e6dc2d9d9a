from __future__ import annotations

import random

import helpers
import pytest
from pyspark.sql import functions as F

from skein.llm import common, simhash


def words(rng, n):
    return " ".join(rng.choice(["the", "and", "Fox", "über", "日本", "run"]) + str(rng.randrange(40)) for _ in range(n))


def near(texts_by_id):
    prints = {i: helpers.fingerprint(t or "") for i, t in texts_by_id.items()}
    return prints, helpers.components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)


def test_against_brute_force(spark, documents):
    rng = random.Random(1)
    base = [words(rng, rng.randint(0, 400)) for _ in range(60)]
    edits = [b.replace("the1 ", "the2 ", 1) for b in base] + [b + " x" for b in base[:20]]
    texts = ["", None, "  \t\n", "One", "two Words", *base, *edits, *base[:10]]
    rng.shuffle(texts)
    prints, comp = near(dict(enumerate(texts)))
    got = {r.id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(documents(texts)).collect()}
    assert got == {i: (prints[i], comp[i]) for i in prints}


def test_links_find_every_pair(spark):
    rng = random.Random(2)
    values = {rng.getrandbits(64) for _ in range(40)}
    for v in list(values):
        values |= {v ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (1, 2, 3, 4)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {frozenset((r.a, r.b)) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()}
    mask = (1 << 64) - 1
    assert got == {frozenset((a, b)) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 3}


@pytest.mark.parametrize("text", ["a", "a b", "a b c", "A B C d", "ﬀ Ä " * 300, "x " * 5000])
def test_fingerprint(text):
    assert simhash.text_fingerprint(text.encode()) == helpers.fingerprint(text)


def test_empty_repeated_and_extra_columns(spark, documents):
    assert simhash.near_duplicates(documents([])).count() == 0
    rows = documents([(5, "same text here"), (5, "same text here"), (9, "same text here"), (7, None)]).withColumn("fp", F.lit("x")).withColumn("id", F.lit(1)).withColumn("component_id", F.lit(2))
    got = sorted((r.id, r.component_id) for r in simhash.near_duplicates(rows).collect())
    assert got == [(5, 5), (5, 5), (7, 7), (9, 5)]
    kept = simhash.keep_row(rows)
    assert sorted(r.doc_id for r in kept.collect()) == [5, 7] and kept.columns == rows.columns


def test_columns_of_any_name(spark, documents):
    rows = documents([(1, "some words to keep"), (2, "some words to keep"), (2, "others here to keep too"), (3, None)]).unionByName(documents([(0, "null id text")]).withColumn("doc_id", F.lit(None).cast("long")))
    for name in ("_fp", "_text", "_id", "_again", "_row", "fp", "id", "row", "again", "chosen", "its", "a.b"):
        rows = rows.withColumn(name, F.concat(F.lit(name), F.col("text")))
    kept = simhash.keep_row(rows)
    assert kept.columns == rows.columns
    got = sorted((r.doc_id is None, r.doc_id, r.text, r["_fp"], r["row"]) for r in kept.collect())
    assert [(x[1], x[2]) for x in got] == [(1, "some words to keep"), (2, "others here to keep too"), (3, None), (None, "null id text")]
    assert got[0][3:] == ("_fpsome words to keep", "rowsome words to keep")


def test_components_on_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(200, 260)]
    edges = spark.createDataFrame([*chain, *star, (5, 5), (7, 200), (None, 3)], "u long, v long")
    got = {r.node: r.component for r in common.components(edges).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in [7, *range(200, 260)]}
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0
