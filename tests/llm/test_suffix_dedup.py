from __future__ import annotations

import random
from collections import Counter

import helpers
import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import suffix_dedup as S


def corpus(rng):
    word = lambda: "".join(rng.choice("aeéтnrst日") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(60) for _ in range(4)]
    texts = ["", None, "short", "ab" * 400, "z" * 650, "z" * 199, "z" * 200, text(900)]
    for k in range(40):
        parts = [text(rng.randint(0, 60)), rng.choice(shared) if k % 3 else "", text(rng.randint(0, 30)), rng.choice(shared)[rng.randint(0, 60) :] if k % 4 == 0 else ""]
        texts.append(" ".join(parts))
    copy = texts[12]
    return [*texts, copy, copy, copy[:150] + "X" + copy[151:], texts[14] + texts[14]]


@pytest.mark.parametrize("big_bucket", [S.BIG_BUCKET, 1])
def test_against_brute_force(spark, documents, big_bucket):
    texts = corpus(random.Random(4))
    out = S.remove_repeats(documents(texts), big_bucket=big_bucket).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    want = helpers.without_repeats([(t or "").encode() for t in texts])
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out} == dict(enumerate(want))
    assert sum(w[1] for w in want) > 1000


def test_repeated_rows_empty_table_and_clashing_columns(spark, documents):
    assert S.remove_repeats(documents([])).count() == 0
    rows = documents([(1, "q" * 10 + "w" * 300), (1, "q" * 10 + "w" * 300), (2, "nothing alike")])
    for name in ("row", "kept", "ranges", "k1", "ah"):
        rows = rows.withColumn(name, F.lit(name))
    out = S.without_repeats(rows)
    assert out.columns == rows.columns
    assert sorted((r.doc_id, r.text, r.kept) for r in out.collect()) == [(1, "", "kept"), (1, "", "kept"), (2, "nothing alike", "kept")]


def test_crowded_buckets_are_split_until_they_fit(spark, documents):
    """Many contexts around one anchor: they agree in all but a few bytes before, after, or both."""
    rng = random.Random(8)
    core = "".join(rng.choice("abcdefgh") for _ in range(190))
    rand = lambda n: "".join(rng.choice("ijklmnop") for _ in range(n))
    texts = [rand(40) + core + rand(40) for _ in range(120)]
    texts += [core + "q" * 30 + rand(9), "r" * 30 + core + rand(30), "r" * 30 + core + rand(31), core + "q" * 30 + rand(7)]
    want = helpers.without_repeats([t.encode() for t in texts])
    for big_bucket in (10_000, 20, 3):
        out = S.remove_repeats(documents(texts), big_bucket=big_bucket).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out} == dict(enumerate(want))
    assert sum(w[1] > 0 for w in want) == 4


def test_many_repeated_rows_have_one_set_of_ranges(spark, documents):
    text = " ".join(f"word{i}" for i in range(60))
    rows = documents([(1, text)]).crossJoin(spark.range(5000).select()).unionByName(documents([(2, "alone " * 20), (3, text[50:] + " more")]))
    keyed = rows.select(F.col("doc_id").alias("k1"), F.lit(0).cast("long").alias("k2"), "text")
    assert S.repeated_windows(keyed).groupBy("k1").agg(F.countDistinct("a", "b").alias("n")).agg(F.max("n")).first()[0] < len(text)
    got = {(r.doc_id, r.n_removed, r.n_spans): r.n for r in S.remove_repeats(rows).groupBy("row.doc_id", "n_removed", "n_spans").agg(F.count("*").alias("n")).collect()}
    assert got == {(1, len(text), 1): 5000, (2, 0, 0): 1, (3, len(text) - 50, 1): 1}


@pytest.mark.parametrize("piece", [1, 150, 333])
def test_pieces_of_long_texts(piece):
    """Anchors found piece by piece are those of the whole text, with runs that end where pieces do."""
    rng = random.Random(piece)
    texts = [bytes(rng.randrange(97, 101) for _ in range(n)) for n in (0, 199, 200, 201, 1500, 640)]
    covered = lambda runs: {(int(t), s, int(p), int(h)) for t, p, a, b, h in zip(runs.text, runs.p, runs.a, runs.b, runs.anchor, strict=True) for s in range(a, b + 1)}
    assert covered(S.Anchors(texts, piece=piece)) == covered(S.Anchors(texts))


def test_cut_ranges():
    rng = random.Random(2)
    for _ in range(200):
        data = bytes(rng.randrange(256) for _ in range(rng.randint(10, 80)))
        ranges = [(a, rng.randint(a, len(data) - 5)) for a in (rng.randint(0, len(data) - 5) for _ in range(rng.randint(0, 6)))]
        gone = [any(a <= i < b + 5 for a, b in ranges) for i in range(len(data))]
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        assert S.cut_ranges(data, [a << 32 | b for a, b in ranges], 5) == (bytes(x for x, g in zip(data, gone, strict=True) if not g), sum(gone), spans)


def test_cut_characters_go_whole(spark, documents):
    shared = ("é" * 100).encode()  # 200 bytes
    texts = ["a" + shared.decode() + "b", "c" + shared.decode() + "d", "é" * 100]
    got = {r.doc_id: r.text for r in S.without_repeats(documents(texts)).collect()}
    assert got == {0: "ab", 1: "cd", 2: ""}


def test_null_id(spark, documents):
    rows = documents([(1, "k" * 250)]).withColumn("doc_id", F.lit(None).cast("long"))
    assert S.remove_repeats(rows).first().n_removed == 250  # the text repeats itself
    assert S.remove_repeats(rows).select("row.doc_id").first().doc_id is None


@pytest.mark.parametrize("seed", range(12))
def test_cover_sorter(seed):
    rng = random.Random(seed)
    data = bytes(rng.randrange(97, 97 + rng.choice([1, 2, 3, 20])) for _ in range(rng.randint(20, 900)))
    data += data[: rng.randint(0, 60)] * 3
    length, period = rng.choice([7, 16, 40, 100]), rng.choice([9, 16, 64])
    starts = np.arange(max(0, len(data) - length + 1))
    sorter = S.CoverSorter(data, length, period)
    seen = Counter(data[i : i + length] for i in starts.tolist())
    assert sorter.repeated(starts).tolist() == [i for i in starts.tolist() if seen[data[i : i + length]] > 1]
    order = [x for pos, _ in sorter.blocks(starts) for x in pos.tolist()]
    assert all(data[a : a + length] <= data[b : b + length] for a, b in zip(order, order[1:], strict=False))


@pytest.mark.parametrize("period", [5, 9, 16, 64, 73])
def test_cover_holds_for_all_differences(period):
    held = set(S.cover(period).tolist())
    assert all(any((i + d) % period in held and (j + d) % period in held for d in range(period)) for i in range(period) for j in range(period))
