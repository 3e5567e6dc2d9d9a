from __future__ import annotations

import random
import re

import helpers
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.llm import minhash as M


def shingles(text: str | None) -> frozenset[str]:
    w = re.findall(r"[^\x20\x09-\x0D]+", helpers.lower(text or ""))
    return frozenset(" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset()


def linked(a: frozenset, b: frozenset) -> bool:
    return bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)


def brute(texts: dict[int, str | None]):
    sets = {i: shingles(t) for i, t in texts.items()}
    comp = helpers.components(sorted(sets), lambda a, b: linked(sets[a], sets[b]))
    return {i: (len(sets[i]), comp[i], comp[i] == i) for i in sets}


def corpus(rng, groups, copies, length, edits):
    vocabulary = [f"w{i}" for i in range(900)] + ["Über", "日本", "THE"]
    out = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(*length))]
        for _ in range(rng.randint(1, copies)):
            words = list(base)
            for _ in range(rng.randint(0, edits)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            out.append(" ".join(words))
    rng.shuffle(out)
    return out


def run(spark, df):
    return {r.id: (r.n, r.component_id, r.id == r.component_id) for r in M.near_duplicates(df).collect()}


def test_against_brute_force(spark, documents):
    rng = random.Random(7)
    texts = [*corpus(rng, 60, 8, (1, 120), 5), "", None, " \t\n", "One", "one", "one two Three", "one two three four", *["same words over and over again"] * 4]
    assert run(spark, documents(texts)) == brute(dict(enumerate(texts)))


def test_a_large_group_of_near_copies(spark, documents):
    """Copies of one text with as many edits as bring pairs to both sides of the threshold."""
    rng = random.Random(8)
    texts = [*corpus(rng, 1, 1, (150, 150), 0)] + [t for _ in range(1) for t in corpus(random.Random(9), 1, 1, (160, 160), 0)]
    base = texts[0].split()
    for _ in range(350):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(40)}"
        texts.append(" ".join(words))
    want = brute(dict(enumerate(texts)))
    assert run(spark, documents(texts)) == want and 3 < len({c for _, c, _ in want.values()}) < 200


def test_exactly_at_the_threshold(spark, documents):
    words = [f"a{i}" for i in range(43)]
    base = " ".join(words)  # 40 shingles
    at = " ".join([*words, *(f"b{i}" for i in range(10))])  # and 10 more: 40 of 50
    below = " ".join([*words, *(f"c{i}" for i in range(11))])  # 40 of 51
    got = run(spark, documents([base, at, below]))
    assert got == {0: (40, 0, True), 1: (50, 0, False), 2: (51, 2, True)}


def test_ids_and_columns(spark, documents, folder):
    assert M.near_duplicates(documents([])).count() == 0
    rows = documents([(5, "some words of a text here"), (5, "some words of a text here"), (9, "SOME words of a text here"), (7, None), (7, "other words in a row")])
    rows = rows.unionByName(documents([(0, "some words of a text here"), (0, "nothing like the rest of it")]).withColumn("doc_id", F.lit(None).cast("long")))
    for name in ("id", "n", "key", "rep", "comp", "component_id", "b0", "values"):
        rows = rows.withColumn(name, F.lit("x"))
    got = sorted(map(str, (tuple(r) for r in M.op13_minhash(spark, folder(documents=rows)).collect())))
    assert got == sorted(map(str, [(5, 3, 5, True), (5, 3, 5, True), (9, 3, 5, False), (7, 0, 7, True), (7, 2, 7, True), (None, 3, 5, False), (None, 3, None, False)]))


def test_miss_bounds():
    most = M.allowed()
    assert most == sorted(most) and most[0] >= 15 and most[-1] < 90
    rng = np.random.default_rng(1)
    far = rng.binomial(64, 0.1, (200_000, M.WORDS)).cumsum(axis=1)
    assert (far > np.array(most)).any(axis=1).mean() < 5e-4
    assert (1 - 0.8**M.ROWS) ** M.BANDS < 2e-7


def test_signature_estimates():
    rng = np.random.default_rng(2)
    for share in (0.2, 0.5, 0.8, 0.95):
        n = 400
        both = int(2 * n * share / (1 + share))
        x = rng.integers(0, 1 << 63, 2 * n - both).astype(np.uint64)
        a, b = (M.signature(np.unique(v)) for v in (x[:n], x[n - both :]))
        assert abs((a == b).mean() - share) < 0.13


@pytest.mark.parametrize("seed", range(3))
def test_blocks_find_a_link_if_there_is_one(seed):
    rng = random.Random(seed)
    side = lambda texts, start: {"comp": [start + k // 2 for k in range(len(texts))], "id": list(range(start, start + len(texts))), "bits": M._bits(np.stack([M.signature(s) for s in texts])).ravel().tolist(), "values": [s.view(np.int64).tolist() for s in texts]}
    run, hashes = M._compare(M.allowed()), M._Hashes()
    for _ in range(40):
        made = corpus(rng, 4, 3, (20, 60), 5)
        sets = [M.shingles(t.encode(), hashes) for t in made]
        cut = rng.randint(1, len(sets) - 1) if len(sets) > 1 else 0
        if not cut:
            continue
        some = [frozenset(s.tolist()) for s in sets]
        pairs = {(i, j) for i in range(cut) for j in range(cut, len(sets)) if linked(some[i], some[j])}
        rows = pa.array([{"x": side(sets[:cut], 0), "y": side(sets[cut:], cut)}])
        batch = pa.RecordBatch.from_arrays([rows.field("x"), rows.field("y")], ["x", "y"])
        got = [tuple(p.values()) for out in run(iter([batch])) for p in out.to_pylist()]
        assert set(got) <= pairs and sorted(i // 2 for i, _ in got) == sorted({i // 2 for i, _ in pairs})
