from __future__ import annotations

import random

import numpy as np
import pytest

from skein.llm import decontam as D

SYLLABLES = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "ü", "日"]


def text(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def edit(rng, s, k):
    s = list(s)
    for _ in range(k):
        p, kind = rng.randrange(len(s)), rng.random()
        if kind < 1 / 3:
            s[p] = "z"
        elif kind < 2 / 3:
            del s[p]
        else:
            s.insert(p, "q")
    return "".join(s)


def best_piece(item: str, x: str) -> int:
    """Least edits between item and any piece of x."""
    a, b = D.codes(item), D.codes(x)
    row = np.zeros(len(b) + 1, int)
    for i, c in enumerate(a, 1):
        new = np.empty_like(row)
        new[0] = i
        diag = row[:-1] + (b != c)
        up = row[1:] + 1
        for j in range(1, len(b) + 1):
            new[j] = min(diag[j - 1], up[j - 1], new[j - 1] + 1)
        row = new
    return int(row.min())


def test_against_full_alignment():
    rng = random.Random(6)
    items = [text(rng, rng.randint(8, 30)) for _ in range(12)]
    index = D.ItemIndex(list(range(12)), items)
    docs = []
    for _ in range(60):
        i = rng.randrange(12)
        k = rng.randint(0, int(index.budget[i]) * 2)
        docs.append(text(rng, rng.randint(0, 20)) + " " + edit(rng, items[i], k) + " " + text(rng, rng.randint(0, 20)))
    found = {(t, i): e for t, i, _, _, e in D.find(index, docs)}
    for t, x in enumerate(docs):
        for i, item in enumerate(items):
            least = best_piece(item, x)
            assert ((t, i) in found) == (least <= index.budget[i])
            if (t, i) in found:
                assert found[t, i] == least


def test_places_and_bounds_of_texts():
    rng = random.Random(7)
    item = text(rng, 20)
    index = D.ItemIndex([9], [item])
    docs = [item, item.upper().replace("Ü", "ü"), "x " + item + " y", item[3:], item[:-3], item.replace(" ", "\n"), "", item + " " + text(rng, 60) + " " + item, item[: len(item) // 2]]
    got = D.find(index, docs)
    assert [(t, s, e) for t, _, s, e, k in got if k == 0 and t == 2] == [(2, 2, 2 + len(item))]
    assert [t for t, *_ in got] == [0, 1, 2, 3, 4, 5, 7, 7]


@pytest.mark.parametrize("blocks", [1, 3])
def test_operator(spark, documents, monkeypatch, blocks):
    if blocks > 1:
        monkeypatch.setattr(D, "BLOCK_CHARS", 200)
    rng = random.Random(9)
    items = [text(rng, 15) for _ in range(8)]
    bench = spark.createDataFrame([*enumerate(items), (50, None), (51, ""), (None, "nothing at all here"), (52, "tiny"), (0, items[0])], "item_id long, text string")
    docs = documents([None, "", f"a {items[1]} b", f"a {items[1]} b", f"{items[2]} and {items[5]}", "has a TINY word", "z" * 60_000, "clean " * 50])
    got = sorted((r.id, r.item_id) for r in D.contaminations(docs, bench).collect())
    assert got == [(2, 1), (3, 1), (4, 2), (4, 5), (5, 52)]
    kept = D.without_contamination(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 6, 7]
    assert D.contaminations(docs, bench.where("false")).count() == 0 and D.without_contamination(docs, bench.where("false")).count() == 8
    assert D.contaminations(docs.where("false"), bench).count() == 0


def test_query_finds_every_exact_passage(spark, sf):
    docs = {r.doc_id: r.text.lower() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: r.text.lower() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in D.op10_decontaminate(spark, sf).collect()}
    assert {(d, i) for d, t in docs.items() for i, x in items.items() if x in t} <= got and got
