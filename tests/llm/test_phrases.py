from __future__ import annotations

import random
import re
from collections import Counter

import helpers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.llm import phrases as P


def counts(rows):
    """({(lang, words): f}, {lang: n})"""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", helpers.lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    return f, n


def brute(rows, least=30, limit=2000):
    f, n = counts(rows)
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, w), a in found.items():
        if any(g == lang and len(x) > len(w) and 100 * b >= 80 * a and any(x[i : i + len(w)] == w for i in range(len(x))) for (g, x), b in found.items()):
            continue
        score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    rank, told = Counter(), []
    for lang, score, a, phrase, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= limit:
            told.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(told)


def texts(rng, n):
    words = ["New", "york", "city", "hall", "über", "日本", "a", "b", "of", "the", "x\0y"]
    made = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 25)):
            parts.append(rng.choice(["New York", "new york city hall", "of the", *words]))
            parts.append(rng.choice([" ", "  ", "\t", ". ", ",", "\n", " ", " "]))
        made.append("".join(parts))
    return made


@pytest.mark.parametrize("bits", [3, 10, None])
def test_against_a_full_count(spark, bits):
    rng = random.Random(4)
    rows = [(t, rng.choice(["en", "fr", None, "und", ""])) for t in texts(rng, 300)] + [(None, "en"), ("", None), ("   \t", "de"), ("only. Words; here", "de")]
    rows += [rows[1]] * 9
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    want = brute(rows, 5, 40)
    got = sorted(tuple(r) for r in P.collocations(df, least=5, limit=40, bits=bits).collect())
    assert got == want and len(want) > 60


def test_counts_of_runs_and_many_words(monkeypatch):
    monkeypatch.setattr(P, "RUN", 50)
    monkeypatch.setattr(P, "WINDOW", 23)
    rng = random.Random(5)
    rows = [(t, "en") for t in texts(rng, 60)]
    batches = [pa.RecordBatch.from_arrays([pa.array([x[1] for x in rows[i : i + 7]]), pa.array([x[0] for x in rows[i : i + 7]])], ["lang", "text"]) for i in range(0, 60, 7)]
    f, _ = counts(rows)
    for length in (1, 2, 4):
        got, blocks = Counter(), {}
        for out in P._counter(length, 8, 5, None, length < 4)(iter(batches)):
            for lang, phrase, n, block, held in zip(*(c.to_pylist() for c in out.columns), strict=True):
                if block is None:
                    got[lang, tuple(phrase.decode().split(" "))] += n
                else:
                    blocks[block] = held
        assert got == {k: a for k, a in f.items() if len(k[1]) == length}
        assert length == 4 or max(blocks[0]) <= 5 and len(blocks[0]) == 256


def test_planted_phrase_and_ties(spark):
    rows = [("alpha beta gamma", "en")] * 30 + [("delta eps", "en"), ("Delta EPS", "en")] * 15 + [("zeta eta", "fr")] * 29
    got = sorted(tuple(r) for r in P.collocations(spark.createDataFrame(rows, "text string, lang string")).collect())
    assert got == brute(rows) == [("en", 1, "alpha beta gamma", 30, 30, 30, 150, 1_000_000), ("en", 2, "delta eps", 30, 30, 30, 150, 1_000_000)]


def test_exact_scores_beyond_64_bits(spark):
    big = 10**13
    one = lambda *rows: spark.createDataFrame(rows, "lang string, phrase string, f long")
    found = [one(("en", "a", big + 7), ("en", "b", big + 3)), one(("en", "a b", big))]
    (r,) = P.scored(found, spark.createDataFrame([("en", 10**15)], "lang string, n long")).collect()
    assert (r.a, r.l, r.r, r.score) == (big, big + 7, big + 3, 2_000_000 * big // (2 * big + 10))


def test_empty_table_and_clashing_names(spark, documents, folder):
    assert P.collocations(documents([])).count() == 0
    rows = documents(["one two"] * 40 + [None, ""])
    for name in ("phrase", "n", "block", "counts", "rank", "f", "w"):
        rows = rows.withColumn(name, F.lit("x"))
    (r,) = P.op11_phrases(spark, folder(documents=rows)).collect()
    assert tuple(r) == ("en", 1, "one two", 40, 40, 40, 80, 1_000_000)
    long = "y" * 300_000
    assert [r.phrase for r in P.collocations(documents([f"{long} z"] * 31)).collect()] == [f"{long} z"]
