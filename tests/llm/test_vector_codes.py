from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from skein.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, entries=256, rounds=4, parts=4):
    """(sorted (vec_id, code, error, label_error), digest) by plain integers."""
    kept = [(i, [math.floor(x * 1024) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    m = len(kept[0][1]) // parts
    cut = lambda v, p: tuple(v[p * m : (p + 1) * m])
    first = {}
    for i, v, _ in kept:
        if i is not None:
            first.setdefault(i, v)
    books = [[cut(first[i], p) for i in sorted(first)[:entries]] for p in range(parts)]
    near = lambda book, x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups: dict[int, list] = {}
            for _, v, _ in kept:
                groups.setdefault(near(books[p], cut(v, p))[1], []).append(cut(v, p))
            books[p] = [tuple(sum(c) // len(groups[e]) for c in zip(*groups[e], strict=True)) if e in groups else c for e, c in enumerate(books[p])]
    out = []
    for i, v, g in kept:
        got = [near(books[p], cut(v, p)) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in got), sum(d for d, _ in got), g))
    sums = Counter()
    for _, _, e, g in out:
        sums[g] += e
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    return sorted(map(str, [(i, c, e, sums[g]) for i, c, e, g in out])), hashlib.sha256(text.encode()).hexdigest()


def run(spark, rows, folder=None, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    coded = V.codes(df, **kw).collect()
    sums = Counter()
    for r in coded:
        sums[r.label] += r.error or 0
    return sorted(map(str, [(r.vec_id, r.code, r.error, sums[r.label]) for r in coded])), {r.codebooks_sha256 for r in coded}


def test_against_plain_integers(spark):
    rng = random.Random(1)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(9)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(centres)], rng.choice([1, 2, None])) for i in range(120)]
    rows += [(200 + i, rows[3][1], 1) for i in range(40)] + [rows[5]] * 3 + [(None, rows[6][1], None), (None, rows[7][1], 2)]
    rows += [(-1, None, 1), (-2, [*rows[0][1][:-1], None], 1), (-3, [*rows[0][1][:-1], math.nan], 1), (-4, [*rows[0][1][:-1], -math.inf], 1)]
    rng.shuffle(rows)
    for entries in (7, 256):
        want, book = brute(rows, entries)
        got, books = run(spark, rows, entries=entries)
        assert got == want and books == {book}


def test_ties_and_large_values(spark):
    rows = [(i, [float(x)] * 4, 0) for i, x in enumerate([0, 2, 1, 1, 1, 3, 16_000, -16_000])]
    want, book = brute(rows, 2)
    got, books = run(spark, rows, entries=2)
    assert got == want and books == {book}


def test_wrong_lengths_and_ranges(spark):
    rows = [(5, [1.0] * 4, 1), (6, [2.0] * 8, 1), (7, [3.0] * 3, 1), (8, [1e9] * 4, 1), (9, [], 2), (4, [1.0] * 5, None)]
    got = {r.vec_id: (r.code, r.error) for r in V.codes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {5: ("00000000", 0)} | {i: (None, None) for i in (4, 6, 7, 8, 9)}
    none = V.codes(spark.createDataFrame([(7, [3.0] * 3, 1), (None, [1.0] * 4, 1), (1, None, 2)], SCHEMA)).collect()
    assert sorted((r.vec_id or 0, r.code, r.codebooks_sha256) for r in none) == [(0, None, None), (7, None, None)]


def test_empty_table_and_clashing_names(spark, folder):
    assert V.codes(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = spark.createDataFrame([(1, [0.5] * 4, 3), (2, [0.25] * 4, None), (2, [0.25] * 4, None)], SCHEMA)
    for name in ("pos", "part", "code", "size", "n", "v", "h"):
        rows = rows.withColumn(name, F.lit("x"))
    got = sorted(tuple(r)[:4] for r in V.op12_vector_codes(spark, folder(embeddings=rows)).collect())
    assert got == [(1, "00000000", 0, 0), (2, "01010101", 0, 0), (2, "01010101", 0, 0)]


def test_sums_beyond_64_bits():
    import pyarrow as pa

    big = 1 << 40
    batch = pa.RecordBatch.from_arrays([pa.array([0, 0], pa.int32()), pa.array([V._pack(np.array([1 << 23]))] * 2, pa.binary()), pa.array([big, big])], ["pos", "part", "weight"])
    (out,) = list(V._summer([np.array([[0]])])(iter([batch])))
    assert out.column(3).to_pylist() == [str(2 * big), str(2 * big << 23)]
