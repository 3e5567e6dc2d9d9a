"""Toxicity scores from a factorization machine over hashed terms.

A document's terms are its distinct lower-cased words and their leading 4, 5 and 6 characters (inflected forms of a stem share
those), hashed to BUCKETS. The machine scores

    sigmoid(w0 + sum_i w_i + sum_{i<j} <v_i, v_j>)

over the terms present, so a pair (an insult with a group mention) can carry weight that neither term has alone.

Fitting uses a bounded sample of labelled rows (`max_rows`, at most half of them positive, taken by a hash of doc_id), one text for each id. Features are
taken up by two tests against chance, neither with a limit on their number: a term's own association with the label, and, for
terms that matter only beside others, its joint association with the terms around it in what a first machine leaves unexplained. The
driver gets the terms' counts by class (at most BUCKETS rows) and the sampled rows' terms (`max_values` at most), whatever the size of the corpus. Scoring is
one pass over whole texts without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import bounded, column, cut, load, slices, texts_of, tidy

BUCKETS = 1 << 18
PREFIXES = (4, 5, 6)
THRESHOLD = 0.7
_WORD = re.compile(r"\w+")
#: Distinct words whose buckets a worker remembers at a time.
_MEMO_WORDS = 150_000
_VALUES = 1 << 18
#: Cells of the sketch that holds the terms around a term.
_CELLS = 256


def word_buckets(word: str) -> list[int]:
    """The hashed terms of one lower-cased word."""
    terms = {f"w:{word}"} | {f"{n}:{word[:n]}" for n in PREFIXES if len(word) >= n}
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in terms]


class _Terms:
    """Distinct feature numbers of a text; `slot` maps a bucket to a feature number, or below zero."""

    def __init__(self, slot: np.ndarray | None = None):
        self.slot, self.memo = slot, {}

    def of(self, text: str) -> set[int]:
        memo, out = self.memo, set()
        for word in set(_WORD.findall(text.lower())):
            got = memo.get(word)
            if got is None:
                got = word_buckets(word)
                if self.slot is not None:
                    got = tuple(s for s in self.slot[got].tolist() if s >= 0)
                if len(memo) >= _MEMO_WORDS:
                    memo.clear()
                memo[word] = got
            if got:
                out.update(got)
        return out

    def packed(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The features of all texts in one array, in order of text and number, and how many each has."""
        sets = [self.of(t) for t in texts]
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        flat = np.fromiter(chain.from_iterable(sets), np.int64, int(sizes.sum()))
        flat += np.repeat(np.arange(len(sets), dtype=np.int64), sizes) << 32
        flat.sort()
        return (flat & 0xFFFFFFFF).astype(np.int32), sizes


@dataclass
class FactorizationMachine:
    """slot: feature number by bucket (-1: none); w0, w, v: the weights."""

    slot: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def margins(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The margins of rows whose distinct feature numbers stand one row after the other in flat."""
        out = np.full(len(sizes), self.w0)
        ends = np.cumsum(sizes)
        begin = 0
        while begin < len(sizes):  # some rows at a time: a row's factors are held at once, whatever its length
            done = int(ends[begin - 1]) if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, done + _VALUES, "right")))
            mine = flat[done : int(ends[stop - 1])]
            owner = np.repeat(np.arange(stop - begin), sizes[begin:stop])
            n, v = stop - begin, self.v[mine]
            total = np.stack([np.bincount(owner, v[:, f], n) for f in range(v.shape[1])], 1)
            out[begin:stop] += np.bincount(owner, self.w[mine], n) + 0.5 * ((total * total).sum(1) - np.bincount(owner, (v * v).sum(1), n))
            begin = stop
        return out

    def probabilities(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(flat, sizes), -40, 40)))

    def scores(self, texts: list[str], terms: _Terms) -> np.ndarray:
        return self.probabilities(*terms.packed(texts))


def fit(rows: list[np.ndarray], y: np.ndarray, n: int, slot: np.ndarray, factors: int = 8, epochs: int = 8, steps: int = 1500, batch: int = 64, rate: float = 0.1, decay: float = 2e-5, seed: int = 7) -> FactorizationMachine:
    """AdaGrad on the logistic loss; rows holds each row's distinct feature numbers below n. No rows, or one class only: a constant.

    All rows are seen at least `epochs` times and at least `steps` batches are taken, so small samples settle too.
    """
    share = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
    w0, w = np.log(share / (1 - share)), np.zeros(n, np.float64)
    rng = np.random.default_rng(seed)
    v = rng.normal(0, 0.01, (n, factors))
    if not n or not len(y) or y.min() == y.max():
        return FactorizationMachine(slot, float(w0), w, v)
    g0, gw, gv = 1e-8, np.full(n, 1e-8), np.full((n, factors), 1e-8)
    for _ in range(max(epochs, -(-steps * batch // len(rows)))):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            mine = order[at : at + batch]
            sizes = np.array([len(rows[i]) for i in mine])
            feats = np.concatenate([rows[i] for i in mine]).astype(np.int64)
            owner = np.repeat(np.arange(len(mine)), sizes)
            vf = v[feats]
            s = np.zeros((len(mine), factors))
            np.add.at(s, owner, vf)
            z = w0 + np.bincount(owner, w[feats], len(mine)) + 0.5 * ((s * s).sum(1) - np.bincount(owner, (vf * vf).sum(1), len(mine)))
            err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[mine]) / len(mine)
            used, place = np.unique(feats, return_inverse=True)
            dw = np.bincount(place, err[owner], len(used)) + decay * w[used]
            each = err[owner, None] * (s[owner] - vf)
            dv = np.stack([np.bincount(place, each[:, f], len(used)) for f in range(factors)], 1) + decay * v[used]
            d0 = err.sum()
            g0 += d0 * d0
            w0 -= rate * d0 / np.sqrt(g0)
            gw[used] += dw * dw
            w[used] -= rate * dw / np.sqrt(gw[used])
            gv[used] += dv * dv
            v[used] -= 0.3 * rate * dv / np.sqrt(gv[used])
    return FactorizationMachine(slot, float(w0), w, v)


def held_out(id_col: str = "doc_id"):
    """Whether a row's labels are kept from training."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def paired_features(flat: np.ndarray, sizes: np.ndarray, y: np.ndarray, probability: np.ndarray, n: int) -> np.ndarray:
    """The features below n whose company tells something about the label that its probability does not.

    Each row's features are added up in a signed sketch of _CELLS cells. Over the rows with a feature the residual (y less probability) and a cell are
    uncorrelated unless the feature and one in that cell interact, so this is a score test of each pair, with the rows' mean residual
    taken out and the larger of the model's and the residuals' variance. A feature counts if its most distant cell is beyond what the best of so many would
    reach by chance (a chi-squared of twice the logarithm of their number). Those with fewer rows than that cannot reach it.
    """
    least = 2 * np.log(max(2, n * _CELLS))
    slot = np.full(n, -1, np.int64)
    often = np.flatnonzero(np.bincount(flat, minlength=n) >= least)
    slot[often] = np.arange(len(often))
    rng = np.random.default_rng(11)
    cell, sign = rng.integers(0, _CELLS, n), rng.choice(np.array([-1.0, 1.0]), n)
    found = np.zeros(len(often), bool)
    residual, variance = y - probability, probability * (1 - probability)
    block = 1 << 13  # features whose sums are held at a time
    for first in range(0, len(often), block):
        size = min(block, len(often) - first)
        rs, vs, vss, rrss = (np.zeros((size, _CELLS), np.float32) for _ in range(4))
        r1, v1 = np.zeros(size), np.full(size, 1e-12)
        for end, count, r, v in zip(np.cumsum(sizes).tolist(), sizes.tolist(), residual.tolist(), variance.tolist(), strict=True):
            mine = flat[end - count : end]
            row = slot[mine] - first
            row = row[(row >= 0) & (row < size)]
            if len(row):
                x = np.bincount(cell[mine], sign[mine], _CELLS)
                for table, factor in ((rs, r * x), (vs, v * x), (vss, v * x * x), (rrss, r * r * x * x)):
                    table[row] += factor.astype(np.float32)
                r1[row] += r
                v1[row] += v
        score = rs - vs * (r1 / v1)[:, None]
        spread = np.maximum(vss - vs * vs / v1[:, None], rrss)
        found[first : first + size] = (score * score / np.maximum(spread, 1e-6)).max(1, initial=0) >= least
    return often[found]


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 16_000, max_values: int = 4_000_000, min_rows: int = 3, min_chi: float | None = None) -> FactorizationMachine:
    """Fits on the labelled rows that aren't held out, max_rows of them at most, and fewer where their features are more than about max_values.

    Of rows with a null label or id nothing is learnt; of several labels for one document the largest counts, of several rows
    with one id the least text. Of the features that occur in min_rows sampled rows those are taken up whose chi-squared is min_chi or more (twice
    the logarithm of their number, where none is given: what the best of so many would reach by chance), and those that paired_features finds in what a machine of
    the former leaves over. Features below only add noise that grows with a text's length.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("y")).where("id is not null and y in (0, 1)")
    known = known.where(~held_out("id")).groupBy("id").agg(F.max("y").alias("y"))
    by_hash = (F.xxhash64("id"), F.col("id"))
    sample = known.where("y = 1").orderBy(*by_hash).limit(max_rows // 2).unionByName(known.where("y = 0").orderBy(*by_hash).limit(max_rows - max_rows // 2))
    sample = spark.createDataFrame(sample.toPandas(), "id long, y int")  # max_rows at most
    labelled = bounded(docs).select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(sample), "id")
    rows = cut(labelled.groupBy("id").agg(F.min("text").alias("text"), F.min("y").alias("y")))

    @tidy
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, total = _Terms(), np.zeros((2, BUCKETS), np.int64)
        for batch in slices(batches):
            for text, y in zip(texts_of(batch), column(batch, "y").to_pylist(), strict=True):
                total[y, list(terms.of(text))] += 1
        seen = np.flatnonzero(total.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[0, seen]), pa.array(total[1, seen])], ["bucket", "neg", "pos"])

    counts = rows.select("text", "y").mapInArrow(counted, "bucket int, neg long, pos long").groupBy("bucket").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).where(F.col("neg") + F.col("pos") >= min_rows).toPandas()
    sizes = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    n1, n0 = max(1, sizes.get(1, 0)), max(1, sizes.get(0, 0))
    a, b = counts["pos"].to_numpy(float), counts["neg"].to_numpy(float)
    total, both = a + b, n1 + n0
    chi = both * (a * (n0 - b) - b * (n1 - a)) ** 2 / np.maximum(1e-9, total * (both - total) * n1 * n0)
    least = 2 * np.log(max(2, len(counts))) if min_chi is None else min_chi
    buckets = counts["bucket"].to_numpy()

    def active(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features (places in the sorted buckets that are chosen) one row after the other, their number by row, the rows' labels: about max_values features at most."""
        wanted = np.sort(buckets[chosen])
        slot = np.full(BUCKETS, -1, np.int32)
        slot[wanted] = np.arange(len(wanted), dtype=np.int32)
        share = max_values / max(1.0, float(total[chosen].sum()))
        taken = rows if share >= 1 else rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)))

        @tidy
        def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms = _Terms(slot)
            for batch in slices(batches):
                flat, each = terms.packed(texts_of(batch))
                parts = np.split(flat, np.cumsum(each)[:-1])
                yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array([x.astype("<i4").tobytes() for x in parts], pa.binary()), pa.array(each), column(batch, "y")], ["id", "f", "n", "y"])

        got = taken.mapInArrow(featured, "id long, f binary, n long, y int").toPandas().sort_values("id")  # in one order, however Spark returned them
        return np.frombuffer(b"".join(got["f"]), "<i4"), got["n"].to_numpy(np.int64), got["y"].to_numpy(float)

    def fitted(chosen: np.ndarray) -> FactorizationMachine:
        flat, each, y = active(chosen)
        slot = np.full(BUCKETS, -1, np.int32)
        slot[np.sort(buckets[chosen])] = np.arange(int(chosen.sum()), dtype=np.int32)
        return fit(np.split(flat, np.cumsum(each)[:-1]) if len(each) else [], y, int(chosen.sum()), slot)

    alone = chi >= least
    machine = fitted(alone)
    # Terms with enough rows for a pair's test, beside those that the machine has.
    wide = alone | (total >= 2 * np.log(max(2, len(counts) * _CELLS)))
    flat, each, y = active(wide)
    names = np.sort(buckets[wide])
    mine = machine.slot[names][flat]
    owner = np.repeat(np.arange(len(each)), each)
    probability = machine.probabilities(mine[mine >= 0], np.bincount(owner[mine >= 0], minlength=len(each)))
    more = np.isin(buckets, names[paired_features(flat, each, y, probability, len(names))])
    return fitted(alone | more) if (more & ~alone).any() else machine


def score(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """(id, score) for each row: 0 to 1. A null or empty text scores as one without terms; repeated rows score alike."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms(model.slot)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(model.scores(texts_of(batch), terms))], ["id", "score"])

    return bounded(docs).select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(run, "id long, score double")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, with whether its label was held out."""
    docs = load(spark, sf_dir, "documents")
    model = train(docs, load(spark, sf_dir, "labels"))
    return score(docs, model).select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """docs without the rows that score THRESHOLD or more; all columns stay, whatever their names."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms(model.slot)
        for batch in slices(batches):
            keep = model.scores(texts_of(batch), terms) < THRESHOLD
            yield batch.filter(pa.array(keep))

    return bounded(docs).mapInArrow(run, docs.schema)
