"""Approximate vector search: coarse cells as partitions, product-quantised residuals, exact scores for the best.

Vectors are scaled to length one, so cosine is a dot product. Centres of cells and of the residuals' parts are fitted by Lloyd rounds on a bounded sample (TRAIN_ROWS rows, the
ones of the least hashes); every vector is then put into its nearest centre's cell, as a folder of its own, with a code of one byte a part and the vector itself. A search takes each
query's nearest cells, so other cells' folders are not opened; it reads codes alone, scores the vectors that they stand for, keeps the best `rerank` of
each task and query, and scores these exactly by their vectors. probes=None asks all cells and skips the codes: the exact way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import retrieval

#: Rows that the centres are fitted on.
TRAIN_ROWS = 50_000
MAX_CELLS = 4_096
PARTS = 8
ENTRIES = 256
#: Distances and scores that are computed at a time.
SCORES = 1 << 20
#: Candidates that a task keeps at most, over all queries of a block.
KEPT_ROWS = 4_000_000


def lloyd(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k centres of the rows (as many as there are different ones, if fewer): the first are spread over the rows, an empty one takes the farthest row."""
    centres = np.unique(x, axis=0)
    if len(centres) <= k:
        return centres
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near, far = _least(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=len(centres))
        lost = np.flatnonzero(counts == 0)
        if len(lost):
            order = np.argsort(-(far + (x * x).sum(1)), kind="stable")
            sums[lost], counts[lost] = x[order[: len(lost)]], 1
        centres = sums / counts[:, None]
    return centres


def _least(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and its squared distance without the row's own square; SCORES distances at a time."""
    near, far, own = np.empty(len(x), np.int64), np.empty(len(x)), (centres * centres).sum(1)[None, :]
    step = max(1, SCORES // len(centres))
    for at in range(0, len(x), step):
        some = own - 2 * (x[at : at + step] @ centres.T)
        near[at : at + step] = some.argmin(1)
        far[at : at + step] = some.min(1)
    return near, far


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return _least(x, centres)[0]


@dataclass
class Quantiser:
    """Centres of the cells, and for each part of the residuals its entries."""

    cells: np.ndarray
    books: list[np.ndarray]

    def cuts(self) -> list[tuple[int, int]]:
        ends = np.cumsum([0, *(b.shape[1] for b in self.books)]).tolist()
        return list(zip(ends[:-1], ends[1:], strict=True))

    @classmethod
    def fit(cls, sample: np.ndarray, cells: int, parts: int = PARTS, entries: int = ENTRIES) -> Quantiser:
        centres = lloyd(sample, cells)
        residuals = sample - centres[_nearest(sample, centres)]
        books = [lloyd(p, min(entries, 256)) for p in np.array_split(residuals, min(parts, sample.shape[1]), axis=1)]
        return cls(centres, books)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = _nearest(x, self.cells)
        rest = x - self.cells[cell]
        return cell, np.stack([_nearest(rest[:, a:b], book) for (a, b), book in zip(self.cuts(), self.books, strict=True)], axis=1).astype(np.uint8)


def _rows(batch: pa.RecordBatch, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of a batch; rows of another length, with a null or of length zero are left out."""
    ids, kept = [], []
    for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        if v is not None and (size is None or len(v) == size) and None not in v and any(v):
            ids.append(i)
            kept.append(v)
    x = np.array(kept, float).reshape(len(kept), -1 if kept else size or 1)
    good = np.isfinite(x).all(axis=1)
    return np.array(ids, np.int64)[good], retrieval._units(x[good])


class VectorIndex:
    """The stored index of a table of vectors of one length."""

    def __init__(self, spark: SparkSession, folder: str, quantiser: Quantiser) -> None:
        self.spark, self.folder, self.quantiser = spark, folder, quantiser

    @classmethod
    def build(cls, vectors: DataFrame, folder: str, id_col: str = "chunk_id", vector_col: str = "embedding", cells: int | None = None, parts: int = PARTS) -> VectorIndex:
        """cells: about the root of the number of vectors, if not given. The length of the first sampled vector counts; others are left out."""
        spark = vectors.sparkSession
        rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
        head = rows.orderBy(F.xxhash64("id"), "id").limit(TRAIN_ROWS).toArrow().combine_chunks()
        batches = head.to_batches()
        size = next((len(v) for b in batches for v in b.column(1).to_pylist()), 1)
        sample = np.concatenate([_rows(b, size)[1] for b in batches]) if batches else np.zeros((0, size))
        if not len(sample):
            sample = np.eye(1, size)
        total = rows.count()
        made = Quantiser.fit(sample, min(MAX_CELLS, cells or max(1, round(total**0.5))), parts)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, x = _rows(batch, size)
                cell, code = made.encode(x) if len(ids) else (np.zeros(0, int), np.zeros((0, len(made.books)), np.uint8))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, size, dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), lists], ["id", "cell", "code", "vector"])

        coded = rows.mapInArrow(run, "id long, cell int, code binary, vector array<double>")
        coded.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.partitionBy("cell").parquet(folder)
        return cls(spark, folder, made)

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema("id long, code binary, vector array<double>, cell int").parquet(self.folder)

    def probed(self, queries: np.ndarray, probes: int) -> np.ndarray:
        """The cells of each query, nearest centres by their dot product first."""
        return np.argsort(-(queries @ self.quantiser.cells.T), axis=1, kind="stable")[:, :probes]

    def candidates(self, ids: list, units: np.ndarray, probes: int, rerank: int) -> DataFrame:
        """(query_id, id, cell, near): each query's best rows by their codes, at most `rerank` of each task. Tasks are as many as cores, so that the rows kept don't grow with the files."""
        made = self.quantiser
        cells = self.probed(units, probes)
        asked = np.zeros((len(units), len(made.cells)), bool)
        np.put_along_axis(asked, cells, True, axis=1)
        packed = np.packbits(asked, axis=1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = np.asarray(ids, np.int64)
            near, name, of = np.full((len(q), rerank), -np.inf), np.zeros((len(q), rerank), np.int64), np.zeros((len(q), rerank), np.int32)
            for whole in batches:
                for start in range(0, whole.num_rows, 8192):
                    batch = whole.slice(start, 8192)
                    names, cell = np.asarray(batch.column(0)), np.asarray(batch.column(2))
                    code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(names), -1)
                    x = made.cells[cell] + np.concatenate([book[code[:, s]] for s, book in enumerate(made.books)], axis=1)  # what the codes stand for
                    step = max(1, SCORES // (len(names) + rerank))
                    for at in range(0, len(q), step):
                        own = slice(at, at + step)
                        scores = units[own] @ x.T
                        scores[np.unpackbits(packed[own], axis=1, count=len(made.cells))[:, cell] == 0] = -np.inf
                        better = np.flatnonzero((scores > near[own].min(axis=1, keepdims=True)).any(axis=1))
                        if not len(better):
                            continue
                        rows = better + at
                        both = np.concatenate([near[rows], scores[better]], axis=1)
                        top = np.argpartition(-both, rerank - 1, axis=1)[:, :rerank]
                        old, new = top < rerank, np.maximum(top - rerank, 0)
                        pick = np.minimum(top, rerank - 1)
                        name[rows] = np.where(old, np.take_along_axis(name[rows], pick, 1), names[new])
                        of[rows] = np.where(old, np.take_along_axis(of[rows], pick, 1), cell[new])
                        near[rows] = np.take_along_axis(both, top, 1)
            step = max(1, 65_536 // rerank)
            for at in range(0, len(q), step):
                i, j = np.nonzero(near[at : at + step] > -np.inf)
                i += at
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(q[i]), pa.array(name[i, j]), pa.array(of[i, j]), pa.array(near[i, j])], ["query_id", "id", "cell", "near"])

        scanned = self.rows.where(F.col("cell").isin(np.unique(cells).tolist())).select("id", "code", "cell")
        return scanned.coalesce(self.spark.sparkContext.defaultParallelism).mapInArrow(run, "query_id long, id long, cell int, near double")

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, rerank: int | None = None, digits: int = 6) -> DataFrame:
        """(query_id, chunk_id, score, rank): the k best of each query (query_id long, vector). Queries go out in blocks of bounded bytes."""
        if probes is None:
            every = retrieval.dense_search(queries, self.rows, "id", "vector", digits, k)
            return retrieval.top_k(every, k)
        rerank = rerank or 10 * k
        size = self.quantiser.cells.shape[1]
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("q"))
        blocks = max(1, -(-(asked.count() * max(size * 8 * KEPT_ROWS, rerank * retrieval.VECTOR_BYTES)) // (retrieval.VECTOR_BYTES * KEPT_ROWS)))
        found = None
        for b in range(blocks):
            rows = (asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else asked).toArrow().combine_chunks().to_batches()  # about VECTOR_BYTES
            parts = [_rows(r, size) for r in rows]
            ids = [i for names, _ in parts for i in names.tolist()]
            if not ids:
                continue
            units = np.concatenate([x for _, x in parts])
            part = self.candidates(ids, units, min(probes, len(self.quantiser.cells)), rerank)
            found = part if found is None else found.unionByName(part)
        if found is None:
            return self.spark.createDataFrame([], "query_id long, chunk_id long, score double, rank int")
        kept = retrieval.top_k(found, rerank, "near", tie="id").select("query_id", "id", "cell")
        unit = F.col("q")
        vectors = self.rows.select("id", "cell", "vector")
        scored = kept.join(vectors, ["id", "cell"]).join(asked, "query_id")
        dot = F.aggregate(F.zip_with("vector", unit, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        length = F.sqrt(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x * x))
        exact = scored.select("query_id", F.col("id").alias("chunk_id"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / length)), digits).alias("score"))
        return retrieval.top_k(exact.where("score > 0"), k)
