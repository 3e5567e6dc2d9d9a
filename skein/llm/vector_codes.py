"""Vector code compression: product codes from exact integer Lloyd rounds over weighted distinct parts.

Each component x becomes the integer floor(1024 * x) and each vector is cut into PARTS equal consecutive parts. Equal integer parts of one position are one
row with a weight, so copies, however many, cost one row in every round. A round assigns each distinct part to its nearest entry (squared Euclidean
distance, ties to the lower index), sums parts by weight within each task, adds the tasks' sums by entry, and floors the means; an entry without parts
stays. Only codebooks reach the driver: PARTS * ENTRIES rows, whatever the table's size. Codes and distances are joined back to the vectors by part.

All arithmetic is on integers (or on floats where they hold them exactly). Parts travel as bytes: two a component, or four where two can't hold all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import bounded, column, load, stored, tidy

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Integer components beyond this are out of range: sums of squares of up to 8,000 differences still fit 64 bits.
LIMIT = 1 << 24
#: Parts that one matrix product compares with a codebook.
BLOCK = 8_192


def _pack(part: np.ndarray) -> bytes:
    """A part's integers as little-endian bytes, in the least width that holds all of them."""
    most = int(np.abs(part).max(initial=0))
    return part.astype("<i2" if most < 1 << 15 else "<i4").tobytes()


def _unpack(values: list[bytes], size: int) -> np.ndarray:
    """Packed parts of `size` components as rows of longs."""
    out = np.empty((len(values), size), np.int64)
    if not size:
        return out
    narrow = np.fromiter((len(v) == 2 * size for v in values), bool, len(values))
    for mask, kind in ((narrow, "<i2"), (~narrow, "<i4")):
        if mask.any():
            out[mask] = np.frombuffer(b"".join([values[i] for i in np.flatnonzero(mask).tolist()]), kind).reshape(-1, size)
    return out


def _cutter(parts: int):
    @tidy
    def cut_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = column(batch, "v")
            ends = np.asarray(vectors.offsets).astype(np.int64)
            sizes = np.diff(ends)
            flat = vectors.values.slice(ends[0], ends[-1] - ends[0])
            values = np.asarray(flat.fill_null(np.nan), np.float64)
            whole = np.floor(values * SCALE)
            # Of each row: whether a component is missing or not finite, and whether one is out of range.
            count = lambda bad: np.diff(np.concatenate([[0], np.cumsum(bad)])[ends - ends[0]])
            kept = np.flatnonzero((count(~np.isfinite(values)) == 0) & np.asarray(vectors.is_valid()))
            fits = (sizes % parts == 0) & (count(~(np.abs(whole) < LIMIT)) == 0)
            packed: list[list[bytes] | None] = []
            for i in kept.tolist():
                own = whole[ends[i] - ends[0] : ends[i + 1] - ends[0]]
                packed.append([_pack(p) for p in own.astype(np.int64).reshape(parts, sizes[i] // parts)] if fits[i] else None)
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [column(batch, "vec_id").take(at), column(batch, "label").take(at), pa.array(np.where(fits, sizes, -1)[kept]), pa.array(packed, pa.list_(pa.binary()))],
                ["vec_id", "label", "size", "parts"],
            )

    return cut_vectors


def integer_parts(vectors: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", label_col: str = "label", parts: int = PARTS) -> DataFrame:
    """(vec_id, label, size, parts array<binary>) of each row whose vector is neither null nor holds a null or non-finite component.

    size is the number of components; it is -1 and parts are null where the vector can't be cut into equal parts or an integer component is LIMIT or more.
    """
    kind = vectors.schema[label_col].dataType.simpleString()
    rows = bounded(vectors).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(_cutter(parts), f"vec_id long, label {kind}, size long, parts array<binary>")


def _nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry, the lower of equals, and the squared distance."""
    most = max(int(np.abs(rows).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * rows.shape[1] * most * most < 1 << 52 else np.int64  # exact either way
    a, b = rows.astype(kind), book.astype(kind)
    far = (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    code = far.argmin(axis=1)
    return code, ((a * a).sum(axis=1) + far[np.arange(len(a)), code]).astype(np.int64)


def _coded(batch: pa.RecordBatch, books: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(position, places in the batch, parts, codes, distances), in blocks."""
    positions = np.asarray(column(batch, "pos"))
    values = column(batch, "part").to_pylist()
    for pos, book in enumerate(books):
        at = np.flatnonzero(positions == pos)
        for s in range(0, len(at), BLOCK):
            some = at[s : s + BLOCK]
            rows = _unpack([values[i] for i in some.tolist()], book.shape[1])
            yield pos, some, rows, *_nearest(rows, book)


def _summer(books: list[np.ndarray]):
    @tidy
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            weights = np.asarray(column(batch, "weight"))
            for pos, at, rows, code, _ in _coded(batch, books):
                w = weights[at]
                order = np.argsort(code, kind="stable")
                starts = np.flatnonzero(np.diff(code[order], prepend=-1))
                # Products leave 64 bits only where a part has thousands of millions of copies; Python's integers hold them then.
                kind = np.int64 if int(w.sum()) * LIMIT < 1 << 62 else object
                w, rows = w.astype(kind)[order], rows.astype(kind)[order]
                counts, added = np.add.reduceat(w, starts), np.add.reduceat(rows * w[:, None], starts, axis=0)
                for k, entry in enumerate(code[order][starts].tolist()):
                    new = [int(counts[k]), *map(int, added[k])]
                    old = total.get((pos, entry))
                    total[pos, entry] = new if old is None else [x + y for x, y in zip(old, new, strict=True)]
        if total:
            keys = list(total)
            rows = [(p, e, j, x) for p, e in keys for j, x in enumerate(total[p, e])]
            p, e, j, x = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(j, pa.int32()), pa.array([str(v) for v in x])], ["pos", "entry", "at", "x"])

    return sums


def _coder(books: list[np.ndarray]):
    @tidy
    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, far = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for _, at, _, c, d in _coded(batch, books):
                code[at], far[at] = c, d
            yield pa.RecordBatch.from_arrays([column(batch, "pos"), column(batch, "part"), pa.array(code), pa.array(far)], ["pos", "part", "code", "far"])

    return codes


def _first_books(rows: DataFrame, parts: int, entries: int) -> list[np.ndarray] | None:
    """The parts of the smallest ids' vectors, or None where no vector can be cut. Of rows that share an id the one with the least bytes counts."""
    usable = rows.where("size >= 0 and vec_id is not null")
    lead = usable.orderBy("vec_id", "size", *[F.col("parts")[k] for k in range(parts)]).select("size").first()
    if lead is None:
        return None
    usable = usable.where(F.col("size") == lead["size"])
    ids = [r.vec_id for r in usable.select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    head = usable.where(F.col("vec_id").between(ids[0], ids[-1])).groupBy("vec_id").agg(F.min("parts").alias("parts")).collect()
    head.sort(key=lambda r: r.vec_id)
    size = lead["size"] // parts
    return [_unpack([bytes(r.parts[k]) for r in head], size) for k in range(parts)]


def _updated(book: np.ndarray, sums: dict[int, list[int]]) -> np.ndarray:
    out = book.copy()
    for entry, (count, *totals) in sums.items():
        out[entry] = [t // count for t in totals]
    return out


def fit(distinct: DataFrame, books: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks after so many Lloyd rounds over (pos, part, weight). What reaches the driver is one codebook's size a round."""
    for _ in range(rounds):
        sums = distinct.mapInArrow(_summer(books), "pos int, entry int, at int, x string")
        got: dict[int, dict[int, dict[int, int]]] = {}
        for r in sums.groupBy("pos", "entry", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
            got.setdefault(r.pos, {}).setdefault(r.entry, {})[r["at"]] = int(r.x)
        books = [_updated(book, {e: [t[j] for j in range(len(t))] for e, t in got.get(pos, {}).items()}) for pos, book in enumerate(books)]
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components in order, joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def codes(vectors: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, label, code, error, codebooks_sha256) of each kept row; code has two hex digits for each part.

    Rows with a null vector or a null or non-finite component are dropped. The table's length is that of the smallest id's vector that can be cut; vectors
    of another length, or with components out of range, keep their row with a null code and error. Null ids are coded but start no codebook. Repeated rows
    stay repeated. Fewer ids than entries: as many entries. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    rows = integer_parts(vectors, vector_col, id_col, label_col, parts)
    books = _first_books(rows, parts, entries)
    none = lambda df: df.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if books is None:
        return none(rows).withColumn("codebooks_sha256", F.lit(None).cast("string"))
    size = books[0].shape[1] * parts
    usable = rows.where(F.col("size") == size)
    pieces = usable.select("vec_id", "label", F.xxhash64("parts").alias("h"), F.hash("parts").alias("g"), F.posexplode("parts").alias("pos", "part"))
    distinct = stored(pieces.groupBy("pos", "part").agg(F.count("*").alias("weight")))
    books = fit(distinct, books, rounds)
    coded = distinct.select("pos", "part").mapInArrow(_coder(books), "pos int, part binary, code int, far long")
    joined = pieces.join(coded, ["pos", "part"])
    # Equal rows are one group; they come back as often as they were there, in two steps so that no array grows with their number.
    text = F.concat(*[F.lpad(F.lower(F.hex(F.max(F.when(F.col("pos") == k, F.col("code"))).cast("long"))), 2, "0") for k in range(parts)])
    far = sum((F.max(F.when(F.col("pos") == k, F.col("far"))) for k in range(1, parts)), F.max(F.when(F.col("pos") == 0, F.col("far"))))
    whole = joined.groupBy("vec_id", "label", "h", "g").agg(F.count(F.when(F.col("pos") == 0, 1)).alias("n"), text.alias("code"), far.alias("error"))
    run = 4_096
    again = whole.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / run)))).withColumn(
        "one", F.explode(F.sequence(F.lit(1), F.least(F.lit(run), F.col("n") - F.col("run") * run)))
    )
    out = again.select("vec_id", "label", "code", "error").unionByName(none(rows.where(F.col("size") != size)))
    return out.withColumn("codebooks_sha256", F.lit(digest(books)))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's code and error, and the error of all vectors with its label."""
    coded = stored(codes(load(spark, sf_dir, "embeddings")))
    sums = coded.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("l"))).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _sql() -> str:
    """The same rounds as one DuckDB statement, each round two materialised tables."""
    steps = [
        "kept AS MATERIALIZED (SELECT vec_id, label, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "p AS MATERIALIZED (SELECT r, vec_id, pos, v[pos * (len(v) // 4) + 1 : (pos + 1) * (len(v) // 4)] AS v FROM kept, range(4) t(pos))",
        "d AS MATERIALIZED (SELECT pos, v, count(*) AS w FROM p GROUP BY ALL)",
        "b0 AS MATERIALIZED (SELECT pos, v, row_number() OVER (PARTITION BY pos ORDER BY vec_id) - 1 AS e FROM p WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256))",
    ]
    near = "SELECT d.pos, d.v, d.w, min(list_sum(list_transform(list_zip(d.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 256 + b.e) AS best FROM d JOIN {b} b ON d.pos = b.pos GROUP BY ALL"
    for k in range(4):
        steps += [
            f"a{k} AS MATERIALIZED ({near.format(b=f'b{k}')})",
            f"s{k} AS MATERIALIZED (SELECT pos, e, list(floor_div ORDER BY j) AS v FROM (SELECT pos, e, j, (s - ((s % n) + n) % n) // n AS floor_div FROM (SELECT pos, best % 256 AS e, j, CAST(sum(w * v[j]) AS HUGEINT) AS s, CAST(sum(w) AS HUGEINT) AS n"
            f" FROM (SELECT *, unnest(range(1, len(v) + 1)) AS j FROM a{k}) GROUP BY ALL)) GROUP BY ALL)",
            f"b{k + 1} AS MATERIALIZED (SELECT b.pos, CAST(coalesce(s.v, b.v) AS BIGINT[]) AS v, b.e FROM b{k} b LEFT JOIN s{k} s ON b.pos = s.pos AND b.e = s.e)",
        ]
    steps += [
        f"z AS MATERIALIZED ({near.format(b='b4')})",
        "c AS MATERIALIZED (SELECT p.r, string_agg(lpad(lower(to_hex(CAST(z.best % 256 AS BIGINT))), 2, '0'), '' ORDER BY p.pos) AS code, CAST(sum(z.best // 256) AS BIGINT) AS error FROM p JOIN z ON p.pos = z.pos AND p.v = z.v GROUP BY p.r)",
        "h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY pos, e)) AS codebooks_sha256 FROM b4)",
        "t AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM kept JOIN c USING (r) GROUP BY label)",
    ]
    return f"WITH {', '.join(steps)} SELECT k.vec_id, c.code, c.error, t.label_error, h.codebooks_sha256 FROM kept k JOIN c USING (r) JOIN t ON k.label IS NOT DISTINCT FROM t.label, h"


OP12_SQL = _sql()
