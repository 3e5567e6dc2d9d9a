"""SimHash near-duplicate search by multi-index hashing.

A fingerprint has 64 bits, taken by majority over the XXH64 of the 3-word shingles. Two fingerprints link at 3 or fewer
differing bits. The 64 bits are two segments of 32, so that of two linked fingerprints one segment differs in one bit at
most: for each segment the Hamming ball of radius 1 is enumerated, looked up in the table of segment values by an
equi-join, and the whole distance is verified inside that join. Of two values that differ in one bit, the one that lacks
it flips it, so half the ball (16 of 32 flips on average, and the value itself) finds every pair once.

Only distinct fingerprints are indexed (equal ones are one class from the start), so groups of exact copies cost one
row however large they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from skein.llm.common import bounded, column, components, cut, load, slices, tidy

SEED = 42
SHINGLE = 3
MAX_BITS = 3
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_LANES = np.uint64(0x0101010101010101)


def text_fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of one UTF-8 text: words are runs of anything but ASCII white space, A-Z is lower-cased.

    Fewer words than a shingle: the whole sequence is the only shingle. No word: zero.
    """
    words = data.translate(_LOWER).split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(
        b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]), ">u8"
    ).astype(np.uint64)
    return _majority(hashes)


def _majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half the hashes. Lane sums of 8 counters at once, 255 hashes before they could overflow."""
    n = len(hashes)
    full = np.zeros(-(-n // 255) * 255, np.uint64)
    full[:n] = hashes
    blocks = full.reshape(-1, 255)
    out = 0
    for b in range(8):
        lanes = ((blocks >> np.uint64(b)) & _LANES).sum(axis=1, dtype=np.uint64)
        counts = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)  # little-endian: lane 0 holds bit b
        for lane in np.flatnonzero(2 * counts > n).tolist():
            out |= 1 << (8 * lane + b)
    return out


@tidy
def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = column(batch, "text").cast(pa.binary()).to_pylist()
        prints = np.array([text_fingerprint(x or b"") for x in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(prints)], ["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id long, fp long) for each row of docs. A null text counts as empty (fingerprint zero); a null id stays null."""
    rows = bounded(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_fingerprint_batches, "id long, fp long")


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) of distinct fingerprints (fp) at 1 to MAX_BITS differing bits, each pair once or twice."""
    halves = distinct.select(
        "fp",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("seg"), F.shiftrightunsigned("fp", 32).cast("long").alias("val")),
                F.struct(F.lit(1).alias("seg"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("val")),
            )
        ).alias("h"),
    ).select("fp", "h.seg", "h.val")
    ball = F.array(F.col("val"), *[F.when(F.col("val").bitwiseAND(F.lit(1 << i)) == 0, F.col("val").bitwiseOR(F.lit(1 << i))) for i in range(32)])
    probes = halves.select(F.col("fp").alias("a"), "seg", "val", F.explode(F.array_compact(ball)).alias("probe"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    found = probes.alias("p").join(
        halves.select(F.col("fp").alias("b"), F.col("seg").alias("seg2"), F.col("val").alias("val2")).alias("t"),
        (F.col("seg") == F.col("seg2")) & (F.col("probe") == F.col("val2")) & (F.col("a") != F.col("b")) & near
        & ((F.col("probe") != F.col("val")) | (F.col("a") < F.col("b"))),
    )
    return found.select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): component_id is the smallest id that links reach, the row's own included.

    Repeated rows stay repeated. Rows with a null id get a fingerprint and the component of their text's other rows, if
    there are any, else null. An empty table gives no rows.
    """
    prints = cut(fingerprints(docs, id_col, text_col))
    distinct = prints.groupBy("fp").agg(F.min("id").alias("rep"))
    # The ids of components come from ids, not from fingerprints: each distinct fingerprint stands for its smallest id.
    pairs = links(distinct.where("rep is not null").select("fp"))
    reps = distinct.select(F.col("fp").alias("k"), F.col("rep"))
    edges = (
        pairs.join(reps.select(F.col("k").alias("a"), F.col("rep").alias("u")), "a")
        .join(reps.select(F.col("k").alias("b"), F.col("rep").alias("v")), "b")
        .select("u", "v")
    )
    comp = components(edges)
    named = distinct.join(comp, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "fp").select("id", "fp", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    out = near_duplicates(load(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@tidy
def _row_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        prints = np.array([text_fingerprint(x or b"") for x in column(batch, "text").cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([column(batch, "row"), column(batch, "id"), pa.array(prints)], ["row", "id", "fp"])


def keep_row(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with exactly one row of each set of near-duplicates: the smallest id (a null id is the last), of its rows the smallest fingerprint.

    Sets are components of fingerprints, so rows that share an id but not a near text are different sets and each keeps a row. Which ids stay is settled from
    ids and fingerprints. Only texts whose id repeats (or is null) are fingerprinted again, to tell their rows apart; equal ones are merged where they
    are before they are shuffled. The caller's columns travel as one struct, so they may have any names.
    """
    prints = cut(fingerprints(docs, id_col, text_col))
    distinct = prints.groupBy("fp").agg(F.min("id").alias("rep"))
    named = distinct.join(components(links(distinct.select("fp")).select(F.col("a").alias("u"), F.col("b").alias("v"))), F.col("fp") == F.col("node"), "left")
    best = named.groupBy(F.coalesce("component", "fp").alias("set")).agg(F.min(F.struct(F.col("rep").isNull().alias("last"), "rep", "fp")).alias("x"))
    chosen = best.select(F.col("x.rep").alias("chosen"), F.col("x.fp").alias("its"))
    repeated = cut(prints.groupBy(F.col("id").alias("again")).agg(F.count("*").alias("n")).where("n > 1 or again is null").select("again"))
    single = chosen.join(repeated, F.col("chosen") == F.col("again"), "left_anti").where("chosen is not null").select("chosen")
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs[id_col].cast("long").alias("id"))
    out = packed.join(single, F.col("id") == F.col("chosen"), "left_semi").select("row.*")
    if repeated.isEmpty():
        return out
    rows = packed.join(repeated, F.col("id").eqNullSafe(F.col("again")), "left_semi").select("row", "id", F.col("row")[text_col].alias("text"))
    schema = StructType([StructField("row", packed.schema["row"].dataType), StructField("id", LongType()), StructField("fp", LongType())])
    wanted = bounded(rows).mapInArrow(_row_batches, schema).join(chosen, F.col("id").eqNullSafe(F.col("chosen")) & (F.col("fp") == F.col("its")), "left_semi")
    one = wanted.groupBy("id", "fp").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return out.unionByName(one.select("row.*"))
