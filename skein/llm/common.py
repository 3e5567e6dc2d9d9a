"""What the corpus operators share: durable cuts of lineage, bounded slices of text, connected components."""

from __future__ import annotations

import ctypes
import ctypes.util
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.session import new_folder, shared_folder

#: Bytes of text that one vectorised step holds at a time.
SLICE_BYTES = 4 << 20


#: Bytes of an Arrow batch between Spark and its Python workers. Whole texts fill batches of thousands of rows otherwise.
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches hold BATCH_BYTES at most; a smaller bound that the session has stays."""
    conf = df.sparkSession.conf
    now = conf.get(_BATCH_SETTING, None)
    if now is None or not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder as a checkpoint and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df, written to the shared folder as a compressed table and read from there: for larger intermediate results."""
    path = new_folder(df.sparkSession, "skein")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, each cut into parts of about equal size that hold at most `limit` bytes of text and one row's more."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_pylist()
        total = sum(sizes)
        share = total / max(1, -(-total // limit))
        start = held = 0
        for i, size in enumerate(sizes):
            held += size
            if held >= share and i + 1 < n:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0
        yield batch.slice(start)


def _release() -> None:
    """Memory that is free again goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.util.find_library("c")
    if libc and hasattr(trim := ctypes.CDLL(libc), "malloc_trim"):
        trim.malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, returning unused memory now and then and at the end of a task: Python workers live on and wait beside those of later stages."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for k, batch in enumerate(run(batches)):
                yield batch
                if k % 16 == 15:
                    _release()
        finally:
            _release()

    return wrapped


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; a null text is an empty one."""
    return [x or "" for x in column(batch, name).to_pylist()]


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, component) for undirected edges (u, v) of longs: component is the smallest node that can be reached.

    Large-star and small-star contraction in turns. Each round is two aggregations and two equi-joins on the
    edges, which only shrink to stars; every round is written to the shared checkpoint folder, so neither
    lineage nor driver memory grows. Rounds grow with the logarithm of the longest chain; more than `limit` are an error, no result is cut short. A null end drops the edge; loops and repeated edges change nothing; no edges give
    no rows.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(limit):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = cut(small.where("u <> v").distinct())
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = seen
    raise RuntimeError(f"components did not settle in {limit} rounds")
