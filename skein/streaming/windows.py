"""Event-time streams over a table of events: windows with watermarks, de-duplication, last values, ordered frames for a client."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from skein.session import new_folder


def event_stream(spark: SparkSession, sf_dir: str, table: str = "events", files_a_batch: int = 4) -> DataFrame:
    """A file stream of a table, with ts as an instant (watermarks need one)."""
    path = f"{sf_dir}/{table}.parquet"
    batch = spark.read.parquet(path)
    single = batch.inputFiles()[:1] and batch.inputFiles()[0].rstrip("/").endswith(f"/{table}.parquet")
    reader = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", files_a_batch)
    stream = reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir) if single else reader.parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in stream.columns else stream


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """What a stream gives once all that is there was read. complete: the last result; update: every batch's rows; append: all rows.

    Rows are written to the shared folder, where the stream keeps its checkpoint too, so a lost executor loses nothing.
    """
    spark = stream.sparkSession
    top = new_folder(spark, "stream")
    save = "overwrite" if mode == "complete" else "append"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_", F.lit(number)).write.mode(save).parquet(f"{top}/out")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("batch_", IntegerType())])
    empty = spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{top}/out") if query.lastProgress else empty


def windowed(events: DataFrame, window: Column, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """Counts and sums of a window and keys, with a watermark so that closed windows leave the state."""
    grouped = events.withWatermark("ts", delay).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def first_seen(events: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """Repeated keys dropped as long as the watermark lets them be known."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def frames(rows: Iterable[dict[str, Any]], meta: dict[str, Any] | None = None) -> Iterator[str]:
    """Server-sent events of a result: meta, one delta a row, done; or error, with what failed."""

    def frame(event: str, data: Any, number: int) -> str:
        return f"id: {number}\nevent: {event}\ndata: {json.dumps(data, ensure_ascii=False, default=str)}\n\n"

    n = 0
    yield frame("meta", meta or {}, n)
    try:
        for row in rows:
            n += 1
            yield frame("delta", row, n)
    except Exception as e:  # the client is told, whatever failed
        yield frame("error", {"message": str(e)}, n + 1)
        return
    yield frame("done", {"rows": n}, n + 1)


def result_frames(df: DataFrame) -> Iterator[str]:
    """A result's rows as frames, a partition at a time on the driver."""
    return frames((r.asDict(recursive=True) for r in df.toLocalIterator()), {"columns": df.columns})
