"""Keyed state that expires: sessions that an event-time timer closes.

State lies in Spark's RocksDB store below the stream's checkpoint, so a stream that is stopped and started again goes on where it was, timers included.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_OPEN = "start long, end long, n long, total double"
SESSIONS = "key string, start timestamp, end timestamp, n long, total double"


def durable_state(spark: SparkSession) -> None:
    """Streams that start from now on keep their state in RocksDB, which timers need. Checkpoints know their own store, so others go on as they were."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def merged(spans: list[tuple[int, int, int, float]], gap: int) -> list[tuple[int, int, int, float]]:
    """Spans (start, end, n, total) in order, those closer than the gap as one."""
    out: list[list] = []
    for start, end, n, total in sorted(spans):
        if out and start - out[-1][1] < gap:
            out[-1][1:] = [max(out[-1][1], end), out[-1][2] + n, out[-1][3] + total]
        else:
            out.append([start, end, n, total])
    return [tuple(x) for x in out]


class _Sessions(StatefulProcessor):
    def __init__(self, gap: int) -> None:
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", _OPEN)

    def _keep(self, spans: list[tuple[int, int, int, float]]) -> None:
        if spans:
            self.open.put(spans)
        else:
            self.open.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        spans = [tuple(x) for x in self.open.get()]
        for frame in rows:
            spans += [(int(at), int(at), 1, float(v)) for at, v in zip(frame["at"], frame["value"], strict=True)]
            spans = merged(spans, self.gap)  # a frame at a time, so state is as large as what is open
        self._keep(spans)
        for _, end, _, _ in spans:
            self.handle.registerTimer(end // 1000 + self.gap // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        spans = [tuple(x) for x in self.open.get()]
        closed = [s for s in spans if (s[1] // 1000 + self.gap // 1000 + 1) * 1000 <= now]
        if closed:
            self._keep([s for s in spans if s not in closed])
            micros = lambda k: pd.to_datetime([s[k] for s in closed], unit="us")
            yield pd.DataFrame({"key": [str(key[0])] * len(closed), "start": micros(0), "end": micros(1), "n": [s[2] for s in closed], "total": [s[3] for s in closed]})

    def close(self) -> None:
        pass


def sessions(events: DataFrame, key: str, gap_seconds: int, delay: str = "1 hour", value: str = "value") -> DataFrame:
    """(key, start, end, n, total): runs of a key's events (ts timestamp) less than a gap apart, each told once, when the watermark has left it behind by the gap.

    Events may come in any order within the delay: they join, widen or connect open sessions. A null key is the text "None"; rows without a time are dropped, a null value counts as zero.
    """
    durable_state(events.sparkSession)
    rows = events.where(F.col("ts").isNotNull()).withWatermark("ts", delay).select(F.col(key).cast("string").alias("key"), "ts", F.unix_micros("ts").alias("at"), F.coalesce(F.col(value), F.lit(0.0)).cast("double").alias("value"))
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=_Sessions(gap_seconds * 1_000_000), outputStructType=SESSIONS, outputMode="append", timeMode="EventTime")
