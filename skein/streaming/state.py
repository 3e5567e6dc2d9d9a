"""Keyed state over event streams: breakers, throttles and expiring caches, driven by event time alone.

Each machine is a plain transition on one key's rows in order, so a stream and a replay of a table run the same code. State is a handful
of numbers a key.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def breaker_step(state: tuple[str, int, float, int], ok: bool, ts: float, failures: int, recovery: float, trials: int) -> tuple[tuple[str, int, float, int], bool]:
    """The state after one call and whether the call was let through. state: (name, failures in a row, opened at, trials)."""
    name, failed, since, tried = state
    if name == "OPEN" and ts - since >= recovery:
        name, tried = "HALF_OPEN", 0
    if name == "OPEN" or (name == "HALF_OPEN" and tried >= trials):
        return (name, failed, since, tried), False
    if ok:
        return ("CLOSED", 0, since, 0), True
    failed += 1
    if name == "HALF_OPEN" or failed >= failures:
        return ("OPEN", failed, ts, 0), True
    return (name, failed, since, tried), True


BREAKER_OUT = "key string, calls long, passed long, refused long, opened long, state string"
BREAKER_STATE = "state string, failed int, since double, tried int, calls long, passed long, refused long, opened long"


def breaker_stream(outcomes: DataFrame, failures: int = 3, recovery: float = 3600.0, trials: int = 1) -> DataFrame:
    """Running counts of a breaker for each key of a stream (key string, seq long, ts double, ok boolean)."""

    def run(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name, failed, since, tried, calls, passed, refused, opened = state.get if state.exists else ("CLOSED", 0, 0.0, 0, 0, 0, 0, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "seq"])  # one micro-batch of one key
        for ts, ok in zip(rows["ts"], rows["ok"], strict=True):
            before = name
            (name, failed, since, tried), let = breaker_step((name, failed, since, tried), bool(ok), float(ts), failures, recovery, trials)
            calls, passed, refused, opened = calls + 1, passed + let, refused + (not let), opened + (name == "OPEN" and before != "OPEN")
        state.update((name, int(failed), float(since), int(tried), int(calls), int(passed), int(refused), int(opened)))
        yield pd.DataFrame([(key[0], calls, passed, refused, opened, name)], columns=["key", "calls", "passed", "refused", "opened", "state"])

    return outcomes.groupBy("key").applyInPandasWithState(run, BREAKER_OUT, BREAKER_STATE, "update", GroupStateTimeout.NoTimeout)


def replay_breaker(rows: list[tuple[float, bool]], failures: int = 3, recovery: float = 3600.0, trials: int = 1) -> list[str]:
    """The states that a list of (ts, ok) leads through."""
    state, out = ("CLOSED", 0, 0.0, 0), []
    for ts, ok in rows:
        state, _ = breaker_step(state, ok, ts, failures, recovery, trials)
        out.append(state[0])
    return out


class ExpiringCache:
    """A cache on a given clock: values expire, a full cache drops what expires first, every `sweep` writes the expired ones go."""

    def __init__(self, capacity: int = 100, ttl: float = 300.0, sweep: int = 100):
        self.capacity, self.ttl, self.sweep = capacity, ttl, sweep
        self.items: dict[str, tuple[Any, float]] = {}
        self.hits = self.misses = self.writes = 0

    def get(self, key: str, now: float) -> Any:
        value, until = self.items.get(key, (None, 0.0))
        if value is not None and now < until:
            self.hits += 1
            return value
        self.items.pop(key, None)
        self.misses += 1
        return None

    def set(self, key: str, value: Any, now: float, ttl: float | None = None) -> None:
        if key not in self.items and len(self.items) >= self.capacity:
            del self.items[min(self.items, key=lambda k: self.items[k][1])]
        self.items[key] = (value, now + (ttl or self.ttl))
        self.writes += 1
        if self.writes % self.sweep == 0:
            self.items = {k: v for k, v in self.items.items() if v[1] >= now}

    def update(self, key: str, value: Any, now: float) -> None:
        if key in self.items:
            self.items[key] = (value, now + self.ttl)

    def get_or_set(self, key: str, compute, now: float) -> Any:
        value = self.get(key, now)
        if value is None:
            value = compute()
            self.set(key, value, now)
        return value

    @property
    def hit_rate(self) -> float:
        return self.hits / (self.hits + self.misses) if self.hits + self.misses else 0.0


def cache_replay(operations: DataFrame, ttl: float) -> DataFrame:
    """Reads of a log (key, seq, ts double, op "get" or "set", value) with the value they find: the last one written, if it is younger than ttl.

    A cache without a limit to its size is a window over its log, so nothing is replayed row by row.
    """
    before = Window.partitionBy("key").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("op") == "set", F.struct("ts", "value")), ignorenulls=True).over(before)
    reads = operations.withColumn("last_", last).where("op = 'get'")
    fresh = F.coalesce(F.col("ts") < F.col("last_.ts") + ttl, F.lit(False)) & F.col("last_.value").isNotNull()
    return reads.select("key", "seq", "ts", fresh.alias("hit"), F.when(fresh, F.col("last_.value")).alias("found"))


CACHE_OUT = "cache string, seq long, key string, hit boolean, found string"


def cache_stream(operations: DataFrame, capacity: int = 100, ttl: float = 300.0, sweep: int = 100) -> DataFrame:
    """Reads of a stream of operations (cache string, seq long, ts double, op "get", "set" or "update", key, value) on caches of limited size.

    A cache's state is its items with their expiry, `capacity` at most, on the operations' own clock.
    """

    def run(name: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cache = ExpiringCache(capacity, ttl, sweep)
        if state.exists:
            items, cache.writes = state.get
            cache.items = {k: (v, until) for k, v, until in json.loads(items)}
        out = []
        for r in pd.concat(list(frames)).sort_values(["ts", "seq"]).itertuples():  # one micro-batch of one cache
            if r.op == "get":
                found = cache.get(r.key, r.ts)
                out.append((name[0], r.seq, r.key, found is not None, found))
            elif r.op == "set":
                cache.set(r.key, r.value, r.ts)
            else:
                cache.update(r.key, r.value, r.ts)
        state.update((json.dumps([(k, v, until) for k, (v, until) in cache.items.items()]), cache.writes))
        yield pd.DataFrame(out, columns=["cache", "seq", "key", "hit", "found"])

    return operations.groupBy("cache").applyInPandasWithState(run, CACHE_OUT, "items string, writes int", "append", GroupStateTimeout.NoTimeout)


def disabled_calls(calls: DataFrame, failures: int = 3, interval: float = 300.0, errors: Sequence[str] = ("错误：", "工具执行失败:", "【搜索不可用】"), terminal: Sequence[str] = ("【搜索不可用】",)) -> DataFrame:
    """calls (tool string, seq long, ts double, result string) with `refused`: whether the tool was switched off when it was called.

    So many errors in a row switch a tool off, a terminal one does so at once; after `interval` seconds it is on again with no error counted. Refused
    calls have no result that counts. The calls of a tool are sorted, not collected: they stream through with two numbers of state.
    """

    def starts(prefixes: Sequence[str]) -> Column:
        found = F.lit(False)
        for p in prefixes:
            found = found | F.coalesce(F.col("result").startswith(p), F.lit(False))
        return found

    weight = F.when(starts(terminal) & starts(errors), failures).when(starts(errors), 1).otherwise(0)
    rows = calls.select("tool", F.col("seq").cast("long").alias("seq"), F.col("ts").cast("double").alias("ts"), weight.alias("weight"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool, count, since = None, 0, None
        for frame in frames:
            refused = []
            for name, ts, weight in zip(frame["tool"], frame["ts"], frame["weight"], strict=True):
                if name != tool:
                    tool, count, since = name, 0, None
                if since is not None and ts - since > interval:
                    count, since = 0, None
                refused.append(since is not None)
                if since is None:
                    count = count + weight if weight else 0
                    since = ts if count >= failures else None
            yield frame[["tool", "seq", "ts"]].assign(refused=refused)

    return rows.repartition("tool").sortWithinPartitions("tool", "ts", "seq").mapInPandas(run, "tool string, seq long, ts double, refused boolean")
