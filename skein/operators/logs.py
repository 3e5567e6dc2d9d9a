"""Sessions, traces and monitors: last-n windows, runs of failures and aggregates over append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_n(rows: DataFrame, n: int, by: str, order: str) -> DataFrame:
    """The last n rows of each group (none for n = 0); Spark keeps n rows a task before it shuffles."""
    w = Window.partitionBy(by).orderBy(F.col(order).desc())
    return rows.withColumn("r_", F.row_number().over(w)).where(F.col("r_") <= n).drop("r_")


def session_counts(sessions: DataFrame, messages: DataFrame, key: str) -> DataFrame:
    counts = messages.groupBy(key).agg(F.count("*").alias("messages"))
    return sessions.join(counts, key, "left").withColumn("messages", F.coalesce("messages", F.lit(0)))


def append_known(messages: DataFrame, sessions: DataFrame, key: str) -> DataFrame:
    """Only messages of sessions that exist."""
    return messages.join(sessions.select(key), key, "left_semi")


def dialogue_depth(messages: DataFrame, by: str, order: str, role: str = "role", last: int = 6) -> DataFrame:
    """messages with depth: the user's among the last six up to each."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(1 - last, 0)
    return messages.withColumn("depth", F.sum((F.col(role) == "user").cast("int")).over(w))


def failure_runs(outcomes: DataFrame, by: str, order: list[str], failed: Column) -> DataFrame:
    """outcomes with run: the number of consecutive failures up to each row, 0 after a success."""
    w = Window.partitionBy(by).orderBy(*order)
    island = F.sum((~failed).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = outcomes.withColumn("island_", island).withColumn("failed_", failed.cast("int"))
    inner = Window.partitionBy(by, "island_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("run", F.sum("failed_").over(inner)).drop("island_", "failed_")


def trace_summary(events: DataFrame, by: str, failed: Column, duration: str) -> DataFrame:
    return events.groupBy(by).agg(
        F.count("*").alias("calls"), F.count_if(failed).alias("failures"), F.avg(F.when(failed, 0.0).otherwise(1.0)).alias("success_rate"), F.avg(duration).alias("mean_duration")
    )


def recent_failures(events: DataFrame, failed: Column, order: list[Column], n: int = 5) -> DataFrame:
    return events.where(failed).orderBy(*order).limit(n)


def failure_chain(events: Column) -> Column:
    """Of an array of event structs, those that didn't succeed, in order."""
    return F.filter(events, lambda e: e["status"] != "success")


def monitor_summary(entries: DataFrame) -> DataFrame:
    """One row on entries (tokens, cache_hit, compressed, sources map<string,int>): means skip nulls, source counts are added up."""
    sums = entries.select(F.explode("sources").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("sources"))
    total = entries.agg(
        F.count("*").alias("entries"), F.avg("tokens").alias("mean_tokens"), F.avg(F.col("cache_hit").cast("double")).alias("cache_hit_rate"), F.avg(F.col("compressed").cast("double")).alias("compression_rate")
    )
    return total.crossJoin(sums)


def every_nth(rows: DataFrame, by: str, order: list[str], cadences: dict[str, int]) -> DataFrame:
    """rows with a boolean for each cadence: whether the row is the nth, 2nth, ... of its group."""
    out = rows.withColumn("n_", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    for name, n in cadences.items():
        out = out.withColumn(name, F.col("n_") % n == 0)
    return out.drop("n_")


def hot_from_second(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with hot: whether the key was met before."""
    return rows.withColumn("hot", F.row_number().over(Window.partitionBy(key).orderBy(*order)) >= 2)
