"""Named queries, each with the SQL that states its result where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are called {name}")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def statement(name: str, text: str, oracle: str | None = None) -> None:
    """A query that is one Spark SQL statement over the tables; the same text (or another dialect's) is its oracle."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for table in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "conversations", "benchmark", "labels", "pages"):
            if table in text:
                spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
        return spark.sql(text)

    query(name, oracle or text)(run)
