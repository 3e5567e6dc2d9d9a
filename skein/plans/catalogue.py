"""All queries of the engine, gathered from the modules that state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.plans import function_queries, memory_queries, relational_queries, retrieval_queries, store_queries, text_queries  # noqa: F401
from skein.plans.registry import QUERIES, SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval: sparse and dense legs for every benchmark question, merged and cut to the best."""
    return retrieval_queries.hybrid_merge(spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
