"""Routing of questions: channel, four features, membership in the paradigms' ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions.lexicons import COMPLEX_WORDS, COMPLEXITY, EXTERNAL, GREETINGS, ITERATION, MATCH_THRESHOLD, PARADIGMS, REFERRAL_WORDS, SOFT_MARGIN, STRUCTURE
from skein.functions.scores import membership


def channel(query: Column) -> Column:
    """fast or full: greetings are fast, telling or referring words full, then very short fast, long full, the rest fast."""
    q = F.trim(query)
    return (
        F.when(F.lower(q).isin(*GREETINGS), "fast")
        .when(T.hits(q, COMPLEX_WORDS, fold=False) > 0, "full")
        .when(T.hits(q, REFERRAL_WORDS, fold=False) > 0, "full")
        .when(F.length(q) < 8, "fast")
        .when(F.length(q) > 30, "full")
        .otherwise("fast")
    )


def features(query: Column) -> Column:
    """struct(complexity, external, iteration, structured). Indicators with capitals never match: the query is lower-cased, they aren't."""
    q = F.lower(F.trim(F.coalesce(query, F.lit(""))))
    count = lambda words: T.hits(q, words, fold=False)
    share = lambda words: F.round(F.least(count(words) * F.lit(0.3), F.lit(1.0)), 4)
    complex_hits = count(COMPLEXITY)
    yes = lambda c: c.cast("int")
    score = F.lit(1) + yes(F.length(q) > 30) + yes(F.length(q) > 80) + yes(complex_hits >= 1) + yes(complex_hits >= 3) + yes(F.regexp_count(q, F.lit("[？?。]")) >= 2)
    empty = q == ""
    zero = lambda c: F.when(empty, 0.0).otherwise(c)
    return F.struct(
        F.when(empty, 1).otherwise(F.least(F.lit(5), score)).alias("complexity"), zero(share(EXTERNAL)).alias("external"), zero(share(ITERATION)).alias("iteration"), zero(share(STRUCTURE)).alias("structured")
    )


def match_scores(f: Column) -> Column:
    """array<struct(score, priority, place, name)> of the six paradigms: the geometric mean of four memberships."""
    rows = []
    for place, (name, c, e, i, s, priority) in enumerate(PARADIGMS):
        product = (
            membership(f["complexity"] / 5.0, c[0] / 5, c[1] / 5, SOFT_MARGIN) * membership(f["external"], *e, SOFT_MARGIN)
            * membership(f["iteration"], *i, SOFT_MARGIN) * membership(f["structured"], *s, SOFT_MARGIN)
        )
        rows.append(F.struct(F.pow(product, F.lit(0.25)).alias("score"), F.lit(priority).alias("priority"), F.lit(-place).alias("place"), F.lit(name).alias("name")))
    return F.array(*rows)


def route(queries: DataFrame, query_col: str = "query", default: str = "simple") -> DataFrame:
    """queries with features, paradigm, match and decided_by: the best match, then priority; below the threshold the default."""
    scored = queries.withColumn("features", features(F.col(query_col)))
    best = F.array_max(match_scores(F.col("features")))
    out = scored.withColumn("best_", best)
    good = F.col("best_.score") >= MATCH_THRESHOLD
    return out.select(
        *queries.columns, "features", F.when(good, F.col("best_.name")).otherwise(default).alias("paradigm"), F.col("best_.score").alias("match"), F.when(good, "feature").otherwise("fallback").alias("decided_by")
    )


def accuracy(routed: DataFrame, expected: str = "expected") -> DataFrame:
    """Share of right decisions for each class and, with a null class, over all."""
    return routed.rollup(expected).agg(F.count("*").alias("n"), F.avg((F.col("paradigm") == F.col(expected)).cast("double")).alias("accuracy"))


def beam(nodes: DataFrame, width: int, threshold: float) -> DataFrame:
    """Of scored nodes (depth, node_id, score) the best `width` of each depth that reach the threshold."""
    order = Window.partitionBy("depth").orderBy(F.col("score").desc(), "node_id")
    return nodes.where(F.col("score") >= threshold).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= width)
