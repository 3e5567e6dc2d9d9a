"""Score formulas of memories, contexts and notes. Time is always an argument: nothing reads a clock."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.lexicons import NOTE_BOOST


def age_seconds(ts: Column, as_of: Column) -> Column:
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    return (micros(as_of) - micros(ts)) / F.lit(1e6)


def importance_weight(importance: Column) -> Column:
    return F.lit(0.8) + importance * 0.4


def working_decay(ts: Column, as_of: Column, ttl_minutes: float) -> Column:
    """exp(-age / ttl) between 0 and 1; 0.5 for a null time, 1 without a ttl."""
    if ttl_minutes is None or ttl_minutes <= 0:
        return F.when(ts.isNull(), 0.5).otherwise(1.0)
    decay = F.exp(-(age_seconds(ts, as_of) / 60) / ttl_minutes)
    return F.when(ts.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), decay)))


def working_score(tfidf: Column, keyword: Column, decay: Column, importance: Column) -> Column:
    relevance = F.when(tfidf > 0, tfidf * 0.7 + keyword * 0.3).otherwise(keyword)
    return relevance * decay * importance_weight(importance)


def episodic_recency(ts: Column, as_of: Column) -> Column:
    recency = F.exp(-(age_seconds(ts, as_of) / 86400) / 30)
    return F.when(ts.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), recency)))


def episodic_score(vector: Column, keyword: Column, recency: Column, importance: Column) -> Column:
    """A vector score of zero falls back on the key words."""
    return (F.when(vector > 0, vector).otherwise(keyword) * 0.8 + recency * 0.2) * importance_weight(importance)


def semantic_score(vector: Column, graph: Column, importance: Column) -> Column:
    return (vector * 0.7 + graph * 0.3) * importance_weight(importance)


def perceptual_recency(ts: Column, as_of: Column) -> Column:
    return F.when(ts.isNull(), 0.5).otherwise(F.greatest(F.lit(0.1), F.exp(-0.1 * (age_seconds(ts, as_of) / 3600) / 24)))


def perceptual_score(vector: Column, recency: Column, importance: Column) -> Column:
    return (vector * 0.8 + recency * 0.2) * importance_weight(importance)


def context_recency(ts: Column, as_of: Column) -> Column:
    """1 for a day (and for a null time), then exp(-(hours - 24) / 72)."""
    hours = F.greatest(F.lit(0.0), age_seconds(ts, as_of) / 3600)
    return F.when(ts.isNull() | (hours <= 24), 1.0).otherwise(F.exp(-(hours - 24) / 72))


def context_score(relevance: Column, recency: Column, weights: tuple[float, float] = (0.7, 0.3)) -> Column:
    if abs(sum(weights) - 1) > 1e-6 or min(weights) < 0:
        raise ValueError("weights must not be negative and have to sum to 1")
    return relevance * weights[0] + recency * weights[1]


def note_score(score: Column, kind: Column) -> Column:
    """A note's score with its type's boost, held between 0 and 1."""
    boosts = F.create_map(*[x for k, v in NOTE_BOOST.items() for x in (F.lit(k), F.lit(v))])
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score + F.coalesce(F.element_at(boosts, kind), F.lit(0.0))))


def distance_score(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - distance)


def _band(value: Column, steps: Sequence[tuple[float, float]]) -> Column:
    out = None
    for least, score in steps:
        out = F.when(value >= least, score) if out is None else out.when(value >= least, score)
    return out.otherwise(0.0)


def adaptive_importance(question: Column, answer: Column, depth: Column, words: Sequence[str]) -> Column:
    """0.5 to 1 by lengths, technical words and depth of a dialogue."""
    both = F.lower(F.concat(question, F.lit(" "), answer))
    technical = sum((F.contains(both, F.lit(w.lower())).cast("int") for w in words), F.lit(0))
    raw = (
        _band(F.length(question), [(30, 0.2), (10, 0.1)]) * 0.25
        + _band(F.length(answer), [(200, 0.2), (50, 0.1)]) * 0.25
        + _band(technical, [(5, 0.3), (3, 0.2), (1, 0.1)]) * 0.30
        + _band(depth, [(3, 0.2), (1, 0.1)]) * 0.20
    )
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.5), F.lit(0.5) + F.least(raw * 2, F.lit(0.5)))), 2)


def membership(value: Column, low: float, high: float, margin: float) -> Column:
    """1 inside a range, falling to 0 over a margin outside."""
    below = F.greatest(F.lit(0.0), F.lit(1.0) - (F.lit(float(low)) - value) / margin)
    above = F.greatest(F.lit(0.0), F.lit(1.0) - (value - F.lit(float(high))) / margin)
    return F.when((value >= low) & (value <= high), 1.0).when(value < low, below).otherwise(above)
