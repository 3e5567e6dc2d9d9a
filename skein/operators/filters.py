"""Filters on JSON metadata, tags and role policies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _path(key: str) -> str:
    return "$['" + key.replace("'", "\\'") + "']"


def metadata_condition(metadata: Column, filters: Mapping[str, Any]) -> Column:
    """All filters hold: a list asks for any of its values (in a scalar or an array), a scalar for equality or membership, None for a missing key.

    No filters hold everywhere. A key whose value is JSON null is there, so it isn't missing. Unreadable metadata has no keys.
    """
    out = F.lit(True)
    for key, wanted in filters.items():
        raw = F.get_json_object(metadata, _path(key))
        if wanted is None:
            keys = F.coalesce(F.json_object_keys(metadata), F.array().cast("array<string>"))
            out = out & ~F.array_contains(keys, key)
            continue
        values = [json_text(v) for v in (wanted if isinstance(wanted, (list, tuple)) else [wanted])]
        held = F.from_json(raw, "array<string>")
        member = F.coalesce(F.arrays_overlap(held, F.array(*[F.lit(v) for v in values])), F.lit(False))
        out = out & (F.coalesce(raw.isin(*values), F.lit(False)) | member)
    return out


def json_text(value: Any) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def metadata_filter(rows: DataFrame, column: str, filters: Mapping[str, Any]) -> DataFrame:
    return rows.where(metadata_condition(F.col(column), filters))


def meaningful(filters: Mapping[str, Any] | None) -> bool:
    """Whether filters ask for anything: a value that isn't None or an empty list."""
    return any(v is not None and v != [] for v in (filters or {}).values())


def has_all_tags(rows: DataFrame, column: str, wanted: Sequence[str]) -> DataFrame:
    return rows.where(F.size(F.array_except(F.array(*[F.lit(t) for t in wanted]), F.col(column))) == 0) if wanted else rows


def has_any_tag(rows: DataFrame, column: str, wanted: Sequence[str]) -> DataFrame:
    return rows.where(F.arrays_overlap(F.col(column), F.array(*[F.lit(t) for t in wanted])))


def apply_policy(calls: DataFrame, policies: DataFrame) -> DataFrame:
    """calls (role, tool) with decision and allowed: no policy allows, deny beats allow, * stands for every tool."""
    joined = calls.join(F.broadcast(policies.select(F.col("role").alias("role_"), "allow", "deny")), F.col("role") == F.col("role_"), "left")
    lists = lambda c: F.array_contains(F.coalesce(F.col(c), F.array().cast("array<string>")), F.col("tool")) | F.array_contains(F.coalesce(F.col(c), F.array().cast("array<string>")), F.lit("*"))
    decision = F.when(F.col("role_").isNull(), "no policy").when(lists("deny"), "denied").when(lists("allow"), "allowed").otherwise("not listed")
    return joined.select(*calls.columns, decision.alias("decision"), decision.isin("no policy", "allowed").alias("allowed"))
