"""An index over JSON metadata: (path, kind, value) postings in ranges, so that filters on metadata become scans of few files and an intersection of ids.

Every value in a document becomes a row: its path (keys joined by "."; array elements keep the array's path), its kind (string, number, boolean, null, object, array) and
its text; numbers have their value too. Rows lie sorted by path, kind and value in files of bounded size, so a filter's bounds prune files and row groups
by Parquet's own statistics. Containment is that of PostgreSQL's @> on jsonb: an object is contained if each of its members is, an array if each of its elements is
contained in some element. The index gives candidates by the leaves of the wanted value; nested ones are confirmed on the document itself.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an index file. Files cover disjoint ranges, so this is what the least selective bounds of one value read too much.
FILE_ROWS = 1_000_000
#: Paths of keys with a separator in them are told apart by this escape.
_ROW = "id long, path string, kind string, value string, number double"


def _step(path: str, key: str) -> str:
    clean = key.replace("\\", "\\\\").replace(".", "\\.")
    return f"{path}.{clean}" if path else clean


def kind_of(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return "string" if isinstance(value, str) else "array" if isinstance(value, list) else "object"


def plain(value: Any) -> str:
    """A leaf's text: numbers that are equal have one."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e15:
        return str(int(value))
    return repr(value) if isinstance(value, (int, float)) else value if isinstance(value, str) else ""


def postings_of(value: Any, path: str = "") -> Iterator[tuple[str, str, str, float | None]]:
    """(path, kind, value, number) of every value in a document, containers included."""
    kind = kind_of(value)
    number = float(value) if kind == "number" and abs(value) < 1e300 else None
    yield path, kind, plain(value), number
    if kind == "object":
        for key, inner in value.items():
            yield from postings_of(inner, _step(path, key))
    elif kind == "array":
        for inner in value:
            yield from postings_of(inner, path)


def contains(whole: Any, part: Any) -> bool:
    """Whether a document contains a value."""
    if isinstance(part, dict):
        return isinstance(whole, dict) and all(k in whole and contains(whole[k], v) for k, v in part.items())
    if isinstance(part, list):
        return isinstance(whole, list) and all(any(contains(x, v) for x in whole) for v in part)
    if isinstance(whole, list):
        return False
    return kind_of(whole) == kind_of(part) and whole == part


def _loaded(text: str | None) -> tuple[bool, Any]:
    try:
        return (False, None) if text is None else (True, json.loads(text))
    except (ValueError, RecursionError):
        return False, None


def _explode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        memo: dict[str, set] = {}  # equal documents of a batch are read once
        rows = []
        for i, text in zip(frame["id"], frame["doc"], strict=True):
            if text is not None and text not in memo:
                known, value = _loaded(text)
                memo[text] = set(postings_of(value)) if known else set()
            rows.extend((i, *p) for p in memo.get(text, ()))
        yield pd.DataFrame(rows, columns=["id", "path", "kind", "value", "number"])


class MetadataIndex:
    """The stored index of a table of documents (id, JSON text). Ids are unique; null, broken and repeated texts are allowed, the first two have no rows."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    @classmethod
    def build(cls, rows: DataFrame, id_col: str, json_col: str, folder: str, file_rows: int = FILE_ROWS) -> MetadataIndex:
        docs = rows.select(F.col(id_col).cast("long").alias("id"), F.col(json_col).alias("doc")).where("id is not null and doc is not null")
        found = docs.mapInPandas(_explode, _ROW)
        found.repartitionByRange("path", "kind", "number", "value", "id").sortWithinPartitions("path", "kind", "number", "value", "id").write.option("maxRecordsPerFile", file_rows).parquet(f"{folder}/values")
        docs.write.parquet(f"{folder}/docs")
        return cls(rows.sparkSession, folder)

    @property
    def values(self) -> DataFrame:
        return self.spark.read.schema(_ROW).parquet(f"{self.folder}/values")

    @property
    def docs(self) -> DataFrame:
        return self.spark.read.schema("id long, doc string").parquet(f"{self.folder}/docs")

    def _at(self, path: str, kind: str, condition: Column | None = None) -> DataFrame:
        rows = self.values.where((F.col("path") == path) & (F.col("kind") == kind))
        return (rows if condition is None else rows.where(condition)).select("id")

    def has_key(self, *keys: str) -> DataFrame:
        """(id) of documents in which the path of these keys exists, whatever its value: JSON null too."""
        path = ""
        for key in keys:
            path = _step(path, key)
        return self.values.where(F.col("path") == path).select("id").distinct()

    def between(self, keys: tuple[str, ...], low: float | str | None = None, high: float | str | None = None) -> DataFrame:
        """(id) of documents with a value from low to high there. Bounds of numbers find numbers and bounds of text find text: no kind is turned into another."""
        path = ""
        for key in keys:
            path = _step(path, key)
        bounds = [b for b in (low, high) if b is not None]
        if not bounds or len({isinstance(b, str) for b in bounds}) > 1:
            raise ValueError("bounds are numbers or texts, one at least")
        text = isinstance(bounds[0], str)
        column = F.col("value" if text else "number")
        condition = F.lit(True)
        if low is not None:
            condition &= column >= (low if text else float(low))
        if high is not None:
            condition &= column <= (high if text else float(high))
        return self._at(path, "string" if text else "number", condition).distinct()

    def containing(self, part: Any) -> DataFrame:
        """(id) of the documents that contain a value. Its leaves are looked up in one scan; where it is nested or an array, candidates are confirmed on their documents."""
        wanted = sorted(set(postings_of(part)), key=str)
        # An empty container is wanted as one; other containers follow from what is in them.
        inner = {p for p, kind, _, _ in wanted if kind not in ("object", "array")}
        keys = [(p, kind, value) for p, kind, value, _ in wanted if kind not in ("object", "array") or not any(x == p or not p or x.startswith(f"{p}.") for x in inner)]
        condition = F.lit(False)
        for path, kind, value in keys:
            one = (F.col("path") == path) & (F.col("kind") == kind)
            condition |= one if kind in ("object", "array") else one & (F.col("value") == value)
        hits = self.values.where(condition).select("id", "path", "kind", "value").distinct()
        found = hits.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= len(keys)).select("id")
        flat = isinstance(part, Mapping) and all(kind_of(v) not in ("object", "array") for v in part.values())
        text = json.dumps(part)

        def confirm(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            want = json.loads(text)
            for frame in frames:
                yield frame.loc[[contains(_loaded(t)[1], want) for t in frame["doc"]], ["id"]]

        # A leaf below an array lies at the array's path, so flat wishes are confirmed too unless no candidate has an array there.
        if flat:
            arrays = self.values.where(F.col("path").isin(["", *[p for p, _, _ in keys]]) & (F.col("kind") == "array")).select("id").distinct()
            sure = found.join(arrays, "id", "left_anti")
            return sure.unionByName(self.docs.join(found.join(arrays, "id", "left_semi"), "id", "left_semi").mapInPandas(confirm, "id long"))
        return self.docs.join(found, "id", "left_semi").mapInPandas(confirm, "id long")
