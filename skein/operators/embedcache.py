"""Embeddings kept by content: (model, hash of the text) -> vector, in a durable store, so that a text is encoded once over all runs.

A run looks the distinct texts up by an anti-join, encodes only those that are missing, in calls of bounded size, and commits what it got. A call that
fails leaves its texts without a row: they come out null this time and are tried again by the next run; how many failed is told. Texts that the
encoder has no vector for are stored as such.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import providers
from skein.sources.store import Conflict, Store

_ROW = "hash string, vector array<double>, failed string"


def text_hash(text: str = "text"):
    """SHA-256 of a text; a null text is an empty one."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


class EmbeddingCache:
    """Vectors of one model's encoder. Several sessions may share a store: what one has committed the next finds."""

    def __init__(self, store: Store, model: str, encoder: providers.Encoder, batch: int = 256) -> None:
        self.store, self.model, self.encoder, self.batch = store, model, encoder, batch

    def known(self) -> DataFrame | None:
        """(hash, vector) of this model."""
        rows = self.store.read("embeddings")
        return None if rows is None else rows.where(F.col("model") == self.model).select("hash", "vector")

    def fill(self, rows: DataFrame, text_col: str = "text") -> tuple[int, int]:
        """Encodes the texts that aren't there yet: (how many were stored, how many failed)."""
        wanted = rows.select(text_hash(text_col).alias("hash"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).groupBy("hash").agg(F.any_value("text").alias("text"))
        known = self.known()
        missing = wanted if known is None else wanted.join(known, "hash", "left_anti")
        encoder, size = self.encoder, self.batch

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for at in range(0, len(frame), size):
                    part = frame.iloc[at : at + size]
                    try:
                        vectors, failed = encoder(part["text"].tolist()), None
                        if len(vectors) != len(part):
                            vectors, failed = [None] * len(part), "the encoder gave another number of vectors"
                    except Exception as e:  # whatever an encoder raises, its texts are tried again by the next run
                        vectors, failed = [None] * len(part), f"{type(e).__name__}: {e}"[:500]
                    yield pd.DataFrame({"hash": part["hash"].tolist(), "vector": vectors, "failed": failed}, columns=["hash", "vector", "failed"])

        t = self.store.begin()
        made = t.append("tried", missing.mapInPandas(run, _ROW).withColumn("model", F.lit(self.model)))
        counts = made.agg(F.count(F.when(F.col("failed").isNull(), 1)).alias("ok"), F.count("failed").alias("bad")).first()
        if counts.ok:
            # Only good rows count; of two runs at once that encoded the same text, readers take either row.
            u = self.store.begin()
            u.append("embeddings", made.where("failed is null").select("model", "hash", "vector"))
            u.commit(f"{counts.ok} texts of {self.model}")
            self.store.compact("embeddings")
        t.abort()
        return counts.ok, counts.bad

    def embed(self, rows: DataFrame, text_col: str = "text", out_col: str = "embedding") -> DataFrame:
        """rows with the vector of each text, encoded now if it was missing."""
        self.fill(rows, text_col)
        known = self.known()
        rows = rows.drop(out_col)
        if known is None:
            return rows.withColumn(out_col, F.lit(None).cast("array<double>"))
        one = known.groupBy(F.col("hash").alias("hash_")).agg(F.any_value("vector").alias(out_col))
        return rows.withColumn("own_", text_hash(text_col)).join(one, F.col("own_") == F.col("hash_"), "left").drop("own_", "hash_")

    def forget(self) -> None:
        """Drops this model's vectors: for an encoder that has changed under the same name."""
        while True:
            try:
                with self.store.begin() as t:
                    rows = t.read("embeddings")
                    if rows is not None:
                        t.replace("embeddings", rows.where(F.col("model") != self.model))
                return
            except Conflict:
                continue
