from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """A documents table of given texts, numbered from 0 (or of (doc_id, text) pairs)."""

    def make(texts):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], DOCUMENTS)

    return make


@pytest.fixture
def folder(spark, tmp_path):
    """A data folder with the tables that are given."""

    def write(**tables):
        for name, df in tables.items():
            df.coalesce(2).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
