"""Table functions over texts: one row in, several out, in Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Characters of text that a batch of results holds at most, and one row's more.
BATCH_CHARS = 2 << 20


def expand_texts(docs: DataFrame, id_col: str, text_col: str, schema: str, make: Callable[[str], Iterable[tuple]]) -> DataFrame:
    """(id, ...) for each tuple that make gives for a text; schema names the columns after id. A null text is an empty one.

    Results leave in batches of about BATCH_CHARS characters, so neither many rows nor one long text are held as a whole batch of results.
    """
    out = StructType.fromDDL(f"id long, {schema}")
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[]] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for got in batches:
            for key, text in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
                for made in make(text or ""):
                    rows.append((key, *made))
                    held += sum(len(x) for x in made if isinstance(x, str))
                    if held >= BATCH_CHARS:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, out)
