"""What the engine takes from outside: encoders, generators, rerankers, web search. All are injected; the defaults work offline.

An encoder maps texts to vectors, a generator a prompt to text. Without an encoder retrieval is sparse only, without a generator
a query stands for its variants and for its hypothetical answer.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text as T

Encoder = Callable[[list[str]], list[list[float] | None]]
Generator = Callable[[str], str]


def hashing_encoder(size: int = 64) -> Encoder:
    """An offline encoder: signed counts of hashed words, scaled to length one. A text without words has no vector."""

    def encode(texts: list[str]) -> list[list[float] | None]:
        out: list[list[float] | None] = []
        for text in texts:
            v = [0.0] * size
            for word in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                v[h % size] += 1.0 if h >> 63 else -1.0
            length = sum(x * x for x in v) ** 0.5
            out.append([x / length for x in v] if length else None)
        return out

    return encode


def embed(rows: DataFrame, encoder: Encoder | None, text_col: str = "text", out_col: str = "embedding", batch: int = 256) -> DataFrame:
    """rows with a vector each. Equal texts of an Arrow batch are encoded once, in calls of `batch` texts; without an encoder vectors are null."""
    if encoder is None:
        return rows.withColumn(out_col, F.lit(None).cast("array<double>"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame[text_col].fillna("")
            distinct = list(dict.fromkeys(texts))
            known: dict[str, list[float] | None] = {}
            for at in range(0, len(distinct), batch):
                part = distinct[at : at + batch]
                known |= dict(zip(part, encoder(part), strict=True))
            yield frame.assign(**{out_col: [known[t] for t in texts]})

    rows = rows.drop(out_col)
    return rows.mapInPandas(run, rows.select("*", F.lit(None).cast("array<double>").alias(out_col)).schema)


def query_variants(generate: Generator | None, query: str, n: int = 3) -> list[str]:
    """The query and up to n (1 to 10) rephrasings: one a line, list marks taken off, repeated ones dropped."""
    n = max(1, min(10, n))
    lines = generate(f"Write {n} different search queries for: {query}\nOne a line.").splitlines() if generate else []
    clean = (re.sub(r"^[-*•]\s*", "", re.sub(r"^[\d一二三四五六七八九十]+[.、)）:：]\s*", "", x.strip())).strip() for x in lines)
    return list(dict.fromkeys([query, *[x for x in clean if x][:n]]))


def hypothetical_answer(generate: Generator | None, query: str) -> str:
    return (generate(f"Write a short passage that answers: {query}").strip() if generate else "") or query


def ranking_of(answer: str, count: int) -> list[tuple[int, float]]:
    """(index, score) of a model's JSON list [{"index": i, "score": s}]: scores held to [0, 1], each index once, others ignored."""
    found = re.search(r"\[.*\]", answer, re.S)
    try:
        rows = json.loads(found[0]) if found else []
    except ValueError:
        return []
    out: dict[int, float] = {}
    for row in rows if isinstance(rows, list) else []:
        if isinstance(row, dict) and isinstance(row.get("index"), int) and 0 <= row["index"] < count and isinstance(row.get("score"), (int, float)):
            out.setdefault(row["index"], max(0.0, min(1.0, float(row["score"]))))
    return sorted(out.items(), key=lambda x: -x[1])


def json_rankings(answer: Column) -> Column:
    """The same for a column of answers: array<struct<index,score>>, null where no list can be read."""
    rows = F.from_json(F.regexp_extract(answer, r"(?s)(\[.*\])", 1), "array<struct<index:int,score:double>>")
    return F.transform(rows, lambda r: F.struct(r["index"].alias("index"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), r["score"])).alias("score")))


@dataclass(frozen=True)
class Found:
    title: str
    url: str
    snippet: str
    source: str


def web_search(providers: Sequence[tuple[str, Callable[[str], list[dict]]]], query: str, limit: int = 5) -> list[Found]:
    """Results of the first provider that gives any, in one shape; a provider that fails is passed over."""
    for name, search in providers:
        try:
            rows = search(query)
        except Exception:  # any failure of a provider means the next one's turn
            continue
        if rows:
            return [Found(str(r.get("title", "")), str(r.get("url") or r.get("link") or ""), str(r.get("snippet") or r.get("content") or ""), name) for r in rows[:limit]]
    return []


def merge_metadata(first: Column, then: Column) -> Column:
    """Of two map<string,string> the entries of both; those of `first` count unless they are null."""
    return F.map_zip_with(first, then, lambda k, a, b: F.coalesce(a, b))


def batches(rows: DataFrame, size: int = 10) -> DataFrame:
    """rows with the number of the batch that they are in, at most `size` to a batch. Rows stay where they are, so each partition has batches of its own."""
    n = F.monotonically_increasing_id()  # the partition in the upper bits, the place in it in the lower 33
    place = n.bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("batch", F.shiftleft(F.shiftright(n, 33), 33) + F.floor(place / size).cast("long"))


def terminal_status(code: Column, output: Column) -> Column:
    """ok, failed, refused or timeout from a command's exit code and output."""
    low = F.lower(F.coalesce(output, F.lit("")))
    return F.when(F.contains(low, F.lit("timed out")), "timeout").when(F.contains(low, F.lit("not allowed")) | F.contains(low, F.lit("permission denied")), "refused").when(code == 0, "ok").otherwise("failed")


def now_parts(ts: Column) -> Column:
    return F.struct(F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("time"), F.date_format(ts, "EEEE").alias("weekday"))


def semantic_text(content: Column, path: Column, labels: Column, modality: Column) -> Column:
    """What of a file is searched: its content, the words of its name, its labels, its modality."""
    name = F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/\\]*)$", 1)
    words = F.when(name != "", F.array_join(T.file_keywords(name), " "))
    return F.concat_ws(" ", F.when(content != "", content), F.when(words != "", words), F.when(F.size(labels) > 0, F.array_join(labels, " ")), F.coalesce(modality, F.lit("text")))
