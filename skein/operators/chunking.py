"""Chunking of documents: blocks by heading, chunks by characters or by tokens with overlap.

Where a chunk ends depends on where the one before it ended, so packing runs as a table function, one document at a time in Arrow
batches. Within a document, running sums of sizes are searched for the end of each chunk; blocks and sentence counts are plain columns.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate, groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.batches import expand_texts
from skein.operators.context import count_tokens, token_starts

_SENTENCE = re.compile(r"(?<=[。！？；.!?;])\s*")
TAIL = 50


def split_sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s.strip()]


def _running(sizes: Sequence[int]) -> list[int]:
    return [0, *accumulate(sizes)]


def _fill(units: Sequence[str], size: int, stride: int, glue: str = "", tail: int = 0) -> Iterator[str]:
    """Units packed into strings of at most `size` characters; a unit is added while one character would still be free after it.

    Each string but the first begins with the last `tail` characters of the packed one before it. An opening that is too long leaves windows of `size`
    characters every `stride`, and its rest is what the next units are added to.
    """
    ends = _running([len(u) + len(glue) for u in units])
    at, before = 0, ""
    while at < len(units):
        opening = glue.join([before[-tail:], units[at]]).strip() if tail and before else units[at]
        windows = max(0, -(-(len(opening) - size) // stride))
        yield from (opening[k * stride : k * stride + size] for k in range(windows))
        rest = opening[windows * stride :]
        fits = ends[at + 1] + size - 1 - len(rest) + len(glue)
        stop = max(at + 1, bisect_right(ends, fits) - 1)
        before = glue.join([rest, *units[at + 1 : stop]])
        before = before.strip() if glue and stop > at + 1 else before
        yield before
        at = stop


def chunk_characters(text: str, size: int = 500, overlap: int = 50) -> list[str]:
    """Lines packed into chunks of at most `size` characters.

    A line that is too long is packed by sentences first, and cut where a sentence is too long. Each chunk after the first starts with the end of the one
    before it (up to TAIL characters); what is left of a forced cut is kept, with or without overlap.
    """
    size = max(50, size)
    stride = size - max(0, min(overlap, size // 2))
    units: list[str] = []
    for line in filter(None, map(str.strip, text.split("\n"))):
        sentences = split_sentences(line) if len(line) > size else []
        units += _fill(sentences, size, size) if len(sentences) > 1 else [line]
    return [c for c in _fill(units, size, stride, "\n", TAIL) if c.strip()]


def cut_by_tokens(text: str, limit: int) -> list[str]:
    """The text in pieces of at most `limit` tokens each, as long as each can be; a piece has one character at least."""
    starts = token_starts(text)
    bounds = [0]
    while bounds[-1] < len(text):
        at = bounds[-1]
        # What is left of a word that was cut counts as a word of its own.
        inside = at > 0 and not text[at - 1].isspace() and not text[at].isspace()
        beyond = bisect_left(starts, at) + limit - inside
        bounds.append(max(at + 1, starts[beyond] if beyond < len(starts) else len(text)))
    return [text[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def _windows(sizes: Sequence[int], limit: int, overlap: int | None = None) -> Iterator[tuple[int, int]]:
    """Index ranges of neighbours whose sizes add up to `limit` at most; one that is larger is alone.

    With an overlap, a range starts with the last members of the one before it: one at least, more while they fit the overlap, fewer where the next
    member would not fit beside them.
    """
    sums, first, end = _running(sizes), 0, 0
    while end < len(sizes):
        end = max(end + 1, bisect_right(sums, sums[first] + limit) - 1)
        yield first, end
        if end < len(sizes):
            shared = end if overlap is None else max(first, min(end - 1, bisect_left(sums, sums[end] - overlap)))
            first = min(end, max(shared, bisect_left(sums, sums[end + 1] - limit)))


def _paragraph_pieces(paragraph: str, limit: int) -> Iterator[str]:
    """A paragraph's pieces: itself where it fits, else runs of sentences that fit together; a sentence that is too long is cut by tokens."""
    if count_tokens(paragraph) <= limit:
        yield paragraph
        return
    sentences = split_sentences(paragraph)
    if not sentences:
        yield paragraph
    for long, group in groupby(sentences, lambda s: count_tokens(s) > limit):
        run = list(group)
        if long:
            yield from (x for s in run for x in cut_by_tokens(s, limit))
        else:
            yield from ("".join(run[a:b]) for a, b in _windows([count_tokens(s) for s in run], limit))


def chunk_tokens(paragraphs: list[str], limit: int, overlap: int) -> list[tuple[str, int, int]]:
    """(text, tokens, paragraphs) of chunks of at most `limit` tokens, a blank line between paragraphs.

    Oversized paragraphs are cut at sentences, oversized sentences by tokens. A chunk starts with the last paragraphs of the one before
    it: one at least, more while they fit `overlap`, fewer if the next paragraph would not fit.
    """
    if limit <= 0:
        raise ValueError("a chunk needs at least one token")
    pieces = [x for p in paragraphs for x in _paragraph_pieces(p, limit)]
    sizes = [count_tokens(p) for p in pieces]
    return [("\n\n".join(pieces[a:b]), sum(sizes[a:b]), b - a) for a, b in _windows(sizes, limit, max(0, overlap))]


def character_chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 500, overlap: int = 50) -> DataFrame:
    """(id, chunk_index, content, tokens)"""
    return expand_texts(docs, id_col, text_col, "chunk_index int, content string, tokens int", lambda t: ((k, c, count_tokens(c)) for k, c in enumerate(chunk_characters(t, size, overlap))))


def token_chunks(docs: DataFrame, id_col: str, text_col: str, limit: int = 200, overlap: int = 30) -> DataFrame:
    """(id, chunk_index, content, tokens, paragraphs); paragraphs are the text's lines that aren't blank."""

    def chunks(text: str) -> Iterator[tuple]:
        return ((k, *c) for k, c in enumerate(chunk_tokens([p for p in text.split("\n") if p.strip()], limit, overlap)))

    return expand_texts(docs, id_col, text_col, "chunk_index int, content string, tokens int, paragraphs int", chunks)


def markdown_blocks(docs: DataFrame, id_col: str, text_col: str, default: str = "全文") -> DataFrame:
    """(id, block, section, content): a heading line starts a block, names it and stays its first line; blank blocks are dropped.

    Lines never leave their document's partition group: running counts over (id) replace a scan in order.
    """
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    heading = F.col("line").rlike(r"^\s*#{1,6}\s+\S")
    w = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("block", F.sum(heading.cast("int")).over(w)).withColumn("section", F.last(F.when(heading, F.trim(F.regexp_replace("line", r"^\s*#{1,6}\s+", ""))), ignorenulls=True).over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    blocks = marked.groupBy("id", "block").agg(F.coalesce(F.min("section"), F.lit(default)).alias("section"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("content"))
    return blocks.where("content <> ''")


def image_references(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, alt, path): Markdown images, the first of each path in a document."""
    pattern = F.lit(r"!\[([^\]]*)\]\(([^)\s]+)[^)]*\)")
    found = docs.select(F.col(id_col).alias("id"), F.posexplode(F.arrays_zip(F.regexp_extract_all(text_col, pattern, F.lit(1)).alias("alt"), F.regexp_extract_all(text_col, pattern, F.lit(2)).alias("path"))).alias("pos", "x"))
    order = Window.partitionBy("id", "x.path").orderBy("pos")
    return found.withColumn("r_", F.row_number().over(order)).where("r_ = 1").select("id", F.col("x.alt").alias("alt"), F.col("x.path").alias("path"))


def visible_lines(html: Column) -> Column:
    """Text of an HTML page without scripts, styles and tags, white space squeezed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]+>", " "), r"\s+", " "))
