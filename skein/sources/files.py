"""Files as documents and blocks: one scan of a folder, a parser for each extension, in Arrow batches.

Every parser needs the standard library only; a converter or a PDF reader can be passed in. A file that can't be read gives no blocks.
"""

from __future__ import annotations

import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from io import BytesIO
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.lexicons import DOC_TYPE_BY_EXTENSION, MODALITY_BY_EXTENSION
from skein.functions.text import by_extension

ENCODINGS = ("utf-8", "utf-8-sig", "gbk", "gb18030", "latin-1")
MEDIA = {e for e, kind in DOC_TYPE_BY_EXTENSION.items() if kind in ("image", "audio", "video")}
Block = tuple[str, str]


def decode(raw: bytes) -> str:
    """The text of a file by the first encoding that reads it."""
    for name in ENCODINGS:
        try:
            return raw.decode(name).lstrip("﻿")
        except UnicodeDecodeError:
            continue
    return ""


def headed_blocks(text: str, default: str = "全文") -> list[Block]:
    """(section, content): a heading line starts a block and stays its first line."""
    blocks: list[tuple[str, list[str]]] = [(default, [])]
    for line in text.split("\n"):
        mark = re.match(r"^\s*#{1,6}\s+(\S.*)$", line)
        if mark:
            blocks.append((mark[1].strip(), []))
        blocks[-1][1].append(line)
    return [(name, body) for name, lines in blocks if (body := "\n".join(lines).strip())]


def _texts(element: ElementTree.Element, tag: str) -> str:
    return "".join(t.text or "" for t in element.iter() if t.tag.rpartition("}")[2] == tag)


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(archive.read(name))


def docx_blocks(raw: bytes) -> list[Block]:
    """A block for each paragraph with text."""
    with zipfile.ZipFile(BytesIO(raw)) as z:
        root = _xml(z, "word/document.xml")
    lines = [_texts(p, "t").strip() for p in root.iter() if p.tag.rpartition("}")[2] == "p"]
    return [("段落", x) for x in lines if x]


def xlsx_blocks(raw: bytes) -> list[Block]:
    """A block for each sheet: rows with cells between bars. A cell is a shared string only if its type says so."""
    with zipfile.ZipFile(BytesIO(raw)) as z:
        names = z.namelist()
        shared = [_texts(s, "t") for s in _xml(z, "xl/sharedStrings.xml") if s.tag.rpartition("}")[2] == "si"] if "xl/sharedStrings.xml" in names else []
        out = []
        for name in sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
            rows = []
            for row in (e for e in _xml(z, name).iter() if e.tag.rpartition("}")[2] == "row"):
                cells = []
                for c in row:
                    value = _texts(c, "v") or _texts(c, "t")
                    cells.append(shared[int(value)] if c.get("t") == "s" and value.isdigit() and int(value) < len(shared) else value)
                if any(x.strip() for x in cells):
                    rows.append(" | ".join(cells))
            out.append((name.rpartition("/")[2].removesuffix(".xml"), "\n".join(rows)))
    return out


def pptx_blocks(raw: bytes) -> list[Block]:
    with zipfile.ZipFile(BytesIO(raw)) as z:
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
        return [(f"slide {k}", "\n".join(x for p in _xml(z, n).iter() if p.tag.rpartition("}")[2] == "p" and (x := _texts(p, "t")).strip())) for k, n in enumerate(slides, 1)]


_SHOWN = re.compile(rb"\((?P<one>(?:\\.|[^\\()])*)\)\s*Tj|\[(?P<many>(?:\\.|[^\]])*)\]\s*TJ", re.S)
_STRING = re.compile(rb"\(((?:\\.|[^\\()])*)\)", re.S)


def pdf_text(raw: bytes) -> str:
    """Text-showing operators of a PDF's plain and deflated streams: a fallback for files with simple fonts."""
    out = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", raw, re.S):
        try:
            data = zlib.decompress(m[1])
        except zlib.error:
            data = m[1]
        for shown in _SHOWN.finditer(data):
            parts = [shown["one"]] if shown["one"] is not None else _STRING.findall(shown["many"])
            out.append(re.sub(rb"\\([()\\])", rb"\1", b"".join(parts)).decode("latin-1"))
    return "\n".join(out)


def media_block(name: str, kind: str, size: int, description: str | None = None) -> list[Block]:
    stem = name.rpartition(".")[0] or name
    words = [w for w in re.split(r"[-_.\s]+", stem) if len(w) >= 2]
    # The sentences that describe a media file.
    parts = [f"这是一个{kind}文件", f"文件名: {name}", *([f"文件名关键词: {' '.join(words)}"] if words else []), *([f"内容描述: {description}"] if description else []), f"文件大小: {size} 字节"]
    return [("文件元数据", "。".join(parts))]


def parse(path: str, raw: bytes, convert: Callable[[str, bytes], str] | None = None, pdf_pages: Callable[[bytes], list[str]] | None = None) -> list[Block]:
    """(section, content) of a file: the converter's Markdown if there is one and it gives any, else the extension's parser. Blank blocks are dropped."""
    name = path.rpartition("/")[2]
    ext = "." + name.rpartition(".")[2].lower() if "." in name else ""
    try:
        if convert and (text := convert(path, raw)).strip():
            blocks = headed_blocks(text)
        elif ext in MEDIA:
            blocks = media_block(name, DOC_TYPE_BY_EXTENSION[ext], len(raw))
        elif ext == ".docx":
            blocks = docx_blocks(raw)
        elif ext == ".xlsx":
            blocks = xlsx_blocks(raw)
        elif ext == ".pptx":
            blocks = pptx_blocks(raw)
        elif ext == ".pdf":
            blocks = [(f"page {k}", t) for k, t in enumerate(pdf_pages(raw), 1)] if pdf_pages else [("全文", pdf_text(raw))]
        else:
            blocks = headed_blocks(decode(raw)) if ext in (".md", ".markdown") else [("全文", decode(raw))]
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError):
        return []
    return [(s, c) for s, c in blocks if c.strip()]


def read_blocks(spark: SparkSession, path: str, pattern: str = "*", convert: Callable[[str, bytes], str] | None = None, pdf_pages: Callable[[bytes], list[str]] | None = None, max_bytes: int = 50 << 20) -> DataFrame:
    """(path, doc_type, modality, size, block, section, content) for the files below a folder; larger files than max_bytes are left out before they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).where(F.col("length") <= max_bytes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, n, k, s, c) for p, n, raw in zip(frame["path"], frame["length"], frame["content"], strict=True) for k, (s, c) in enumerate(parse(p, bytes(raw), convert, pdf_pages))]
            yield pd.DataFrame(rows, columns=["path", "size", "block", "section", "content"])

    blocks = files.select("path", "length", "content").mapInPandas(run, "path string, size long, block int, section string, content string")
    return blocks.select("path", by_extension(F.col("path"), DOC_TYPE_BY_EXTENSION).alias("doc_type"), by_extension(F.col("path"), MODALITY_BY_EXTENSION).alias("modality"), "size", "block", "section", "content")


def read_texts(spark: SparkSession, path: str, pattern: str = "*.{md,txt}") -> DataFrame:
    """(path, text): whole text files below a folder, by Spark's own reader."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return rows.select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def preview(spark: SparkSession, path: str, chars: int = 5000, max_bytes: int = 50 << 20) -> DataFrame:
    """(path, size, preview) of the files of a folder up to a size."""
    return read_blocks(spark, path, max_bytes=max_bytes).where("block = 0").select("path", "size", F.substring("content", 1, chars).alias("preview"))


def frame_numbers(total: int, duration: float, limit: int) -> list[int]:
    """Evenly spaced frames of a video: one a second, at most `limit`, one at least."""
    n = min(limit, max(1, int(duration)))
    return [k * total // n for k in range(n)] if total > 0 else []
