"""WARC derivatives: linked metadata and plain-text conversion records for response records.

A response row has its WARC headers (record_id, target_uri, warc_date, payload_digest) and its HTTP message
(`content`: status line, headers, blank line, payload). For each, a conversion record holds the payload's text and a metadata
record its title, language, out-links and HTTP headers as warc-fields. Both refer to the response, keep its target, date and
payload digest, carry a digest of their own block, and name each other in WARC-Concurrent-To. Record ids are
name-based (from the response's id), so a task that is run again writes the same records.

A stored message is as it was sent: chunks are joined, gzip, deflate and zstd bodies inflated (up to BODY_BYTES; what a broken stream gives until it breaks
counts, and the metadata say so), and text is decoded by its byte order mark, its header, its meta element or as UTF-8. Pages are read as HTML, other text
stays as it is, and other types have an empty text. `responses_in` cuts WARC files into response rows.

Each response is handled on its own: no shuffle, memory bounded by a slice of payloads.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import bounded, column, load, slices

SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space for URLs of RFC 4122
_MARK = re.compile(r"<(?:(!--)|(/?)([a-z!?]\w*))", re.I)
_HIDDEN = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template", "svg")}
_TITLE_END = re.compile(r"</title\s*>", re.I)
_HEAD_END = re.compile(r"</head\s*>", re.I)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([\w-]+)", re.I)
_HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)|'([^']*)|([^\s>]+))", re.I)
_BREAKS = frozenset("p div li ul ol h1 h2 h3 h4 h5 h6 tr table section article header footer nav main aside blockquote pre br hr td th title dd dt".split())
_BLANKS = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")
_ZEROS = re.compile(r"&#0+(?=\d)")
_HUGE = re.compile(r"&#\d{8,};?")
#: Bytes that a coded body may have when it is inflated; more are left out.
BODY_BYTES = 64 << 20
_CHUNK = re.compile(rb"[ \t]*([0-9a-fA-F]{1,15})[ \t]*(?:;[^\r\n]*)?\r?\n")
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
_META = re.compile(rb"<meta\s[^>]*?charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)
_BOMS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))


def digest(block: bytes) -> str:
    """A labelled digest as WARC writers put it: SHA-1 in base 32."""
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*names: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, ' '.join(names))}>"


def unescaped(text: str) -> str:
    """Text with its character references resolved; a number of any length is one."""
    return html.unescape(_HUGE.sub("\ufffd", _ZEROS.sub("&#", text)) if "&#" in text else text)


def _clean(value: str) -> str:
    return " ".join(unescaped(value).split())


def read_page(page: str) -> tuple[str, str, str, list[str]]:
    """Visible text, title, language and distinct out-links (in order) of a page, in one pass from left to right.

    Hidden elements and comments go (to the page's end, if they never close), so does a closed head; block elements end
    lines, other tags vanish, references are resolved and white space is squeezed. A tag ends at the next ">"; where none follows, "<" is text. No place
    is searched for twice, so time is linear for any input.
    """
    out: list[str] = []
    links: dict[str, None] = {}
    title, lang = None, ""
    at, head, tags_end = 0, -1, True
    while m := _MARK.search(page, at):
        start, name = m.start(), (m[3] or "").lower()
        out.append(page[at:start])
        if m[1]:
            end = page.find("-->", m.end())
            out.append(" ")
            at = len(page) if end < 0 else end + 3
            continue
        if name in _HIDDEN and not m[2]:
            end = _HIDDEN[name].search(page, m.end())
            out.append(" ")
            at = end.end() if end else len(page)
            continue
        stop = page.find(">", m.end()) if tags_end else -1
        if stop < 0:
            tags_end = False
            out.append(m[0])
            at = m.end()
            continue
        at = stop + 1
        if name in _BREAKS:
            out.append("\n")
        if name == "head":
            if not m[2] and head < 0:
                head = len(out)
            elif m[2] and head >= 0 and _HEAD_END.fullmatch(page, start, at):
                del out[head:]
                head = -1
        elif name == "title" and not m[2] and title is None:
            end = _TITLE_END.search(page, at)
            title = _clean(page[at : end.start()]) if end else ""
        elif name == "a" and not m[2]:
            found = _HREF.search(page, m.end(), stop)
            link = _clean(found[1] or found[2] or found[3] or "") if found else ""
            if link:
                links[link] = None
        elif name == "html" and not m[2] and not lang:
            found = _LANG.search(page, m.end(), stop)
            lang = found[1].lower() if found else ""
    out.append(page[at:])
    text = _LINES.sub("\n", _BLANKS.sub(" ", unescaped("".join(out)))).strip()
    return text, title or "", lang, list(links)


def visible(page: str) -> str:
    return read_page(page)[0]


def facts(page: str) -> tuple[str, str, list[str]]:
    """Title, language and distinct out-links in order."""
    return read_page(page)[1:]


def split_http(content: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP message; one without a blank line is all payload."""
    head, found, payload = content.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"HTTP/"):
        return "", [], content
    status, *lines = head.decode("latin-1").split("\r\n")
    pairs = [("-".join(k.split()), " ".join(v.split())) for k, _, v in (x.partition(":") for x in lines) if k.strip()]
    return " ".join(status.split()), pairs, payload


def unchunked(body: bytes) -> tuple[bytes, bool]:
    """The body of a chunked message and whether all of it was there. A body whose first line is no chunk size is as it stands."""
    out, at = [], 0
    while m := _CHUNK.match(body, at):
        size = int(m[1], 16)
        if not size:
            return b"".join(out), True
        part = body[m.end() : m.end() + size]
        out.append(part)
        at = m.end() + size
        if len(part) < size:
            return b"".join(out), False
        at += 2 if body[at : at + 2] == b"\r\n" else body[at : at + 1] == b"\n"
    return (b"".join(out), False) if out else (body, False)


def _inflated(body: bytes, kind: str, limit: int) -> tuple[bytes, str]:
    """The inflated body, limit bytes at most, and what is wrong with it."""
    out, wrong, room = [], "", limit
    if kind == "zstd":
        try:
            with zstandard.ZstdDecompressor().stream_reader(body, read_across_frames=True) as reader:
                while room > 0 and (part := reader.read(min(room, 1 << 20))):
                    out.append(part)
                    room -= len(part)
                wrong = "truncated" if not room and reader.read(1) else ""
        except zstandard.ZstdError:
            wrong = "broken"
        return b"".join(out), wrong
    windows = [31] if kind == "gzip" else [15, -15]  # deflate is zlib's format by the standard, and the bare one by habit
    for bits in windows:
        out, wrong, room, rest = [], "", limit, body
        try:
            while rest:
                stream = zlib.decompressobj(bits)
                while room > 0 and not stream.eof and (part := stream.decompress(rest, room)):
                    out.append(part)
                    room -= len(part)
                    rest = stream.unconsumed_tail
                if stream.eof:
                    rest = stream.unused_data if bits == 31 else b""
                    if rest[:2] != b"\x1f\x8b":
                        break  # what follows the last member is padding
                    continue
                wrong = "truncated" if room <= 0 else "broken"
                break
            if not body:
                wrong = "broken"
        except zlib.error:
            wrong = "broken"
        if out or not wrong:
            break
    return b"".join(out), wrong


def entity(headers: list[tuple[str, str]], body: bytes, limit: int = BODY_BYTES) -> tuple[bytes, bytes, str]:
    """(body without chunks, body without its codings, what is wrong with it: empty, broken, truncated or unknown-coding)."""
    named = lambda name: [x.strip().lower() for k, v in headers if k.lower() == name for x in v.split(",") if x.strip()]
    wrong = ""
    if "chunked" in named("transfer-encoding"):
        body, whole = unchunked(body)
        wrong = "" if whole else "broken"
    plain = body
    for coding in reversed(named("content-encoding")):
        if coding == "identity":
            continue
        kind = coding.removeprefix("x-")
        if kind not in ("gzip", "deflate", "zstd"):
            return body, b"", "unknown-coding"
        plain, fault = _inflated(plain, kind, limit)
        wrong = wrong or fault
    return body, plain, wrong


def decoded(body: bytes, kind: str) -> str:
    """Text of a body by its byte order mark, the charset of its Content-Type, that of a meta element among its first 4,096 bytes, or as UTF-8."""
    for mark, name in _BOMS:
        if body.startswith(mark):
            return body[len(mark) :].decode(name, "replace")
    said = _CHARSET.search(kind)
    found = None if said else _META.search(body[:4096])
    name = said[1] if said else found[1].decode("ascii", "replace") if found else "utf-8"
    if found and name.lower().replace("_", "-").startswith(("utf-16", "utf-32")):
        name = "utf-8"  # a page whose meta element could be read is in neither
    try:
        return body.decode(name, "replace")
    except (LookupError, ValueError):  # an unknown encoding, or one that is none of text
        return body.decode("utf-8", "replace")


def reading(kind: str) -> str:
    """How a body of this Content-Type is read: html, text or none. One without a type is a page."""
    mime = kind.partition(";")[0].strip().lower()
    if mime in ("", "text/html", "application/xhtml+xml"):
        return "html"
    if mime.startswith("text/") or mime.endswith(("+json", "+xml")) or mime in ("application/json", "application/xml", "application/javascript", "application/x-ndjson"):
        return "text"
    return "none"


def extracted(headers: list[tuple[str, str]], body: bytes) -> tuple[bytes, str, str, str, list[str], str]:
    """(body without chunks, text, title, language, out-links, what is wrong) of a response's payload."""
    kind = next((v for k, v in headers if k.lower() == "content-type"), "")
    sent, plain, wrong = entity(headers, body)
    how = reading(kind)
    if how == "html":
        return (sent, *read_page(decoded(plain, kind)), wrong)
    return sent, decoded(plain, kind).strip() if how == "text" else "", "", "", [], wrong


FIELDS = "response_id string, record_type string, record_id string, refers_to string, concurrent_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, source_payload_digest string, block string"


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in FIELDS.split(", ")]
    kinds = [pa.int64() if f.endswith(" long") else pa.string() for f in FIELDS.split(", ")]
    for batch in slices(batches, "content", 2 << 20):
        rows = []
        for rid, uri, date, source, content in zip(*(column(batch, n).to_pylist() for n in ("record_id", "target_uri", "warc_date", "payload_digest", "content")), strict=True):
            status, headers, payload = split_http(content or b"")
            payload, text, title, lang, links, wrong = extracted(headers, payload)
            text_id, meta_id = record_id(rid or "", "conversion"), record_id(rid or "", "metadata")
            source = source or digest(payload)
            fields = [("http-status", status), *((f"http-{k.lower()}", v) for k, v in headers), ("body", wrong), ("title", title), ("language", lang), *(("outlink", x) for x in links)]
            meta = "".join(f"{k}: {v}\r\n" for k, v in fields if v)
            for what, own, other, mime, block in (("metadata", meta_id, text_id, "application/warc-fields", meta), ("conversion", text_id, meta_id, "text/plain; charset=utf-8", text)):
                raw = block.encode("utf-8", "replace")
                rows.append((rid, what, own, rid, other, uri, date, mime, len(raw), digest(raw), source, raw.decode()))
        cols = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def derivatives(responses: DataFrame) -> DataFrame:
    """Two records for each response row (record_id, target_uri, warc_date, payload_digest, content binary).

    A null or empty message gives an empty text and a metadata block without fields; a null payload digest is computed (of the body without chunks); a null
    id is an empty name. A body that is cut short, broken, longer than BODY_BYTES or in an unknown coding has what could be read as its text, and a field `body`
    in its metadata that says so; an image or another type that is no text has an empty text. Repeated rows give repeated records; no rows give none.
    """
    wanted = bounded(responses).select(*(F.col(c).cast("string").alias(c) for c in ("record_id", "target_uri", "warc_date", "payload_digest")), F.col("content").cast("binary").alias("content"))
    return wanted.mapInArrow(_derive, FIELDS)


def to_warc(records: DataFrame) -> DataFrame:
    """(record binary): the records in the bytes of a WARC/1.1 file; a file is any concatenation of them."""
    header = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise(F.lit(""))
    text = F.concat(
        F.lit("WARC/1.1\r\n"), header("WARC-Type", F.col("record_type")), header("WARC-Record-ID", F.col("record_id")), header("WARC-Refers-To", F.col("refers_to")),
        header("WARC-Concurrent-To", F.col("concurrent_to")), header("WARC-Target-URI", F.col("target_uri")), header("WARC-Date", F.col("warc_date")),
        header("WARC-Block-Digest", F.col("block_digest")), header("WARC-Source-Payload-Digest", F.col("source_payload_digest")),
        header("Content-Type", F.col("content_type")), header("Content-Length", F.col("content_length").cast("string")), F.lit("\r\n"), F.col("block"), F.lit("\r\n\r\n"),
    )
    return records.select(text.cast("binary").alias("record"))


RESPONSES = "record_id string, target_uri string, warc_date string, payload_digest string, content binary"


def _members(data: bytes) -> Iterator[bytes]:
    """The bytes of a file, inflated if it is gzip: records are its members, one or several to a member. A broken member ends the file."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    rest = memoryview(data)
    while len(rest) and bytes(rest[:2]) == b"\x1f\x8b":
        stream = zlib.decompressobj(31)
        at = 0
        try:
            while not stream.eof and at < len(rest):
                yield stream.decompress(rest[at : at + (1 << 20)])
                at += 1 << 20
        except zlib.error:
            return
        rest = rest[min(at, len(rest)) - len(stream.unused_data) :] if stream.eof else rest[len(rest) :]


def split_records(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of a stream of bytes. Blocks are told by Content-Length alone, so they may hold anything; a record that is cut short is left out,
    and after a damaged head the next line that begins a record counts."""
    held, more = bytearray(), True
    parts = iter(parts)

    def fill(size: int) -> bool:
        nonlocal more
        while more and len(held) < size:
            part = next(parts, None)
            if part is None:
                more = False
            else:
                held.extend(part)
        return len(held) >= size

    while True:
        begin = held.find(b"WARC/")
        while begin < 0 and more:
            del held[: max(0, len(held) - 4)]
            fill(len(held) + 1)
            begin = held.find(b"WARC/")
        if begin < 0:
            return
        del held[:begin]
        end = held.find(b"\r\n\r\n")
        while end < 0 and fill(len(held) + 1):
            end = held.find(b"\r\n\r\n")
        if end < 0:
            return
        lines = bytes(held[:end]).decode("utf-8", "replace").split("\r\n")[1:]
        heads = {k.strip().lower(): v.strip() for k, found, v in (x.partition(":") for x in lines) if found}
        size = heads.get("content-length", "")
        if not size.isdigit():
            del held[:5]
            continue
        if not fill(end + 4 + int(size)):
            return
        yield heads, bytes(held[end + 4 : end + 4 + int(size)])
        del held[: end + 4 + int(size)]


def _responses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in RESPONSES.split(", ")]
    for batch in batches:
        for i in range(batch.num_rows):
            for heads, block in split_records(_members(column(batch, "content")[i].as_py() or b"")):
                if heads.get("warc-type", "").lower() == "response":
                    row = [heads.get(k) for k in ("warc-record-id", "warc-target-uri", "warc-date", "warc-payload-digest")]
                    yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.string()) for x in row), pa.array([block], pa.binary())], names)


def responses_in(files: DataFrame) -> DataFrame:
    """The response rows of WARC files, plain or gzip, given as Spark's binaryFile source reads them (content). A task holds one file at a time; writers cut
    WARC files at about 1 GB. Other records are passed over, a null or empty file has none."""
    return files.select(F.col("content").cast("binary").alias("content")).mapInArrow(_responses, RESPONSES)


def base32(digits: Column) -> Column:
    """The base 32 form (RFC 4648) of 40 hex digits: four of its digits for five of theirs."""
    groups = [F.lpad(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def responses_of(pages: DataFrame) -> DataFrame:
    """Response records of a table of pages (page_id, url, html): fetched one a second from the start of 2024, in order of page_id."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.length(payload).cast("string"), F.lit("\r\n\r\n"))
    day = F.timestamp_seconds(F.lit(1704067200) + F.coalesce(F.col("page_id"), F.lit(0)))
    name = F.md5(F.concat_ws(" ", F.col("page_id").cast("string"), "url"))
    return pages.select(
        "page_id",
        F.concat(F.lit("<urn:uuid:"), *[x for i, (a, n) in enumerate([(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]) for x in ([F.lit("-")] if i else []) + [F.substring(name, a, n)]], F.lit(">")).alias("record_id"),
        F.col("url").alias("target_uri"), F.date_format(F.to_utc_timestamp(day, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("warc_date"),
        F.concat(F.lit("sha1:"), base32(F.sha1(payload))).alias("payload_digest"), F.concat(head.cast("binary"), payload).alias("content"),
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata and conversion records of every page's response."""
    return derivatives(responses_of(load(spark, sf_dir, "pages")))
