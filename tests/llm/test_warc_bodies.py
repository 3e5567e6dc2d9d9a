from __future__ import annotations

import gzip
import random
import zlib

import pytest
import zstandard

from skein.llm import warc

PAGE = "<html lang=en><head><title>A title</title></head><body><p>Some café text</p><a href='/x'>link</a></body></html>"
TEXT = "Some café text\nlink"


def chunked(body: bytes, size: int = 7) -> bytes:
    parts = [body[i : i + size] for i in range(0, len(body), size)]
    return b"".join(b"%x;note=1\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def bare(body: bytes) -> bytes:
    c = zlib.compressobj(wbits=-15)
    return c.compress(body) + c.flush()


def read(body: bytes, kind: str | None = "text/html; charset=utf-8", **heads: str):
    pairs = [(k.replace("_", "-"), v) for k, v in heads.items()] + ([("Content-Type", kind)] if kind is not None else [])
    _, text, title, lang, links, wrong = warc.extracted(pairs, body)
    return text, title, lang, links, wrong


@pytest.mark.parametrize(("code", "name"), [(gzip.compress, "gzip"), (gzip.compress, "x-gzip"), (zlib.compress, "deflate"), (bare, "deflate"), (zstandard.compress, "zstd"), (bytes, "identity"), (bytes, "")])
@pytest.mark.parametrize("cut", [False, True])
def test_codings(code, name, cut):
    body = code(PAGE.encode())
    heads = {"Content_Encoding": name} | ({"Transfer_Encoding": "chunked"} if cut else {})
    assert read(chunked(body) if cut else body, **heads) == (TEXT, "A title", "en", ["/x"], "")


def test_two_codings_and_members():
    twice = gzip.compress(zlib.compress(PAGE.encode()))
    assert read(twice, Content_Encoding="deflate, gzip")[0] == TEXT
    members = gzip.compress(PAGE.encode()[:40]) + gzip.compress(PAGE.encode()[40:]) + b"\0" * 9
    assert read(members, Content_Encoding="gzip")[0] == TEXT


def test_broken_and_oversized(monkeypatch):
    rng = random.Random(1)
    long = "<p>" + " ".join(str(rng.random()) for _ in range(5_000))
    whole = gzip.compress(long.encode())
    text, *_, wrong = read(whole[: len(whole) // 2], Content_Encoding="gzip")
    assert wrong == "broken" and len(text) > 1_000 and long[3:].startswith(text)
    assert read(b"no gzip at all", Content_Encoding="gzip") == ("", "", "", [], "broken")
    assert read(b"", Content_Encoding="gzip")[::4] == ("", "broken")
    assert read(PAGE.encode(), Content_Encoding="br") == ("", "", "", [], "unknown-coding")
    assert read(b"zz\r\nplain", Transfer_Encoding="chunked")[::4] == ("zz\nplain", "broken")
    assert read(b"5\r\nabcde\r\nff\r\nrest", Transfer_Encoding="chunked")[::4] == ("abcderest", "broken")
    monkeypatch.setattr(warc.entity, "__defaults__", (1_000,))
    for code, name in ((gzip.compress, "gzip"), (zlib.compress, "deflate"), (zstandard.compress, "zstd")):
        text, *_, wrong = read(code(b"<p>" + b"a" * 5_000_000), Content_Encoding=name)
        assert (len(text), wrong) == (997, "truncated")


def test_charsets_and_types():
    latin = PAGE.encode("latin-1")
    meta = latin.replace(b"<head>", b"<head><meta charset='iso-8859-1'>")
    assert read(latin, "text/html; charset=iso-8859-1")[0] == TEXT
    assert read(meta, "text/html")[0] == TEXT and read(meta, None)[0] == TEXT
    assert read(latin.replace(b"<head>", b'<head><meta http-equiv="Content-Type" content="text/html; charset=latin1">'), "text/html")[0] == TEXT
    assert read(b"\xff\xfe" + PAGE.encode("utf-16-le"), "text/html")[0] == TEXT and read(b"\xef\xbb\xbf" + PAGE.encode(), "text/html; charset=latin-1")[0] == TEXT
    assert read(latin, "text/html; charset=nothing")[0] == TEXT.replace("é", "�")
    assert read(b"\x89PNG\r\n<p>x", "image/png") == ("", "", "", [], "")
    assert read(b"a <b> c\n", "text/plain")[0] == "a <b> c" and read(b'{"a": "<p>"}', "application/json")[0] == '{"a": "<p>"}'


def record(kind: str, n: int, block: bytes) -> bytes:
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{n}>\r\nWARC-Target-URI: http://x/{n}\r\nwarc-date: 2024-01-01T00:00:00Z\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def test_records_of_files(spark, tmp_path):
    blocks = [b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>one", b"HTTP/1.1 200 OK\r\n\r\n\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc", b""]
    records = [record("warcinfo", 0, b"software: x\r\n"), record("response", 1, blocks[0]), record("request", 2, b"GET /"), record("response", 3, blocks[1]), record("response", 4, blocks[2])]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "c.warc").write_bytes(b"WARC/1.1\r\nbroken head\r\n\r\n" + records[1] + records[3][:-40])
    (tmp_path / "d.warc.gz").write_bytes(gzip.compress(records[1]) + gzip.compress(records[3])[:-30])
    (tmp_path / "e.warc").write_bytes(b"")
    got = {}
    for name in "abcde":
        rows = warc.responses_in(spark.read.format("binaryFile").load(f"{tmp_path}/{name}.warc*")).collect()
        got[name] = [(r.record_id, r.target_uri, bytes(r.content)) for r in rows]
    full = [(f"<urn:uuid:{n}>", f"http://x/{n}", b) for n, b in zip((1, 3, 4), blocks, strict=True)]
    assert got == {"a": full, "b": full, "c": full[:1], "d": full[:1], "e": []}


def test_round_trip_of_written_records(spark, sf, tmp_path):
    records = warc.derivatives(warc.responses_of(spark.read.parquet(f"{sf}/pages.parquet").limit(20)))
    rows = records.collect()
    data = b"".join(bytes(r.record) for r in warc.to_warc(records).collect())
    for parts in ([data], [data[i : i + 13] for i in range(0, len(data), 13)]):
        back = list(warc.split_records(iter(parts)))
        assert [(h["warc-type"], h["warc-record-id"], h["warc-refers-to"], h["content-length"], b) for h, b in back] == [(r.record_type, r.record_id, r.refers_to, str(r.content_length), r.block.encode()) for r in rows]
