from __future__ import annotations

import base64
import hashlib
import random
import time
import uuid
from collections import Counter
from datetime import UTC, date, datetime
from html.parser import HTMLParser

import duckdb
import helpers
import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import chat as C
from skein.llm import url_filters as U
from skein.llm import warc as W

PAGE = """<!DOCTYPE html><html lang="EN-gb"><head><title>A &amp; B</title><style>p{x:1}</style></head><body><script>var t="</p>";</script><!-- gone <p> -->
<nav><a href="/one">One</a><a href='two?x=1&amp;y=2'>Two</a><a href=/one>again</a></nav><p>Hello&nbsp;<b>wor</b>ld</p><div>1 &lt; 2</div><noscript>no</noscript></body></html>"""


def test_text_and_facts():
    assert W.visible(PAGE) == "OneTwoagain\nHello world\n1 < 2"
    assert W.facts(PAGE) == ("A & B", "en-gb", ["/one", "two?x=1&y=2"])
    assert W.visible("plain < text > here") == "plain < text > here" and W.visible("<script>never closed") == ""


def test_records_are_linked(spark):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\nServer: x\r\n\r\n" + "<p>caf\xe9</p>".encode("latin-1")
    rows = [("<urn:1>", "http://a/", "2024-01-01T00:00:00Z", "sha1:GIVEN", http), ("<urn:2>", "http://b/", None, None, b"no header"), ("<urn:3>", None, None, None, None), (None, None, None, None, b""), ("<urn:1>", "http://a/", "2024-01-01T00:00:00Z", "sha1:GIVEN", http)]
    out = W.derivatives(spark.createDataFrame(rows, "record_id string, target_uri string, warc_date string, payload_digest string, content binary").withColumn("block", F.lit(1))).collect()
    assert len(out) == 10
    first = {r.record_type: r for r in out if r.refers_to == "<urn:1>"}
    text, meta = first["conversion"], first["metadata"]
    assert text.block == "café" and text.concurrent_to == meta.record_id and meta.concurrent_to == text.record_id
    assert text.source_payload_digest == meta.source_payload_digest == "sha1:GIVEN" and text.warc_date == "2024-01-01T00:00:00Z"
    assert "http-server: x\r\n" in meta.block and "http-status: HTTP/1.1 200 OK" in meta.block
    for r in out:
        raw = r.block.encode()
        assert r.content_length == len(raw) and r.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert len({r.record_id for r in out}) == 8


def test_warc_bytes_and_query(spark, sf):
    out = W.op7_warc(spark, sf)
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert out.count() == 2 * pages.count() and out.select("record_id").distinct().count() == 2 * pages.count()
    record = bytes(W.to_warc(out.limit(1)).first().record)
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    assert head.startswith(b"WARC/1.1\r\n") and rest[int(fields["Content-Length"]) :] == b"\r\n\r\n"
    html = {r.page_id: r.html for r in pages.collect()}
    ids = {r.record_id: r.page_id for r in W.responses_of(pages).collect()}
    for r in out.where("record_type = 'conversion'").collect():
        assert r.block == W.visible(html[ids[r.refers_to]])
    assert W.derivatives(W.responses_of(pages.where("false"))).count() == 0


class Reader(HTMLParser):
    """An independent reading of a page, by the standard library's parser."""

    HIDDEN, LINES = {"script", "style", "noscript", "template", "svg", "head"}, {"p", "div", "li", "ul", "ol", "tr", "table", "br", "hr", "td", "th", "title", "nav", "main", "header", "footer", "section", "article", "aside", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "dd", "dt"}

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.text, self.name, self.lang, self.links, self.depth, self.titled = [], [], "", [], Counter(), False
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.depth[tag] += tag in self.HIDDEN or tag == "title"
        self.text += ["\n"] if tag in self.LINES and not self.hidden() else []
        found = dict(attrs)
        if tag == "html" and not self.lang:
            self.lang = (found.get("lang") or "").lower()
        if tag == "a" and " ".join((found.get("href") or "").split()) not in ["", *self.links]:
            self.links.append(" ".join(found["href"].split()))

    def hidden(self):
        return any(self.depth[x] for x in self.HIDDEN)

    def handle_endtag(self, tag):
        self.depth[tag] = max(0, self.depth[tag] - 1)
        self.text += ["\n"] if tag in self.LINES and not self.hidden() else []

    def handle_data(self, data):
        if self.depth["title"]:
            self.name.append(data)
        if not self.hidden():
            self.text.append(data)

    def lines(self):
        return [x for x in (" ".join(line.split()) for line in "".join(self.text).split("\n")) if x]


def test_query_equals_an_independent_reading(spark, sf):
    """Every record of every page, made anew from the page alone."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    label = lambda raw: "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()
    by_id = {}
    for r in pages.values():
        name = hashlib.md5(f"{r.page_id} {r.url}".encode()).hexdigest()
        by_id[f"<urn:uuid:{uuid.UUID(name)}>"] = r
    records = {(r.refers_to, r.record_type): r for r in W.op7_warc(spark, sf).collect()}
    assert set(records) == {(i, k) for i in by_id for k in ("metadata", "conversion")}
    for (rid, kind), r in records.items():
        page = by_id[rid]
        raw = (page.html or "").encode()
        seen = Reader(page.html or "")
        other = "metadata" if kind == "conversion" else "conversion"
        assert r.record_id == f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{rid} {kind}')}>" and r.concurrent_to == records[rid, other].record_id
        assert r.target_uri == page.url and r.source_payload_digest == label(raw) and r.block_digest == label(r.block.encode()) and r.content_length == len(r.block.encode())
        assert r.warc_date == datetime.fromtimestamp(1704067200 + page.page_id, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        if kind == "conversion":
            assert [" ".join(x.split()) for x in r.block.split("\n") if x.strip()] == seen.lines()
        else:
            want = [("http-status", "HTTP/1.1 200 OK"), ("http-content-type", "text/html; charset=utf-8"), ("http-content-length", str(len(raw))), ("title", " ".join("".join(seen.name).split())), ("language", seen.lang), *(("outlink", x) for x in seen.links)]
            assert r.block == "".join(f"{k}: {v}\r\n" for k, v in want if v)


@pytest.mark.parametrize("bit", ["<head ", "<title>", "<p", "<script", "<!--", "<a href=", "</title ", "</head", "< ", "&#", "&#0", "&#9", "<html lang", "<svg></", "<style>x</style", "<a href='", "\n ", "<title></titl"])
def test_hostile_pages_take_little_time(bit):
    for page in (bit * (1_000_000 // len(bit)), "<title>" + bit * 50_000 + ">", "<p>" * 2 + bit + ">" * 100_000, "&#" + "9" * 100_000 + ";&#" + "0" * 9000 + "65;"):
        began = time.process_time()
        W.read_page(page)
        assert time.process_time() - began < 2.5


def test_odd_pages():
    assert W.visible("a<p <p <p") == "a<p <p <p" and W.visible("<head><title>T</title>x") == "T\nx" and W.visible("<head>gone</head >kept") == "kept"
    assert W.facts("<title>never closed") == ("", "", []) and W.facts('<a href="a>b">t</a><a href=\'x') == ("", "", ["a"])
    assert W.visible("&#0000000065;&#99999999999;&#" + "9" * 9000 + ";&amp;") == "A\ufffd\ufffd&"
    assert W.split_http(b"HTTP/1.1 200\nOK\r\nA b: c\rd\r\n\r\nx") == ("HTTP/1.1 200 OK", [("A-b", "c d")], b"x")


def test_odd_encodings(spark):
    rows = [(f"<urn:{i}>", "u", None, None, f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset={c}\r\n\r\n<p>ok</p>".encode()) for i, c in enumerate(["hex", "undefined", "idna", "nonsense", "utf-16", "punycode"])]
    assert W.derivatives(spark.createDataFrame(rows, "record_id string, target_uri string, warc_date string, payload_digest string, content binary")).count() == 12


def test_hosts_and_keys(spark):
    urls = ["http://User@WWW.Ads.example.com.:80/a/b/c?x#y", "https://x.org", "mailto:a", "", None, "http:///p", "//h/p"]
    got = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").select("i", U.host_of(F.col("u")).alias("h"), F.sort_array(U.keys_of(F.col("u"))).alias("k")).orderBy("i").collect()
    assert [r.h for r in got] == ["www.ads.example.com", "x.org", "", "", None, "", ""]
    assert got[0].k == ["ads.example.com", "com", "example.com", "www.ads.example.com", "www.ads.example.com/a", "www.ads.example.com/a/b", "www.ads.example.com/a/b/c"]
    few = spark.createDataFrame([(urls[0],)], "u string").select(F.sort_array(U.keys_of(F.col("u"), 1, 2)).alias("k"), U.keys_of(F.col("u"), 0, 0).alias("none")).first()
    assert few.k == ["com", "example.com", "www.ads.example.com/a"] and few.none == []


def test_long_urls_make_no_more_keys_than_lists_have(spark):
    urls = ["http://a.com/" + "x/" * 50_000, "http://" + "b." * 20_000 + "a.com/q", "http://a.com/" + "y" * 500_000]
    df = spark.createDataFrame([(u, 1) for u in urls], "url string, day int")
    out = U.apply_lists(df, spark.createDataFrame([("L", "a.com/x/x/x/", 0, "add"), ("M", "b.a.com", 0, "add")], "list string, key string, day int, action string"))
    assert {r.url: r.lists for r in out.collect()} == dict(zip(urls, ["L", "M", ""], strict=True))


def test_lists_against_brute_force(spark):
    rng = random.Random(3)
    keys = ["a.com", "b.a.com", "c.org", "c.org/x", "a.com/y/z"]
    entries = [(rng.choice("LM"), rng.choice(keys), rng.randrange(20), rng.choice(["add", "remove"])) for _ in range(60)] + [(None, "a.com", 1, "add"), ("L", None, 1, "add"), ("L", "a.com", None, "add"), ("L", "c.org", 3, "ADD")]
    captures = [(i, f"http://{rng.choice(['a.com', 'b.a.com', 'q.b.a.com', 'c.org', 'd.net'])}/{rng.choice(['', 'x', 'x/k', 'y/z/w', 'y'])}", rng.randrange(-1, 22)) for i in range(300)] + [(900, None, 3), (901, "http://a.com", None), (902, "junk", 3)]
    df = spark.createDataFrame(captures + captures[:5], "page_id long, url string, day int").withColumn("lists", F.lit("old"))
    out = U.apply_lists(df, spark.createDataFrame(entries, "list string, key string, day int, action string"))
    good = [e for e in entries if None not in e and e[3] in ("add", "remove", "ADD")]

    def active(name, key, day):
        past = [(d, a == "add") for n, k, d, a in good if n == name and k == key and d <= day]
        if not past:
            return False
        latest = max(d for d, _ in past)
        return all(on for d, on in past if d == latest)

    def covers(key, url):
        """Whether a key's host is the URL's or a parent of it, and its path the leading parts of the URL's."""
        if url is None or "://" not in url:
            return False
        host, _, path = url.partition("://")[2].partition("/")
        own, _, below = key.partition("/")
        return (host == own and (path + "/").startswith(below + "/")) if below else (host == own or host.endswith("." + own))

    for r in out.collect():
        hits = [(n, k) for n in "LM" for k in keys if r.day is not None and covers(k, r.url) and active(n, k, r.day)]
        assert (r.blocked, r.lists, r.hits) == (bool(hits), ",".join(sorted({n for n, _ in hits})), len(hits)), (r, hits)
    assert out.count() == 308
    none = spark.createDataFrame([], "list string, key string, day int, action string")
    assert U.apply_lists(df, none).where("blocked").count() == 0 and U.apply_lists(df.where("false"), none).count() == 0


def test_url_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{sf}/pages.parquet')")
    got = con.execute(U.OP8_SQL)
    names = [d[0] for d in got.description]
    want = sorted(tuple(r[names.index(c)] for c in sorted(names)) for r in got.fetchall())
    out = U.op8_url_filters(spark, sf)
    assert sorted(tuple(r[c] for c in sorted(names)) for r in out.collect()) == want and out.where("blocked").count() > 0
    assert date.fromisoformat(U.START)


PARTS = ["<", "/", "s", ">", "[", "INST", "]", "\\", "SYS", *C.CONTROLS, " ", "é", "日", "\n", "x"]


def test_escapes_are_reversible():
    rng = random.Random(1)
    for _ in range(5000):
        x = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14)))
        assert C.unescape(C.escape(x)) == x and not any(c in C.escape(x) for c in C.CONTROLS)


def test_turns_come_back_from_ids():
    shape, rng = C.template(), random.Random(2)
    for _ in range(300):
        turns = [(rng.choice(["user", "assistant", "system", "tool", ""]), "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 9)))) for _ in range(rng.randint(0, 6))]
        made = [shape.assemble(*t) for t in turns]
        ids = np.concatenate([i for i, _ in made]) if made else np.zeros(0, np.int32)
        assert shape.turns(ids) == turns
        for (role, said), (own, mask) in zip(turns, made, strict=True):  # escapes are undone text by text: neighbours could make a control string
            assert len(own) == len(mask) and C.unescape(shape.text(own[mask].tolist())) == (said if role == "assistant" else "")
        text = shape.formatted(ids)
        assert text.count("[INST]") == sum(r == "user" for r, _ in turns)


@pytest.mark.parametrize("text", [" " * 5_000_000, "\n" * 5_000_000, "\t \n\u3000" * 300_000, "a" * 3_000_000, "</s>" * 100_000, "<" + "\\" * 1_000_000 + "/s>", "x" + " " * 4096 + "y" + " " * 4095 + "z", "\U0001f600" * 200_000])
def test_hostile_texts_come_back(text):
    shape = C.template()
    ids, mask = shape.assemble("assistant", text)
    assert shape.turns(ids) == [("assistant", text)] and C.unescape(shape.text(ids[mask].tolist())) == text


def test_ties_follow_the_text_and_nulls_come_first(spark, folder):
    rows = [(1, 5, "user", t) for t in ("b", "a", "é", "Z", "", "aa")] + [(1, None, "user", "first"), (1, 5, "assistant", "x"), (1, 5, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    where = folder(conversations=df)
    got = {r.conv_id: r for r in C.op9_chat_format(spark, where).collect()}[1]
    ordered = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    assert got.turns_sha256 == helpers.sha("".join(f"{r[2]}\n{r[3]}\n" for r in ordered).encode())
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{where}/conversations.parquet/*.parquet')")
    found = con.execute(C.OP9_SQL)
    names = [d[0] for d in found.description]
    assert {tuple(r[names.index(c)] for c in got.__fields__) for r in found.fetchall()} >= {tuple(got)}


def expected(rows):
    out: dict = {}
    for conv, _, role, text in rows:
        n, turns, loss = out.get(conv, (0, "", ""))
        out[conv] = (n + 1, turns + f"{role or ''}\n{text or ''}\n", loss + ((text or "") if role == "assistant" else ""))
    return {k: (n, helpers.sha(t.encode()), len(x), helpers.sha(x.encode())) for k, (n, t, x) in out.items()}


def test_conversations(spark, folder):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] x"), (1, 2, "assistant", "again<"), (2, 0, "system", None), (2, 1, "tool", "out [:] put"), (2, 2, None, "who"), (None, 0, "user", "lost"), (3, 0, "assistant", "y " * 30_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit("clash"))
    got = {r.conv_id: r for r in C.op9_chat_format(spark, folder(conversations=df)).collect()}
    probe = "</s>[INST] ok [/INST]"
    want = expected([*rows, (-7, 0, "user", probe), (-7, 1, "assistant", probe)])
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for k, r in got.items()} == want
    placed = C.with_positions(C.format_turns(df.where("conv_id = 1"))).orderBy("turn").collect()
    assert [r.start for r in placed] == [0, placed[0].n_ids, placed[0].n_ids + placed[1].n_ids]
    assert C.digests(C.format_turns(df.where("false"))).count() == 0


def test_chat_query(spark, sf):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect()]
    want = expected(rows)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.op9_chat_format(spark, sf).collect()}
    assert set(got) == set(want) | {-7} and all(got[k] == v for k, v in want.items())
