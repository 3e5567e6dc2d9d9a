from __future__ import annotations

import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from skein.operators import tools as T
from skein.sources import files as S
from skein.sources import notes as N
from skein.streaming import state as ST
from skein.streaming import windows as W


def test_registry_roles_parameters_and_chain():
    seen = []
    reg = T.Registry(lambda name, r: seen.append((name, r.status)))
    reg.register(T.Tool.of(lambda a, b=2: a + b, "add"))
    reg.register(T.Tool.of(T.calculate))
    assert reg.execute("ADD", {"a": 1}).output == 3
    assert reg.execute("add").error == "parameter a is missing"
    assert reg.execute("nope").status == "error"
    assert reg.execute("calculate", {"expression": "2 * (3 + -1) ** 2 % 5"}).output == 3
    assert reg.execute("calculate", {"expression": "__import__('os')"}).status == "error"
    reg.set_policy("guest", ["*"], ["add"])
    assert not reg.allowed("guest", "add") and reg.allowed("guest", "calculate") and reg.allowed("boss", "add")
    out = T.run_chain(reg, [T.Step("add", {"a": "{x}"}, "y"), T.Step("calculate", {"expression": "{y} * 10"}, "z")], {"x": 4})
    assert out["z"] == 60
    assert [r.output for r in T.run_parallel(reg, [("add", {"a": i}) for i in range(5)])] == [2, 3, 4, 5, 6]
    assert reg.register_group({"bad": lambda: 1 / 0, "good": lambda: [T.Tool.of(len, "size")]}) == {"bad": "division by zero"}
    assert seen[0] == ("ADD", "success") and "size" in reg.tools
    assert reg.schemas("guest")[0]["name"] == "calculate"


def test_nesting_is_limited():
    reg = T.Registry(max_depth=3)
    reg.register(T.Tool("again", lambda: reg.execute("again")))
    deep = reg.execute("again")
    assert deep.status == "error" and "nested" in deep.error


def test_breaker():
    now = [0.0]
    reg = T.Registry(clock=lambda: now[0])
    ok = [False]

    def work():
        if not ok[0]:
            raise OSError("down")
        return 1

    reg.register(T.Tool("work", work), T.Breaker(2, 10, 1))
    assert [reg.execute("work").error for _ in range(3)] == ["OSError: down", "OSError: down", "work is switched off for now"]
    now[0], ok[0] = 11.0, True
    assert reg.execute("work").output == 1 and reg.breakers["work"].state == "CLOSED"
    assert ST.replay_breaker([(0, False), (1, False), (2, True), (20, False), (21, True), (40, True)], 2, 10) == ["CLOSED", "OPEN", "OPEN", "OPEN", "OPEN", "CLOSED"]


def test_cache():
    c = ST.ExpiringCache(3, 10, 100)
    for i in range(3):
        c.set(f"k{i}", i, float(i), ttl=10 + i)
    c.set("k3", 3, 4.0)
    assert c.get("k0", 5.0) is None and c.get("k1", 5.0) == 1 and c.get("k1", 50.0) is None
    c.update("missing", 1, 5.0)
    assert c.get("missing", 5.0) is None and c.get_or_set("new", lambda: 7, 5.0) == 7 and 0 < c.hit_rate < 1


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("intro\n# One\nbody 1\n## Two\n\nbody 2", encoding="utf-8")
    (tmp_path / "b.txt").write_bytes("中文内容".encode("gbk"))
    (tmp_path / "big-cat_photo.png").write_bytes(b"\x89PNG")
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:p><w:r><w:t>there</w:t></w:r></w:p></w:document>")
    with zipfile.ZipFile(tmp_path / "d.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row><c t="s"><v>0</v></c><c><v>0</v></c></row></sheetData></worksheet>')
    with zipfile.ZipFile(tmp_path / "e.pptx", "w") as z:
        z.writestr("ppt/slides/slide1.xml", '<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>Slide text</a:t></a:r></a:p></p:sld>')
    (tmp_path / "f.pdf").write_bytes(b"%PDF\nstream\nBT (Hi \\(you\\)) Tj [(a) 3 (b)] TJ ET\nendstream\n")
    got = {}
    for r in S.read_blocks(spark, str(tmp_path)).collect():
        got.setdefault(r.path.rpartition("/")[2], []).append((r.section, r.content, r.doc_type))
    assert got["a.md"] == [("全文", "intro", "markdown"), ("One", "# One\nbody 1", "markdown"), ("Two", "## Two\n\nbody 2", "markdown")]
    assert got["b.txt"][0][1] == "中文内容" and [x[1] for x in got["c.docx"]] == ["Hello", "there"] and got["d.xlsx"][0][1] == "name | 0"
    assert got["e.pptx"] == [("slide 1", "Slide text", "ppt")] and got["f.pdf"][0][1] == "Hi (you)\nab"
    assert "big cat photo" in got["big-cat_photo.png"][0][1] and "broken.docx" not in got
    assert S.read_texts(spark, str(tmp_path), "*.md").count() == 1 and S.preview(spark, str(tmp_path), 3).where("preview = 'int'").count() == 1
    assert S.frame_numbers(100, 4.5, 10) == [0, 25, 50, 75] and S.frame_numbers(0, 1, 1) == []


def test_notes(spark):
    at = datetime(2024, 1, 1)
    rows = [("n1", "Plan", "action", ["spark", "sql"], at, at, "use spark"), ("n2", "Block", "blocker", ["sql"], at, at, "spark is down"), ("n3", " ", "general", [], at, at, "no title")]
    notes = spark.createDataFrame(rows, "id string, title string, type string, tags array<string>, created_at timestamp, updated_at timestamp, body string")
    back = N.parse_notes(N.render(notes).select(F.concat("id", F.lit(".md")).alias("path"), "text")).orderBy("id").collect()
    assert [(r.id, r.title, r.tags, r.body, r.created_at) for r in back[:2]] == [(x[0], x[1], x[3], x[6], at) for x in rows[:2]]
    assert N.valid(notes).count() == 2
    now = F.lit(datetime(2024, 1, 2)).cast("timestamp")
    assert [r.id for r in N.search(notes, "spark", now).collect()] == ["n1", "n2"]  # both are held at 1
    assert [r.id for r in N.search(notes, "spark", now, tags=["spark", "sql"]).collect()] == ["n1"]
    changed = N.update(notes, spark.createDataFrame([("n1", None, None, None, "new")], "id string, title string, type string, tags array<string>, body string"), now)
    assert changed.where("body = 'new' and title = 'Plan' and updated_at > created_at").count() == 1
    assert {(r.what, r.name): r.n for r in N.summary(notes).collect()}[("tag", "sql")] == 2
    assert N.page(notes, 1, 1).count() == 1
    raw = "---\nname: helper\ntags: [a, 'b']\nactive: true\nlevel: 3\n---\nDo it."
    skill = N.parse_skills(spark.createDataFrame([("x/helper/SKILL.md", raw), ("x/y.md", raw)], "path string, text string")).collect()
    assert [(s.name, s.version, s.tags, s.content) for s in skill] == [("helper", "1.0.0", ["a", "b"], "Do it.")]
    t = spark.createDataFrame([(raw,)], "text string").select(N.header(F.col("text")).alias("h")).select(N.typed(F.col("h")["active"]).alias("a"), N.typed(F.col("h")["level"]).alias("l")).first()
    assert t.a.flag is True and t.l.number == 3


def test_frames_and_stream(spark, sf):
    got = list(W.result_frames(spark.range(2)))
    assert [f.split("\n")[1] for f in got] == ["event: meta", "event: delta", "event: delta", "event: done"]

    def failing():
        yield {"a": 1}
        raise ValueError("gone")

    assert "event: error" in list(W.frames(failing()))[-1]
    rows = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts", "event_id").collect()
    by: dict[str, list] = {}
    for r in rows:
        by.setdefault(str(r.user_id), []).append((r.ts.timestamp(), r.event_type != "error"))
    from skein.plans.text_queries import stream_breaker

    found = {r.key: r for r in stream_breaker(spark, sf).collect()}
    assert len(found) == len(by)
    for key, calls in by.items():
        assert found[key].state == ST.replay_breaker(calls, 2, 86400.0)[-1] and found[key].calls == len(calls) == found[key].passed + found[key].refused


@pytest.mark.parametrize("text", ["1 +", "a", "9 ** 9999", "'x' * 3"])
def test_calculate_refuses(text):
    with pytest.raises((ValueError, SyntaxError)):
        T.calculate(text)
