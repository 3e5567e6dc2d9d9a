from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skein.operators import traces as X


def test_recorder_and_files(spark, tmp_path):
    now = iter(range(1000))
    rec = X.Recorder(lambda: float(next(now)), keep=2, clip=5)

    def work(x):
        if x < 0:
            raise ValueError("negative")
        return x

    hooked = rec.hook(work)
    assert rec.hook(hooked) is hooked and hooked(1) == 1  # no open trace: nothing is recorded
    rec.start("outer", "react", "a long question")
    hooked(2)
    rec.start("inner", "tool", "q")
    with pytest.raises(ValueError, match="negative"):
        hooked(-1)
    inner = rec.finish("error", "negative")
    outer = rec.finish()
    assert [e.status for e in outer.events] == ["success"] and [e.error for e in inner.failure_chain()] == ["negative"]
    assert outer.query == "a lon..." and outer.duration_ms > 0 and rec.finish() is None
    path = str(tmp_path / "traces")
    assert rec.flush(spark, path) == 2 and rec.flush(spark, path) == 0
    (tmp_path / "traces" / "bad.json").write_text("{broken\n")
    back = X.read_traces(spark, path)
    row = X.summary(back).first()
    assert (row.traces, row.success_rate, row.calls) == (2, 0.5, 2)
    failed = X.recent_failures(back).first()
    assert failed.error == "negative" and failed.chain[0].name == "work"


def test_parsers(spark):
    of = lambda text, f: spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("o")).first().o
    x = of("Thought: think\nmore\nAction: search[spark sql]\n", X.thought_and_action)
    assert (x.thought, x.action, x.input) == ("think\nmore", "search", "spark sql")
    assert of('```json\n["a", "b"]\n```', X.listed) == ["a", "b"]
    assert of("1. one\n- two\n\nthree", X.listed) == ["one", "two", "three"]
    assert X.split_reading("/file a b") == ("/file", "a b")


def test_skills_and_commands(spark):
    skills = spark.createDataFrame([("b", "B!"), ("a", "A!"), ("c", "C!")], "name string, content string")
    assert X.skill_context(skills, ["b", "a"]).first().text == "## a\nA!\n\n## b\nB!"
    assert X.skill_context(skills, []).first().text == ""
    log = spark.createDataFrame([(i, f"ls {i}", "ok" if i % 2 else "failed") for i in range(9)], "seq int, command string, status string")
    assert X.terminal_context(log, "in /tmp").count() == 6
    assert {r.importance for r in X.command_memories(log).collect()} == {0.4, 0.8}
