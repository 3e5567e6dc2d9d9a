from __future__ import annotations

from pathlib import Path

from skein.operators.embedcache import EmbeddingCache
from skein.sources.store import Store


def counting(log: str, bad: str = "") -> object:
    """An encoder that writes down what it is asked, and fails on calls with a text."""

    def encode(texts):
        with Path(log).open("a") as f:
            f.write("".join(f"{t}\n" for t in texts))
        if bad and bad in texts:
            raise RuntimeError("down")
        return [[float(len(t)), 1.0] if t else None for t in texts]

    return encode


def rows(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(3)


def asked(log):
    out = sorted(Path(log).read_text().splitlines()) if Path(log).exists() else []
    Path(log).write_text("")
    return out


def test_a_text_is_encoded_once(spark, tmp_path):
    log = str(tmp_path / "log")
    cache = EmbeddingCache(Store(spark, f"{tmp_path}/s"), "m1", counting(log), batch=2)
    got = {r.id: r.embedding for r in cache.embed(rows(spark, "aa", "b", "aa", None, "")).collect()}
    assert got == {0: [2.0, 1.0], 1: [1.0, 1.0], 2: [2.0, 1.0], 3: None, 4: None} and asked(log) == ["", "aa", "b"]
    again = EmbeddingCache(Store(spark, f"{tmp_path}/s"), "m1", counting(log))
    assert again.fill(rows(spark, "b", "aa", "ccc", "ccc", "")) == (1, 0) and asked(log) == ["ccc"]
    assert again.fill(rows(spark, "b", "ccc")) == (0, 0) and asked(log) == []
    other = EmbeddingCache(Store(spark, f"{tmp_path}/s"), "m2", counting(log))
    assert other.fill(rows(spark, "b")) == (1, 0) and asked(log) == ["b"]
    other.forget()
    assert other.known().count() == 0 and again.known().count() == 4


def test_failures_are_tried_again(spark, tmp_path):
    log = str(tmp_path / "log")
    store = Store(spark, f"{tmp_path}/s")
    down = EmbeddingCache(store, "m", counting(log, bad="b"), batch=1)
    assert down.fill(rows(spark, "aa", "b", "ccc")) == (2, 1) and asked(log) == ["aa", "b", "ccc"]
    assert {r.id: r.embedding for r in down.embed(rows(spark, "aa", "b")).collect()} == {0: [2.0, 1.0], 1: None} and asked(log) == ["b"]
    up = EmbeddingCache(store, "m", counting(log))
    assert up.fill(rows(spark, "aa", "b", "ccc")) == (1, 0) and asked(log) == ["b"]
    assert store.read("tried") is None and len(store.files.names(f"{store.folder}/_pending")) == 0
    wrong = EmbeddingCache(store, "w", lambda texts: [])
    assert wrong.fill(rows(spark, "x")) == (0, 1)
    assert wrong.embed(rows(spark, "x")).columns == ["id", "text", "embedding"]
