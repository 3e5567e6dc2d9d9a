"""Functions against literal rows, most of all those that the tables have no text for (CJK)."""

from __future__ import annotations

import math
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from skein.functions import lexicons as L
from skein.functions import scores as S
from skein.functions import text as T
from skein.functions import vectors as V
from skein.operators import routing as R


def column(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(build(F.col("v")).alias("o")).first().o


def expanded(text: str) -> list[str]:
    out = []
    for t in re.findall(r"[a-zA-Z0-9]+|[一-鿿]+", text.lower()):
        out.append(t)
        if "一" <= t[0] <= "鿿" and len(t) >= 2:
            out += [t[i : i + 2] for i in range(len(t) - 1)]
    return out


def test_tokens_on_mixed_text(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab1 ,混合检索词。Z") for _ in range(rng.randint(0, 25))) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, v string").select("i", T.tokens(F.col("v")).alias("o")).collect()
    assert all(r.o == expanded(texts[r.i]) for r in rows)


@pytest.mark.parametrize(
    ("text", "n"), [("", 0), ("hello world", 2), ("你好", 3), ("你好 world", 4), ("\U00020000x", 2), ("   ", 0)]
)
def test_token_estimate(spark, text, n):
    assert column(spark, text, T.token_estimate) == n


def test_sentences(spark):
    assert column(spark, "一。二！three. four? ", T.sentences) == ["一。", "二！", "three.", "four?"]


def test_keyword_and_coverage(spark):
    assert column(spark, "hybrid search engine", lambda c: T.keyword_score(F.lit("hybrid search"), c)) == pytest.approx(2 / 3 + 0.15)
    assert column(spark, "", lambda c: T.keyword_score(F.lit("x"), c)) == 0
    assert column(spark, "alpha beta", lambda c: T.coverage(F.lit("alpha alpha gamma"), c)) == pytest.approx(2 / 3)


def test_classes_titles_tags(spark):
    assert column(spark, "什么是 RAG？基础概念介绍", lambda c: T.best_class(c, L.DOC_TYPES, "general")) == "concept"
    assert column(spark, "nothing here", lambda c: T.best_class(c, L.DOC_TYPES, "general")) == "general"
    assert column(spark, "\n\n## Hybrid retrieval\nbody", T.title) == "Hybrid retrieval"
    assert column(spark, "# ab", T.title) is None
    assert column(spark, "rag with docker and pgvector", lambda c: T.tags(c, L.TAGS)) == ["RAG", "pgvector", "Docker"]


def test_query_parsing(spark):
    q = "关于 RAG 的技术架构文档"
    kind = column(spark, q, lambda c: T.best_class(c, L.QUERY_DOC_TYPES, None))
    assert kind == "technical"
    assert "RAG" in column(spark, q, lambda c: T.query_tags(c, L.QUERY_TAGS))
    assert "架构" not in column(spark, q, lambda c: T.clean_query(c, F.lit("technical"), L.QUERY_DOC_TYPES))


def test_small_text_functions(spark):
    assert column(spark, "2、second", T.list_item) == "second"
    assert column(spark, "my-photo_of.the cat.png", T.file_keywords) == ["my", "photo", "of", "the", "cat"]
    assert column(spark, "a/b/C.PNG", lambda c: T.by_extension(c, L.MODALITY_BY_EXTENSION)) == "image"
    assert column(spark, "x [TOOL_CALL:search: spark ] y", T.tool_calls)[0].asDict() == {"name": "search", "input": "spark"}
    assert column(spark, "Finish[42]", T.finish_answer) == "42"
    assert column(spark, "score: 120", lambda c: T.first_number(c, 0, 100)) == 100
    check = lambda cmd: column(spark, cmd, lambda c: T.unsafe_command(c, ["ls", "cat"], ["passwd"]))
    assert [check(x) for x in ("ls -l", "ls; rm x", "cat /etc/passwd", "rm x", "ls\nrm", "")] == [None, "metacharacter", "blocked", "unknown program", "newline", "empty"]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.5, 0.5, 0.0], [0.0, 0.0, 0.0], [1.0])], "a array<double>, b array<double>, c array<double>, z array<double>, s array<double>")
    got = df.select(V.cosine(F.col("a"), F.col("b")), V.cosine(F.col("a"), F.col("c")), V.cosine(F.col("a"), F.col("z")), V.cosine(F.col("a"), F.col("s"))).first()
    assert [round(x, 4) for x in got] == [0.0, 0.7071, 0.0, 0.0]
    assert column(spark, "[1,2.5]", V.from_text) == [1.0, 2.5]


def test_scores(spark):
    now = F.lit(datetime(2024, 1, 31)).cast("timestamp_ntz")
    ts = datetime(2024, 1, 16)
    of = lambda build: column(spark, ts, build, "timestamp_ntz")
    assert of(lambda c: S.episodic_recency(c, now)) == pytest.approx(math.exp(-0.5))
    assert of(lambda c: S.context_recency(c, now)) == pytest.approx(math.exp(-(15 * 24 - 24) / 72))
    assert of(lambda c: S.perceptual_recency(c, now)) == pytest.approx(math.exp(-1.5))
    assert column(spark, None, lambda c: S.context_recency(c, now), "timestamp_ntz") == 1.0
    assert column(spark, None, lambda c: S.episodic_recency(c, now), "timestamp_ntz") == 0.5
    with pytest.raises(ValueError, match="sum to 1"):
        S.context_score(F.lit(1.0), F.lit(1.0), (0.5, 0.6))


@pytest.mark.parametrize(
    ("query", "channel"), [("你好", "fast"), ("为什么天空是蓝色", "full"), ("它好吗", "full"), ("天气", "fast"), ("x" * 31, "full"), ("weather now", "fast")]
)
def test_channel(spark, query, channel):
    assert column(spark, query, R.channel) == channel


@pytest.mark.parametrize(
    ("query", "paradigm"),
    [("", "simple"), ("今天天气真好", "simple"), ("搜索最新的汇率", "react"), ("优化并润色这段话", "reflection"), ("计算 1+1", "function_call")],
)
def test_route(spark, query, paradigm):
    out = R.route(spark.createDataFrame([(query,)], "query string")).first()
    assert out.paradigm == paradigm


def test_membership(spark):
    got = [column(spark, v, lambda c: S.membership(c, 0.2, 0.6, 0.3), "double") for v in (0.4, 0.0, 0.9, 2.0)]
    assert got == pytest.approx([1.0, 1 - 0.2 / 0.3, 0.0, 0.0])
