"""Queries that take every row, held against brute force on small tables."""

from __future__ import annotations

import re
from collections import Counter
from itertools import combinations

import pytest

import __spark_entry__ as entry

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = ["The", "And", "With", "Paris", "Berlin", "Madrid"]


@pytest.fixture
def folder(spark, tmp_path):
    def write(**tables):
        for name, df in tables.items():
            df.coalesce(2).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def run(spark, where, name):
    return entry.queries()[name](spark, where).collect()


def test_graph_takes_every_document(spark, folder):
    texts = {i: (" ".join(n for k, n in enumerate(NAMES) if (i // 7) >> k & 1) + " some words", ["en", "fr", None][i % 3]) for i in (3, 40, 61, 100, 299, 300, 411, 5000, 9999)}
    where = folder(documents=spark.createDataFrame([(i, t, lang, "s", len(t)) for i, (t, lang) in texts.items()], DOCUMENTS))
    found = {i: {n.lower() for n in re.findall(r"\b[A-Z][a-zA-Z]{2,}\b", t)} for i, (t, _) in texts.items()}
    memories = Counter(k for keys in found.values() for k in keys)
    assert {r.key: r.memories for r in run(spark, where, "entities")} == memories
    assert {r.key: r.ids for r in run(spark, where, "entity_memory_ids")} == {k: ",".join(str(i) for i in sorted(found) if k in found[i]) for k in memories}
    edges = [(i, *pair) for i, keys in found.items() for pair in combinations(sorted(keys), 2)]
    counts = Counter(e[1:] for e in edges)
    assert {(r.source, r.target): (r.n, r.weight) for r in run(spark, where, "cooccurrence_edges")} == {e: (n, n / 2) for e, n in counts.items() if n > 1}
    assert sorted(tuple(r) for r in run(spark, where, "entity_relations")) == sorted(e for e in edges if "the" in e[1:])
    asked, want = {"the", "and", "with"}, {}
    for m, keys in found.items():
        links = sum(0.5 * (0.3 if o == m else 0.15) for o, s, t in edges if (s in asked and t in keys) or (t in asked and s in keys))
        score = min(1.0, len(keys & asked) / (len(keys | asked)) * 0.6 + links * 0.4)
        if score > 0:
            want[m] = score
    got = {r.memory_id: r.score for r in run(spark, where, "graph_score")}
    assert set(got) == set(want) and all(got[m] == pytest.approx(want[m], abs=1e-6) for m in want)


def test_every_question_is_asked(spark, folder):
    items, n = [3, 8, 50, 77], 40
    words = [f"w{i}" for i in range(n)]
    docs = [(i, f"{words[i]} {words[(i + 1) % n]} common", "en", "src1", 10) for i in range(n)]
    bench = [(i, words[i % n] + " common") for i in items]
    vectors = [(i, [1.0, float(i)], 3) for i in range(90)]
    where = folder(
        documents=spark.createDataFrame(docs, DOCUMENTS), benchmark=spark.createDataFrame(bench, "item_id long, text string"),
        embeddings=spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int"),
    )
    # Two documents hold a question's rare word and share the best score; the lower id is first.
    best = {i: min(i % n, (i - 1) % n) for i in items}
    for name in ("sparse_tfidf_topk", "sparse_raw_tf_topk", "bm25_topk", "filter_then_search"):
        rows = run(spark, where, name)
        assert {r.query_id: r.chunk_id for r in rows if r["rank"] == 1} == best and len(rows) == 10 * len(items), name
    cosine = lambda a, b: (1 + a * b) / ((1 + a * a) * (1 + b * b)) ** 0.5
    want = {q: [v for _, v in sorted((-round(min(1.0, cosine(q, v)), 6), v) for v in range(90))[:10]] for q in items}
    rows = run(spark, where, "dense_cosine_topk")
    assert {q: [r.chunk_id for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == q] for q in items} == want
    for name in ("hybrid_merge", "min_score_filter", "hybrid_rank_fusion", "citation_context", "offline_embedding_search"):
        assert {r.query_id for r in run(spark, where, name)} == set(items), name
    assert {r.chunk_id: r.hits for r in run(spark, where, "mqe_max_merge")} == dict.fromkeys(range(n), len(items))
    assert {r.chunk_id for r in run(spark, where, "expanded_search")} >= {i % n for i in items}
    for name in ("rrf_fusion", "node_dedup"):
        assert {r.chunk_id for r in run(spark, where, name)} == set(range(n)), name


def test_entry_asks_every_question(spark, sf):
    asked = {r.item_id for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    assert {r.query_id for r in entry.entry(spark).select("query_id").distinct().collect()} == asked and max(asked) >= 8


def test_duplicates_in_every_language(spark, folder):
    base = [" ".join(f"t{k}x{j}" for j in range(12)) for k in range(4)]
    texts = [base[0], base[0] + " more", base[0], base[1], base[1] + " x", base[1] + " x y", base[1] + " x y z w", base[2], base[3], base[3], "", None, base[3] + " " + base[3], base[2] + " q"]
    langs = ["fr", "en", None, "de", "es", "es", "en", "de", None, "fr", "en", "fr", "de", "es"]
    where = folder(documents=spark.createDataFrame([(i, t, lang, "s", 1) for i, (t, lang) in enumerate(zip(texts, langs, strict=True))], DOCUMENTS))
    sets = {i: set(t.split()) for i, t in enumerate(texts) if t}
    close = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in combinations(sorted(sets), 2)}
    close = {p: x for p, x in close.items() if x >= 0.8}
    rep = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    rows = run(spark, where, "dedup_pairs")
    assert {(r.a, r.b) for r in rows if r.kind == "member"} == {(rep[i], i) for i in sets if rep[i] != i}
    assert {(r.a, r.b): r.similarity for r in rows if r.kind == "pair"} == {(a, b): round(x, 6) for (a, b), x in close.items() if rep[a] == a and rep[b] == b and a != b and sets[a] != sets[b]}
    losers = {a if b % 7 > a % 7 else b for a, b in close}
    assert {r.memory_id for r in run(spark, where, "dedup_jaccard")} == set(range(len(texts))) - losers


def test_notes_and_questions_of_every_row(spark, folder):
    texts = ["plain", "a --- b\n---\nc", "  blanks  ", None]
    where = folder(
        documents=spark.createDataFrame([(i, t, "en", "src1", 1) for i, t in enumerate(texts)], DOCUMENTS),
        benchmark=spark.createDataFrame([(1, "zzz moron zzz"), (2, "zzz")], "item_id long, text string"),
    )
    assert {r.id: (r.title, r.tags, r.body) for r in run(spark, where, "front_matter")} == {i: (f"Title {i}", "en,src1", (t or "").strip()) for i, t in enumerate(texts)}
    got = {r.item_id: (r.doc_type, r.cleaned) for r in run(spark, where, "query_parse_all")}
    assert set(got) == {1, 2} and got[1] == ("insult", "zzz zzz") and got[2] == (None, "zzz")
    assert [r.item_id for r in run(spark, where, "query_parse")] == [2]


def test_titles_of_blank_texts(spark, folder):
    """A text without a line has no title; what is trimmed is what the SQL trims."""
    import duckdb

    texts = ["", "\n", "  \n \n", None, "# Title\nx", "\n\n  ** Bold line \n", "#" * 9, "\u00a0\n\u3000\nafter wide blanks", "\u00a0 inside \u2003", "#\x0bnot trimmed", "#\t\f tabs", "\t\nnext line", "abc", "a" * 99, "a" * 100]
    where = folder(documents=spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCUMENTS))
    sql = entry.oracle_sql()["title_extract"].replace("from documents", f"from '{where}/documents.parquet/*.parquet'")
    want = dict(duckdb.sql(sql).fetchall())
    assert {r.doc_id: r.title for r in run(spark, where, "title_extract")} == want and want[0] is None and want[4] == "Title"
