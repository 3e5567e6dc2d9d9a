"""Packing is held against its rules: sizes, maximality, what is shared between neighbours, and nothing lost."""

from __future__ import annotations

import random

import pytest

from skein.operators import chunking as C
from skein.operators import context as X


def text_of(rng, words, cjk=0.2):
    def word():
        return rng.choice("中文字句") * rng.randint(1, 9) if rng.random() < cjk else "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 14)))

    return "".join(word() + rng.choice([" ", " ", ". ", "! ", "。", "  ", ""]) for _ in range(words))


def squeezed(text):
    return "".join(text.split())


@pytest.mark.parametrize("seed", range(20))
def test_cut_by_tokens_is_maximal(seed):
    rng = random.Random(seed)
    text, limit = text_of(rng, rng.randint(1, 120)), rng.randint(1, 9)
    pieces = C.cut_by_tokens(text, limit)
    assert "".join(pieces) == text and all(pieces)
    for k, piece in enumerate(pieces):
        assert X.count_tokens(piece) <= limit or len(piece) == 1
        if k + 1 < len(pieces):
            assert X.count_tokens(piece + pieces[k + 1][0]) > limit


@pytest.mark.parametrize("seed", range(20))
def test_token_chunks_follow_their_rules(seed):
    rng = random.Random(seed)
    limit, overlap = rng.randint(4, 40), rng.randint(0, 20)
    # Paragraphs that fit are told apart by number, so a chunk's members can be read from its text.
    paragraphs = [f"p{i} " + " ".join("x" for _ in range(rng.randint(0, limit - 1))) for i in range(rng.randint(1, 60))]
    sizes = [X.count_tokens(p) for p in paragraphs]
    members = [[int(line[1:].split()[0]) for line in text.split("\n\n")] for text, _, _ in C.chunk_tokens(paragraphs, limit, overlap)]
    assert sorted({i for m in members for i in m}) == list(range(len(paragraphs)))
    for m, after in zip(members, members[1:], strict=False):
        assert m == list(range(m[0], m[-1] + 1)) and sum(sizes[i] for i in m) <= limit
        new = m[-1] + 1  # the first paragraph that the chunk had no room for
        assert sum(sizes[i] for i in m) + sizes[new] > limit and new in after
        shared = [i for i in after if i < new]
        wanted = [j for j in range(m[0], new) if j == new - 1 or sum(sizes[j:new]) <= overlap]
        assert shared == [j for j in wanted if sum(sizes[j : new + 1]) <= limit]


def test_oversized_paragraphs_lose_nothing():
    rng = random.Random(3)
    for _ in range(30):
        paragraph, limit = text_of(rng, 150), rng.randint(3, 30)
        pieces = list(C._paragraph_pieces(paragraph, limit))
        assert squeezed("".join(pieces)) == squeezed(paragraph) and all(X.count_tokens(p) <= limit or len(p) == 1 for p in pieces)
    assert list(C._paragraph_pieces("a b. c d e f g. h.", 3)) == ["a b.", "c d e ", "f g.", "h."]


@pytest.mark.parametrize("seed", range(20))
def test_character_chunks_follow_their_rules(seed):
    rng = random.Random(seed)
    lines = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 80))]
    size = rng.randint(95, 160)  # beyond a tail and a line: no forced cuts
    chunks = C.chunk_characters("\n".join(lines), size, 20)
    assert all(len(c) <= size for c in chunks)
    at, before = 0, ""
    for chunk in chunks:
        body = chunk
        if before:
            tail = before[-C.TAIL :].strip()
            assert chunk.startswith(tail + "\n")
            body = chunk[len(tail) + 1 :]
        own = body.split("\n")
        assert own == lines[at : at + len(own)]
        at += len(own)
        assert at == len(lines) or len(chunk) + len(lines[at]) + 1 > size  # the next line had no room
        before = chunk
    assert at == len(lines)


def test_forced_cuts_keep_all():
    line = "".join(chr(0x4E00 + i) for i in range(1234))
    for overlap in (0, 30):
        chunks = C.chunk_characters(line, 100, overlap)
        assert all(len(c) <= 100 for c in chunks)
        assert chunks[0] + "".join(c[overlap:] for c in chunks[1:]) == line
    sentences = ["s" * 130 + ".", "t" * 20 + ".", "u" * 60 + "."]
    assert list(C._fill(sentences, 100, 100)) == ["s" * 100, "s" * 30 + "." + "t" * 20 + ".", "u" * 60 + "."]


@pytest.mark.parametrize("seed", range(30))
def test_truncate_is_the_longest_allowed_part(seed):
    rng = random.Random(seed)
    text, limit = text_of(rng, rng.randint(20, 90)), rng.randint(1, 40)
    out = X.truncate(text, limit)
    total = X.count_tokens(text)
    if total <= limit:
        assert out == text
        return
    share = max(1, len(text) * max(0, limit - min(limit - 1, X.MARK_TOKENS)) // total)
    allowed = [n for n in range(2, share + 1) if X.count_tokens(text[:n] + X.CUT_MARK) <= limit]
    assert out == text[: max(allowed, default=1)] + X.CUT_MARK


def test_compress_keeps_important_sections_and_counts_their_headings():
    body = " ".join(f"w{i}" for i in range(30))
    text = "\n\n".join(f"[{n}]\n{body}" for n in ("Role & Policies", "Task", "Evidence", "Context"))
    out, changed, tokens = X.compress(text, 100)
    assert changed and tokens == X.count_tokens(out) <= 100
    names = [n for n, _ in X.sections_of(out)]
    assert names == ["Task", "Evidence", "Role & Policies"]
    # 90 of 100 tokens, less two important sections of 30 words and a heading each, leave 28 for the first of the others.
    held = dict(X.sections_of(out))
    assert held["Task"] == held["Evidence"] == body and held["Role & Policies"] == X.truncate(body, 28)
    assert X.compress(text, 1000) == (text, False, X.count_tokens(text))
    plain, changed, _ = X.compress(body * 5, 20)
    assert changed and plain.startswith("[全文]\n")


@pytest.mark.parametrize("limit", [1, 5, 20, 60])
def test_chunk_queries_equal_the_function(spark, sf, limit):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    got = C.token_chunks(docs, "doc_id", "text", limit, 3).collect()
    want = {r.doc_id: C.chunk_tokens([p for p in r.text.split("\n") if p.strip()], limit, 3) for r in docs.collect()}
    assert sorted((r.id, r.chunk_index, r.content, r.tokens, r.paragraphs) for r in got) == sorted((i, k, *c) for i, cs in want.items() for k, c in enumerate(cs))
