from __future__ import annotations

import random
import re

from skein.llm import licenses as L


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    places, labels = [], set()
    for phrase, label in L.PHRASES.items():
        q = phrase.split()
        for i in range(len(words) - len(q) + 1):
            if words[i : i + len(q)] == q:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_matching_statistics_and_phrases():
    machine = L.LicenceAutomaton()
    rng = random.Random(2)
    vocabulary = [*list(machine.vocabulary)[:40], "zzz", "mit", "license", "apache", "general", "public"]
    sequences = [L.words_of(t) for _, t in L.TEMPLATES] + [p.split() for p in L.PHRASES]
    pieces = {tuple(q[i:j]) for q in sequences for i in range(len(q)) for j in range(i + 4, min(len(q), i + 14) + 1)}
    for _ in range(100):
        words = [rng.choice(vocabulary) for _ in range(150)]
        cut = rng.choice(sequences)
        at = rng.randrange(len(cut))
        words[70:70] = cut[at : at + 13]
        places, matches = machine.scan(words)
        assert brute(" ".join(words))[1:4] == (len(places), min((p for _, p in places), default=None), max((p for _, p in places), default=None))
        want = set()
        for i in range(len(words)):
            n = max((n for n in range(4, 15) if i + n <= len(words) and tuple(words[i : i + n]) in pieces), default=0)
            if n and not (i and tuple(words[i - 1 : i + n]) in pieces):
                want.add((i, n))
        assert {(a, n) for a, n, _ in matches if n < 14} == {(a, n) for a, n in want if n < 14}


def test_templates_and_gaps():
    machine = L.LicenceAutomaton()
    for k, (label, text) in enumerate(L.TEMPLATES):
        n = len(L.words_of(text))
        found = {(machine.labels[t], a, b) for t, a, b, c in machine.report(f"foo bar {text} qux")[2] if c == 1}
        assert (label, 2, n + 1) in found, k
    words = L.TEMPLATES[1][1].split()
    broken = " ".join(w for i, w in enumerate(words) if i % 23 != 11)
    assert {"mit"} == {machine.labels[s[0]] for s in machine.report(broken)[2]}
    assert machine.report("permission is hereby granted to eat cake and drink tea all day long")[2] == []


def test_one_label_for_notices_of_one_family():
    machine = L.LicenceAutomaton()
    for label, text in L.TEMPLATES:
        lines = "\n".join(f" * {x}" for x in re.findall(r".{1,70}(?:\s|$)", text))  # as in a comment of a source file
        assert {machine.labels[s[0]] for s in machine.report(f"Copyright 2024 A. Body\n{lines}\n*/ int main")[2]} == {label}


def test_phrases_of_one_word():
    machine = L.LicenceAutomaton(phrases={"copyleft": "x", "mit license": "mit"})
    assert sorted(machine.scan("a copyleft b mit license copyleft".split())[0]) == [(0, 1), (0, 5), (1, 3)]


def test_operator(spark, documents):
    texts = [None, "", "MIT License", "mit\nlicense Apache-License general public license MIT LICENSE", "Licensed under CC BY-NC 4.0.", "Mité license Ä x1", "word " * 60_000 + "mit license", "mit license"]
    docs = documents([*texts, (7, "mit license")])
    got = {}
    for r in L.scan(docs).collect():
        got.setdefault(r.id, []).append(r)
    assert len(got[7]) == 2
    for i, t in enumerate(texts):
        r = got[i][0]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t or "")
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[4][0].labels == "cc-by-nc" and got[3][0].labels == "apache,gpl,mit"
    assert L.scan(docs.where("false")).count() == 0
    assert {r.label for r in L.licence_spans(docs).collect()} == {"cc-by-nc"}


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in L.op6_license_scan(spark, sf).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
