"""Licence scans with a generalised suffix automaton.

The token sequences of all licence templates are one automaton. A file's words are streamed through it; after each word the state
and the length of the longest suffix that occurs in some template (the matching statistic) are known. Phrases are
templates too: a phrase ends at a word if its state lies on the suffix-link path and the statistic covers it. Statistics that
cannot be extended and have MIN_MATCH words or more are maximal matches; those of one template are chained in order of both
file and template (gaps up to MAX_GAP words), and a chain that covers enough of its template is a span with the template's label.

The automaton has at most twice as many states as the templates have words; it is sent to every task. Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import bounded, column, load, slices, texts_of, tidy

_LOWER = {c: c + 32 for c in range(65, 91)}
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MIN_MATCH = 4
MAX_GAP = 4

# The phrases and labels of the base result.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# The notices of public licences, with their labels.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("cc0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this software."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("boost", "Distributed under the Boost Software License, Version 1.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.translate(_LOWER))


class LicenceAutomaton:
    """Suffix automaton of several token sequences, each added after a return to the root, with end positions by template."""

    def __init__(self, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None):
        templates = TEMPLATES if templates is None else templates
        self.phrases = list((PHRASES if phrases is None else phrases).items())
        self.labels = [label for label, _ in templates]
        sequences = [words_of(t) for _, t in templates]
        self.sizes = [len(s) for s in sequences]
        spoken = [words_of(p) for p, _ in self.phrases]
        self.vocabulary: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[dict[int, list[int]]] = [{}]
        for k, sequence in enumerate([*sequences, *spoken]):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, self.vocabulary.setdefault(word, len(self.vocabulary)), ends)
                if k < len(sequences):
                    ends[last].setdefault(k, []).append(at)
        # Ends travel up the suffix links, from long strings to short ones.
        order = sorted(range(1, len(self.next)), key=lambda s: -self.length[s])
        for s in order:
            for k, places in ends[s].items():
                mine = ends[self.link[s]].setdefault(k, [])
                mine += [p for p in places if p not in mine]
        self.ends = ends
        said: dict[int, list[tuple[int, int]]] = {}
        for k, sequence in enumerate(spoken):
            s = 0
            for word in sequence:
                s = self.next[s][self.vocabulary[word]]
            said.setdefault(s, []).append((k, len(sequence)))
        self.said: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for s in sorted(range(1, len(self.next)), key=lambda s: self.length[s]):
            self.said[s] = said.get(s, []) + self.said[self.link[s]]

    def _extend(self, last: int, token: int, ends: list) -> int:
        nxt, link, length = self.next, self.link, self.length

        def clone(p: int, q: int) -> int:
            c = len(nxt)
            nxt.append(dict(nxt[q]))
            length.append(length[p] + 1)
            link.append(link[q])
            ends.append({})
            link[q] = c
            while p >= 0 and nxt[p].get(token) == q:
                nxt[p][token] = c
                p = link[p]
            return c

        q = nxt[last].get(token)
        if q is not None:
            return q if length[q] == length[last] + 1 else clone(last, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        ends.append({})
        p = last
        while p >= 0 and token not in nxt[p]:
            nxt[p][token] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][token]
            link[new] = q if length[q] == length[p] + 1 else clone(p, q)
        return new

    def scan(self, words: list[str]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """(phrase, first word) of every place of a phrase; (first word, words, state) of every maximal match of MIN_MATCH or more."""
        get = self.vocabulary.get
        tokens = np.fromiter(map(get, words, _repeat(-1)), np.int32, len(words))
        known = tokens >= 0
        edges = np.flatnonzero(np.diff(known.astype(np.int8), prepend=0, append=0))
        places: list[tuple[int, int]] = []
        matches: list[tuple[int, int, int]] = []
        nxt, link, length, said = self.next, self.link, self.length, self.said
        least = min([MIN_MATCH, *(n for found in said for _, n in found)])  # a shorter run of known words holds nothing
        for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if end - begin < least:
                continue
            state = size = 0
            for at, token in enumerate(tokens[begin:end].tolist(), begin):
                to = nxt[state].get(token)
                if to is None:
                    if size >= MIN_MATCH:
                        matches.append((at - size, size, state))
                    while state and token not in nxt[state]:
                        state = link[state]
                        size = length[state]
                    to = nxt[state].get(token, 0)
                    size = size + 1 if to else 0
                else:
                    size += 1
                state = to
                for k, n in said[state]:
                    if size >= n:
                        places.append((k, at + 1 - n))
            if size >= MIN_MATCH:
                matches.append((end - size, size, state))
        return places, matches

    def spans(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        """(template, first word, last word, covered share) of the best chain of each template and cluster of matches."""
        by: dict[int, list[tuple[int, int, int, int]]] = {}
        for first, size, state in matches:
            for k, places in self.ends[state].items():
                for p in places:
                    by.setdefault(k, []).append((first, first + size - 1, p - size + 1, p))
        out = []
        for k, pieces in sorted(by.items()):
            pieces.sort()
            # best[i]: words covered by the best chain that ends with piece i, and where that chain begins
            best: list[tuple[int, int]] = []
            for i, (a, b, x, y) in enumerate(pieces):
                score, start = b - a + 1, a
                for j in range(i - 1, -1, -1):
                    c, d, _, w = pieces[j]
                    if a - c > self.sizes[k] + MAX_GAP * 8:
                        break
                    overlap = max(0, d - a + 1, w - x + 1)
                    if c < a and pieces[j][2] < x and a - d - 1 <= MAX_GAP and x - w - 1 <= MAX_GAP and overlap < b - a + 1:
                        if best[j][0] + b - a + 1 - overlap > score:
                            score, start = best[j][0] + b - a + 1 - overlap, best[j][1]
                best.append((score, start))
            i = 0
            while i < len(pieces):  # one span for each run of chains that touch
                j, top, right = i, i, pieces[i][1]
                while j + 1 < len(pieces) and pieces[j + 1][0] <= right + MAX_GAP + 1:
                    j += 1
                    right = max(right, pieces[j][1])
                    if best[j][0] > best[top][0]:
                        top = j
                out.append((k, best[top][1], pieces[top][1], min(1.0, best[top][0] / self.sizes[k])))
                i = j + 1
        return out

    def report(self, text: str) -> tuple[int, list[tuple[int, int]], list[tuple[int, int, int, float]]]:
        """Number of words, places of phrases, spans that cover enough: four fifths of short templates, three fifths of others.

        Of spans over the same words the one that covers most of them counts: notices of one family share much of their text.
        """
        words = words_of(text)
        places, matches = self.scan(words)
        spans = [s for s in self.spans(matches) if s[3] >= (0.8 if self.sizes[s[0]] <= 16 else 0.6)] if matches else []
        best: list[tuple[int, int, int, float]] = []
        for s in sorted(spans, key=lambda s: (-s[3] * self.sizes[s[0]], s[1], s[0])):
            if all(2 * (min(s[2], t[2]) - max(s[1], t[1]) + 1) <= s[2] - s[1] + 1 for t in best):
                best.append(s)
        return len(words), places, sorted(best)


def _repeat(value: int) -> Iterator[int]:
    while True:
        yield value


def licence_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """(id, label, template, first_word, last_word, covered) of every span in docs. Null and empty texts have none."""
    machine = LicenceAutomaton(templates)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [(i, machine.labels[k], k, a, b, c) for i, t in zip(column(batch, "id").to_pylist(), texts_of(batch), strict=True) for k, a, b, c in machine.report(t)[2]]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], ["id", "label", "template", "first_word", "last_word", "covered"])

    rows = bounded(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, label string, template int, first_word long, last_word long, covered double")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row for each row of docs: words, phrase places, labels and a score.

    The score is the largest covered share of a template, 1 where a phrase stands. A null or empty text has no words, no places (null
    first and last), empty labels and score 0; repeated rows are told repeatedly; an empty table gives no rows.
    """
    machine = LicenceAutomaton(templates)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [label for _, label in machine.phrases]
        for batch in slices(batches):
            cols: list[list] = [[] for _ in range(7)]
            for text in texts_of(batch):
                n, places, spans = machine.report(text)
                base = {names[k] for k, _ in places}
                starts = [at for _, at in places]
                more = base | {machine.labels[s[0]] for s in spans}
                row = (n, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(more)), 1.0 if base else max((s[3] for s in spans), default=0.0))
                for col, value in zip(cols, row, strict=True):
                    col.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([column(batch, "id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    rows = bounded(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, phrase places, labels and score."""
    return scan(load(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
