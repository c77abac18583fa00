"""License scans with a generalised suffix automaton of license words.

The automaton recognises every run of words of every template. Reading a text through it
gives the matching statistics: at each word, the longest run that ends there and stands
in some template. Runs of at least ``LEAST_RUN`` words that cannot be made longer are
chained, in the order of both the text and the template, into the template's covered span;
enough cover gives the template's label.

Words that no template has end every run, so only stretches of template words go through
the automaton; all others are told apart by one vectorised lookup.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..shipping import ship
from .textbytes import ALNUM, Words, slices

# The phrases of the base rules.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Public license notices.
TEMPLATES = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation
the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("mit", "Released under the MIT License"),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions
and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies."""),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
)

LEAST_RUN = 4
#: share of a template that its chained runs must cover
LEAST_COVER = 0.6
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long,cover:double>>"


def words_of(text: str) -> list[bytes]:
    w = Words(pa.array([text]), ALNUM)
    return [w.word(i) for i in range(len(w))]


class Automaton:
    """States are sets of runs with the same ends; ``ends[state]`` are those ends, as (template,
    place of the last word)."""

    def __init__(self, templates: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: list[list[tuple[int, int]]] = [[]]

        def new(length: int, moves: dict[int, int], link: int) -> int:
            self.next.append(moves)
            self.length.append(length)
            self.link.append(link)
            own.append([])
            return len(self.next) - 1

        def branch(p: int, word: int) -> int:
            """The state after p and word whose longest run is exactly one word longer than p's."""
            q = self.next[p][word]
            if self.length[q] == self.length[p] + 1:
                return q
            clone = new(self.length[p] + 1, dict(self.next[q]), self.link[q])
            self.link[q] = clone
            while p != -1 and self.next[p].get(word) == q:
                self.next[p][word] = clone
                p = self.link[p]
            return clone

        for t, template in enumerate(templates):
            last = 0
            for place, word in enumerate(template):
                if word in self.next[last]:
                    last = branch(last, word)
                else:
                    fresh = new(self.length[last] + 1, {}, 0)
                    p = last
                    while p != -1 and word not in self.next[p]:
                        self.next[p][word] = fresh
                        p = self.link[p]
                    if p != -1:
                        self.link[fresh] = branch(p, word)
                    last = fresh
                own[last].append((t, place))
        self.ends = [set(x) for x in own]
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def matching(self, words: list[int]) -> list[tuple[int, int]]:
        """For each word: state, and length of the longest run that ends there."""
        state = length = 0
        out = []
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            out.append((state, length))
        return out


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES, least_run: int = LEAST_RUN):
        texts = [words_of(t) for _, t in templates]
        phrase_words = [words_of(p) for p, _ in phrases]
        vocabulary = sorted({w for t in texts + phrase_words for w in t})
        hashes = Words(pa.array([w.decode() for w in vocabulary]), ALNUM).hashes()
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        number = {vocabulary[k]: i for i, k in enumerate(order.tolist())}
        self.templates = [[number[w] for w in t] for t in texts]
        self.template_labels = [label for label, _ in templates]
        self.phrases = [([number[w] for w in p], label) for p, (_, label) in zip(phrase_words, phrases, strict=True)]
        in_templates = np.zeros(len(vocabulary), bool)
        in_templates[[w for t in self.templates for w in t]] = True
        self.in_templates = in_templates
        self.automaton = Automaton(self.templates)
        self.least_run = least_run
        self.needed = [max(int(np.ceil(LEAST_COVER * len(t))), min(len(t), least_run + 1)) for t in self.templates]

    def ids(self, words: Words) -> np.ndarray:
        h = words.hashes()
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)

    def base(self, ids: np.ndarray, of_text: np.ndarray) -> list[tuple[np.ndarray, str]]:
        """Places of each phrase."""
        out = []
        for phrase, label in self.phrases:
            n = len(phrase)
            hit = np.ones(max(0, len(ids) - n + 1), bool)
            for k, word in enumerate(phrase):
                hit &= ids[k : len(ids) - n + 1 + k] == word
            at = np.flatnonzero(hit)
            out.append((at[of_text[at] == of_text[at + n - 1]], label))
        return out

    def stretches(self, ids: np.ndarray, of_text: np.ndarray) -> list[tuple[int, int]]:
        """Runs of template words inside one text, long enough to hold a match."""
        inside = (ids >= 0) & self.in_templates[np.maximum(ids, 0)]
        at = np.flatnonzero(inside)
        if not len(at):
            return []
        cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(of_text[at]) != 0)) + 1
        first, last = at[np.concatenate([[0], cut])], at[np.concatenate([cut, [len(at)]]) - 1]
        long = last - first + 1 >= self.least_run
        return list(zip(first[long].tolist(), last[long].tolist(), strict=True))

    def runs(self, ids: np.ndarray, first: int, last: int) -> Iterator[tuple[int, int, int]]:
        """(state, length, place of the last word) of the runs that the next word does not lengthen."""
        stats = self.automaton.matching(ids[first : last + 1].tolist())
        for i, (state, length) in enumerate(stats):
            if length >= self.least_run and (i + 1 == len(stats) or stats[i + 1][1] != length + 1):
                yield state, length, first + i

    def chain(self, runs: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """(label, first word, last word, cover) of the templates that the runs of one text cover."""
        best: dict[int, np.ndarray] = {}
        for state, length, end in runs:
            begin = end - length + 1
            for t, place in self.automaton.ends[state]:
                # Of the best chain within the template's first p words: words covered, and its first and last word in the text.
                cover, first, last = best.setdefault(t, np.full((3, len(self.templates[t]) + 1), -1))
                before = place - length + 1
                joins = cover[before] > 0 and last[before] < begin
                got = length + (int(cover[before]) if joins else 0)
                begun = int(first[before]) if joins else begin
                better = cover[place + 1 :] < got
                for row, value in ((cover, got), (first, begun), (last, end)):
                    row[place + 1 :][better] = value
        return [
            (self.template_labels[t], int(first[-1]), int(last[-1]), int(cover[-1]) / len(self.templates[t]))
            for t, (cover, first, last) in sorted(best.items())
            if cover[-1] >= self.needed[t]
        ]

    def scan(self, texts: pa.Array) -> list[tuple]:
        """Columns n_words ... spans of SCHEMA for each text."""
        w = Words(texts, ALNUM)
        of_text = np.repeat(np.arange(len(texts)), w.counts)
        ids = self.ids(w)
        places: list[list[tuple[int, str]]] = [[] for _ in range(len(texts))]
        for at, label in self.base(ids, of_text):
            for i in at.tolist():
                places[of_text[i]].append((i - int(w.ptr[of_text[i]]), label))
        runs: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
        for first, last in self.stretches(ids, of_text):
            t = int(of_text[first])
            runs[t] += [(s, n, e - int(w.ptr[t])) for s, n, e in self.runs(ids, first, last)]
        out = []
        for n, base, own in zip(w.counts.tolist(), places, runs, strict=True):
            spans = self.chain(own)
            found = {label for _, label in base}
            score = 1.0 if base else max((s[3] for s in spans), default=0.0)
            starts = [i for i, _ in base]
            out.append((n, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(found)), ",".join(sorted(found | {s[0] for s in spans})), score, spans))
        return out


_scanner: Scanner | None = None


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    global _scanner
    _scanner = _scanner or Scanner()
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("cover", pa.float64())]))
    for batch in batches:
        for part in slices(batch):
            found = _scanner.scan(part.column("text"))
            columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds)]
            spans = pa.array([[dict(zip(("label", "first", "last", "cover"), s, strict=True)) for s in x[7]] for x in found], span)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns, spans], names=["doc_id", *names, "spans"])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """See SCHEMA; one row for each row of docs (doc_id, text).

    Base places are those of PHRASES; spans are covered templates, in words from 0, and their labels
    join the base ones. score is 1 with a base place, else the largest cover. A null or empty
    text has no words, no places (first_word and last_word null) and empty labels. Repeated
    rows are scanned alike; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_scan, SCHEMA)
