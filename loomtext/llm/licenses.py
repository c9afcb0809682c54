"""License scans by a generalised suffix automaton of the words of license templates.

The automaton holds every part of every template. A text's words are streamed through it once, which gives matching statistics: for each
word the length of the longest part of a template that ends there, and its state. Where such a part cannot be continued it is a maximal match; its state knows
the places of the templates where it ends. Matches of at least LEAST_MATCH words (or of a whole template that is shorter) are chained: from one match to a later one that lies
further on in the same template and begins at most MOST_GAP words after it in the text. The chains that cover most words of their template, of which none overlap, are
its spans; spans that cover LEAST_COVERED of the template give its label. Base phrases are templates, too; a place of one is a word where the
state or one of its suffix links is the phrase's own and the length reaches it, so base places come out of the same statistics.

Only words that occur in a template are walked; all others set the length to zero, so texts without license words cost little more than
their splitting. Texts are scanned whole, each within its task, in memory proportional to the text; nothing is shuffled.

Words: A-Z lower-cased, then maximal runs of digits, a-z and characters beyond ASCII. A null or empty text has no words: counts 0, first_word
and last_word null, labels empty, score 0. Ties: of chains that overlap and cover as many words the one that ends first; spans are in order of their place, then by template. Repeated
rows are scanned each for itself. An empty table gives an empty result. Other columns are kept; those with names of result columns give way.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from loomtext.llm.common import packed, table, trimmed, unpacked

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices as their licenses word them, by label.
TEMPLATES: dict[str, list[str]] = {
    "mit": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may "
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See "
        "the License for the specific language governing permissions and limitations under the License.",
    ],
    "gpl-2.0": [
        "licensed under the GNU General Public License, version 2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "gpl-3.0": [
        "licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in "
        "binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You "
        "can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "cc-by-4.0": ["licensed under a Creative Commons Attribution 4.0 International License", "licensed under CC BY 4.0"],
}

#: Words of a match that counts.
LEAST_MATCH = 4
#: Words of the text between two matches of one chain.
MOST_GAP = 12
#: Share of a template's words that a span covers.
LEAST_COVERED = 0.8

#: Lower-cases A-Z and makes every other ASCII character but digits and letters a space; bytes beyond ASCII stay.
_SPLIT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

MADE = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
SPAN = T.StructType([
    T.StructField("label", T.StringType()), T.StructField("template", T.IntegerType()), T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()), T.StructField("covered", T.LongType()), T.StructField("coverage", T.DoubleType()),
])


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_SPLIT).split() if text else []


class SuffixAutomaton:
    """All parts of a set of sequences of numbers; each state stands for parts with equal places of their ends."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: dict[int, list[tuple[int, int]]] = {}
        for at, sequence in enumerate(sequences):
            last = 0
            for end, symbol in enumerate(sequence, 1):
                last = self._add(last, symbol)
                own.setdefault(last, []).append((at, end))
        self.ends = self._gathered(own)

    def _add(self, last: int, symbol: int) -> int:
        """The state of last's longest part and symbol."""
        there = self.next[last].get(symbol)
        if there is not None:
            return there if self.length[there] == self.length[last] + 1 else self._split(last, symbol, there)
        new = self._state(self.length[last] + 1, {}, 0)
        while last >= 0 and symbol not in self.next[last]:
            self.next[last][symbol] = new
            last = self.link[last]
        if last >= 0:
            there = self.next[last][symbol]
            self.link[new] = there if self.length[there] == self.length[last] + 1 else self._split(last, symbol, there)
        return new

    def _state(self, length: int, arcs: dict[int, int], link: int) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, last: int, symbol: int, there: int) -> int:
        """A copy of state `there` for its parts up to last's length and one."""
        copy = self._state(self.length[last] + 1, dict(self.next[there]), self.link[there])
        self.link[there] = copy
        while last >= 0 and self.next[last].get(symbol) == there:
            self.next[last][symbol] = copy
            last = self.link[last]
        return copy

    def _gathered(self, own: dict[int, list[tuple[int, int]]]) -> list[list[tuple[int, int]]]:
        """For each state where its parts end: its own places and those of the states that link to it."""
        ends: list[set[tuple[int, int]]] = [set(own.get(q, ())) for q in range(len(self.link))]
        for q in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            ends[self.link[q]] |= ends[q]
        return [sorted(x) for x in ends]

    def statistics(self, symbols: list[int]) -> Iterator[tuple[int, int]]:
        """For each symbol the state and the length of the longest part that ends there."""
        arcs, link, length = self.next, self.link, self.length
        q = n = 0
        for symbol in symbols:
            while symbol not in arcs[q] and q:
                q = link[q]
                n = length[q]
            there = arcs[q].get(symbol)
            if there is None:
                n = 0
            else:
                q, n = there, n + 1
            yield q, n


@dataclass
class Match:
    """Words [start, end) of the text are words [at, at + end - start) of the template."""

    start: int
    end: int
    at: int
    covered: int = 0
    first: int = 0

    def gain(self, after: Match) -> int:
        """Words that this match adds to one that comes before it."""
        return self.end - self.start - max(0, after.end - self.start, after.at + after.end - after.start - self.at)


def chained(matches: list[Match], gap: int) -> list[tuple[int, int, int]]:
    """Of matches of one template, by (end, at): (first word, end, covered words) of its best chains, of which no two overlap in the text."""
    begin = 0
    for i, m in enumerate(matches):
        m.covered, m.first = m.end - m.start, m.start
        while matches[begin].end + gap < m.start:  # starts never decrease
            begin += 1
        for other in itertools.islice(matches, begin, i):
            if other.start < m.start and other.at < m.at:
                gain = m.gain(other)
                if gain > 0 and other.covered + gain > m.covered:
                    m.covered, m.first = other.covered + gain, other.first
    taken: list[tuple[int, int]] = []
    out = []
    for m in sorted(matches, key=lambda m: (-m.covered, m.end, m.at)):
        at = bisect.bisect_left(taken, (m.end, 0))
        if at and taken[at - 1][1] > m.first:
            continue
        taken.insert(at, (m.first, m.end))
        out.append((m.first, m.end, m.covered))
    return sorted(out)


@dataclass
class Scanner:
    """Templates by label, and base phrases by phrase, compiled."""

    templates: dict[str, list[str]] = field(default_factory=lambda: TEMPLATES)
    base: dict[str, str] = field(default_factory=lambda: BASE)
    least_match: int = LEAST_MATCH
    gap: int = MOST_GAP
    least_covered: float = LEAST_COVERED

    def __post_init__(self) -> None:
        named = [(label, words_of(phrase.encode())) for phrase, label in self.base.items()]
        named += [(label, words_of(text.encode())) for label, texts in self.templates.items() for text in texts]
        if not all(words for _, words in named):
            raise ValueError("a template has no words")
        self.ids = {w: i for i, w in enumerate(dict.fromkeys(itertools.chain.from_iterable(words for _, words in named)), 1)}
        self.labels, self.sizes = [label for label, _ in named], [len(words) for _, words in named]
        self.automaton = SuffixAutomaton([[self.ids[w] for w in words] for _, words in named])
        # by state the base phrases that end where its parts do: (phrase, words) that are the end of a part
        own: dict[int, list[int]] = {}
        for phrase in range(len(self.base)):
            q = 0
            for w in named[phrase][1]:
                q = self.automaton.next[q][self.ids[w]]
            own.setdefault(q, []).append(phrase)
        self.phrases = [[p for up in self._up(q) for p in own.get(up, ())] for q in range(len(self.automaton.link))]
        # by state the places of templates that a long match may end at
        self.places = [[(t, end) for t, end in ends if t >= len(self.base)] for ends in self.automaton.ends]
        self.least_run = min([self.least_match, *self.sizes])
        self.least_noted = min([self.least_match, *self.sizes[len(self.base) :]])

    def _up(self, q: int) -> Iterator[int]:
        while q > 0:
            yield q
            q = self.automaton.link[q]

    def scan(self, text: bytes | None) -> dict:
        words = words_of(text)
        ids = np.fromiter(map(self.ids.get, words, itertools.repeat(0)), np.int32, len(words))
        base: list[tuple[int, int]] = []  # (start, phrase)
        found: dict[int, list[Match]] = {}
        for start, end in self._runs(ids):
            self._walk(ids[start:end].tolist(), start, base, found)
        spans = []
        for template, matches in sorted(found.items()):
            size = self.sizes[template]
            for first, end, covered in chained(matches, self.gap):
                spans.append((first, template, end, covered, min(1.0, covered / size)))
        spans.sort()
        starts = [s for s, _ in base]
        base_labels = sorted({self.labels[p] for _, p in base})
        method = {self.labels[t] for _, t, _, _, c in spans if c >= self.least_covered}
        score = max([1.0 if base else 0.0, *(c for *_, c in spans)])
        return {
            "n_words": len(words), "n_base": len(base), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": ",".join(base_labels), "labels": ",".join(sorted({*base_labels, *method})), "score": score,
            "spans": [{"label": self.labels[t], "template": t - len(self.base), "first_word": f, "last_word": e - 1, "covered": n, "coverage": c} for f, t, e, n, c in spans],
        }

    def _runs(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of words of templates, as long as anything that counts."""
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (ids > 0).view(np.int8), [0]])))
        begins, ends = edges[::2], edges[1::2]
        long = ends - begins >= self.least_run
        return zip(begins[long].tolist(), ends[long].tolist(), strict=True)

    def _walk(self, symbols: list[int], start: int, base: list[tuple[int, int]], found: dict[int, list[Match]]) -> None:
        """Base places and maximal matches of a run of words."""
        before = (0, 0)
        for at, (q, n) in enumerate(self.automaton.statistics(symbols)):
            if self.phrases[q]:
                base += [(start + at + 1 - self.sizes[p], p) for p in self.phrases[q] if n >= self.sizes[p]]
            if n <= before[1] >= self.least_noted:
                self._note(before, start + at, found)
            before = q, n
        if before[1] >= self.least_noted:
            self._note(before, start + len(symbols), found)

    def _note(self, part: tuple[int, int], end: int, found: dict[int, list[Match]]) -> None:
        q, n = part
        for template, place in self.places[q]:
            if n >= min(self.least_match, self.sizes[template]):
                found.setdefault(template, []).append(Match(end - n, end, place - n))


def _scanned(settings: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(**settings)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), _SPANS]
        for batch in batches:
            rows = [scanner.scan(text) for text in batch.column("text").to_pylist()]
            made = [pa.array([r[c] for r in rows], kind) for c, kind in zip(MADE, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("row"), *made], ["text", "row", *MADE])

    return run


_SPANS = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.int64()), ("coverage", pa.float64())]))


def scan_licenses(docs: DataFrame, text_col: str = "text", **settings) -> DataFrame:
    """docs with MADE: counts, base places, labels, score and the spans; settings are those of Scanner."""
    rows = packed(docs, text_col)
    made = [T.StructField(c, T.LongType()) for c in MADE[:4]] + [T.StructField(c, T.StringType()) for c in MADE[4:6]] + [T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(SPAN))]
    return unpacked(rows.mapInArrow(trimmed(_scanned(settings)), T.StructType(rows.schema.fields + made)), docs, text_col, MADE)


def op11_license_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *MADE[:-1])
