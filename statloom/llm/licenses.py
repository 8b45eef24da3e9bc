"""License scan: matching statistics of documents against an automaton of licence templates.

All templates and key phrases, as word numbers, go into one generalised suffix
automaton.  Streaming a document's words through it gives, at every place, the
longest template string that ends there, and by the links of its state what other
templates share of it.  Matches that cannot be extended in their template and have ``LEAST_MATCH`` words or more are chained per template: later in the document means
later in the template, with at most ``MAX_GAP`` words between; where two overlap, the
later one counts from behind the earlier one on.  For every match the chain ending
there that covers most template words is found by dynamic programming over the
matches before it that are near enough; of the chains that cover ``LEAST_COVERAGE``
of their template, a second dynamic programme takes those that lie apart in the
document and cover most words together.  They are the licence spans.  A key phrase
occurs wherever it is a suffix of the current match, so base places come
from the same stream.  Words outside the templates reset the automaton, so only
runs of template words are streamed; this changes no result.

Templates are fixed and small, so tasks hold the automaton and nothing is
shuffled: the scan is one pass over the texts.

Nulls and edge cases: a null or empty text has no words and no labels, score 0;
repeated rows are scanned one by one; very long texts are scanned whole; an
empty table gives no rows; only the id and the text are read.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from statloom.llm.common import text_bytes

LEAST_MATCH = 5
MAX_GAP = 12
LEAST_COVERAGE = 0.5

# Key phrases with their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# Wording of public licences and their usual notices.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
     "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
     "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
     "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "Released under the MIT License."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
     "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
     "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the "
     "License for the specific language governing permissions and limitations under the License."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
     "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it "
     "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General "
     "Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see "
     "https://www.gnu.org/licenses/."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
     "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in "
     "binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
     "provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
     "copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
     "You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
     "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
]

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
RESULT = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label:string,first:bigint,last:bigint,coverage:double>>"


def words_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters (lower-cased), digits and anything outside ASCII."""
    return text.translate(_WORD_BYTES).split()


class Automaton:
    """Generalised suffix automaton over sequences of word numbers, built one sequence after the other."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for number, sequence in enumerate(sequences):
            last = 0
            for place, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].append((number, place))
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[state]].extend(self.ends[state])

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.ends.append([])
        return len(self.link) - 1

    def _split(self, source: int, word: int) -> int:
        """The target of a transition, cut in two where it also stands for longer strings."""
        target = self.next[source][word]
        if self.length[target] == self.length[source] + 1:
            return target
        part = self._state(self.length[source] + 1)
        self.next[part] = dict(self.next[target])
        self.link[part], self.link[target] = self.link[target], part
        while source >= 0 and self.next[source].get(word) == target:
            self.next[source][word] = part
            source = self.link[source]
        return part

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new = self._state(self.length[last] + 1)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, word)
        return new

    def read(self, words: list[int]) -> int:
        state = 0
        for word in words:
            state = self.next[state][word]
        return state

    def statistics(self, words: list[int]) -> list[tuple[int, int]]:
        """(state, length) of the longest string ending at every word."""
        out = []
        state = length = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            state = self.next[state].get(word, 0)
            length = length + 1 if state else 0
            out.append((state, length))
        return out


class Scanner:
    def __init__(self, templates=None, phrases=None):
        templates = TEMPLATES if templates is None else templates
        phrases = PHRASES if phrases is None else phrases
        texts = [words_of(t.encode()) for _, t in templates] + [words_of(p.encode()) for p, _ in phrases]
        self.numbers = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        coded = [[self.numbers[w] for w in t] for t in texts]
        self.labels = [label for label, _ in templates]
        self.coded = coded
        self.sizes = [len(t) for t in coded]
        self.automaton = Automaton(coded)
        self.phrases = [(len(t), label) for t, (_, label) in zip(coded[len(templates) :], phrases)]
        # phrases that end at a state: its own (if the match is long enough) and those of the states it links to
        self.own: dict[int, list[int]] = {}
        for i, t in enumerate(coded[len(templates) :]):
            self.own.setdefault(self.automaton.read(t), []).append(i)
        self.shorter: list[list[int]] = [[] for _ in self.automaton.link]
        for state in sorted(range(1, len(self.automaton.link)), key=self.automaton.length.__getitem__):
            above = self.automaton.link[state]
            self.shorter[state] = self.shorter[above] + self.own.get(above, [])

        # where the string of a state ends in a template, and how much of it that template shares: all of the match, or as much as a state it links to
        self.reach: list[list[tuple[int, int, int]]] = []
        for state in range(len(self.automaton.link)):
            found: dict[tuple[int, int], int] = {}
            up, shared = state, 1 << 30
            while up > 0 and (up == state or shared >= LEAST_MATCH):
                for end in self.automaton.ends[up]:
                    if end[0] < len(self.labels):
                        found.setdefault(end, shared)
                up = self.automaton.link[up]
                shared = self.automaton.length[up]
            self.reach.append([(*end, n) for end, n in found.items()])

    def scan(self, text: bytes):
        """n_words, places [(start, label)] of phrases, spans [(label, first, last, coverage)]."""
        words = words_of(text)
        codes = np.fromiter(map(self.numbers.get, words, repeat(0)), np.int32, len(words))
        known = np.concatenate(([False], codes > 0, [False]))
        edges = np.flatnonzero(known[1:] != known[:-1])
        places, matches = [], []
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - start > 1:
                self._stream(start, codes[start:end].tolist(), places, matches)
        return len(words), places, self._chains(matches)

    def _stream(self, start: int, run: list[int], places, matches) -> None:
        trail = self.automaton.statistics(run)
        for i, (state, length) in enumerate(trail):
            for p in self.own.get(state, ()):
                if length >= self.phrases[p][0]:
                    places.append((start + i + 1 - self.phrases[p][0], self.phrases[p][1]))
            for p in self.shorter[state]:
                places.append((start + i + 1 - self.phrases[p][0], self.phrases[p][1]))
            if length >= LEAST_MATCH:
                following = run[i + 1] if i + 1 < len(run) else 0
                for template, place, most in self.reach[state]:
                    sequence, shared = self.coded[template], min(length, most)
                    if place + 1 == len(sequence) or sequence[place + 1] != following:
                        matches.append((template, start + i + 1 - shared, place + 1 - shared, shared))

    def _chains(self, matches) -> list[tuple[str, int, int, float]]:
        """Spans (label, first word, last word, coverage) of every template's chains."""
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for template, at, place, length in set(matches):
            by_template.setdefault(template, []).append((at, place, length))
        spans = []
        for template, own in by_template.items():
            size = self.sizes[template]
            enough = [c for c in best_chains(sorted(own)) if c[2] >= LEAST_COVERAGE * size]
            spans += [(self.labels[template], first, end - 1, min(1.0, covered / size)) for first, end, covered in apart(enough)]
        return sorted(spans, key=lambda s: (s[1], s[0], s[2]))


def best_chains(matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(first word, end, covered words) of the chain that covers most, of those the one that begins last, up to every match.

    matches (at, place, length) of one template, in order.  Only matches that end
    near enough to a match can stand before it, so few are looked at for each.
    """
    out: list[tuple[int, int, int]] = []
    near: list[int] = []
    for j, (at, place, length) in enumerate(matches):
        near = [i for i in near if matches[i][0] + matches[i][2] >= at - MAX_GAP]
        covered, first = length, at
        for i in near:
            before, reached = matches[i][0] + matches[i][2], matches[i][1] + matches[i][2]
            gain = length - max(0, before - at, reached - place)
            if gain > 0 and matches[i][0] < at and (out[i][2] + gain, out[i][0]) > (covered, first):
                covered, first = out[i][2] + gain, out[i][0]
        out.append((first, at + length, covered))
        near.append(j)
    return out


def apart(chains: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Chains without a common word that cover most together; on ties those that end first."""
    chains = sorted(set(chains), key=lambda c: (c[1], c[0]))
    ends = [c[1] for c in chains]
    total, way = [0], [()]
    for i, (first, _, covered) in enumerate(chains):
        before = bisect_right(ends, first, 0, i)
        if total[before] + covered > total[i]:
            total.append(total[before] + covered)
            way.append((way[before], chains[i]))
        else:
            total.append(total[i])
            way.append(way[i])
    out, left = [], way[-1]
    while left:
        left, chain = left
        out.append(chain)
    return out[::-1]


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    """One per worker process."""
    return Scanner()


def scan_row(scan: Scanner, text: bytes):
    n_words, places, spans = scan.scan(text)
    starts = [p for p, _ in places]
    base = {label for _, label in places}
    labels = base | {s[0] for s in spans}
    score = 1.0 if places else max((s[3] for s in spans), default=0.0)
    first, last = (min(starts), max(starts)) if starts else (None, None)
    return n_words, len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, spans


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Phrase places, licence spans, labels and score of every document."""

    @pandas_udf(RESULT)
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = [scan_row(scanner(), t) for t in texts]
        frame = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])
        return frame.astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), scan(text_bytes(text_col)).alias("s")).select("doc_id", "s.*")
