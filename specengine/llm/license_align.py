"""License scans by patience alignment of texts with license templates.

Words are letters, digits and everything beyond ASCII, without case.  Text and template are aligned on
words that occur once in either; the longest increasing subsequence of these anchors is kept, and the
gaps between two anchors are aligned in the same way, where other words become unique.  A gap without
anchors matches its equal words at both ends.  Coverage is the share of the template's words that are
matched.

Only regions with a run of three successive template words are aligned: hits of a template closer than
its length form one region, widened by the template's words before the first and behind the last hit.
A text that covers MIN_COVERAGE of a template of MIN_WORDS words or more shares such a run unless every
third word differs, so the regions lose nothing else.  A region is as long as its hits reach.

A template may be found several times, however close: where the hits' place in the template falls back, a
new copy begins.  Each copy is aligned by itself, and so is the template's length around each beginning
that a hit implies (a chance hit may have cut a copy); of overlapping finds of a template that with most
matched words stays, then the shortest.  The region as a whole counts if it matches more than its only copy.

Defined cases: null text and text without words have no license; of overlapping finds that with most
matched words stays, ties by name; repeated rows are scanned each.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from specengine.llm.common import U, chunks, mix, span_hashes, spans, utf8

MIN_COVERAGE = 0.8
RUN = 3

# Wordings of public license notices, by SPDX name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version."),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software."),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."),
}

SCHEMA = ("license string, coverage double, matched long, first_word long, last_word long, "
          "found array<struct<license:string,coverage:double,first_word:bigint,last_word:bigint>>")

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the words of a text column."""
    data, at = utf8(pc.utf8_lower(column))
    start, end, row = spans(_LETTER[data], at)
    return span_hashes(data, start, end), row


def increasing(places: list[int]) -> list[int]:
    """Positions in the list of a longest increasing subsequence."""
    tops, back, ends = [], [], []
    for i, p in enumerate(places):
        pile = bisect_left(tops, p)
        if pile == len(tops):
            tops.append(p)
            ends.append(i)
        else:
            tops[pile], ends[pile] = p, i
        back.append(ends[pile - 1] if pile else -1)
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(text: list, template: list) -> list[tuple[int, int]]:
    """Matched (text word, template word) places, ascending in both."""
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        if a == b or c == d:
            continue
        own, theirs = _once(text, a, b), _once(template, c, d)
        anchors = [(i, theirs[w]) for w, i in own.items() if w in theirs]
        kept = [anchors[k] for k in increasing([p for _, p in anchors])]
        if not kept:
            continue
        pairs += kept
        for (i, p), (j, q) in zip([(a - 1, c - 1), *kept], [*kept, (b, d)]):
            if j - i > 1 and q - p > 1:
                todo.append((i + 1, j, p + 1, q))
    return sorted(pairs)


def _once(words: list, low: int, high: int) -> dict:
    """Place of every word that occurs once in the range, in order."""
    seen: dict = {}
    for i in range(low, high):
        seen[words[i]] = -1 if words[i] in seen else i
    return {w: i for w, i in seen.items() if i >= 0}


def _runs(word: np.ndarray) -> np.ndarray:
    return mix(mix(word[:-2] + U(1)) + mix(word[1:-1] + U(2)) + mix(word[2:] + U(3)))


def _copies(hits: list[tuple[int, list[int]]]) -> list[list[int]]:
    """[first place, its offset, last place, its offset] of each ascending stretch of hits (place, offsets)."""
    out: list[list[int]] = []
    for at, offsets in hits:
        on = [o for o in offsets if out and o > out[-1][3]]
        if on:
            out[-1][2:] = [at, min(on)]
        else:
            out.append([at, min(offsets), at, min(offsets)])
    return out


class Scanner:
    def __init__(self, templates: Mapping[str, str], min_coverage: float):
        self.names = sorted(templates)
        self.min_coverage = min_coverage
        self.words = [word_hashes(pa.array([templates[n]]))[0] for n in self.names]
        if min(map(len, self.words), default=RUN) < RUN:
            raise ValueError(f"a template needs {RUN} words")
        keys = [(int(h), t, i) for t, w in enumerate(self.words) for i, h in enumerate(_runs(w))]
        keys.sort()
        self.keys = np.array([k[0] for k in keys], U)
        self.of = [(t, i) for _, t, i in keys]

    def scan(self, column: pa.Array) -> list[list[tuple]]:
        """Finds (name, coverage, matched, first, last word) of every row."""
        out: list[list[tuple]] = [[] for _ in range(len(column))]
        word, row = word_hashes(column)
        if len(word) < RUN or not len(self.keys):
            return out
        run = _runs(word)
        low, high = np.searchsorted(self.keys, run), np.searchsorted(self.keys, run, "right")
        first = np.searchsorted(row, np.arange(len(column)))
        stop = np.append(first[1:], len(word))
        regions: dict[tuple[int, int], list[list[tuple[int, list[int]]]]] = {}
        for at in np.flatnonzero((high > low) & (row[:-2] == row[2:])):
            hits: dict[int, list[int]] = {}
            for t, offset in self.of[low[at]:high[at]]:
                hits.setdefault(t, []).append(offset)
            for t, offsets in hits.items():
                own = regions.setdefault((int(row[at]), t), [])
                if own and int(at) - own[-1][-1][0] <= len(self.words[t]):
                    own[-1].append((int(at), offsets))
                else:
                    own.append([(int(at), offsets)])
        for (r, t), found in regions.items():
            for hits in found:
                out[r] += self._finds(word, int(first[r]), int(stop[r]), t, hits)
        return [self._apart(finds) for finds in out]

    def _finds(self, word: np.ndarray, first: int, stop: int, t: int, hits: list[tuple[int, list[int]]]) -> list[tuple]:
        """Finds of a template in a region, from its hits (place, offsets in the template) in order."""
        template = self.words[t].tolist()
        size = len(template)
        margin = size // 4

        def find(begin: int, end: int) -> list[tuple]:
            begin, end = max(begin, first), min(end, stop)
            pairs = align(word[begin:end].tolist(), template)
            if len(pairs) < self.min_coverage * size:
                return []
            return [(self.names[t], len(pairs) / size, len(pairs),
                     begin + pairs[0][0] - first, begin + pairs[-1][0] - first)]

        begins = [at - offset for at, offsets in hits for offset in offsets]
        whole = min(begins) - margin, max(begins) + size + margin
        copies = _copies(hits)
        if len(copies) == 1:
            return find(*whole)
        finds: list[tuple] = []
        for k, (at, offset, last, reached) in enumerate(copies):
            begin, end = at - offset - margin, last + size - reached + margin
            if k:
                begin = max(begin, min(copies[k - 1][2] + RUN, at))
            if k + 1 < len(copies):
                end = min(end, max(copies[k + 1][0] - copies[k + 1][1], last + RUN))
            finds += find(begin, end)
        for begin in sorted(set(begins)):
            finds += find(begin, begin + size) + find(begin - margin, begin + size + margin)
        finds = self._apart(sorted(set(finds), key=lambda f: (-f[2], f[4] - f[3], f[3])), True)
        if len(finds) < 2:
            return max(finds, find(*whole), key=lambda f: f[0][2] if f else 0)
        return finds

    @staticmethod
    def _apart(finds: list[tuple], ordered: bool = False) -> list[tuple]:
        kept: list[tuple] = []
        for find in finds if ordered else sorted(finds, key=lambda f: (-f[2], f[0], f[3])):
            if all(find[4] < k[3] or find[3] > k[4] for k in kept):
                kept.append(find)
        return kept


def scan(docs: DataFrame, templates: Mapping[str, str] | None = None,
         min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """doc_id and its license of most matched words (null if none), its coverage and place, and all finds."""
    templates = dict(TEMPLATES if templates is None else templates)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, min_coverage)
        kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()),
                                   ("first_word", pa.int64()), ("last_word", pa.int64())]))
        for batch in chunks(batches):
            finds = scanner.scan(batch.column(1))
            best = [f[0] if f else (None, 0.0, 0, None, None) for f in finds]
            every = [[{"license": n, "coverage": c, "first_word": a, "last_word": b} for n, c, _, a, b in f]
                     for f in finds]
            columns = [pa.array(c, k) for c, k in zip(zip(*best), (
                pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns, pa.array(every, kind)],
                ["doc_id", "license", "coverage", "matched", "first_word", "last_word", "found"])

    return docs.select("doc_id", "text").mapInArrow(step, f"doc_id {id_type}, {SCHEMA}")
