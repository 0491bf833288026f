"""License texts and notices in documents: winnowed fingerprints pick candidates, banded alignment measures them."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from reconlake.llm.shared import frugal

_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = (
    "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
    "This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details."
)
#: Templates by SPDX-like name: whole license texts, standard headers and one-line notices. A caller can pass others.
TEMPLATES: dict[str, str] = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause": _BSD + _BSD_END,
    "BSD-3-Clause": _BSD + _BSD_NAMES + _BSD_END,
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0-or-later-header": _GNU.format(what="program", kind="General Public License", version="3"),
    "GPL-2.0-or-later-header": _GNU.format(what="program", kind="General Public License", version="2"),
    "LGPL-3.0-or-later-header": _GNU.format(what="library", kind="Lesser General Public License", version="3"),
    "LGPL-2.1-or-later-header": _GNU.format(what="library", kind="Lesser General Public License", version="2.1"),
    "AGPL-3.0-or-later-header": _GNU.format(what="program", kind="Affero General Public License", version="3"),
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC0-1.0-statement": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense-opening": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "GPL-3.0-free-software": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0-notice": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0-notice": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0-notice": "Licensed under CC BY-NC-ND 4.0.",
    "GPL-3.0-notice": "Licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "Licensed under the GNU General Public License, version 2.",
    "LGPL-3.0-notice": "Licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-2.1-notice": "Licensed under the GNU Lesser General Public License, version 2.1.",
    "AGPL-3.0-notice": "Licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0-notice": "Licensed under the Mozilla Public License, version 2.0.",
    "BSD-2-Clause-notice": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause-notice": "Licensed under the BSD 3-Clause License.",
    "All-rights-reserved-notice": "All rights reserved.",
    "All-rights-reserved": "All rights reserved. No part of this publication may be reproduced.",
}
#: Words that tell licenses apart, as numbers do: in a short template's match they must be the template's own.
MARKS = frozenset("mit apache bsd isc cc by nc sa nd gnu gpl lgpl agpl general lesser affero library program mozilla mpl cc0 rights reserved clause".split())
WORD = re.compile(r"[A-Za-z]+[0-9]*|[0-9]+(?:\.[0-9]+)*")
#: One word in five may differ. Templates of up to SHORT words are sought by all their word pairs, others by winnowed triples:
#: a match has that many edits at most, so some run of its words is long enough to hold a fingerprint of both.
EDITS_IN, SHORT, LONG_GRAM, WINDOW = 5, 19, 3, 2
#: In longer templates numbers may be put in (items of a list); no other mark may, in any template.
NUMBERED = 60
OTHER, NUMBER = 0, -1
_EDIT, _MATCH, _LIMIT = 1 << 42, 1 << 21, (1 << 21) - 1
_MARKED, _OUT = 64 * _EDIT, _EDIT << 18


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash in each window, the last of equal ones, ascending; short lists: the least of all."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    window = min(window, len(hashes))
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return np.unique(np.arange(len(views)) + window - 1 - views.argmin(axis=1))


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the word runs of `size`; the greatest value where a run has a word that no template has."""
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    code, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for i in range(size):
        code = (code + words[i : i + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
        known &= words[i : i + n] > 0
    return np.where(known, code >> np.uint64(1), np.uint64(2**64 - 1))


def aligned(template: np.ndarray, words: np.ndarray, low: int, high: int, mark: np.ndarray | None = None, mark_in: np.ndarray | None = None) -> tuple[int, int, int, int]:
    """(edits, matched words, first and past-last word) of the template's best alignment on the diagonals low to high.

    A word replaced, left out or put in is an edit; with `mark` (by word number), one of a marked word counts as many;
    `mark_in`, if given, says so of words put in.
    The fewest edits win, then the most matches, then the shortest and the earliest span. Row by row over the
    band; a cell is one number that holds edits, matches and start.
    """
    width = high - low + 1
    at = np.arange(low, high + 1)
    best = _MATCH * _LIMIT + _LIMIT - np.arange(width)
    best[(at < 0) | (at > len(words))] = _OUT
    for i, wanted in enumerate(template):
        j = at + i
        inside = (j >= 0) & (j < len(words))
        word = np.full(width, OTHER)
        word[inside] = words[j[inside]]
        put_in = np.full(width, _EDIT) if mark is None else np.where((mark if mark_in is None else mark_in)[word], _MARKED, _EDIT)
        left_out = _EDIT if mark is None or not mark[wanted] else _MARKED
        row = np.where(word == wanted, best - _MATCH, best + np.maximum(put_in, left_out))
        row[~inside] = _OUT
        row[:-1] = np.minimum(row[:-1], best[1:] + left_out)
        step = np.cumsum(put_in)
        row = np.minimum.accumulate(row - step) + step
        row[(j + 1 < 0) | (j + 1 > len(words))] = _OUT
        best = row
    past = int(best.argmin())
    edits, rest = divmod(int(best[past]), _EDIT)
    matched, start = _LIMIT - (rest >> 21), _LIMIT - (rest & _LIMIT)
    return edits, matched, low + start, low + past + len(template)


@dataclass(frozen=True)
class _Template:
    name: str
    words: np.ndarray
    edits: int
    marks: list[int]
    mark_in: np.ndarray


class TemplateIndex:
    """An inverted index from fingerprints to (template, place): all word pairs of short templates, winnowed triples of others."""

    def __init__(self, templates: dict[str, str]):
        words = {name: [m.group().lower() for m in WORD.finditer(text)] for name, text in sorted(templates.items())}
        self.number = {w: i for i, w in enumerate(sorted({w for ws in words.values() for w in ws} | MARKS), 1)}
        self.mark = np.zeros(len(self.number) + 2, bool)
        self.mark[[i for w, i in self.number.items() if w in MARKS or w[0].isdigit()]] = True
        word_mark = self.mark.copy()
        self.mark[NUMBER] = True
        word_mark[[i for w, i in self.number.items() if w[0].isdigit()]] = False
        self.templates, self.postings = [], {2: defaultdict(list), LONG_GRAM: defaultdict(list)}
        for name, ws in words.items():
            if not ws:
                continue
            numbers = np.array([self.number[w] for w in ws])
            self.templates.append(_Template(name, numbers, len(ws) // EDITS_IN, numbers[self.mark[numbers]].tolist(), self.mark if len(ws) <= NUMBERED else word_mark))
            size = 2 if len(ws) <= SHORT else LONG_GRAM
            hashes = grams(numbers, min(size, len(ws)))
            for place in range(len(hashes)) if size == 2 else winnow(hashes, WINDOW):
                self.postings[size][int(hashes[place])].append((len(self.templates) - 1, int(place)))
        self.known = {size: np.array(sorted(p), np.uint64) for size, p in self.postings.items()}

    def _seeds(self, words: np.ndarray) -> dict[int, set[int]]:
        """Per template the diagonals on which it and the text share a fingerprint."""
        seeds: dict[int, set[int]] = defaultdict(set)
        for size, known in self.known.items():
            hashes = grams(words, size)
            places = np.arange(len(hashes)) if size == 2 else winnow(hashes, WINDOW)
            for place in places[np.isin(hashes[places], known)].tolist():
                for template, at in self.postings[size][int(hashes[place])]:
                    seeds[template].add(place - at)
        return seeds

    def scan(self, text: str) -> list[tuple[str, float, int, int, float]]:
        """(template, coverage, first and past-last character, similarity) of every match; of overlapping ones the best."""
        found = list(WORD.finditer(text))
        number = self.number
        words = np.array([number.get(w, NUMBER if w[0] <= "9" else OTHER) for w in (m.group().lower() for m in found)], np.int64)
        seeds, there = self._seeds(words), None
        if not seeds:
            return []
        there, matches = set(words.tolist()), []
        for of, shifts in seeds.items():
            t = self.templates[of]
            if not there.issuperset(t.marks):
                continue
            # neighbouring diagonals share a band; it is too narrow for two matches that don't overlap
            ordered, at = sorted(shifts), 0
            while at < len(ordered):
                low = ordered[at]
                at = bisect_right(ordered, low + 2 * t.edits, at)
                edits, matched, first, past = aligned(t.words, words, low - t.edits, ordered[at - 1] + t.edits, self.mark, t.mark_in)
                if edits <= t.edits:
                    matches.append((matched, edits, first, past, t))
        taken: list[tuple[int, int]] = []
        out = []
        for matched, edits, first, past, t in sorted(matches, key=lambda m: (-m[0], m[1], m[2], m[3], m[4].name)):
            place = bisect_right(taken, (first, past))
            if (not place or taken[place - 1][1] <= first) and (place == len(taken) or past <= taken[place][0]):
                taken.insert(place, (first, past))
                out.append((t.name, matched / len(t.words), found[first].start(), found[past - 1].end(), 1 - edits / len(t.words)))
        return sorted(out, key=lambda m: (m[2], m[0]))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per match: `id_col`, license, coverage, first_char, past_char, similarity.

    Templates are a given list of bounded size; their fingerprints form an inverted index that travels with the tasks.
    A document's words are fingerprinted the same way, hits give a template and a diagonal, and a banded alignment
    around it finds the span with the fewest edits. A template matches where at most one word in five is edited;
    marks (versions, and words such as NC, Lesser or Library) can't be edited: none is left out, put in or replaced, but that
    numbers may be put into templates of over 60 words, as items of their lists. No such span is missed. `coverage` is the
    share of the template's words found in order; `similarity` is 1 less the edits' share, so words put in lower it. Of overlapping matches, whatever their templates, the one with the most matched words is reported,
    then that with the fewest edits, then the earliest. The scan is a map over whole texts, without a shuffle.

    Null and empty texts match nothing; null ids are kept; repeated rows are reported each; extra columns are
    ignored; an empty table gives an empty result.
    """
    index = TemplateIndex(TEMPLATES if templates is None else templates)

    def scanned(batches):
        for batch in batches:
            rows = [(at, *m) for at, text in enumerate(batch.column(1).to_pylist()) if text for m in index.scan(text)]
            at, name, coverage, first, past, similarity = zip(*rows, strict=True) if rows else ([],) * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(name, pa.string()), pa.array(coverage, pa.float64()), pa.array(first, pa.int64()), pa.array(past, pa.int64()), pa.array(similarity, pa.float64())],
                names=[id_col, "license", "coverage", "first_char", "past_char", "similarity"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(frugal(scanned), f"`{id_col}` {kind}, license string, coverage double, first_char long, past_char long, similarity double")
