"""Licence scans: winnowed fingerprints of templates in an inverted index pick candidates, banded alignment confirms.

Words are runs of ASCII letters and digits (A-Z lowered) and of bytes above ASCII. The index maps the fingerprint of
each GRAM-word run that winnowing keeps to (template, place); templates shorter than GRAM + WINNOW - 1 words, which
winnowing may miss, are indexed at every place. A text's own winnowed fingerprints are looked up in it: a run of
GRAM + WINNOW - 1 words in common is sure to give a hit. Hits of one template on neighbouring diagonals open a
candidate, and banded local alignments (numpy, one row of the band at a time) of the template's words with the text's
words there report coverage and span, each on words that no other match of the template has taken.

Defined results: texts without a match give no row, and so do null and empty texts; repeated rows give repeated
matches; an empty table gives none; other columns, whatever their names, are ignored; a very long text is a step of its
own. Matches of one template do not overlap; of alignments with equal score that with more matches, then the later start
is taken; templates match one by one, so a notice within a longer one is reported as well. The index is built from the
parameter `templates` (MOST_TEMPLATE_BYTES in all and MOST_TEMPLATE_WORDS each at most; more raise an error), so what each
task holds does not grow with the data.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, gram_hashes, map_arrow, text_chunks

GRAM, WINNOW = 3, 2
LEAST_COVERAGE = 0.8
MOST_TEMPLATE_BYTES, MOST_TEMPLATE_WORDS = 4 << 20, (1 << 16) - 1

#: Public licence texts and notices.
TEMPLATES = {
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "apache-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mit-disclaimer": "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd-third-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "gpl-2-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "cc0-notice": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "zlib-text": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "boost-text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    "apache-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mit-line": "Released under the MIT License",
    "apache-line": "Licensed under the Apache License, Version 2.0",
    "gpl-line": "This work is licensed under the GNU General Public License, version 3",
    "cc-by-nc-line": "Licensed under CC BY-NC 4.0",
    "cc-by-line": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "reserved-line": "All rights reserved",
}

_table = np.full(256, 32, np.uint8)
_table[128:] = np.arange(128, 256)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _table[_c] = _c
_table[65:91] = np.arange(97, 123)


def winnow(h: np.ndarray) -> np.ndarray:
    """Places of the smallest hash of each run of WINNOW hashes."""
    if len(h) <= WINNOW:
        return np.arange(len(h))
    view = np.lib.stride_tricks.sliding_window_view(h, WINNOW)
    return np.unique(view.argmin(1) + np.arange(len(view)))


class Index:
    """Inverted index: fingerprint -> (template, place)."""

    def __init__(self, templates: dict[str, str]):
        if sum(map(len, templates.values())) > MOST_TEMPLATE_BYTES:
            raise ValueError("templates exceed the bound of what each task holds")
        self.names = sorted(templates)
        w = Words(pa.array([templates[k] for k in self.names]), table=_table)
        self.words = [w.hashes[w.first[d] : w.first[d + 1]] for d in range(len(w))]
        if max(map(len, self.words), default=0) > MOST_TEMPLATE_WORDS:
            raise ValueError("a template exceeds the bound of words that an alignment counts")
        self.posts: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for d, x in enumerate(self.words):
            h = gram_hashes(x, min(GRAM, len(x)))
            for p in winnow(h).tolist() if len(x) >= GRAM + WINNOW - 1 else range(len(h)):
                self.posts[int(h[p])].append((d, p))
        self.keys = np.array(sorted(self.posts), np.uint64)
        brief = {d for d, x in enumerate(self.words) if len(x) < GRAM + WINNOW - 1}
        #: Fingerprints of templates too short for winnowing to be sure to keep one.
        self.brief = np.array(sorted(k for k, v in self.posts.items() if any(d in brief for d, _ in v)), np.uint64)


#: An alignment cell is score, matched words and first word of the text in one integer, compared in this order.
_MATCHES, _SCORE = 1 << 20, 1 << 36


def align(a: np.ndarray, b: np.ndarray, shift: int, band: int, taken: np.ndarray) -> tuple[int, int, int]:
    """(matched words, first and end word of b) of the best local alignment of a with b near b = a + shift; none
    passes a taken word of b. A match counts 2, a mismatch or a gap -1."""
    if not len(b):
        return 0, 0, 0
    columns = np.arange(len(b), dtype=np.int64)
    stretch = np.cumsum(taken & ~np.append(False, taken[:-1]))  # so that a running maximum does not cross taken words
    above, best, end = np.full(len(b) + 1, -1, np.int64), 0, 0  # above[j + 1] is column j; negative: no cell
    for i in range(len(a)):
        low, high = max(0, i + shift - band), min(len(b), i + 1 + shift + band)
        if low >= high:
            above = np.full(len(b) + 1, -1, np.int64)
            continue
        at = columns[low:high]
        start = np.where(above[low:high] >= 0, above[low:high], at)
        cell = np.where(b[low:high] == a[i], start + 2 * _SCORE + _MATCHES, start - _SCORE)
        cell = np.maximum(cell, np.where(above[low + 1 : high + 1] >= 0, above[low + 1 : high + 1] - _SCORE, -1))
        cell[taken[low:high] | (cell < _SCORE)] = -1
        apart = (stretch[low:high] - stretch[low]) << 54
        slope = (at - low) * _SCORE + apart
        run = np.maximum.accumulate(np.where(cell >= 0, cell + slope, apart)) - slope
        cell = np.maximum(cell, np.where(taken[low:high], -1, run))
        cell[cell < _SCORE] = -1
        above = np.full(len(b) + 1, -1, np.int64)
        above[low + 1 : high + 1] = cell
        k = int(np.argmax(cell // _SCORE))
        if cell[k] // _SCORE > best // _SCORE:
            best, end = int(cell[k]), low + k + 1
    if not best:
        return 0, 0, 0
    return best % _SCORE // _MATCHES, best % _MATCHES, end


def scan_text(words: np.ndarray, index: Index) -> list[tuple[str, int, int, int, float]]:
    """(template, matched words, first word, end word, coverage) of one text's word hashes."""
    h = gram_hashes(words, GRAM)
    at = winnow(h)
    at = np.union1d(at[np.isin(h[at], index.keys)], np.flatnonzero(np.isin(h, index.brief)))
    hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for p in at.tolist():
        for d, q in index.posts[int(h[p])]:
            hits[d].append((p, q))
    out = []
    for d, found in hits.items():
        t = index.words[d]
        band = 4 + len(t) // 8
        groups: list[list[tuple[int, int]]] = []  # (diagonal, place) of hits whose diagonals fit one band
        for hit in sorted((p - q, p) for p, q in found):
            if not groups or hit[0] > groups[-1][0][0] + band:
                groups.append([])
            groups[-1].append(hit)
        taken = np.zeros(len(words), bool)
        matches = []
        for group in sorted(groups, key=lambda g: (-len(g), g[0])):
            shift = group[len(group) // 2][0]
            low, high = max(0, shift - band), shift + len(t) + band
            while any(not taken[p] for _, p in group):
                matched, first, end = align(t, words[low:high], shift - low, band, taken[low:high])
                if matched < LEAST_COVERAGE * len(t):
                    break
                taken[low + first : low + end] = True
                matches.append((low + first, low + end, matched))
        out += [(index.names[d], n, a, b, n / len(t)) for a, b, n in sorted(matches)]
    return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row per match: doc_id, license, coverage, start_char, end_char, matched_words, template_words."""
    schema = "doc_id long, license string, coverage double, start_char long, end_char long, matched_words long, template_words long"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.string(), pa.float64()] + [pa.int64()] * 4

    def run(batches):
        index = Index(templates)
        size = dict(zip(index.names, map(len, index.words), strict=True))
        for part, col in text_chunks(batches, "text"):
            w = Words(col, table=_table)
            at, h = w.grams(GRAM)
            touched = np.unique(w.text_of_word()[at[np.isin(h, index.keys)]])
            rows: list[list] = [[] for _ in names]
            for d in touched.tolist():
                s, e = w.first[d], w.first[d + 1]
                raw, base = w.buf, w.offsets[d]
                for name, n, a, b, share in scan_text(w.hashes[s:e], index):
                    first, end = w.starts[s + a], w.ends[s + b - 1]
                    chars = lambda x, y: int(((raw[x:y] & 0xC0) != 0x80).sum())
                    start = chars(base, first)
                    row = (part.column(0)[d].as_py(), name, share, start, start + chars(first, end), n, size[name])
                    for x, v in zip(rows, row, strict=True):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types, strict=True)], names)

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)
