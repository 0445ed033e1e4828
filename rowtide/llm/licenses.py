"""License scan: winnowed fingerprints pick candidates, banded alignment reports what of a template a text holds and where."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import Bounded, Scratch, resident, text_rows

#: Words of a fingerprinted run; runs of a window, of which the least is kept. A shared stretch of GRAM + WINDOW - 1 words shares a fingerprint.
GRAM, WINDOW = 3, 2
BAND, COVERAGE, CACHE = 8, 0.8, 300_000
EDGE, WORD = re.compile(r"^\W+|\W+$"), re.compile(r"\S+")

#: Fixed texts: notices by which licenses are commonly named, and texts of licenses or of the headers they ask for.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
}


def word_code(word: str) -> int:
    """A word's number; words apart in case or in signs around them have the same. 0: no letters or digits."""
    w = EDGE.sub("", word.lower())
    return (xxhash.xxh64_intdigest(w.encode(), 3) or 1) if w else 0


class WordCodes(Bounded):
    """Numbers of words; a worker remembers CACHE of them at most between texts."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > CACHE:
            known.clear()
        for w in {w for w in words if w not in known}:
            known[w] = word_code(w)
        return np.array([known[w] for w in words], dtype=np.uint64)


def winnow(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and fingerprints: the least of each window of WINDOW runs of GRAM words (the only one, where there is no whole window)."""
    n = len(codes) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
        h ^= h >> np.uint64(29)
    if n < WINDOW:
        at = np.arange(n)
    else:
        windows = np.lib.stride_tricks.sliding_window_view(h, WINDOW)
        at = np.unique(windows.argmin(1) + np.arange(len(windows)))
    return at, h[at]


class Templates:
    """The templates' words and the inverted index from fingerprint to (template, place); its size is that of the templates."""

    def __init__(self, texts: dict[str, str]):
        self.names = list(texts)
        self.words = [np.array([c for w in texts[n].split() if (c := word_code(w))], dtype=np.uint64) for n in self.names]
        found = [(int(f), t, int(p)) for t, w in enumerate(self.words) for p, f in zip(*winnow(w), strict=True)]
        found.sort()
        self.prints = np.array([f for f, _, _ in found], dtype=np.uint64)
        self.where = [(t, p) for _, t, p in found]

    def candidates(self, codes: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """By template: stretches of the text's words, merged where they overlap, in which it may begin."""
        at, prints = winnow(codes)
        low, high = np.searchsorted(self.prints, prints, "left"), np.searchsorted(self.prints, prints, "right")
        spans: dict[int, list[tuple[int, int]]] = {}
        for i in np.flatnonzero(high > low).tolist():
            for t, p in self.where[low[i] : high[i]]:
                start = int(at[i]) - p
                spans.setdefault(t, []).append((start - BAND, start + BAND))
        out = {}
        for t, own in spans.items():
            own.sort()
            merged = [own[0]]
            for a, b in own[1:]:
                if a <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
                else:
                    merged.append((a, b))
            out[t] = merged
        return out


def align(template: list[int], words: list[int], low: int, high: int, start: int, stop: int, least: float) -> list[tuple[int, int, int]]:
    """Alignments that match at least so many words of the template in order and don't overlap: words matched, first and last word of the text.

    Local alignment (match 2, else -1) of a template that begins between words ``low`` and ``high`` of the text: only
    places on those diagonals, with BAND more on each side, and words from ``start`` to before ``stop`` are looked at. The
    best of each first word are taken in descending order, as far as they don't overlap.
    """
    ends: dict[int, tuple[int, int, int, int]] = {}
    width = range(low - BAND, high + BAND + 1)
    row: dict[int, tuple[int, int, int, int]] = {}
    for i, w in enumerate(template):
        new: dict[int, tuple[int, int, int, int]] = {}
        left = None
        for d in width:
            j = d + i
            if j < start or j >= stop:
                left = None
                continue
            diagonal, up = row.get(d), row.get(d + 1)
            if words[j] == w:
                s, m, a, _ = diagonal or (0, 0, j, j)
                cell = (s + 2, m + 1, a, j)
            else:
                cell = (diagonal[0] - 1, *diagonal[1:]) if diagonal else None
            for other in (up, left):
                if other and (cell is None or other[0] - 1 > cell[0]):
                    cell = (other[0] - 1, *other[1:])
            if cell and cell[0] > 0:
                new[d] = left = cell
                if cell[1] >= least and (cell[0], cell[1]) > ends.get(cell[2], (0, 0))[:2]:
                    ends[cell[2]] = cell
            else:
                left = None
        row = new
    taken: list[tuple[int, int, int]] = []  # ascending by place
    for _, m, a, z in sorted(ends.values(), key=lambda c: (-c[0], -c[1], c[2])):
        k = bisect.bisect(taken, a, key=lambda t: t[1])
        if (k == 0 or taken[k - 1][2] < a) and (k == len(taken) or z < taken[k][1]):
            taken.insert(k, (m, a, z))
    return taken


def places(template: list[int], words: list[int], low: int, high: int, least: float) -> list[tuple[int, int, int]]:
    """All alignments of a stretch: those of :func:`align`, and again between them until nothing more is found."""
    found, todo = [], [(max(0, low - BAND), min(len(words), high + len(template) + BAND))]
    while todo:
        start, stop = todo.pop()
        if stop - start < least:
            continue
        own = align(template, words, max(low, start - len(template)), min(high, stop), start, stop, least)
        if own:
            found += own
            todo += zip([start, *(z + 1 for _, _, z in own)], [*(a for _, a, _ in own), stop], strict=True)
    return sorted(found, key=lambda f: f[1])


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, coverage, matched_words, span_start, span_end): a row for each place of a document that holds at least ``coverage`` of a template's words in order.

    Spans are code points, the end not included. Whole texts are read, in place (no exchange). Null and empty texts
    and texts of fewer than GRAM words give no rows; repeated rows give their rows as often. Templates of fewer than
    GRAM words can't be found. A stretch that one template covers is reported for other templates too if it covers them.
    """
    known = Templates(templates or TEMPLATES)
    sent = docs.sparkSession.sparkContext.broadcast(known)  # of the templates' own size
    Scratch(docs.sparkSession, "licenses")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, codes_of = sent.value, resident("licenses", WordCodes)
        names = ["id", "license", "coverage", "matched_words", "span_start", "span_end"]
        types = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.int64()]
        for b in batches:
            out = []
            for key, body in zip(b.column("id").to_pylist(), b.column("body").to_pylist(), strict=True):
                text = body.decode("utf-8", "replace")
                words = text.split()
                all_codes = codes_of(words)
                place = np.flatnonzero(all_codes)
                codes = all_codes[place]
                found = known.candidates(codes)
                if not found:
                    continue
                spans = [m.span() for m in WORD.finditer(text)]
                listed = codes.tolist()
                for t, starts in found.items():
                    template = known.words[t].tolist()
                    for low, high in starts:
                        for matched, first, last in places(template, listed, low, high, coverage * len(template)):
                            out.append((key, known.names[t], matched / len(template), matched, spans[place[first]][0], spans[place[last]][1]))
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*out, strict=True) if out else [[]] * 6, types, strict=True)], names)

    rows = text_rows(docs, id_col, text_col)
    return rows.mapInArrow(run, "id long, license string, coverage double, matched_words int, span_start long, span_end long").withColumnRenamed("id", id_col)
