"""License scans by patience alignment.

A text's words (lower-cased letters and digits) are aligned with each template: words that occur once
in both are anchors; the longest run of anchors that ascends in both is kept (patience sorting); the
gaps between neighbours are aligned in the same way, where words that were frequent may now be unique. A gap
without anchors matches equal words at its ends. Coverage is the share of the template's words that
are matched. A template is reported from ``least`` coverage on, with its place in the text.

A copy inside a long text would lose anchors to words that the rest of the text repeats, so a text is
aligned in stretches: maximal runs in which the template's words are never further apart than the
template is long. Matched words of one copy lie in one stretch. A bound keeps most texts out: the
matches can't outnumber the words, with repeats, that text and template share.

Whole texts are scanned in one pass without a shuffle; templates are a parameter of fixed size.

Defined results: null or empty text has no license; several copies of a template in a text give the
best, of equals the tightest, then the first; repeated rows have a row each; an empty table gives no row.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

from pyspark.sql import DataFrame

from gneiss.llm.common import derived

WORD = re.compile(r"[^\W_]+")
LEAST = 0.8

#: Public license texts and notices.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def unique_anchors(a: list[str], a0: int, a1: int, b: list[str], b0: int, b1: int) -> list[tuple[int, int]]:
    """(place in a, place in b) of the words that stand once in either stretch, ascending in a."""
    if a1 - a0 > 4 * (b1 - b0):
        wanted = set(b[b0:b1])
        counts = Counter(w for w in a[a0:a1] if w in wanted)
    else:
        counts = Counter(a[a0:a1])
    place = {w: j for j, w in enumerate(b[b0:b1], b0)}
    once = {w for w, n in Counter(b[b0:b1]).items() if n == 1 and counts.get(w) == 1}
    return [(i, place[a[i]]) for i in range(a0, a1) if a[i] in once] if once else []


def ascending(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence that ascends in its second part, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        if p == len(tops):
            tops.append(j)
            piles.append(k)
        else:
            tops[p], piles[p] = j, k
        back.append(piles[p - 1] if p else -1)
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list[str], b: list[str], a0: int = 0, a1: int | None = None, b0: int = 0, b1: int | None = None) -> list[tuple[int, int]]:
    """Matched places of two word lists, ascending in both."""
    out: list[tuple[int, int]] = []
    todo = [(a0, len(a) if a1 is None else a1, b0, len(b) if b1 is None else b1)]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        anchors = ascending(unique_anchors(a, a0, a1, b, b0, b1))
        if not anchors:
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


class Template:
    def __init__(self, text: str):
        self.words = words_of(text)
        self.counts = Counter(self.words)

    def stretches(self, words: list[str], places: list[int]) -> Iterator[tuple[int, int]]:
        """Runs of the template's words whose neighbours are within its length."""
        first = last = places[0]
        for p in places[1:]:
            if p - last > len(self.words):
                yield first, last + 1
                first = p
            last = p
        yield first, last + 1

    def find(self, words: list[str], index: dict[str, list[int]], least: float) -> tuple[float, int, int] | None:
        """Coverage, first word and the place after the last of the best copy, the tightest of equals."""
        need = least * len(self.words)
        if sum(min(n, len(index.get(w, ()))) for w, n in self.counts.items()) < need:
            return None
        found = None
        for lo, hi in self.stretches(words, sorted(p for w in self.counts for p in index.get(w, ()))):
            if hi - lo < need:
                continue
            for got in self.copies(words, lo, hi, need):
                if not found or (got[0], got[1] - got[2]) > (found[0], found[1] - found[2]):
                    found = got
        return found

    def copies(self, words: list[str], lo: int, hi: int, need: float) -> Iterator[tuple[float, int, int]]:
        """Alignments in a stretch: all of it, and, as copies after one another hide each other's anchors, twice the template's length from each template's length on."""
        n = len(self.words)
        spans = [(lo, hi)] + ([(i, min(i + 2 * n, hi)) for i in range(lo, hi, n)] if hi - lo > 2 * n else [])
        for a0, a1 in spans:
            pairs = align(words, self.words, a0, a1)
            if len(pairs) >= need:
                yield len(pairs) / n, pairs[0][0], pairs[-1][0] + 1


def scan(text: str | None, templates: dict[str, Template], least: float) -> list[tuple[str, float, int, int]]:
    """Licenses in a text, best first: name, coverage, first character, the place after the last. What is a better one again is left out."""
    text = text or ""
    present = set(WORD.findall(text.lower()))
    able = {name: t for name, t in templates.items() if t.words and sum(n for w, n in t.counts.items() if w in present) >= least * len(t.words)}
    if not able:
        return []
    needed = {w for t in able.values() for w in t.counts}
    spans = [(m.start(), m.end()) for m in WORD.finditer(text)]
    words = [text[a:b].lower() for a, b in spans]
    index: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        if w in needed:
            index.setdefault(w, []).append(i)
    out = []
    for name, t in able.items():
        got = t.find(words, index, least)
        if got:
            out.append((name, *got))
    best: list[tuple[str, float, int, int]] = []
    for x in sorted(out, key=lambda x: (-x[1], -len(templates[x[0]].words), x[0])):
        if not any(_same(templates[y[0]], y, templates[x[0]], x, least) for y in best):
            best.append(x)
    return [(name, coverage, spans[a][0], spans[b - 1][1]) for name, coverage, a, b in best]


def _same(better: Template, y: tuple[str, float, int, int], template: Template, x: tuple[str, float, int, int], least: float) -> bool:
    """Whether a find is a better one again: in its place, or a lesser match of a template that is much like the better's."""
    inside = y[2] <= x[2] and x[3] <= y[3]
    return inside or (x[1] < y[1] and len(align(template.words, better.words)) >= least * len(template.words))


def scan_licenses(docs: DataFrame, keep: list[str] | None = None, text: str = "text", templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """Columns ``keep`` (doc_id), licenses array<struct<license, coverage, begin, end>>, best first, places in characters."""
    keep = ["doc_id"] if keep is None else keep
    known = {name: Template(t) for name, t in (TEMPLATES if templates is None else templates).items()}
    kind = "array<struct<license: string, coverage: double, begin: long, end: long>>"

    def found(texts: list) -> list[list]:
        return [[[dict(zip(("license", "coverage", "begin", "end"), x, strict=True)) for x in scan(t, known, least)] for t in texts]]

    return derived(docs, keep, text, {"licenses": kind}, lambda: found)
