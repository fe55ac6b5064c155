"""License scans by patience alignment of whole texts with license templates.

Words unique to both text and template are anchors; the longest increasing run of anchors is kept, and the gaps between
them are aligned the same way down to plain longest common subsequences of gaps without such words. Coverage is the share
of a template's words that are aligned.

A match is a stretch of the text in which at least LEAST of the template's words align, in which the aligned words are at
least DENSITY of all words, and that no shorter stretch within makes needless. Stretches have no greatest length: the
earliest end and the latest start of each are found by bit-parallel longest common subsequences over the whole text, then
patience aligns it, with the words just around it that add to it. A stretch where patience falls short of what can be aligned is
aligned plainly. A match within a match of more words is part of that one.

Templates are a parameter; TEMPLATES holds whole short licenses and the usual notices of long ones. Nulls, ties and odd
input: a null text is empty and matches nothing; repeated rows are scanned each; several copies of a notice are several
matches; of equal coverage the template first in order counts as best; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, text_or_empty

LEAST, DENSITY = 0.8, 0.05
# Public licenses and their usual notices, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "MIT": "Released under the MIT License.",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "all-rights-reserved": "All rights reserved.",
}

_WORDS = re.compile(r"[^\W_]+")
RESULT = "doc_id long, template string, coverage double, matched_words long, first_char long, end_char long"


def patience(a: list, b: list, a0: int = 0, b0: int = 0) -> list[tuple[int, int]]:
    """Pairs of positions of equal words, increasing in both."""
    most, head, tail = min(len(a), len(b)), 0, 0
    while head < most and a[head] == b[head]:
        head += 1
    while tail < most - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    pairs = [(a0 + k, b0 + k) for k in range(head)]
    end = [(a0 + len(a) - k, b0 + len(b) - k) for k in range(tail, 0, -1)]
    a, b, a0, b0 = a[head : len(a) - tail], b[head : len(b) - tail], a0 + head, b0 + head
    if a and b:
        once_a, once_b = Counter(a), Counter(b)
        where = {w: k for k, w in enumerate(b) if once_b[w] == 1}
        anchors = increasing([(k, where[w]) for k, w in enumerate(a) if once_a[w] == 1 and w in where])
        if anchors:
            last = (-1, -1)
            for x, y in [*anchors, (len(a), len(b))]:
                pairs += patience(a[last[0] + 1 : x], b[last[1] + 1 : y], a0 + last[0] + 1, b0 + last[1] + 1)
                if x < len(a):
                    pairs.append((a0 + x, b0 + y))
                last = (x, y)
        else:
            pairs += [(a0 + x, b0 + y) for x, y in common(a, b)]
    return pairs + end


def increasing(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of points increasing in both, by piles."""
    tops, piles, before = [], [], [-1] * len(points)
    for k, (_, y) in enumerate(points):
        at = bisect_left(tops, y)
        if at == len(tops):
            tops.append(y)
            piles.append(k)
        else:
            tops[at], piles[at] = y, k
        before[k] = piles[at - 1] if at else -1
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(points[k])
        k = before[k]
    return out[::-1]


def common(a: list, b: list) -> list[tuple[int, int]]:
    """A longest common subsequence of a gap without unique words in common."""
    shared = set(a) & set(b)
    xs, ys = [k for k, w in enumerate(a) if w in shared], [k for k, w in enumerate(b) if w in shared]
    best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for i in range(len(xs) - 1, -1, -1):
        for j in range(len(ys) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[xs[i]] == b[ys[j]] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(xs) and j < len(ys):
        if a[xs[i]] == b[ys[j]]:
            out.append((xs[i], ys[j]))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


class Template:
    """A template's words, and for each word the bits of its places, read forwards and backwards."""

    def __init__(self, name: str, body: str, least: float):
        self.name, self.words = name, words_of(body)
        self.counts, self.size = Counter(self.words), len(self.words)
        self.need = max(1, math.ceil(least * self.size - 1e-9))
        self.places: list[dict[str, int]] = [{}, {}]
        for k, w in enumerate(self.words):
            self.places[0][w] = self.places[0].get(w, 0) | 1 << k
            self.places[1][w] = self.places[1].get(w, 0) | 1 << (self.size - 1 - k)

    def reached(self, words: list[str], at: int, stop: int, step: int = 1) -> int | None:
        """The first place, from `at` in steps of 1 or -1 before `stop`, at which `need` words of the template are in order (read backwards with -1)."""
        places, full, row = self.places[step < 0], (1 << self.size) - 1, (1 << self.size) - 1
        for k in range(at, stop, step):
            hit = row & places[words[k]]
            row = ((row + hit) | (row - hit)) & full
            if self.size - row.bit_count() >= self.need:
                return k
        return None

    def furthest(self, words: list[str], at: int, stop: int, enough: int, step: int = 1) -> int:
        """The last place, `enough` or one further on, at which the common subsequence from `at` grows, in steps of at most a quarter of the template's words: nothing is read beyond."""
        places, full, row = self.places[step < 0], (1 << self.size) - 1, (1 << self.size) - 1
        last, length, most = enough, 0, max(8, self.size // 4)
        for k in range(at, stop, step):
            if length == self.size or (k - last) * step > most:
                break
            hit = row & places[words[k]]
            row = ((row + hit) | (row - hit)) & full
            if (now := self.size - row.bit_count()) > length:
                length, last = now, (max if step > 0 else min)(last, k)
        return last


class Scanner:
    """Matches of templates in a text, each (template, coverage, aligned words, first and end character)."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, least: float = LEAST, density: float = DENSITY):
        self.templates = [t for t in (Template(name, body, least) for name, body in sorted(templates.items())) if t.size]
        self.density = density

    def scan(self, text: str) -> list[tuple[str, float, int, int, int]]:
        low = text.lower()
        if len(low) != len(text):  # characters that grow in lower case: keep positions
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        seen = set(_WORDS.findall(low))
        likely = [t for t in self.templates if sum(n for w, n in t.counts.items() if w in seen) >= t.need]
        if not likely:
            return []
        spans = [(m.group(), m.start(), m.end()) for m in _WORDS.finditer(low)]
        found = [m for t in likely for m in self.matches(t, [(k, w) for k, (w, _, _) in enumerate(spans) if w in t.counts])]
        # a match within one of more aligned words is part of it
        found.sort(key=lambda m: (m[2], -m[3], -len(m[1]), m[0].name))
        out, best = [], []
        for t, pairs, first, last in found:
            if not any(b <= first and last <= e and n > len(pairs) for b, e, n in best):
                out.append((t.name, len(pairs) / t.size, len(pairs), spans[first][1], spans[last][2]))
            best = [x for x in best if x[1] >= first] + [(first, last, len(pairs))]
        return out

    def matches(self, t: Template, hits: list[tuple[int, str]]):
        """(template, pairs, first word, last word) of each match; hits are the text's words that the template has, with their number."""
        words, at = [w for _, w in hits], 0
        while at < len(words):
            end = t.reached(words, at, len(words))
            if end is None:
                return
            start = t.reached(words, end, at - 1, -1)
            if t.size < self.density * (hits[end][0] - hits[start][0] + 1):
                at = start + 1
                continue
            high = t.furthest(words, start, len(words), end)
            low = t.furthest(words, high, at - 1, start, -1)
            for a, b in ((low, high), (start, end)):
                pairs = patience(t.words, words[a : b + 1])
                if len(pairs) < t.need:
                    pairs = common(t.words, words[a : b + 1])
                first, last = hits[pairs[0][1] + a][0], hits[pairs[-1][1] + a][0]
                if len(pairs) >= self.density * (last - first + 1):
                    yield t, pairs, first, last
                    at = pairs[-1][1] + a + 1
                    break
            else:
                at = start + 1


def license_matches(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST, density: float = DENSITY) -> DataFrame:
    """RESULT: one row for each match, and one with a null template for a document without any."""

    def scan(batches):
        import pyarrow as pa

        scanner = Scanner(templates, least, density)
        kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
        for some in chunks(batches):
            out = []
            for r in some:
                out += [(r["doc_id"], *m) for m in scanner.scan(r["text"])] or [(r["doc_id"], None, 0.0, 0, None, None)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], [c.split()[0] for c in RESULT.split(", ")])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(scan, RESULT)


def license_report(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST, density: float = DENSITY) -> DataFrame:
    """One row for every row of docs: doc_id, n_matches, templates, best_template, best_coverage, matched_words."""

    @F.pandas_udf("n_matches long, templates string, best_template string, best_coverage double, matched_words long")
    def report(texts: pd.Series) -> pd.DataFrame:
        scanner, out = Scanner(templates, least, density), []
        for text in texts:
            found = scanner.scan(text or "")
            best = min(found, key=lambda m: (-m[1], m[0]), default=(None, 0.0))
            out.append((len(found), ",".join(sorted({m[0] for m in found})), best[0], best[1], sum(m[2] for m in found)))
        return pd.DataFrame(out, columns=["n_matches", "templates", "best_template", "best_coverage", "matched_words"])

    return docs.select("doc_id", report(text_or_empty()).alias("found")).select("doc_id", "found.*")
