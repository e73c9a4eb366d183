"""License scans by patience alignment of texts with license templates.

Words that stand once in the text and once in the template are anchors; the longest run of anchors in the same
order on both sides is taken, and each gap between neighbours is aligned in the same way. Where a gap has no
anchor, equal words at its two ends are taken. Coverage is the share of the template's words that are matched.

A text that repeats a notice, or reuses its words elsewhere, has few anchors as a whole. So the template is also aligned
with each region of the text that fits it best (``regions``), where words need be unique only there, and the best
coverage is kept: of equal ones the whole text's, then the first region's.

A template is aligned only where it can reach the coverage asked for: the text must hold that share of its
words at all. That test is exact and is made on word hashes for whole batches.

Edge cases: null and empty texts have no row. Each (text, template) is judged alone: templates that overlap in a text (a notice
inside a license, the LGPL beside the GPL) each have their row where each is covered, and of several copies of one license the best
gives the row. A repeated row has its rows repeated; words are lower-case runs of letters and digits.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelex.llm import textkit as K
from tidelex.llm.shared import small_batches

COVERAGE = 0.8
#: Words of the text that a region passes over rather than leave out one word of the template.
PASSED = 4
#: Notices and texts of public licenses.
TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
}
_WORD = re.compile(r"[a-z0-9]+")
_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[65:91] += 32
_BLANK[[b for b in range(256) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123)]] = 32


def words_of(text: str) -> list[str]:
    return _WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text) if not text.isascii() else text.lower())


def longest_rise(values: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence."""
    tails, at, back = [], [], [0] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        back[i] = at[k - 1] if k else -1
        tails[k : k + 1], at[k : k + 1] = [v], [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched positions of two word lists, ascending on both sides."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        seen: dict[str, int] = {}
        for i in range(a0, a1):
            seen[a[i]] = -1 if a[i] in seen else i
        there: dict[str, int] = {}
        for j in range(b0, b1):
            there[b[j]] = -1 if b[j] in there else j
        pairs = sorted((i, there[w]) for w, i in seen.items() if i >= 0 and there.get(w, -1) >= 0)
        pairs = [pairs[k] for k in longest_rise([j for _, j in pairs])]
        if not pairs:
            while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
                out.append((a0, b0))
                a0, b0 = a0 + 1, b0 + 1
            while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
                a1, b1 = a1 - 1, b1 - 1
                out.append((a1, b1))
            continue
        out += pairs
        x, y = a0, b0
        for i, j in [*pairs, (a1, b1)]:
            todo.append((x, i, y, j))
            x, y = i + 1, j + 1
    return sorted(out)


def dense_runs(hits: list[int], a: list[str], b: list[str], need: int) -> list[tuple[int, int]]:
    """Ranges of ``hits`` (positions in a of words of b) that hold all windows of (PASSED + 1) * len(b) words with ``need`` of b's words."""
    wanted, have, met, out, low = Counter(b), Counter(), 0, [], 0
    for high, p in enumerate(hits):
        have[a[p]] += 1
        met += have[a[p]] <= wanted[a[p]]
        while p - hits[low] >= (PASSED + 1) * len(b):
            w = a[hits[low]]
            met -= have[w] <= wanted[w]
            have[w] -= 1
            low += 1
        if met >= need:
            if out and low <= out[-1][1]:
                out[-1] = (out[-1][0], high + 1)
            else:
                out.append((low, high + 1))
    return out


def regions(a: list[str], b: list[str], need: int) -> list[tuple[int, int]]:
    """Ranges of a that hold at least ``need`` words of b in order, by position: for each place where a best fit of b
    begins, the one of least cost. Leaving out a word of b costs PASSED, passing over a word of a costs 1; a fit that
    costs more than leaving out all of b is none, so a range has at most (PASSED + 1) * len(b) words."""
    places: dict[str, list[int]] = {}
    for j, w in enumerate(b):
        places.setdefault(w, []).append(j)
    at = {w: np.array(j) for w, j in places.items()}
    hits = [i for i, w in enumerate(a) if w in at]
    # A fit's cost, and below it how late it begins: the least number is the cheapest fit, of equal ones the shortest.
    one, late = 1 << 32, (1 << 32) - 1
    left_out = np.arange(len(b) + 1, dtype=np.int64) * PASSED * one
    best: dict[int, tuple[int, int]] = {}
    for low, high in dense_runs(hits, a, b, need):
        before, fit = hits[low], left_out + (late - hits[low])
        for p in hits[low:high]:
            fit = np.minimum(fit + (p - before) * one, left_out + (late - p))
            j = at[a[p]]
            here = fit + one
            here[0] = late - p - 1
            here[j + 1] = np.minimum(here[j + 1], fit[j])
            fit = np.minimum.accumulate(here - left_out) + left_out
            before = p + 1
            cost, start = int(fit[-1]) >> 32, late - (int(fit[-1]) & late)
            if PASSED * len(b) + before - start - cost >= (PASSED + 1) * need:
                best[start] = min(best.get(start, (cost, before)), (cost, before))
    return [(start, best[start][1]) for start in sorted(best)]


def best_alignment(a: list[str], b: list[str], need: int) -> list[tuple[int, int]]:
    """Matched positions of the whole of a, or of the region of a where more of b is matched."""
    out = align(a, b)
    if len(out) < len(b):
        for low, high in regions(a, b, need):
            found = align(a[low:high], b)
            if len(found) > len(out):
                out = [(low + i, j) for i, j in found]
    return out


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, n_matched, first_word, last_word) of ``docs(doc_id, text)``: a row for each
    template that covers at least ``coverage``; the last two are positions among the text's words."""
    wanted = [(name, words_of(t)) for name, t in (templates or TEMPLATES).items()]
    small_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def hashed(words: list[str]) -> np.ndarray:
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        starts, ends, _ = K.word_spans(data, np.array([0, len(data)], np.int64))
        return K.word_hashes(data, starts, ends)

    def run(batches):
        known = np.unique(np.concatenate([hashed(w) for _, w in wanted]))
        # A template's words with their counts: those present bound its coverage.
        shares = np.zeros((len(known), len(wanted)))
        for k, (_, w) in enumerate(wanted):
            np.add.at(shares[:, k], np.searchsorted(known, hashed(w)), 1 / len(w))
        for batch in batches:
            for part in K.slices(batch, "text"):
                data, offsets = K.text_buffers(part.column("text"))
                data = _BLANK[data]
                starts, ends, texts = K.word_spans(data, offsets)
                h = K.word_hashes(data, starts, ends)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = np.flatnonzero(known[at] == h)
                owner = np.searchsorted(texts, hit, "right") - 1
                present = np.zeros((part.num_rows, len(known)), bool)
                present[owner, at[hit]] = True
                rows = []
                doubtful = present @ shares >= coverage - 1e-9
                for i in np.flatnonzero(doubtful.any(1)):
                    words = words_of(part.column("text")[int(i)].as_py())
                    for k in np.flatnonzero(doubtful[i]):
                        name, template = wanted[k]
                        need = math.ceil(coverage * len(template) - 1e-9)
                        found = best_alignment(words, template, need)
                        if len(found) >= need:
                            rows.append((part.column("doc_id")[int(i)].as_py(), name, len(found) / len(template), len(found), found[0][0], found[-1][0]))
                if rows:
                    kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "license", "coverage", "n_matched", "first_word", "last_word"])

    return source.mapInArrow(run, "doc_id long, license string, coverage double, n_matched long, first_word long, last_word long")
