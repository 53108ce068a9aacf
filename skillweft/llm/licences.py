"""Licence scans by patience alignment.

A text is compared with each template where a stretch of it holds enough of the template's words in order. There, words unique
to both the stretch of text and the template are anchors; their longest increasing subsequence is kept and the gaps between
anchors are aligned in the same way. Coverage is the share of the template's words that were aligned.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillweft.llm.common import arrow_map, batch, words

# Short notices by which works name their licence, standard headers, and whole texts of the short licences.
TEMPLATES: dict[str, str] = {
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-3-Clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense-notice": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "all-rights-reserved": "All rights reserved.",
}


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience sorting."""
    tops, at, back = [], [], [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        if k:
            back[i] = at[k - 1]
        if k == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def subsequence(a: list, b: list, i: int, j: int, p: int, q: int) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence of ``a[i:j]`` and ``b[p:q]``."""
    n = [[0] * (q - p + 1) for _ in range(j - i + 1)]
    for x in range(j - i - 1, -1, -1):
        for y in range(q - p - 1, -1, -1):
            n[x][y] = n[x + 1][y + 1] + 1 if a[i + x] == b[p + y] else max(n[x + 1][y], n[x][y + 1])
    out, x, y = [], 0, 0
    while x < j - i and y < q - p:
        if a[i + x] == b[p + y]:
            out.append((i + x, p + y))
            x, y = x + 1, y + 1
        elif n[x + 1][y] >= n[x][y + 1]:
            x += 1
        else:
            y += 1
    return out


def align(a: list, b: list, a0: int = 0, a1: int | None = None, b0: int = 0, b1: int | None = None) -> list[tuple[int, int]]:
    """Aligned positions of two word lists: equal ends first, then unique anchors, then the gaps between them.

    A gap without an anchor is aligned by a longest common subsequence.
    """
    out, stack = [], [(a0, len(a) if a1 is None else a1, b0, len(b) if b1 is None else b1)]
    while stack:
        i, j, p, q = stack.pop()
        while i < j and p < q and a[i] == b[p]:
            out.append((i, p))
            i, p = i + 1, p + 1
        while i < j and p < q and a[j - 1] == b[q - 1]:
            j, q = j - 1, q - 1
            out.append((j, q))
        if i == j or p == q:
            continue
        left, right = Counter(a[i:j]), Counter(b[p:q])
        place = {w: k for k, w in enumerate(b[p:q], p) if right[w] == 1}
        anchors = [(k, place[w]) for k, w in enumerate(a[i:j], i) if left[w] == 1 and w in place]
        chosen = [anchors[k] for k in increasing([y for _, y in anchors])]
        if not chosen:
            if not left.keys().isdisjoint(right):
                out += subsequence(a, b, i, j, p, q)
            continue
        out += chosen
        ends = [(i - 1, p - 1), *chosen, (j, q)]
        stack += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(ends, ends[1:], strict=False)]
    return sorted(out)


#: Words that most texts hold; others are sought first. Any choice finds the same places.
COMMON = frozenset(words("a all an and any are as at be by copies copy do file following for form free from have if in is it may must not of on or other out own rights see source that the their this to under use with without work you your"))


class Scanner:
    """Templates prepared for scanning; ``least`` is the coverage that counts as found.

    A stretch that covers ``least`` of a template lacks at most ``miss`` of its words, so it holds one of any ``miss + 1``
    different ones. Texts are searched for these, and alignments are tried only around them.
    """

    def __init__(self, templates: dict[str, str], least: float = 0.8) -> None:
        self.least, self.names = least, sorted(templates)
        self.texts = [words(templates[n]) for n in self.names]
        self.ids = {w: i + 1 for i, w in enumerate(sorted({w for t in self.texts for w in t}))}
        self.miss = [len(t) - max(1, math.ceil(least * len(t) - 1e-9)) for t in self.texts]
        self.span = [len(t) + 3 * (2 + len(t) // 4) for t in self.texts]
        self.held = [frozenset(self.ids[w] for w in t) for t in self.texts]
        self.masks: list[dict[int, int]] = []
        self.seeds: dict[int, list[int]] = {}
        for t, ws in enumerate(self.texts):
            bits: dict[int, int] = {}
            for i, w in enumerate(ws):
                bits[self.ids[w]] = bits.get(self.ids[w], 0) | 1 << i
            self.masks.append(bits)
            for w in sorted(set(ws), key=lambda w: (w in COMMON, -len(w), w))[: self.miss[t] + 1]:
                self.seeds.setdefault(self.ids[w], []).append(t)
        self.seeding = np.zeros(len(self.ids) + 1, bool)
        self.seeding[list(self.seeds)] = True

    def stretches(self, t: int, codes: list[int], a: int, z: int) -> list[tuple[int, int, int]]:
        """``(-common words, length, start)`` of stretches in ``codes[a:z]`` that share enough words in order with template ``t``.

        From each word that can be the first, the longest common subsequence with the template grows word by word, as bits of
        one integer; where it grows, a stretch ends.
        """
        bits, size = self.masks[t], len(self.texts[t])
        full, need = (1 << size) - 1, size - self.miss[t]
        first = {self.ids[w] for w in self.texts[t][: self.miss[t] + 1]}
        places = [i for i in range(a, z) if codes[i] in bits]
        out = []
        for k, i in enumerate(places):
            if codes[i] not in first:
                continue
            v, n = full, 0
            for j in places[k:]:
                if j - i >= self.span[t]:
                    break
                u = v & bits[codes[j]]
                v = ((v + u) | (v - u)) & full
                if (now := size - v.bit_count()) > n:
                    n = now
                    if n >= need:
                        out.append((-n, j + 1 - i, i))
                        if n == size:
                            break
        return out

    def scan(self, ws: list[bytes]) -> list[tuple[str, int, int, float]]:
        """``(licence, first word, word after the last, coverage)`` of each place where a template is covered, in order.

        Of overlapping stretches of a template the one with the most words in common and then the shortest counts, so each of
        several copies is found. Where several templates cover the same words, the one with the highest coverage and then
        the most words counts.
        """
        row = np.fromiter((self.ids.get(w, 0) for w in ws), np.int32, len(ws))
        at: dict[int, list[int]] = {}
        for i in np.flatnonzero(self.seeding[row]).tolist():
            for t in self.seeds[int(row[i])]:
                at.setdefault(t, []).append(i)
        if not at:
            return []
        codes = row.tolist()
        held, out = set(codes), []
        for t, places in at.items():
            template, few = self.texts[t], len(self.held[t]) - self.miss[t]
            if len(held & self.held[t]) < few:
                continue
            found, k = [], 0
            while k < len(places):
                a = max(0, places[k] - self.span[t] + 1)
                z = places[k] + self.span[t]
                while k < len(places) and places[k] - self.span[t] < z:
                    z = places[k] + self.span[t]
                    k += 1
                if len(self.held[t].intersection(codes[a:z])) >= few:
                    found += self.stretches(t, codes, a, min(z, len(codes)))
            taken = bytearray(len(ws))
            for _, n, i in sorted(found):
                if taken.find(1, i, i + n) >= 0:
                    continue
                pairs = align(ws, template, i, i + n)
                covered = len(pairs) / len(template)
                if pairs and covered >= self.least:
                    begin, end = pairs[0][0], pairs[-1][0] + 1
                    taken[begin:end] = b"\1" * (end - begin)
                    out.append((self.names[t], begin, end, covered, len(template)))
        # where templates overlap, the one that is covered best and has more words
        kept: list[tuple[str, int, int, float]] = []
        taken = bytearray(len(ws))
        for *hit, _ in sorted(out, key=lambda x: (-x[3], -x[4], x[1], x[0])):
            if taken.find(1, hit[1], hit[2]) < 0:
                taken[hit[1] : hit[2]] = b"\1" * (hit[2] - hit[1])
                kept.append(tuple(hit))
        return sorted(kept, key=lambda x: x[1])


_TYPES = {"doc_id": pa.int64(), "licence": pa.string(), "start_word": pa.int64(), "end_word": pa.int64(), "coverage": pa.float64()}


def licence_scan(documents: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """A row ``doc_id, licence, start_word, end_word, coverage`` for each covered template in each whole text.

    The law: a place of a template of ``n`` words is a stretch of at most ``n + 3 * (2 + n // 4)`` words that holds ``least`` of
    them in order. Of a template's overlapping places the one with the most words in common, then the shortest, then the
    first counts; so does, of different templates', the one that is covered best, then the longer template. A template that
    occurs twice gives two rows. Words are those of ``common.words``. Null and empty texts give none; rows with
    null or repeated ids each give their own; other columns are ignored; templates without words are never found.
    """
    chosen = TEMPLATES if templates is None else templates

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen, least)
        for b in batches:
            rows = [(doc, *hit) for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) for hit in scanner.scan(words(text))]
            yield batch(dict(zip(_TYPES, map(list, zip(*rows, strict=True)), strict=True)) if rows else {k: [] for k in _TYPES}, _TYPES)

    return arrow_map(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), scan, "doc_id long, licence string, start_word long, end_word long, coverage double")
