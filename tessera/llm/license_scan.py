"""License scan: shared grams and dense stretches of words find candidates, banded alignment confirms them.

Templates and texts are word sequences, lower-cased and without punctuation. All grams of GRAM words
of the templates form an inverted index, as small as the templates and broadcast; all grams of a text
are looked up. Hits of one template whose diagonals lie within its reach make one candidate: 2 * BAND,
for long templates their length, 4 * BAND at least, and as much on both sides, so that inserted words,
such as a holder's name and address, don't split a notice. Changes can also leave no gram whole: stretches of up to one and a half times a template's
length that hold enough of its words are candidates too. A candidate whose longest common subsequence
is long enough gives one alignment of the template against that part of the text, within a band. A
match has its share of the template's words and its place in the text, in characters.

Words that decide which license it is must be in the matched part: those of a template that hold a digit
or are in DECIDING; and words in DECIDING that the template lacks must not be. So another version or
variant of a license isn't a match, however many words it shares.

Defined results: null or empty text has no match, and texts are read whole, however long; a text with
the same notice twice has two matches; of overlapping matches the one with more matching words stays,
then the one with higher coverage, then the first in order of name. Rows that repeat each get their
matches, also without a doc_id; an empty table gives no rows. Columns other than doc_id and text are
not read.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .common import spread

GRAM, BAND, LEAST_COVERAGE = 3, 8, 0.8
LONG = 16  # words of a template from which on runs of words can be put in
WORDS_KEPT = 500_000
EDGES = ".,;:!?|\"'()[]{}<>*&%$#_-/\\`~^=+«»¡¿“”‘’"

#: Notices of public licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "Apache-2.0-disclaimer": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-ND-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-ND-4.0-long": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "MIT-warranty": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "rights-reserved": "All rights reserved.",
    "rights-reserved-long": "All rights reserved. No part of this publication may be reproduced without permission.",
}


#: Words that tell licenses and their variants apart.
DECIDING = (
    "affero lesser library limited agpl lgpl gpl gnu mozilla mpl apache mit bsd isc boost unlicense eclipse "
    "attribution attribution-sharealike attribution-noderivatives attribution-noncommercial attribution-noncommercial-sharealike attribution-noncommercial-noderivatives "
    "noncommercial noderivatives sharealike by by-sa by-nd by-nc by-nc-sa by-nc-nd cc0"
).split()


class Words:
    """Hashes of normalised words; 0 for a word that is all punctuation."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        for w in set(words).difference(self.known):
            plain = w.strip(EDGES).lower()
            self.known[w] = xxhash.xxh3_64_intdigest(plain) | 1 if plain else 0
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


def grams(codes: np.ndarray) -> np.ndarray:
    out = np.zeros(max(0, len(codes) - GRAM + 1), np.uint64)
    for k in range(GRAM):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[k : len(codes) - GRAM + 1 + k]
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


class Index:
    def __init__(self, templates: dict[str, str], least: float = LEAST_COVERAGE):
        words = Words()
        self.names = sorted(templates)
        self.codes = [(c := words.of(templates[n].split()))[c != 0] for n in self.names]
        entries = sorted((int(h), k, at) for k, c in enumerate(self.codes) for at, h in enumerate(grams(c)))
        self.hashes = np.array([e[0] for e in entries], np.uint64)
        self.owner, self.at = np.array([e[1] for e in entries]), np.array([e[2] for e in entries])
        self.need = [max(GRAM, math.ceil(least * len(c) - 1e-9)) for c in self.codes]
        telling = words.of(DECIDING)
        own = [{int(words.of([w])[0]) for w in templates[n].split() if any(map(str.isdigit, w.strip(EDGES)))} for n in self.names]
        # of the words that decide: those that a match must hold, and those that it must not
        self.must = [np.array(sorted(d | set(telling.tolist()) & set(c.tolist())), np.uint64) for d, c in zip(own, self.codes, strict=True)]
        self.never = [np.setdiff1d(telling, c) for c in self.codes]
        self.spans = [len(c) + len(c) // 2 for c in self.codes]
        # per template the places of each word as bits; per word the templates that hold it
        self.bits: list[dict[int, int]] = [{} for _ in self.codes]
        for held, c in zip(self.bits, self.codes, strict=True):
            for i, w in enumerate(c.tolist()):
                held[w] = held.get(w, 0) | 1 << i
        self.vocabulary = np.unique(np.concatenate([np.zeros(1, np.uint64), *self.codes]))  # 0 stands for none
        self.holds = np.stack([np.isin(self.vocabulary, c) for c in self.codes], axis=1) if self.codes else np.zeros((1, 0), bool)

    def common(self, owner: int, codes: np.ndarray) -> int:
        """Length of the longest common subsequence of a template and codes."""
        bits, n = self.bits[owner], len(self.codes[owner])
        full = v = (1 << n) - 1
        for c in codes.tolist():
            if m := bits.get(c):
                u = v & m
                v = ((v + u) | (v - u)) & full
        return n - v.bit_count()

    def decided(self, owner: int, codes: np.ndarray) -> bool:
        """Whether a matched part of a text holds the words that tell this template from others, and no other's."""
        return bool(np.isin(self.must[owner], codes).all()) and not np.isin(self.never[owner], codes).any()

    def candidates(self, codes: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, first diagonal, last diagonal): hits of one template within its reach are one candidate,
        widened by it for long templates; each longest set of hits is one, so sets can overlap."""
        h = grams(codes)
        lo, hi = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        some = np.flatnonzero(hi > lo)
        hits = sorted({(int(self.owner[e]), int(i) - int(self.at[e])) for i in some.tolist() for e in range(lo[i], hi[i])})
        out: list[tuple[int, int, int]] = []
        end = 0
        for k, (owner, diagonal) in enumerate(hits):
            n, before = len(self.codes[owner]), end
            reach = 2 * BAND if n < LONG else max(4 * BAND, n)
            wider = 0 if n < LONG else reach - BAND
            end = max(end, k)
            while end < len(hits) and hits[end][0] == owner and hits[end][1] - diagonal <= reach:
                end += 1
            if end > before:
                out.append((owner, diagonal - wider, hits[end - 1][1] + wider))
        return out

    def dense(self, codes: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, first and end word): pieces of the text such that each stretch of a template's span
        that holds as many of its words as a match needs lies in one piece."""
        at = np.searchsorted(self.vocabulary, codes)
        at[at == len(self.vocabulary)] = 0
        at[self.vocabulary[at] != codes] = 0
        held = self.holds[at]
        out = []
        for owner in np.flatnonzero(held.sum(axis=0) >= self.need).tolist():
            span = self.spans[owner]
            total = np.concatenate([[0], np.cumsum(held[:, owner])])
            starts = np.arange(max(1, len(codes) - span + 1))
            full = np.flatnonzero(total[np.minimum(starts + span, len(codes))] - total[starts] >= self.need[owner])
            while len(full):
                first = int(full[0])
                full = full[np.searchsorted(full, first + span, "right") :]
                out.append((owner, first, min(len(codes), first + 2 * span)))
        return out


def align(template: np.ndarray, codes: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """(matching words, first and end word in the text) of the longest common subsequence on the diagonals
    low - BAND to high + BAND; of equally long ones one that ends, then begins, where the text span is short."""
    low, high = low - BAND, high + BAND
    width = high - low + 1
    # per diagonal: matches so far, and minus the place of the first matching word
    best = [(0, 0)] * width
    end_best = (0, 0, 0)
    for i in range(len(template)):
        new = [(0, 0)] * width
        for k in range(width):
            j = i + low + k
            value = best[k]
            if 0 <= j < len(codes) and codes[j] == template[i]:
                n, first = value
                value = (n + 1, first if n else -j)
                if (value[0], -j - 1 - value[1]) > (end_best[0], end_best[1] - end_best[2]):
                    end_best = (value[0], -value[1], j + 1)
            elif k + 1 < width and best[k + 1] > value:  # a template word is skipped
                value = best[k + 1]
            if k and new[k - 1] > value:  # a text word is skipped
                value = new[k - 1]
            new[k] = value
        best = new
    return end_best


def matches(index: Index, words: Words, text: str | None, least: float = LEAST_COVERAGE) -> list[tuple[str, float, int, int]]:
    """(template, coverage, first character, end character) of a text."""
    plain = text.split() if text else []
    codes = words.of(plain)
    kept = np.flatnonzero(codes)
    codes = codes[kept]
    found: list[tuple] = []
    free: dict[int, np.ndarray] = {}  # the text without what was found of a template

    def look(owner: int, rest: np.ndarray, first: int, end: int, low: int, high: int) -> None:
        template, first = index.codes[owner], max(0, first)
        while index.common(owner, rest[first:end]) >= need[owner]:  # a candidate can hold a notice several times
            n, start, stop = align(template, rest, low, high)
            if n < need[owner]:
                break
            if not index.decided(owner, rest[start:stop]):
                rest[start:stop] = 0  # another version or variant
                continue
            found.append((-n, -n / len(template), index.names[owner], int(kept[start]), int(kept[stop - 1]) + 1))
            rest[start:stop] = 0
            if owner not in free:
                free[owner] = codes.copy()
            free[owner][start:stop] = 0

    need = [max(GRAM, math.ceil(least * len(c) - 1e-9)) for c in index.codes]
    for owner, low, high in index.candidates(codes):
        first, end = low - BAND, high + BAND + len(index.codes[owner])
        part = codes.copy() if index.common(owner, codes[max(0, first) : end]) >= need[owner] else None
        if part is not None:
            look(owner, part, first, end, low, high)
    for owner, first, end in index.dense(codes):
        rest = free.get(owner, codes)
        if index.common(owner, rest[first:end]) >= need[owner]:
            # all diagonals of this piece; align() widens them by BAND
            miss = len(index.codes[owner]) - need[owner]
            part = np.zeros_like(rest)
            part[first:end] = rest[first:end]
            look(owner, part, first, end, first - miss + BAND, end - need[owner] - BAND)
    if not found:
        return []
    places = [m.span() for m in re.finditer(r"\S+", text)]
    out, taken = [], []
    for n, coverage, name, first, end in sorted(found):
        if all(end <= a or b <= first for a, b in taken):
            taken.append((first, end))
            out.append((name, -coverage, places[first][0], places[end - 1][1]))
    return sorted(out, key=lambda x: (x[2], x[0]))


def scan(spark: SparkSession, docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST_COVERAGE) -> DataFrame:
    """doc_id, license, coverage, start, stop: a row for each match."""
    held = spark.sparkContext.broadcast(Index(templates or TEMPLATES, least))  # as large as the templates

    def run(batches):
        words = Words()
        for batch in batches:
            rows = [(i, *m) for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for m in matches(held.value, words, text.as_py(), least)]
            if rows:
                kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "license", "coverage", "start", "stop"])

    return spread(docs.selectExpr("cast(doc_id as long) doc_id", "text")).mapInArrow(run, "doc_id long, license string, coverage double, start long, stop long")
