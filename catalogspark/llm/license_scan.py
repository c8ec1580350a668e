"""License notices in documents: winnowed fingerprints of the templates form an inverted index that picks candidates
(template, place); a banded alignment of words then reports how much of the template is there, and where."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .kernels import NOT_ALNUM, Words, _combine, text_chunks

#: Words in a fingerprint, and fingerprints in a window of which the least is kept: every run of GRAM + WINDOW - 1 words
#: that a document shares with a template holds a common fingerprint.
GRAM, WINDOW = 3, 2
#: Insertions and deletions that an alignment may be off its diagonal by.
BAND = 12
MIN_COVERAGE = 0.7
#: Templates with fewer words are found word by word only.
SHORT = 10
#: Where two templates differ by so few words, these words tell them apart and must be there.
TELLING = 4

#: Notices as their licences word them, without names of holders.
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_ADS = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. "
_BSD_NAME = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_NO_WARRANTY = "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the"
TEMPLATES: Mapping[str, str] = {
    "MIT-short": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-2.0-short": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-2.1-short": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0-short": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-short": "This work is licensed under the GNU Affero General Public License, version 3.",
    "GPL-2.0": f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program {_NO_WARRANTY} GNU General Public License for more details.",
    "GPL-3.0": f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program {_NO_WARRANTY} GNU General Public License for more details.",
    "LGPL-2.1": f"This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library {_NO_WARRANTY} GNU Lesser General Public License for more details.",
    "LGPL-3.0": f"This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library {_NO_WARRANTY} GNU Lesser General Public License for more details.",
    "AGPL-3.0": f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program {_NO_WARRANTY} GNU Affero General Public License for more details.",
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD + "3. " + _BSD_NAME + _BSD_TAIL,
    "BSD-4-Clause": _BSD_HEAD + _BSD_ADS + "4. " + _BSD_NAME + _BSD_TAIL,
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
} | {
    f"CC-{kind}-4.0-short": f"Licensed under CC {kind} 4.0." for kind in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND")
} | {
    f"CC-{kind}-4.0": f"This work is licensed under a Creative Commons {words} 4.0 International License."
    for kind, words in {
        "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial",
        "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
    }.items()
}


def _winnow(h: np.ndarray) -> np.ndarray:
    """Places of the fingerprints kept: the last least of each window; of fewer, the least."""
    if len(h) <= WINDOW:
        return np.array([len(h) - 1 - int(np.argmin(h[::-1]))]) if len(h) else np.zeros(0, int)
    windows = np.lib.stride_tricks.sliding_window_view(h, WINDOW)
    return np.unique(np.arange(len(windows)) + WINDOW - 1 - np.argmin(windows[:, ::-1], axis=1))


def _grams(h: np.ndarray) -> np.ndarray:
    return _combine([h[k : len(h) - GRAM + 1 + k] for k in range(GRAM)]) if len(h) >= GRAM else np.zeros(0, np.uint64)


class TemplateIndex:
    """Word hashes of each template, its fingerprints as sorted (hash, template, place), and the places of the words that
    tell it from others. Templates under GRAM words have no fingerprint and are listed in ``tiny``."""

    def __init__(self, templates: Mapping[str, str]):
        self.names = list(templates)
        self.words: list[np.ndarray] = []
        entries = []
        for t, text in enumerate(templates.values()):
            (_, _, data, offsets), *_ = text_chunks(pa.array([text or ""]), 1 << 30)
            h = Words(data, offsets, NOT_ALNUM).hash
            self.words.append(h)
            grams = _grams(h)
            entries += [(int(grams[p]), t, int(p)) for p in _winnow(grams)]
        entries.sort()
        self.hashes = np.array([e[0] for e in entries], np.uint64)
        self.template = np.array([e[1] for e in entries], np.int64)
        self.place = np.array([e[2] for e in entries], np.int64)
        self.tiny = [t for t, w in enumerate(self.words) if 0 < len(w) < GRAM]
        self.telling: list[frozenset[int]] = []
        long = [t for t, w in enumerate(self.words) if len(w) >= SHORT]
        for t, own in enumerate(self.words):
            apart: set[int] = set()
            for other in long if len(own) >= SHORT else ():
                if other != t and abs(len(own) - len(self.words[other])) <= TELLING:
                    pairs = align(own, self.words[other], -TELLING, TELLING)
                    if len(pairs) >= min(len(own), len(self.words[other])) - TELLING:
                        apart |= set(range(len(own))) - {i for i, _ in pairs}
            self.telling.append(frozenset(apart))

    def lookup(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``grams`` that are fingerprints of templates, their first entries)."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, grams), len(self.hashes) - 1)
        places = np.flatnonzero(self.hashes[at] == grams)
        return places, at[places]


def align(template: np.ndarray, words: np.ndarray, low: int, high: int) -> list[tuple[int, int]]:
    """(place in template, place in words) of the words matched in order by the best alignment whose places differ by
    ``low`` to ``high``; a row of the band at a time."""
    n, width = len(template), high - low + 1
    best = np.zeros((n + 1, width + 1), np.int32)  # the last column stands for what is right of the band
    for i in range(1, n + 1):
        j = i - 1 + low + np.arange(width)
        inside = (j >= 0) & (j < len(words))
        hit = np.where(inside & (words[np.clip(j, 0, max(len(words) - 1, 0))] == template[i - 1]), best[i - 1, :width] + 1, 0) if len(words) else np.zeros(width, np.int32)
        best[i, :width] = np.maximum.accumulate(np.maximum(best[i - 1, 1:], hit))
    end = best[n, :width]
    # of equally good ends the one nearest to the middle, so that each of two near copies is found from its own
    goals = np.flatnonzero(end == end.max())
    i, c, pairs = n, int(goals[np.argmin(np.abs(goals - width // 2))]), []
    while i > 0 and best[i, c] > 0:
        j = i - 1 + low + c
        if 0 <= j < len(words) and template[i - 1] == words[j] and best[i, c] == best[i - 1, c] + 1:
            pairs.append((i - 1, j))
            i -= 1
        elif c and best[i, c] == best[i, c - 1]:
            c -= 1
        else:
            i, c = i - 1, c + 1
    return pairs[::-1]


def _regions(shifts: list[int], n: int) -> list[tuple[int, int]]:
    """Shifts of one template taken together: neighbours within BAND, as long as all lie within half a template."""
    out: list[tuple[int, int]] = []
    for s in shifts:
        if out and s - out[-1][1] <= BAND and s - out[-1][0] <= max(BAND, n // 2):
            out[-1] = (out[-1][0], s)
        else:
            out.append((s, s))
    return out


def _findings(index: TemplateIndex, h: np.ndarray, coverage: float) -> list[tuple[int, int, int, int]]:
    """(template, first word, last word, words matched) in one document, in page order and without overlaps."""
    hits: dict[int, set[int]] = {}
    places, entries = index.lookup(_grams(h))
    for place, k in zip(places.tolist(), entries.tolist(), strict=True):
        fingerprint = index.hashes[k]
        while k < len(index.hashes) and index.hashes[k] == fingerprint:
            hits.setdefault(int(index.template[k]), set()).add(place - int(index.place[k]))
            k += 1
    for t in index.tiny:
        n = len(index.words[t])
        starts = range(max(len(h) - n + 1, 0))
        hits[t] = set(np.flatnonzero(h == index.words[t][0]).tolist()) & set(starts)
    found = []
    for t, shifts in hits.items():
        own, n = index.words[t], len(index.words[t])
        if n < SHORT:
            found += [(t, s, s + n - 1, n) for s in shifts if s >= 0 and s + n <= len(h) and (h[s : s + n] == own).all()]
            continue
        telling = sorted(index.telling[t])
        for low, high in _regions(sorted(shifts), n):
            start = max(0, low - BAND)  # only the words that the band reaches
            end = min(len(h), high + BAND + n)
            todo = [(start, end)]
            while todo:  # what is left and right of a finding may hold another
                a, b = todo.pop()
                there = np.isin(own, h[a:b])  # no alignment matches more
                if there.sum() < coverage * n or not there[telling].all():
                    continue
                pairs = align(own, h[a:b], low - BAND - a, high + BAND - a)
                if len(pairs) < coverage * n:
                    continue
                first, last = pairs[0][1] + a, pairs[-1][1] + a
                if len(pairs) >= coverage * (last - first + 1) and {i for i, _ in pairs}.issuperset(telling):
                    found.append((t, first, last, len(pairs)))
                todo += [(a, first), (last + 1, b)]
    # of findings that overlap, the one with most words matched less words between; then the shorter template
    taken: list[tuple[int, int, int, int]] = []
    for f in sorted(set(found), key=lambda f: (-(2 * f[3] - (f[2] - f[1] + 1)), len(index.words[f[0]]), f[0], f[1])):
        at = bisect_right(taken, f[1], key=lambda g: g[1])
        if (at == 0 or taken[at - 1][2] < f[1]) and (at == len(taken) or taken[at][1] > f[2]):
            taken.insert(at, f)
    return taken


def _scan(index: TemplateIndex, coverage: float):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = []
            for a, _, data, offsets in text_chunks(batch.column("text")):
                words = Words(data, offsets, NOT_ALNUM)
                places = index.lookup(_grams(words.hash))[0]
                if index.tiny:
                    places = np.union1d(places, np.flatnonzero(np.isin(words.hash, [index.words[t][0] for t in index.tiny])))
                for d in np.unique(np.searchsorted(words.first, places, "right") - 1).tolist():
                    lo, hi = int(words.first[d]), int(words.first[d + 1])
                    findings = _findings(index, words.hash[lo:hi], coverage)
                    if findings:
                        head, text = int(offsets[d]), data[offsets[d] : offsets[d + 1]]
                        before = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])  # code points before each byte
                    for t, first, last, matched in findings:
                        begin, end = int(before[int(words.start[lo + first]) - head]), int(before[int(words.end[lo + last]) - head])
                        rows.append((ids[a + d], index.names[t], begin, end, matched, len(index.words[t])))
            yield pa.record_batch(
                [pa.array([r[k] for r in rows], kind) for k, kind in enumerate([pa.int64(), pa.string(), *[pa.int64()] * 4])],
                names=["doc_id", "template", "begin", "end", "matched", "words"],
            )

    return run


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, coverage: float = MIN_COVERAGE) -> DataFrame:
    """(doc_id, template, begin, end, matched, words, coverage): each place of a document where at least ``coverage`` of
    a template's words stand in order, none further than BAND words off, and make up as large a part of the words from
    the first to the last of them; ``begin`` and ``end`` are code points.

    Words are runs of letters and digits, A-Z lower-cased. Where two templates differ by TELLING words or less, these
    words must be there. Templates under SHORT words are found word by word only, those under GRAM words without
    fingerprints; one without words is found nowhere, and without templates there are no rows. Of findings that overlap
    the one with most matched words, less words between, stays. Documents with null or empty texts, or without a notice,
    have no row; repeated rows are scanned each; a null doc_id stays null; an empty table gives no rows; further columns
    are ignored. The templates go to every task."""
    index = docs.sparkSession.sparkContext.broadcast(TemplateIndex(templates))

    def run(batches):
        yield from _scan(index.value, coverage)(batches)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = source.mapInArrow(run, "doc_id long, template string, begin long, end long, matched long, words long")
    return found.withColumn("coverage", F.col("matched") / F.col("words"))
