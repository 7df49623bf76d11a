"""License scan: MinHash bands over overlapping text windows, then exact shingle containment.

Templates and texts are compared by 5-word shingles (words: runs of ASCII letters, digits and non-ASCII bytes of the
lower-cased text, so case, punctuation and line breaks do not count). A template of n shingles is looked for in windows of
whole strides that are wide enough for some window to hold every occurrence whole (stride n/4, at least one shingle; sizes
are rounded up to a grid, so many templates share their windows). For an occurrence with containment `MIN_CONTAINMENT` the
window's similarity to the template has a lower bound; the number of bands is chosen so that a window at that bound shares a
band with probability 1 - `MISS`. The bound is taken for windows that hold `RETRIEVED` of the template where text may be
inserted into it: such a notice stands in no window whole. Windows that share a band are verified: the share of the
template's shingles that stand in the window. Overlapping verified windows are one match, with the best window's
containment and from its first to its last shingle. Around windows that fail, the span is widened to both sides for as long
as a further shingle of the template follows, at most a template's length of words on; it is a match if its parts outside
other matches hold the share.

Null, empty and shorter-than-a-shingle texts match nothing; very long texts are scanned whole. Repeated rows give repeated
matches; equal matches of several templates are each reported; empty tables give an empty result; extra columns are not
read. Templates are a bounded constant (or parameter) and are broadcast.
"""

from __future__ import annotations

from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PUNCTUATED, CodeTable, bounded_batches, flat, mix64, row_blocks, shingle_hashes, word_hashes

SHINGLE = 5
MIN_CONTAINMENT = 0.8
RETRIEVED = 0.6
MISS = 1e-3
# Fixed values: (license, template name, text); public license notices.
TEMPLATES = [
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice-licensed", "This project is licensed under the MIT License."),
    ("MIT", "permission", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, "
     "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
     "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all "
     "copies or substantial portions of the Software."),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
     "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed "
     "to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
     "either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
     "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
     "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
     "FOR A PARTICULAR PURPOSE."),
    ("BSD", "conditions", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
     "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
     "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
     "documentation and/or other materials provided with the distribution."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("MPL-2.0", "header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
     "with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MIT", "disclaimer", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
     "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
     "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
     "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD", "disclaimer", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT "
     "NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("ISC", "permission", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
     "the above copyright notice and this permission notice appear in all copies."),
    ("Zlib", "permission", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
     "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
     "alter it and redistribute it freely, subject to the following restrictions"),
    ("AGPL-3.0", "header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
     "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "header", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
     "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
]
_SEEDS = np.random.default_rng(23).integers(1, 2**63, (2, 256), dtype=np.uint64)
_NONE = np.uint64(2**64 - 1)


def grid_size(n: int) -> int:
    """The next size of the grid 1, 2, 3, 4, 6, 8, 12, 16, 24, ..."""
    size = 1
    while size < n:
        size = size * 3 // 2 if size & (size - 1) == 0 and size > 1 else 2 if size == 1 else size * 4 // 3
    return size


def windows_for(n: int) -> tuple[int, int]:
    """(stride, strides per window) for templates of at most n shingles: any n consecutive shingles lie in one window."""
    stride = max(1, n // 4)
    return stride, ceil((n + stride - 1) / stride)


def similarity_bound(n: int, window: int, containment: float = MIN_CONTAINMENT) -> float:
    need = ceil(containment * n - 1e-9)
    return need / (n + window - need)


def bands_for(similarity: float, miss: float = MISS) -> tuple[int, int]:
    """(rows, bands) with (1 - similarity**rows)**bands <= miss; two rows where that takes at most 48 coordinates."""
    if similarity >= 1:
        return 1, 1
    for rows in (2, 1):
        bands = ceil(log(miss) / log(1 - similarity**rows))
        if rows * bands <= 48 or rows == 1:
            return rows, bands
    raise AssertionError


def _band_keys(low: np.ndarray, rows: int) -> np.ndarray:
    """(windows, bands) keys of MinHash coordinates (windows, rows * bands)."""
    n, k = low.shape
    key = np.zeros((n, k // rows), np.uint64)
    for r in range(rows):
        key = key * np.uint64(0xD1342543DE82EF95) + low[:, r::rows]
    return mix64(key + np.arange(k // rows, dtype=np.uint64)[None, :])


class Templates:
    """Templates by window class, with their band index."""

    def __init__(self, templates=None, containment: float = MIN_CONTAINMENT, miss: float = MISS):
        self.names, self.sets, self.sizes, self.containment = [], [], [], containment
        classes: dict[int, list[int]] = {}
        for name, kind, text in TEMPLATES if templates is None else templates:
            buf = np.frombuffer(text.lower().encode(), np.uint8)
            words = word_hashes(buf, np.array([0, len(buf)]), PUNCTUATED)[0]
            if len(words) < SHINGLE:
                raise ValueError(f"template {name}/{kind} is shorter than a shingle")
            classes.setdefault(grid_size(len(words) - SHINGLE + 1), []).append(len(self.sets))
            self.names.append((name, kind)), self.sets.append(np.unique(shingle_hashes(words, SHINGLE))), self.sizes.append(len(words) - SHINGLE + 1)
        self.classes = []
        for size, members in sorted(classes.items()):
            stride, per = windows_for(size)
            rows, bands = bands_for(min(similarity_bound(len(self.sets[t]), stride * per, self._held(t)) for t in members), miss)
            keys = [_band_keys(np.array([[self._image(self.sets[t], k).min() for k in range(rows * bands)]], np.uint64), rows)[0] for t in members]
            flat_keys, of = np.concatenate(keys), np.repeat(members, bands)
            order = np.argsort(flat_keys, kind="stable")
            unique, first, count = np.unique(flat_keys[order], return_index=True, return_counts=True)
            self.classes.append((stride, per, rows, bands, CodeTable(unique), first, count, of[order]))

    def _held(self, t: int) -> float:
        """Share of the template that a window is sure to be retrieved with; an insertion breaks SHINGLE - 1 shingles, which
        short templates cannot miss."""
        n = len(self.sets[t])
        return min(RETRIEVED, self.containment) if n - SHINGLE + 1 >= self.containment * n else self.containment

    @staticmethod
    def _image(h: np.ndarray, k: int) -> np.ndarray:
        return h * (_SEEDS[0, k] | np.uint64(1)) + _SEEDS[1, k]

    def retrieve(self, shingle: np.ndarray, first: np.ndarray, n: np.ndarray):
        """(template, document, first shingle, last + 1) of the windows that share a band; `shingle` is _NONE where none starts."""
        for stride, per, rows, bands, index, at, count, of in self.classes:
            blocks = -(-n // stride)
            doc = np.repeat(np.arange(len(n)), blocks)
            if not len(doc):
                continue
            start = first[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * stride
            last = doc[1:] != doc[:-1]
            low = np.empty((len(doc), rows * bands), np.uint64)
            for k in range(rows * bands):
                image = self._image(shingle, k)
                image[shingle == _NONE] = _NONE
                block = np.minimum.reduceat(image, start)
                window = block.copy()
                for _ in range(per - 1):
                    ahead = np.append(window[1:], _NONE)
                    ahead[:-1][last] = _NONE
                    window = np.minimum(block, ahead)
                low[:, k] = window
            key = _band_keys(low, rows)
            row = index.rows(key.ravel()).reshape(key.shape)
            w, b = np.nonzero(row >= 0)
            r = row[w, b]
            hits = np.unique(np.stack([of[np.repeat(at[r] - np.cumsum(count[r]) + count[r], count[r]) + np.arange(count[r].sum())], np.repeat(w, count[r])]), axis=1)
            for t, x in hits.T:
                d = doc[x]
                yield int(t), int(d), int(start[x]), int(min(start[x] + stride * per, first[d] + n[d]))


def widened(shingle: np.ndarray, lo: int, hi: int, own: np.ndarray, size: int, containment: float, taken: list, windows: list) -> list[list]:
    """[first, last + 1 word, share] of the chains of a template's shingles in a document, at most `size` words between neighbours, that
    reach the containment, lie outside the spans taken and touch one of the windows (first, last shingle)."""
    at = lo + np.flatnonzero(np.isin(shingle[lo:hi], own))
    for s, e, _ in taken:
        at = at[(at < s) | (at > e - SHINGLE)]
    begins, reach = np.array(sorted(windows)).T
    reach = np.maximum.accumulate(reach)
    out = []
    for chain in np.split(at, np.flatnonzero(np.diff(at) > size + SHINGLE) + 1):
        if len(chain) < containment * len(own):
            continue
        share = len(np.unique(shingle[chain])) / len(own)
        k = int(np.searchsorted(begins, chain[-1], side="right"))
        if share >= containment and k and reach[k - 1] >= chain[0]:
            out.append([int(chain[0]), int(chain[-1]) + SHINGLE, share])
    return out


def scan(docs: DataFrame, templates: Templates | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, license, template, containment, start, end): one row per match; start and end are code points of the
    lower-cased text, from the first to the last shingle of the template."""
    bounded_batches(docs.sparkSession)
    bc = docs.sparkSession.sparkContext.broadcast(templates or Templates())

    def matches(buf: np.ndarray, off: np.ndarray, known: Templates):
        words, start, end, n = word_hashes(buf, off, PUNCTUATED)
        first = np.cumsum(n) - n
        shingle = np.full(len(words), _NONE)
        if len(words) >= SHINGLE:
            doc = np.repeat(np.arange(len(n)), n)
            h = shingle_hashes(words, SHINGLE)
            shingle[: len(h)] = np.where(doc[SHINGLE - 1:] == doc[: len(h)], h, _NONE)
        found: dict[tuple[int, int], list] = {}
        failed: dict[tuple[int, int], list] = {}
        for t, d, lo, hi in known.retrieve(shingle, first, n):
            inside = np.flatnonzero(np.isin(shingle[lo:hi], known.sets[t]))
            share = len(np.unique(shingle[lo:hi][inside])) / len(known.sets[t])
            if share >= known.containment:
                found.setdefault((d, t), []).append((lo + int(inside[0]), lo + int(inside[-1]) + SHINGLE, share))
            elif len(inside):
                failed.setdefault((d, t), []).append((lo + int(inside[0]), lo + int(inside[-1])))
        for d, t in sorted(found.keys() | failed.keys()):
            merged: list[list] = []
            for s, e, share in sorted(found.get((d, t), [])):
                if merged and s < merged[-1][1]:
                    merged[-1][1:] = max(e, merged[-1][1]), max(share, merged[-1][2])
                else:
                    merged.append([s, e, share])
            if (d, t) in failed:
                merged = sorted(merged + widened(shingle, int(first[d]), int(first[d] + n[d]), known.sets[t], known.sizes[t], known.containment, merged, failed[d, t]))
            if not merged:
                continue
            whole = np.concatenate([[0], np.cumsum((buf[off[d]: off[d + 1]] & 0xC0) != 0x80)])
            for s, e, share in merged:
                yield d, *known.names[t], share, int(whole[start[s] - off[d]]), int(whole[end[e - 1] - off[d]])

    def run(batches):
        for b in batches:
            buf, off = flat(b.column(1))
            rows = [(i + d, *rest) for i, j in row_blocks(off) for d, *rest in matches(buf[off[i]: off[j]], off[i: j + 1] - off[i], bc.value)]
            cols = list(zip(*rows)) if rows else [()] * 6
            types = [pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
            row, *rest = (pa.array(c, t) for c, t in zip(cols, types))
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), *rest], names=["doc_id", "license", "template", "containment", "start", "end"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id), F.lower(F.col(text).cast("string")).cast("binary")).mapInArrow(
        run, f"doc_id {kind}, license string, template string, containment double, start long, end long")
