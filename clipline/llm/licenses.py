"""License scans: winnowed template fingerprints pick candidates, banded alignment measures them."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipline.llm.common import Memo, map_batches, text_or_empty

# Statements and notices by which texts are commonly licensed.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."),
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        "General Public License for more details."),
    "mit-line": "Released under the MIT License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED'),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer."),
}

_MARKS = ".,;:!?\"'()[]{}<>*#%$&-_/“”‘’«»"
_TOKEN = re.compile(r"\S+")
GRAM, WINDOW, BAND = 3, 2, 8


def normal_words(text: str) -> list[str]:
    """White-space tokens in lower case without the marks around them."""
    return [t.strip(_MARKS) for t in text.lower().split()]


def winnow(hashes: list[int], window: int) -> list[int]:
    """Places of the smallest hash of every run of ``window`` hashes, the rightmost among equals."""
    if len(hashes) <= window:
        return [min(range(len(hashes)), key=lambda i: (hashes[i], -i))] if hashes else []
    return sorted({min(range(i, i + window), key=lambda j: (hashes[j], -j)) for i in range(len(hashes) - window + 1)})


def _cells(template: list[int], words: np.ndarray, low: int, high: int) -> Iterator[tuple[int, int, int, int]]:
    """(score, matched, first, end) of the best local alignment up to every place on the diagonals low to high.

    Equal words count 1; replaced, left out and added ones -1.
    """
    width = high - low + 1
    nothing = (0, 0, 0, 0)
    above = [nothing] * (width + 2)
    for i, word in enumerate(template):
        row = [nothing] * (width + 2)
        for d in range(width):
            j = i + low + d
            if not 0 <= j < len(words):
                continue
            score, matched, first, end = above[d + 1]
            if score <= 0:
                score, matched, first = 0, 0, j
            equal = word > 0 and words[j] == word
            cell = (score + 1, matched + 1, first, j + 1) if equal else (score - 1, matched, first, end)
            for gap in (above[d + 2], row[d]):
                if gap[0] - 1 > cell[0]:
                    cell = (gap[0] - 1, *gap[1:])
            row[d + 1] = cell
            yield cell
        above = row


def align(template: list[int], words: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Best local alignment of ``template`` with ``words`` on the diagonals low to high: (matched, first, end).

    ``first`` and ``end`` are places in ``words``; matched is 0 if nothing agrees.
    """
    return max(_cells(template, words, low, high), key=lambda c: c[0], default=(0, 0, 0, 0))[1:]


def apart(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of alignments (score, matched, first, end) the best, then the best that overlaps none taken, and so on."""
    taken: list[tuple[int, int, int, int]] = []
    for cell in sorted(found, key=lambda c: -c[0]):
        at = bisect_left(taken, cell[2], key=lambda c: c[2])
        if (not at or taken[at - 1][3] <= cell[2]) and (at == len(taken) or cell[3] <= taken[at][2]):
            taken.insert(at, cell)
    return taken


def passages(template: list[int], words: np.ndarray, low: int, high: int,
             coverage: float) -> list[tuple[int, int, int, int]]:
    """Every alignment on the diagonals low to high that covers enough, none over another.

    The words between those taken are aligned again until nothing covers enough.
    """
    out, stretches = [], [(max(0, low), min(len(words), high + len(template)))]
    while stretches:
        start, stop = stretches.pop()
        if stop - start < coverage * len(template):
            continue
        best: dict[int, tuple[int, int, int, int]] = {}
        for cell in _cells(template, words[start:stop], max(low - start, 1 - len(template)),
                           min(high - start, stop - start - 1)):
            if cell[0] > 0 and cell[1] / len(template) >= coverage and cell[0] > best.get(cell[3], (0,))[0]:
                best[cell[3]] = cell
        taken = [(score, matched, start + first, start + end) for score, matched, first, end in apart(list(best.values()))]
        if taken:
            out += taken
            stretches += zip([start, *[c[3] for c in taken]], [*[c[2] for c in taken], stop])
    return out


class Scanner:
    """An inverted index from winnowed word grams to places in the templates, and their alignment with texts."""

    def __init__(self, templates: Mapping[str, str], gram: int, window: int, band: int, coverage: float):
        self.names, self.gram, self.band, self.coverage = list(templates), gram, band, coverage
        words = [normal_words(t) for t in templates.values()]
        if any(len(w) < gram for w in words):
            raise ValueError(f"a template needs {gram} words at least")
        self.known = {w: i + 1 for i, w in enumerate(sorted({w for own in words for w in own if w}))}
        self.base = len(self.known) + 1
        self.templates = [[self.known.get(w, 0) for w in own] for own in words]
        places: dict[int, list[tuple[int, int]]] = {}
        for t, own in enumerate(words):
            hashes = [zlib.crc32(" ".join(own[i:i + gram]).encode("utf-8")) for i in range(len(own) - gram + 1)]
            for at in winnow(hashes, window):
                places.setdefault(int(self.grams(np.array(self.templates[t][at:at + gram]))[0]), []).append((t, at))
        self.keys = np.array(sorted(places), dtype=np.int64)
        self.places = [places[int(k)] for k in self.keys]
        known = self.known
        self.words = Memo(lambda token: known.get(token.strip(_MARKS), 0))

    def grams(self, ids: np.ndarray) -> np.ndarray:
        n = max(0, len(ids) - self.gram + 1)
        out = np.zeros(n, dtype=np.int64)
        for i in range(self.gram):
            out = out * self.base + ids[i:i + n]
        return out

    def candidates(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, lowest, highest diagonal) of each group of hits whose diagonals are at most a band apart."""
        grams = self.grams(ids)
        at = np.searchsorted(self.keys, grams)
        hits = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == grams)
        found: dict[int, list[int]] = {}
        for p in hits.tolist():
            for t, o in self.places[at[p]]:
                found.setdefault(t, []).append(p - o)
        out = []
        for t, diagonals in sorted(found.items()):
            diagonals.sort()
            low = last = diagonals[0]
            for d in [*diagonals[1:], None]:
                if d is None or d - last > self.band:
                    out.append((t, low, last))
                    low = d
                last = d
        return out

    def scan(self, text: str) -> list[tuple[str, int, int, int, int, float]]:
        """(template, start, end, matched, words, coverage) of every passage that covers enough of a template."""
        ids = np.fromiter(map(self.words.__getitem__, text.lower().split()), dtype=np.int64)
        found: dict[int, list[tuple[int, int, int, int]]] = {}
        for t, low, high in self.candidates(ids):
            own = passages(self.templates[t], ids, low - self.band, high + self.band, self.coverage)
            found.setdefault(t, []).extend(own)
        out, spans = [], None
        for t, cells in found.items():
            n = len(self.templates[t])
            for _, matched, first, end in apart(cells):
                spans = spans or [m.span() for m in _TOKEN.finditer(text)]
                out.append((self.names[t], spans[first][0], spans[end - 1][1], matched, n, matched / n))
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, coverage: float = 0.8, gram: int = GRAM,
                  window: int = WINDOW, band: int = BAND, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, template, start, end, matched, words, coverage of every licensed passage of every row.

    A run of ``gram + window - 1`` words shared with a template holds one of
    its fingerprints; each place where fingerprints meet on nearby diagonals is
    aligned within ``band`` words of them, and all passages there that do not
    overlap are taken, adjacent copies too. ``start`` and ``end`` are character
    offsets in the whole text, ``matched`` the template's words found in order.
    A template that is part of another is reported beside it. Null and empty
    texts have no passages; repeated rows give their passages each; extra
    columns are ignored; an empty table gives no rows. The templates, a
    parameter, go to every task.
    """
    def make():
        scanner = Scanner(templates, gram, window, band, coverage)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, found = [], []
            for i, scalar in enumerate(batch.column(1)):
                own = scanner.scan(scalar.as_py())
                rows += [i] * len(own)
                found += own
            columns = list(zip(*found)) or [[]] * 6
            types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, types)]],
                ["doc_id", "template", "start", "end", "matched", "words", "coverage"])
        return work

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return map_batches(rows, make, "doc_id long, template string, start long, end long, matched int, words int, "
                                   "coverage double")
