"""License scans by patience alignment.

Words unique to both a stretch of text and a template are anchors; the longest increasing subsequence of their places is
kept, and the gaps between the kept ones are aligned the same way, down to common ends. Coverage is the part of the
template's words that find a partner. Of finds that overlap, the one with the best coverage stays (then more words, then
the name).

A template is laid at every place of the whole text, in a window with room for a fifth more words on each side; what is
left out can't reach the coverage asked for. Four bounds see to that, each a count of words that the alignment can't
exceed: a text must hold one of the template's key words, which are so many that the coverage can't be reached without
all of them; its words must make up that part of the template; so must those of the window, whose counts run along
the text; and so must the window's longest common subsequence with the template. The next window has one new word, so
its subsequence is longer by one at most: a window that lacks k words rules out the k - 1 after it. So a notice is found
anywhere, any number of times, whichever of its words were changed.

An alignment depends on nothing but which of the window's words are which of the template's. Windows that are the same
in that are aligned once: a file of the same notice over and over has few of them, however long it is. What was aligned
is forgotten by halves (`HELD_BYTES`), which costs time and no result.

Words are runs of ASCII letters and digits, lower-cased; all other bytes part words. Cases: null or wordless text: no
finds; repeated rows are scanned alike; ties go by name; an empty table gives an empty table; columns besides id and text
are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST_COVERAGE = 0.8
#: Bytes of windows whose alignment a template remembers.
HELD_BYTES = 16_000_000
#: Notices, opening sentences and whole short licenses; a parameter, as a full collection of templates would be.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT-full": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-2-Clause-full": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list
of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF
ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "ISC-full": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
}
#: Bytes to lower-cased letters and digits, all others to a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def fold(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def increasing(places: list[int]) -> list[int]:
    """The indices of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    before = [-1] * len(places)
    for i, p in enumerate(places):
        k = bisect_left(tops, p)
        if k == len(tops):
            tops.append(p)
            piles.append(i)
        else:
            tops[k], piles[k] = p, i
        before[i] = piles[k - 1] if k else -1
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(a: list[Any], b: list[Any]) -> list[tuple[int, int]]:
    """Pairs (i, j) of a patience alignment of a and b, in order."""
    pairs: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        i, m, j, n = work.pop()
        while i < m and j < n and a[i] == b[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            pairs.append((m, n))
        if i >= m or j >= n:
            continue
        once_a, once_b = Counter(a[i:m]), Counter(b[j:n])
        at = {w: k for k, w in enumerate(b[j:n], j) if once_b[w] == 1}
        anchors = [(k, at[w]) for k, w in enumerate(a[i:m], i) if once_a[w] == 1 and w in at]
        if not anchors:
            continue
        kept = [anchors[k] for k in increasing([y for _, y in anchors])]
        pairs += kept
        for (x0, y0), (x1, y1) in zip([(i - 1, j - 1), *kept], [*kept, (m, n)], strict=True):
            work.append((x0 + 1, x1, y0 + 1, y1))
    return sorted(pairs)


class Find(NamedTuple):
    license: str
    start: int  # word places in the text, end exclusive
    stop: int
    matched: int
    coverage: float


class Template:
    """A template's words, the least number that has to match, and the words of which one must be in any text that does."""

    def __init__(self, name: str, words: list[bytes], least: float, shared: Counter[bytes]):
        self.name, self.words, self.counts = name, words, Counter(words)
        self.need = max(1, math.ceil(least * len(words) - 1e-9))
        self.slack = max(2, len(words) // 5)
        self.keys, missing = set(), 0
        for w in sorted(self.counts, key=lambda w: (shared[w], -len(w), w)):
            if missing > len(words) - self.need:
                break
            self.keys.add(w)
            missing += self.counts[w]
        self.code = {w: k for k, w in enumerate(self.counts)}
        self.coded = [self.code[w] for w in words]
        self.at = [0] * len(self.counts)
        for j, c in enumerate(self.coded):
            self.at[c] |= 1 << j
        self.full = (1 << len(words)) - 1
        self.known: dict[bytes, tuple[int, int, int]] = {}
        self.held = 0

    def common(self, window: list[int]) -> int:
        """The length of a longest common subsequence with the template, all of a row's cells in one number."""
        row = self.full
        for c in window:
            if c >= 0:
                hit = row & self.at[c]
                row = (row + hit | row - hit) & self.full
        return len(self.words) - row.bit_count()

    def find(self, window: np.ndarray) -> tuple[int, int, int]:
        """(first place, end, matched words) of the alignment with a window, or (0, 0, a bound on them) if that is too low."""
        key = window.tobytes()
        got = self.known.get(key)
        if got is None:
            codes = window.tolist()
            got = (0, 0, self.common(codes))
            if got[2] >= self.need:
                pairs = align(codes, self.coded)
                got = (pairs[0][0], pairs[-1][0] + 1, len(pairs)) if pairs else (0, 1, 0)
            self.held += len(key)
            if self.held > HELD_BYTES:
                self.known = dict(list(self.known.items())[len(self.known) // 2 :])
                self.held = sum(map(len, self.known)) + len(key)
            self.known[key] = got
        return got

    def finds(self, words: list[bytes], present: set[bytes]) -> Iterator[Find]:
        codes, places = self.places(words, present)
        skip, before = 0, None
        for p in places:
            span = self.window(p, len(words))
            if p < skip or span == before:
                continue
            before = span
            start, stop, matched = self.find(codes[span[0] : span[1]])
            if stop == 0:
                skip = p + self.need - matched
            elif matched >= self.need:
                yield Find(self.name, span[0] + start, span[0] + stop, matched, matched / len(self.words))

    def window(self, p: int, n: int) -> tuple[int, int]:
        """What the template is aligned with when it is laid at word p of n."""
        return max(0, p - self.slack), min(n, p + len(self.words) + self.slack)

    def places(self, words: list[bytes], present: set[bytes]) -> tuple[np.ndarray, list[int]]:
        """The words' codes and the places whose window holds enough of the template's words."""
        if self.keys.isdisjoint(present) or sum(c for w, c in self.counts.items() if w in present) < self.need:
            return np.empty(0, np.int32), []
        code = np.fromiter((self.code.get(w, -1) for w in words), np.int32, len(words))
        p = np.arange(len(words))
        low, high = np.maximum(0, p - self.slack), np.minimum(len(words), p + len(self.words) + self.slack)
        held = np.zeros(len(words), np.int64)
        for w, c in self.counts.items():
            if w in present:
                upto = np.append(0, np.cumsum(code == self.code[w]))
                held += np.minimum(upto[high] - upto[low], c)
        return code, np.flatnonzero(held >= self.need).tolist()


class Scanner:
    def __init__(self, templates: dict[str, str] | None = None, least: float = LEAST_COVERAGE):
        folded = {name: fold(text.encode()) for name, text in sorted((templates or TEMPLATES).items())}
        shared = Counter(w for words in folded.values() for w in set(words))
        self.templates = [Template(name, words, least, shared) for name, words in folded.items() if words]

    def scan(self, text: bytes) -> list[Find]:
        words = fold(text)
        present = set(words)
        found = {f for t in self.templates for f in t.finds(words, present)}
        out: list[Find] = []
        taken: list[tuple[int, int]] = []
        for f in sorted(found, key=lambda f: (-f.coverage, -f.matched, f.license, f.start, f.stop)):
            k = bisect_left(taken, (f.start, f.stop))
            if (k == 0 or taken[k - 1][1] <= f.start) and (k == len(taken) or taken[k][0] >= f.stop):
                taken.insert(k, (f.start, f.stop))
                out.append(f)
        return sorted(out, key=lambda f: f.start)


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST_COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, start, stop, matched, coverage) of every find; places count words, from 0."""
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("matched", pa.int64()), ("coverage", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)
        for b in batches:
            rows = [(i, *f) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t for f in scanner.scan(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(text_col, "UTF-8").alias("text"))
    return picked.mapInArrow(run, "doc_id bigint, license string, start bigint, stop bigint, matched bigint, coverage double")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
