"""Licence scans by patience alignment.

A window of the text is aligned with a template: words that occur once in both
are anchors, the longest increasing run of anchor positions is kept, and the
gaps between anchors are aligned the same way; a gap without such words is
aligned by its longest common subsequence. Coverage is the share of the
template's words that are matched. A notice is reported where the coverage is
at least ``coverage`` and the matched words span at most ``1 / DENSITY`` times
the template (plus ``SLACK`` words). Words that tell licences apart (``KEYS``
and the template's version numbers) must all be matched, and none of them may
stand unmatched within the notice; templates of at most ``WHOLE`` words must
be matched in a row. A notice of at most ``SHORT`` words that is denied (a word
of ``DENIALS`` in it or just before it) does not count, nor does a line that
reserves all rights at most ``LEAD`` words before the licence that it heads.

An index of template words picks the templates that a text can hold: one of a
template's distinguishing words must stand in the text, or, without such words,
one of as many of its rarest words as may be missing and one more. Of those,
only windows that hold enough words of the template, each as often as the
template has it at most, can reach the coverage; they are found by running
counts over the whole text, so that clean text is never aligned, and templates
that no word points to cost nothing. Each document is handled within its row:
nothing is shuffled.

Cases: null, empty and wordless texts have no notice; several notices, also
adjacent copies of one, are reported each; a template without words raises
ValueError; repeated rows each get their result; other columns pass through, a
clashing ``notices`` column is replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epilens.llm.common import alnum_words, prepare

COVERAGE, DENSITY, SLACK = 0.8, 0.67, 4
WHOLE = 4
_BY = "This work is licensed under a Creative Commons"
KEYS = set(
    b"mit bsd isc apache mozilla gnu lesser affero nc sa nd noncommercial sharealike noderivatives noderivs "
    b"gpl lgpl agpl mpl 0bsd cc0 unlicense spdx".split()
)
SHORT, LEAD = 30, 12
DENIALS = set(b"not never cannot isn aren wasn nor".split())
# The parts of a Creative Commons licence and its versions.
_CC_PARTS = {
    "BY": ("Attribution", "permissive"),
    "BY-SA": ("Attribution-ShareAlike", "copyleft"),
    "BY-ND": ("Attribution-NoDerivatives", "noderivatives"),
    "BY-NC": ("Attribution-NonCommercial", "noncommercial"),
    "BY-NC-SA": ("Attribution-NonCommercial-ShareAlike", "noncommercial"),
    "BY-NC-ND": ("Attribution-NonCommercial-NoDerivatives", "noncommercial"),
}
_CC_VERSIONS = {"2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
_FREE = "you can redistribute it and/or modify it under the terms of the GNU"
_FSF = "as published by the Free Software Foundation, either version"
_LATER = "of the License, or (at your option) any later version."
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
    "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution."
)
_VERSIONED = (b"version", b"v", b"attribution", b"international", b"by", b"nc", b"sa", b"nd", *KEYS)

# Licence, kind, text of the notice.
TEMPLATES: list[tuple[str, str, str]] = [
    ("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "permissive",
     "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
     "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
     "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
     "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
     "specific language governing permissions and limitations under the License."),
    ("MIT", "permissive", "Released under the MIT License."),
    ("MIT", "permissive", "Licensed under the MIT License."),
    ("MIT", "permissive",
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
     "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
     "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
     "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
     "Software."),
    ("BSD-2-Clause", "permissive", _BSD),
    ("BSD-3-Clause", "permissive",
     _BSD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
     "promote products derived from this software without specific prior written permission."),
    ("ISC", "permissive",
     "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-3.0", "copyleft", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "copyleft",
     f"This program is free software: {_FREE} General Public License {_FSF} 3 {_LATER}"),
    ("GPL-2.0", "copyleft", f"This program is free software; {_FREE} General Public License {_FSF} 2 {_LATER}"),
    ("LGPL-2.1", "copyleft", f"This library is free software; {_FREE} Lesser General Public License {_FSF} 2.1 {_LATER}"),
    ("LGPL-3.0", "copyleft", f"This library is free software: {_FREE} Lesser General Public License {_FSF} 3 {_LATER}"),
    ("AGPL-3.0", "copyleft", f"This program is free software: {_FREE} Affero General Public License {_FSF} 3 {_LATER}"),
    ("GPL-3.0", "copyleft",
     "GNU General Public License Version 3, 29 June 2007. Everyone is permitted to copy and distribute verbatim copies of "
     "this license document, but changing it is not allowed."),
    ("GPL-2.0", "copyleft",
     "GNU General Public License Version 2, June 1991. Everyone is permitted to copy and distribute verbatim copies of "
     "this license document, but changing it is not allowed."),
    ("Apache-2.0", "permissive",
     "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ Terms and conditions for use, reproduction, "
     "and distribution 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and "
     "distribution as defined by Sections 1 through 9 of this document."),
    ("0BSD", "permissive",
     "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted."),
    ("Unlicense", "public-domain",
     "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
     "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
     "purpose, commercial or non-commercial, and by any means."),
    ("CC0-1.0", "public-domain",
     "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this "
     "work."),
    ("CC0-1.0", "public-domain",
     "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his "
     "or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the "
     "extent allowed by law."),
    ("CC0-1.0", "public-domain", "Creative Commons CC0 1.0 Universal"),
    ("MPL-2.0", "copyleft",
     "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
     "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("All-Rights-Reserved", "proprietary", "Copyright. All rights reserved. No part may be reproduced without permission."),
    ("All-Rights-Reserved", "proprietary", "All rights reserved."),
    ("BSD-2-Clause", "permissive", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "permissive", "Licensed under the BSD 3-Clause License."),
    ("ISC", "permissive", "Licensed under the ISC License."),
    ("GPL-2.0", "copyleft", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "copyleft", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "copyleft", "This work is licensed under the GNU Affero General Public License, version 3."),
]
for _parts, (_words, _kind) in _CC_PARTS.items():
    for _version, _port in _CC_VERSIONS.items():
        TEMPLATES += [
            (f"CC-{_parts}-{_version}", _kind, f"{_BY} {_words} {_version} {_port} License."),
            (f"CC-{_parts}-{_version}", _kind, f"Licensed under CC {_parts} {_version}."),
        ]
# the tag of every licence named above
TEMPLATES += [
    (name, kind, f"SPDX-License-Identifier: {name}")
    for name, kind in {n: k for n, k, _ in TEMPLATES if k != "proprietary"}.items()
]


def _increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence (patience piles)."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        if k == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[k], at[k] = v, i
        back.append(at[k - 1] if k else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _common(a: list, b: list, a0: int, b0: int) -> list[tuple[int, int]]:
    """A longest common subsequence, as index pairs."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j] and best[i][j] == best[i + 1][j + 1] + 1:
            out.append((a0 + i, b0 + j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched (index in a, index in b), increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place]
        if not anchors:
            if in_a.keys() & in_b.keys():
                out += _common(a[a0:a1], b[b0:b1], a0, b0)
            continue
        kept = [anchors[k] for k in _increasing([j for _, j in anchors])]
        out += kept
        ends = [(a0 - 1, b0 - 1), *kept, (a1, b1)]
        todo += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(ends, ends[1:])]
    return sorted(out)


@dataclass(frozen=True)
class Notice:
    template: int
    start: int
    stop: int
    coverage: float


class Scanner:
    def __init__(self, templates=TEMPLATES, coverage: float = COVERAGE):
        self.words = [alnum_words(t) for _, _, t in templates]
        if not all(self.words):
            raise ValueError("a template has no words")
        self.coverage = coverage
        self.numbers = {w: i for i, w in enumerate(dict.fromkeys(w for t in self.words for w in t))}
        self.bags = [sorted(Counter(self.numbers[w] for w in t).items()) for t in self.words]
        self.keys = [{j for j, w in enumerate(t) if w in KEYS or self._version(t, j)} for t in self.words]
        spread = Counter(w for t in self.words for w in set(t))
        self.pointers: list[list[int]] = [[] for _ in self.numbers]  # word number -> templates that it points to
        for k, t in enumerate(self.words):
            rare = sorted(range(len(t)), key=lambda j: (spread[t[j]], -len(t[j]), j))
            needed = [j for j in rare if j in self.keys[k] and not t[j].isdigit()]
            for w in {t[j] for j in needed[:1] or rare[: len(t) - self.need(k) + 1]}:
                self.pointers[self.numbers[w]].append(k)
        self.reserving = {k for k, (_, kind, _) in enumerate(templates) if kind == "proprietary"}
        self.member = np.zeros((len(self.words), len(self.numbers) + 1), bool)  # the last: any other word
        for k, t in enumerate(self.words):
            self.member[k, [self.numbers[w] for w in t]] = True

    @staticmethod
    def _version(words: list[bytes], j: int) -> bool:
        """Whether word j is a number that belongs to a version."""
        while words[j].isdigit() and j:
            j -= 1
            if words[j] in _VERSIONED:
                return True
        return False

    def _told_apart(self, words: list[bytes], k: int, pairs: list[tuple[int, int]]) -> bool:
        own = words[: pairs[-1][0] + 1]
        if len(self.words[k]) <= SHORT and any(own[i] in DENIALS for i in set(range(pairs[0][0], len(own))) - {i for i, _ in pairs}):
            return False
        if len(self.words[k]) <= WHOLE and pairs[-1][0] - pairs[0][0] >= len(self.words[k]):
            return False
        hit = {i for i, _ in pairs}
        more = (i for i in range(pairs[0][0], len(own)) if i not in hit)
        return self.keys[k] <= {j for _, j in pairs} and not any(own[i] in KEYS or self._version(own, i) for i in more)

    def reach(self, k: int) -> int:
        """Longest span of a notice of template k, in words."""
        return int(len(self.words[k]) / DENSITY) + SLACK

    def need(self, k: int) -> int:
        """Fewest matched words of a notice of template k."""
        return int(np.ceil(self.coverage * len(self.words[k]) - 1e-9))

    def _align(self, words: list[bytes], k: int, at: int) -> Notice | None:
        pairs = patience(words[at : at + self.reach(k)], self.words[k])
        if len(pairs) < self.need(k) or not self._told_apart(words[at : at + self.reach(k)], k, pairs):
            return None
        start = at + pairs[0][0]
        before = 2 + pairs[0][1]  # and as many as the template has before its first matched word
        if len(self.words[k]) <= SHORT and DENIALS & set(words[max(0, start - before) : start]):
            return None
        return Notice(k, start, at + pairs[-1][0] + 1, len(pairs) / len(self.words[k]))

    def notices(self, text: str | None) -> list[Notice]:
        words = alnum_words(text)
        other = len(self.numbers)
        get = self.numbers.get
        ids = np.fromiter((get(w, other) for w in words), np.int32, len(words))
        out: list[Notice] = []
        some = np.unique(ids)
        for k in sorted({k for w in some[some < other].tolist() for k in self.pointers[w]}):
            count = np.concatenate([[0], np.cumsum(self.member[k][ids])])
            ends = np.minimum(np.arange(len(words)) + self.reach(k), len(words))
            starts = np.flatnonzero(count[ends] - count[:-1] >= self.need(k))
            if len(starts):
                most = np.zeros(len(starts), np.int64)
                for w, n in self.bags[k]:
                    count = np.concatenate([[0], np.cumsum(ids == w)])
                    most += np.minimum(count[ends[starts]] - count[starts], n)
                starts = starts[most >= self.need(k)]
            free = 0
            for at in starts.tolist():
                if at < free:
                    continue
                found = self._align(words, k, at)
                if found:
                    again = self._align(words, k, found.start)  # the rest of the notice may lie beyond the window
                    if again and again.coverage > found.coverage:
                        found = again
                    out.append(found)
                    free = found.stop
        return self._best(out)

    def _best(self, found: list[Notice]) -> list[Notice]:
        """Of overlapping notices the one that matches most words stays."""
        kept: list[Notice] = []
        for n in sorted(found, key=lambda n: (-n.coverage * len(self.words[n.template]), n.start, n.template)):
            if all(n.stop <= o.start or n.start >= o.stop for o in kept):
                kept.append(n)
        heads = [n.start for n in kept if n.template not in self.reserving]
        kept = [n for n in kept if n.template not in self.reserving or not any(0 <= h - n.stop <= LEAD for h in heads)]
        return sorted(kept, key=lambda n: n.start)


_NOTICES = "array<struct<license:string,kind:string,start:bigint,stop:bigint,coverage:double>>"


def scan(docs: DataFrame, text: str = "text", templates=TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` with ``notices``: licence, kind, word range and coverage."""
    Scanner(templates, coverage)  # bad templates fail here
    prepare(docs.sparkSession)

    @F.pandas_udf(_NOTICES)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(templates, coverage)
        for s in batches:
            yield pd.Series(
                [
                    [
                        {"license": templates[n.template][0], "kind": templates[n.template][1], "start": n.start,
                         "stop": n.stop, "coverage": n.coverage}
                        for n in scanner.notices(t if isinstance(t, str) else None)
                    ]
                    for t in s
                ],
                dtype=object,
            )

    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "notices"]
    return docs.select(*keep, of(F.col(f"`{text}`")).alias("notices"))
