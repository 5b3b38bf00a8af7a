import random

import pytest
from pyspark.sql import functions as F

from epilens.llm import licenses as L
from epilens.llm.common import alnum_words
from util import DOCS, docs, words


BSD3 = """Copyright (c) 2020, Somebody. All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
GPL = (
    "This %s is free software; you can redistribute it and/or modify it under the terms of the GNU %sGeneral Public License as "
    "published by the Free Software Foundation; either version %s of the License, or (at your option) any later version."
)
ZERO = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."


def increasing(values):
    """Length of a longest increasing subsequence, by trying all ends."""
    best = []
    for i, v in enumerate(values):
        best.append(1 + max((best[j] for j in range(i) if values[j] < v), default=0))
    return max(best, default=0)


def test_longest_increasing_run():
    r = random.Random(1)
    for _ in range(60):
        v = r.sample(range(40), r.randrange(0, 15))
        got = [v[i] for i in L._increasing(v)]
        assert got == sorted(got) and len(got) == increasing(v)


def test_alignment_is_a_common_subsequence():
    r = random.Random(2)
    for _ in range(60):
        a, b = ([r.choice("abcdefghij") for _ in range(r.randrange(0, 20))] for _ in range(2))
        pairs = L.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x < u and y < v for (x, y), (u, v) in zip(pairs, pairs[1:]))
        assert len(pairs) <= len(L._common(a, b, 0, 0))
    t = alnum_words(max((x for _, _, x in L.TEMPLATES), key=len))
    assert len(L.patience(t, t)) == len(t)


def brute(scanner, text):
    """Templates that some window reaches, with the words that tell licences
    apart, by aligning every window with every template."""
    w = alnum_words(text)
    out = set()
    for k in range(len(scanner.words)):
        for at in range(len(w)):
            own = w[at : at + scanner.reach(k)]
            if len(set(own) & set(scanner.words[k])) * 3 < len(set(scanner.words[k])):
                continue  # far from the coverage
            pairs = L.patience(own, scanner.words[k])
            if len(pairs) >= scanner.need(k) and scanner._told_apart(own, k, pairs):
                out.add(k)
    return out


def texts():
    r = random.Random(4)
    out = []
    for i, (_, _, notice) in enumerate(L.TEMPLATES):
        out.append(" ".join(words(30, i)) + "\n" + notice + "\n" + " ".join(words(30, 50 + i)))
        w = notice.split()
        for _ in range(len(w) // 12):
            w[r.randrange(len(w))] = "changed"
        out.append(" ".join(w).upper())
    out += ["the " * 300, "the license the license under " * 30, "", None, "MIT", " ".join(words(300, 9))]
    return out


def test_prefilter_loses_nothing():
    scanner = L.Scanner()
    for t in texts():
        found = {n.template for n in scanner.notices(t)}
        want = brute(scanner, t)
        assert bool(found) == bool(want) and found <= want


def test_every_template_is_found_at_its_place():
    scanner = L.Scanner()
    for name, kind, notice in L.TEMPLATES:
        n = len(alnum_words(notice))
        got = scanner.notices("one two three " + notice + " four five " + notice)
        assert [(L.TEMPLATES[x.template][0], x.start, x.stop, x.coverage) for x in got] == [(name, 3, 3 + n, 1.0), (name, 5 + n, 5 + 2 * n, 1.0)]


@pytest.mark.parametrize(
    "notice,names",
    [
        ("All rights reserved.", ["All-Rights-Reserved"]),
        ("all of us have rights that were reserved", []),
        ("Licensed under CC BY 4.0.", ["CC-BY-4.0"]),
        ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
        ("Licensed under CC BY-SA 4.0.", ["CC-BY-SA-4.0"]),
        ("Licensed under CC BY-NC 3.0.", ["CC-BY-NC-3.0"]),
        ("Licensed under CC BY-NC 1.0.", []),
        ("This is not Released under the MIT License.", []),
        ("It isn't licensed under the MIT License.", []),
        ("This work is not licensed under the GNU General Public License, version 3.", []),
        ("SPDX-License-Identifier: MIT", ["MIT"]),
        ("SPDX-License-Identifier: Apache-2.0", ["Apache-2.0"]),
        ("SPDX-License-Identifier: GPL-2.0-or-later", ["GPL-2.0"]),
        ("SPDX-License-Identifier: BSD-3-Clause", ["BSD-3-Clause"]),
        ("SPDX-License-Identifier: Foo-1.0", []),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.", ["CC-BY-SA-3.0"]),
        (BSD3, ["BSD-3-Clause"]),
        (BSD3[: BSD3.index("3. Neither")], ["BSD-2-Clause"]),
        (GPL % ("program", "", "2"), ["GPL-2.0"]),
        (GPL % ("program", "", "3"), ["GPL-3.0"]),
        (GPL % ("library", "Lesser ", "2.1"), ["LGPL-2.1"]),
        (GPL % ("program", "Affero ", "3"), ["AGPL-3.0"]),
        (ZERO, ["0BSD"]),
        (ZERO.replace("hereby granted.", "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."), ["ISC"]),
        ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
         "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
         "commercial or non-commercial, and by any means.", ["Unlicense"]),
        ("To the extent possible under law, Jane Doe has waived all copyright and related or neighboring rights to this work.", ["CC0-1.0"]),
        ("Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\nTERMS AND CONDITIONS FOR USE, REPRODUCTION, AND "
         "DISTRIBUTION\n\n1. Definitions.\n\n\"License\" shall mean the terms and conditions for use, reproduction, and distribution "
         "as defined by Sections 1 through 9 of this document.", ["Apache-2.0"]),
        ("Released under the MIT License.", ["MIT"]),
        ("Released under the Foo License.", []),
        ("Licensed under the BSD 3-Clause License.", ["BSD-3-Clause"]),
        ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
        ("Licensed under the Apache License, Version 1.1.", []),
        ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
        ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0"]),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ["CC-BY-NC-4.0"]),
    ],
)
def test_licences_are_told_apart(notice, names):
    found = L.Scanner().notices("some words before " + notice + " and after it")
    assert [L.TEMPLATES[n.template][0] for n in found] == names


def test_scan_of_documents(spark):
    mit = "Released under the MIT License."
    rows = [(1, f"{mit} {mit}"), (2, None), (3, ""), (None, mit), (4, "clean words"), (1, f"{mit} {mit}")]
    df = docs(spark, rows).withColumn("notices", F.lit("old"))
    out = L.scan(df)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "notices"]
    got = [(r.doc_id, [(x.license, x.kind, x.start, x.stop, x.coverage) for x in r.notices]) for r in out.collect()]
    two = [("MIT", "permissive", 0, 5, 1.0), ("MIT", "permissive", 5, 10, 1.0)]
    assert sorted(got, key=str) == sorted([(1, two), (2, []), (3, []), (None, two[:1]), (4, []), (1, two)], key=str)
    assert L.scan(spark.createDataFrame([], DOCS)).count() == 0


def test_very_long_text_with_notices_far_apart():
    gap = words(60_000, 1)
    text = " ".join([*gap, "Released under the MIT License.", *gap, BSD3, *gap])
    found = L.Scanner().notices(text)
    assert [(L.TEMPLATES[n.template][0], n.coverage) for n in found] == [("MIT", 1.0), ("BSD-3-Clause", 1.0)]
    assert found[0].start == 60_000


def test_every_template_has_a_word_that_points_to_it():
    scanner = L.Scanner()
    assert {k for own in scanner.pointers for k in own} == set(range(len(L.TEMPLATES)))


def test_empty_template():
    with pytest.raises(ValueError):
        L.Scanner([("x", "y", "...")])
