import random
from itertools import combinations

import numpy as np
import pytest

from parlance.llm import licenses as L
from parlance.llm.license_texts import TEMPLATES


def test_longest_increasing_subsequence():
    rng = random.Random(0)
    for _ in range(200):
        values = [rng.randrange(9) for _ in range(rng.randrange(9))]
        best = max((n for n in range(len(values) + 1) for c in combinations(values, n) if all(a < b for a, b in zip(c, c[1:]))), default=0)
        found = [values[i] for i in L.longest_increasing(values)]
        assert len(found) == best and all(a < b for a, b in zip(found, found[1:]))


def test_alignment_is_increasing_and_equal():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(12) for _ in range(rng.randrange(30))] for _ in range(2))
        pairs = L.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x < z and y < w for (x, y), (z, w) in zip(pairs, pairs[1:]))
    same = [rng.randrange(5) for _ in range(400)]
    assert len(L.patience(same, same)) == 400
    assert len(L.patience([1, 2, 3, 9, 4, 5], [0, 1, 2, 7, 3, 4, 5, 8])) == 5


def test_every_template_is_found_in_prose(spark):
    rng = np.random.default_rng(0)
    prose = lambda n: " ".join(rng.choice("the of lorem ipsum dolor and to in sit amet software license".split(), n))
    names = list(TEMPLATES)
    rows = [(i, prose(300) + ".\n" + TEMPLATES[n] + "\n" + prose(50)) for i, n in enumerate(names)]
    rows += [(100, prose(5000)), (101, None), (102, ""), (103, "Released under the MIT License. Released under the MIT License."), (103, "Released under the MIT License.")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")
    got = {}
    for r in L.scan_licenses(docs).collect():
        got.setdefault(r.doc_id, []).append((f"{r.license}/{r.form}", r.start, r.end))
    for i, n in enumerate(names):
        text = rows[i][1]
        assert [g[0] for g in got[i]] == [n]
        (_, start, end), = got[i]
        assert text[start:end].split()[0].strip("\"") == TEMPLATES[n].split()[0].strip("\"")
        assert end - start >= 0.9 * len(TEMPLATES[n])
    assert 100 not in got and 101 not in got and 102 not in got and len(got[103]) == 3
    assert L.scan_licenses(docs.limit(0)).collect() == []


def test_changed_texts_and_versions():
    scanner = L.Scanner(TEMPLATES)
    mit = TEMPLATES["MIT/text"].replace("Software", "Library").upper()
    (found,), none = scanner.scan([mit]), scanner.scan([TEMPLATES["MPL-2.0/header"].replace("2.0", "1.1"), mit[: len(mit) // 2]])
    assert found[0][0] == "MIT/text" and found[0][2] / found[0][1] > 0.9
    assert none == [[], []]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("This project is licensed under the MIT license", "MIT"),
        ("Code here is Licensed Under Apache-2.0, docs aren't", "Apache-2.0"),
        ("// SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"),
        ("# SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"),
        ("Distributed under the Boost Software License, Version 1.0. (See accompanying file)", "BSL-1.0"),
        ("made available under the terms of the Eclipse Public License 2.0 which accompanies it", "EPL-2.0"),
        ("a Creative Commons Attribution 4.0 International License", "CC-BY-4.0"),
        ("a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 licence", "CC-BY-NC-SA-3.0"),
        ("It is free software released under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
        ("available under the GNU Affero General Public License, version 3", "AGPL-3.0"),
        ("published under the 3-Clause BSD License", "BSD-3-Clause"),
        ("We were licensed under the sea by MIT people", None),
        ("he was released under bail to MIT", None),
        ("students at MIT were available under the license of the king", None),
        ("the general public had a license", None),
        ("Licensed under CC BY-NC 2.0", None),
    ],
)
def test_wordings_that_the_templates_were_not_written_from(text, found):
    (got,) = L._scanner(None).scan([f"Some words before. {text} and more words."])
    assert [name.partition("/")[0] for name, *_ in got] == ([found] if found else [])


def test_whole_query_matches_plain_patterns(spark):
    """The lines of the test table are few enough to be told by patterns."""
    import re

    from parlance.llm import queries

    patterns = {"GPL-3.0": "licensed under the GNU General Public License, version 3", "MIT": "Released under the MIT License", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0", "Apache-2.0": "Licensed under the Apache License, Version 2.0", "proprietary": "All rights reserved"}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    wanted = sorted((r.doc_id, k) for r in docs for k, p in patterns.items() for _ in re.findall(p, r.text or ""))
    got = sorted((r.doc_id, r.license) for r in queries.op2_scan_licenses(spark, "/root/testdata/sf0.01").collect())
    assert got == wanted and len(got) > 20


def test_no_templates_find_nothing(spark):
    assert L.scan_licenses(spark.createDataFrame([(1, "All rights reserved.")], "doc_id long, text string"), templates={}).collect() == []
