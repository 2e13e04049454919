import re
import textwrap

import pytest

from jobweave.llm.licenses import LicenseParams, Scanner, common_words, differences, parsed, scan, tags, words_of

ROOT = "/root/testdata/sf0.01"
PLANTED = {"Apache-2.0": "Licensed under the Apache License, Version 2.0.", "MIT": "Released under the MIT License.", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "Proprietary": "All rights reserved."}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_differences_against_the_plain_recurrence():
    import random

    rng = random.Random(2)
    for _ in range(200):
        a, b = (tuple(rng.choice("abcd") for _ in range(rng.randrange(1, 9))) for _ in range(2))
        common, missing, first, end = differences(a, b)
        assert (common, missing) == (lcs(a, b), len(a) - lcs(a, b))
        assert lcs(a, b[first:end]) == common
        places = {}
        for k, w in enumerate(b):
            places[w] = places.get(w, 0) | 1 << k
        assert common_words(a, places, len(b)) == common


@pytest.mark.parametrize("template", [t for own in [parsed(LicenseParams().templates)] for t in [*own, *tags(own)]], ids=lambda t: t.license)
def test_every_template_finds_itself(template):
    found = [b for *_, b in Scanner(LicenseParams()).blocks(f"text\n\n{template.text}\n\nmore")]
    assert [b[0] for b in found] == [template.license] and not found[0][3] and not found[0][4]


def test_edges_and_edits(spark):
    rows = [(1, None), (2, ""), (3, "no notice here"), (4, "ab\nLicensed under the Apache License, Version 2.0.\nend"), (4, "ab\nLicensed under the Apache License, Version 2.0.\nend")]
    rows += [(5, "Licensed under the Apache License, Version 1.1."), (6, "license"), (7, "word " * 60_000 + "\nReleased under the MIT License."), (None, "All rights reserved.")]
    rows += [(8, "Released under the MIT License.\nLicensed under CC BY-NC-SA 4.0."), (9, "This work is kindly licensed under the GNU General Public License, version 3.")]
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, license string, start int")
    got = {}
    for r in scan(docs).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.start, r.end))
    apache = ("Apache-2.0", 3, 50)
    assert got == {4: [apache, apache], 7: [("MIT", 300_001, 300_032)], None: [("Proprietary", 0, 20)], 8: [("MIT", 0, 31), ("CC-BY-NC-SA-4.0", 32, 63)], 9: [("GPL-3.0", 0, 77)]}
    edited = scan(docs.where("doc_id = 9")).first()
    assert edited.missing == [] and edited.extra == ["kindly"] and edited.coverage == 1
    assert scan(docs.limit(0)).count() == 0


def test_every_planted_line_is_found(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    want = sorted((r.doc_id, name) for r in docs.collect() for line in (r.text or "").splitlines() for name, notice in PLANTED.items() if line.strip() == notice)
    got = sorted((r.doc_id, r.license) for r in scan(docs).collect() if not r.missing and not r.extra)
    assert want and got == want
    assert all(re.search(r"[a-z]", w) for w in words_of("Version 2.0")[:1])


@pytest.mark.parametrize("template", [t for own in [parsed(LicenseParams().templates)] for t in [*own, *tags(own)]], ids=lambda t: t.license)
@pytest.mark.parametrize("prefix", ["", " * "])
def test_every_template_is_found_wrapped(template, prefix):
    for width in (30, 80):
        wrapped = textwrap.fill(template.text, width, initial_indent=prefix, subsequent_indent=prefix, break_long_words=False, break_on_hyphens=False)
        for before in ("", "\n\n", "Copyright (c) 2020 Some Author\n\n", "some line about a license\n" * 11):
            text = "plain words stand here\n" + before + wrapped + "\nand some more follow"
            found = list(Scanner(LicenseParams()).blocks(text))
            assert [b[0] for *_, b in found] == [template.license] and not found[0][2][3], (width, before, found)
            assert words_of(text[found[0][0] : found[0][1]]) == template.words


def test_shuffled_license_words_do_not_hold_a_task():
    """100 KB of nothing but license words in random order: some 5 s here, 170 s before searches were shared and bounded."""
    import random
    import time

    rng, scanner = random.Random(1), Scanner(LicenseParams())
    every = [w for t in scanner.templates for w in t.text.split()]
    text = " ".join(rng.choice(every) for _ in range(16_000))
    notice = next(t.text for t in scanner.templates if t.license == "MIT" and len(t.words) > 60)
    began = time.process_time()
    found = list(scanner.blocks(f"{text}\n\n{notice}\n\n{text[:2000]}"))
    assert len(text) > 100_000 and time.process_time() - began < 60
    assert any(b[0] == "MIT" and words_of(notice)[:20] == words_of(f"{text}\n\n{notice}"[s:e])[:20] for s, e, b in found)


@pytest.mark.parametrize(
    "text, want",
    [
        ("// SPDX-License-Identifier: MIT\nint main() {}", ["MIT"]),
        ("/* SPDX-License-Identifier: GPL-2.0-only */", ["GPL-2.0"]),
        ("# SPDX-License-Identifier: GPL-3.0-or-later", ["GPL-3.0"]),
        ("SPDX-License-Identifier: CC-BY-NC-SA-4.0", ["CC-BY-NC-SA-4.0"]),
        ("SPDX-License-Identifier: LicenseRef-Own", []),
        ("License: GPLv2+", ["GPL-2.0"]),
        ("This file is licensed under Apache 2.0.", ["Apache-2.0"]),
        ("Distributed under the Boost Software License, Version 1.0.\n(See accompanying file)", ["BSL-1.0"]),
    ],
)
def test_tags_and_short_forms(text, want):
    assert [b[0] for *_, b in Scanner(LicenseParams()).blocks(f"code\n{text}\nmore code\n")] == want
