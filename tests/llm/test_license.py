"""The license scan against full alignments by plain loops."""

import random
import re

import numpy as np
import pytest

from catalogspark.llm import license_scan
from catalogspark.llm.license_scan import TEMPLATES, scan_licenses

SCHEMA = "doc_id long, text string"


def words(text):
    return [w.lower() for w in re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", text)]


def common(a, b):
    """Length of the longest common subsequence, every cell by itself."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_edited_notices_equal_full_alignment(spark):
    rng = random.Random(4)
    texts, want = [], []
    for k in range(120):
        name = rng.choice([n for n in TEMPLATES if len(words(TEMPLATES[n])) >= 40])
        own = words(TEMPLATES[name])
        for _ in range(rng.randrange(len(own) // 6)):
            at = rng.randrange(len(own))
            own[at : at + rng.choice([0, 1, 1])] = [f"new{rng.randrange(99)}"] * rng.choice([0, 1, 1])
        filler = lambda: [f"filler{rng.randrange(50)}é" for _ in range(rng.randrange(30))]
        before, after = filler(), filler()
        texts.append(" ".join([*before, *own, *after]))
        want.append((name, common(words(TEMPLATES[name]), own)))
    found = {k: [] for k in range(len(texts))}
    for r in scan_licenses(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect():
        found[r.doc_id].append(r)
    index = license_scan.TemplateIndex(TEMPLATES)
    seen = 0
    for k, (name, matched) in enumerate(want):
        n = len(words(TEMPLATES[name]))
        telling = [words(TEMPLATES[name])[i] for i in index.telling[index.names.index(name)]]
        inside = words(texts[k])
        if any(inside.count(w) < 1 for w in telling):
            continue
        own = [r for r in found[k] if r.template == name]
        if own:
            seen += 1
            assert (own[0].matched, own[0].words) == (matched, n)
            assert "filler" not in texts[k][own[0].begin : own[0].end]
        else:  # a word that tells licences apart was lost, a near relative matches more, or too little is left
            assert telling or found[k] or matched < 0.75 * n
    assert seen > 80


@pytest.mark.parametrize(
    ("text", "names"),
    [
        (TEMPLATES["BSD-2-Clause"], ["BSD-2-Clause"]),
        (TEMPLATES["BSD-3-Clause"], ["BSD-3-Clause"]),
        (TEMPLATES["BSD-4-Clause"], ["BSD-4-Clause"]),
        (TEMPLATES["GPL-2.0"], ["GPL-2.0"]),
        (TEMPLATES["GPL-3.0"].replace("version 3", "version 9"), []),
        (TEMPLATES["LGPL-3.0"], ["LGPL-3.0"]),
        (TEMPLATES["AGPL-3.0"], ["AGPL-3.0"]),
        (TEMPLATES["MIT"] + "\n" + TEMPLATES["MIT-warranty"], ["MIT", "MIT-warranty"]),
        ("Licensed under CC BY-SA 4.0 or Licensed under CC BY 4.0", ["CC-BY-SA-4.0-short", "CC-BY-4.0-short"]),
        (TEMPLATES["CC-BY-NC-SA-4.0"], ["CC-BY-NC-SA-4.0"]),
        ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0-short"]),
        ((TEMPLATES["CC-BY-4.0"] + " ") * 50, ["CC-BY-4.0"] * 50),
        ((TEMPLATES["MIT-short"] + " and ") * 70, ["MIT-short"] * 70),
    ],
)
def test_relatives_and_repeats(spark, text, names):
    got = scan_licenses(spark.createDataFrame([(1, "x é " + text)], SCHEMA)).orderBy("begin").collect()
    assert [r.template for r in got] == names and all(r.coverage == 1.0 for r in got)


def test_short_empty_and_no_templates(spark):
    df = spark.createDataFrame([(1, "Licensed under CC BY here, MIT"), (2, None), (3, ""), (None, "mit cc by cc"), (4, "by cc")], SCHEMA)
    assert scan_licenses(df, {}).count() == 0
    assert scan_licenses(df, {"none": "", "dots": "..."}).count() == 0
    got = sorted((r.doc_id or 0, r.template, r.begin, r.end) for r in scan_licenses(df, {"CC": "CC BY", "MIT": "MIT", "none": ""}).collect())
    assert got == [(0, "CC", 4, 9), (0, "MIT", 0, 3), (1, "CC", 15, 20), (1, "MIT", 27, 30)]
    mixed = scan_licenses(df, {"CC": "CC BY", "long": TEMPLATES["MIT"]})
    assert {r.template for r in mixed.collect()} == {"CC"}


def test_band_alignment_is_the_full_one_inside_its_band():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = rng.integers(0, 6, 12).astype(np.uint64), rng.integers(0, 6, 15).astype(np.uint64)
        pairs = license_scan.align(a, b, -20, 20)
        assert len(pairs) == common(a.tolist(), b.tolist())
        assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs)
    assert license_scan.align(a, b[:0], -2, 2) == []
