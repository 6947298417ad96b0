"""Licences outside the templates, denials, long paragraphs, and the choice of units against a plain version."""

from __future__ import annotations

import re
import time
from functools import cache

import numpy as np
import pytest

from surveyspan.llm import license_classifier as lc


@pytest.fixture(scope="module")
def model():
    return lc.train()


def scanned(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in lc.scan_licenses(rows).orderBy("doc_id").collect()]


def test_other_licences_and_denials_are_unknown(spark):
    texts = [
        "Licensed under the Sleepycat License.",
        "Released under the Q Public License.",
        "Licensed under the Apache License, Version 1.1.",
        "Licensed under the NASA Open Source Agreement, Version 1.3.",
        "Distributed under the Open Software License, Version 3.0.",
        "SPDX-License-Identifier: Foo-1.0",
        "Licensed under the Mozilla Public License, Version 1.1.",
        "This work is not licensed under the MIT License.",
        "This work is no longer licensed under the Apache License, Version 2.0.",
        "This work isn't licensed under the MIT License.",
        "This work has not been released under the GNU General Public License, version 3.",
        "This work is not\nlicensed under the MIT License.",
        "This work is not licensed under\nthe MIT License.",
    ]
    for text, r in zip(texts, scanned(spark, texts), strict=True):
        assert r["families"] == "" and r["n_confirmed"] == 0 and r["n_candidates"] >= 1, text


def test_families_told_apart_by_their_name(spark):
    notices = {
        "Licensed under the zlib License.": "zlib",
        "Licensed under the Artistic License, Version 2.0.": "artistic-2.0",
        "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as\npublished by the Free Software Foundation, either version 3 of the\nLicense, or (at your option) any later version.": "agpl",
        "You may use it under the GNU General Public License, version 2, as you like.": "gpl",
        "Licensed under CC BY-NC-ND 4.0.": "cc-by-nd",
        "Released today under the MIT License here.": "mit",
        "Licensed under the ISC License.": "isc",
    }
    assert [r["families"] for r in scanned(spark, list(notices))] == list(notices.values())


def test_every_template_is_its_own_family(spark):
    pairs = [(t, f) for f, ts in lc.TEMPLATES.items() for t in ts]
    got = scanned(spark, [t for t, _ in pairs])
    assert [(t, r["families"]) for (t, _), r in zip(pairs, got, strict=True)] == pairs


def test_long_paragraphs_take_linear_time(spark):
    line = "Released today under the MIT License here."
    scanned(spark, [line])
    spent = []
    for n in (500, 4000):
        begun = time.time()
        got = scanned(spark, ["\n".join([line] * n)])[0]
        spent.append(time.time() - begun)
        assert got["n_confirmed"] == n and got["families"] == "mit"
    assert spent[1] < 60 and spent[1] < 8 * spent[0] + 10
    many = scanned(spark, ["\n\n".join([line] * 3000)])[0]
    assert many["n_confirmed"] == 3000


# ---- the choice of units, plainly


def _unit(model, lines, first, last):
    w = [lc.words(x) for x in lines[first : last + 1]]
    joined = [x for part in w for x in part]
    grams = {*joined, *(f"{a} {b}" for a, b in zip(joined, joined[1:], strict=False))}
    denied = False
    for i in range(first, last + 1):
        before = lc.words(lines[i - 1])[-lc.DENIAL_REACH :] if i else []
        denied |= bool(re.search(lc.DENIAL, " ".join(before + lc.words(lines[i]))))
    z = np.array(model.bias)
    for g in grams:
        z = z + np.array(model.weights.get(g, [0.0] * len(model.bias)))
    p = np.exp(z - z.max())
    p = p / p.sum()
    k = int(p.argmax())
    family = model.families[k]

    def share(text):
        pairs = lc._pairs(text) or lc.words(text)
        return sum(g in grams for g in set(pairs)) / len(pairs)

    held = any(grams.issuperset(n) for n in lc.NAMES.get(family, ()))
    own = [share(t) for t in lc.TEMPLATES.get(family, ()) if held or not lc._named(family, t)]
    coverage = max(own, default=0.0)
    sure = p[k] >= model.threshold and coverage >= lc.CONFIRM and not denied and family != lc.UNKNOWN
    hopeful = max(share(t) for ts in lc.TEMPLATES.values() for t in ts) >= lc.CONFIRM
    return (family if sure else lc.UNKNOWN), round(coverage, 4), hopeful


def plain(model, text):
    lines = text.split("\n")
    out, start = [], 0
    bounds = [i for i, x in enumerate(lines) if not re.search("[A-Za-z0-9]", x)] + [len(lines)]
    for end in bounds:
        part, first = lines[start:end], start
        start = end + 1
        if not part or not re.search(lc.ANCHOR_WRAPPED, "\n".join(part)):
            continue
        n, longest = len(part), lc.longest_template()
        marked = [bool(re.search(lc.ANCHOR_WRAPPED, "\n".join(part[i : i + 2]))) for i in range(n)]
        single = [_unit(model, part, i, i) if re.search(lc.ANCHOR, part[i]) else None for i in range(n)]
        whole = [s is not None and s[0] != lc.UNKNOWN and s[1] == 1.0 for s in single]
        units = {}
        for i in range(n):
            if single[i] and single[i][0] != lc.UNKNOWN:
                units[i, i] = single[i]
            for j in range(i + 1, n):
                if any(whole[i : j + 1]) or sum(len(lc.words(x)) for x in part[i + 1 : j]) > longest:
                    break
                if any(marked[i : j + 1]):
                    u = _unit(model, part, i, j)
                    if u[0] != lc.UNKNOWN and u[2]:
                        units[i, j] = u

        @cache
        def best(i, n=n, units=units):
            if i == n:
                return (0, 0), ()
            options = []
            for (a, b), u in units.items():
                if a == i:
                    (s, less), rest = best(b + 1)
                    gain = int(u[1] * u[1] * 1e8 + 0.5)
                    options.append(((s + gain, less - (b - a + 1)), 1, -(b - a + 1), ((a, b, u[0]), *rest)))
            (s, less), rest = best(i + 1)
            options.append(((s, less), 0, 0, rest))
            top = max(options, key=lambda o: o[:3])
            return top[0], top[3]

        taken = list(best(0)[1])
        if not taken and n > 1:
            u = _unit(model, part, 0, n - 1)
            if u[0] != lc.UNKNOWN and u[2]:
                out.append((first, u[0]))
                continue
        covered = {k for a, b, _ in taken for k in range(a, b + 1)}
        out += [(first + a, f) for a, _, f in taken]
        out += [(first + i, lc.UNKNOWN) for i in range(n) if single[i] and i not in covered]
    return sorted(out)


def test_choice_of_units_agrees_with_a_plain_version(spark, model):
    random = np.random.default_rng(5)
    templates = [t for ts in lc.TEMPLATES.values() for t in ts]
    filler = ["The river rose.", "He lost his driving license last year.", "It is not", "never released under", "", "/* --- */", "under the terms of", "copyright 2020"]
    texts = []
    for _ in range(60):
        lines = []
        for _ in range(int(random.integers(1, 5))):
            w = templates[int(random.integers(len(templates)))].split()
            w = [x for x in w if random.random() > 0.1]
            while w:
                k = int(random.integers(1, 9))
                lines.append(" ".join(w[:k]))
                w = w[k:]
            if random.random() < 0.6:
                lines.append(filler[int(random.integers(len(filler)))])
        texts.append("\n".join(lines))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows.select("doc_id", lc.paragraph_matches(rows["text"], model).alias("m")).orderBy("doc_id").collect()
    for r, text in zip(got, texts, strict=True):
        assert [(m["line"], m["family"]) for m in r["m"]] == plain(model, text), text
    assert sum(m["family"] != lc.UNKNOWN for r in got for m in r["m"]) > 60
