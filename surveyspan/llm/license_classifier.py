"""Licence scan: a trained paragraph classifier, confirmed against templates.

Training is a small numpy fit on the driver over the templates below, variations of them
(dropped, doubled and foreign words) and counterexamples, among them notices under made-up names: a softmax regression on
the presence of word 1-grams and 2-grams of the templates, with one class for "no licence". Its size depends on the
templates alone. The temperature and the probability below which a paragraph stays unknown come from a first
fit that has not seen a template of each family, nor any variation of it.

Applying it is one projection of DataFrame functions per document, with no shuffle and no
Python. The text is split into paragraphs, runs of lines that hold a letter or digit, and those with a licence
word, also across a line break, are looked at. Units are the lines with such a word, and windows of neighbouring lines
that hold one (as long as the lines between the first and the last have no more words than the longest template, so
any wrapped notice lies in a window). The weights of a unit's n-grams are added up from a literal map. The winning
family is confirmed if the unit shares half of the word pairs of one of its templates, holds the licence's name where that
template gives it, and no line of it denies ("not licensed under", in it or just before). Of the confirmed units of a paragraph those are reported which do not
overlap and have the largest sum of squared shares, then the fewest lines, then the earliest; where none is
confirmed, the whole paragraph is tried as one unit. Windows are left out only where no
outcome depends on them: in paragraphs whose pairs, all together, confirm nothing, over lines that hold a whole template,
and where a shorter window from the same line shares as much.

The work for a paragraph grows with its lines: each line looks at a stretch bounded by the longest template, and
the choice among units is one pass from the last line to the first and one back.

Defined cases: a NULL or empty text has no candidates; a text of any length is scanned
whole; repeated rows are reported each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspan.llm.tools import text_of

# Opening sentences and short notices of public licences.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "Released under the GNU AGPL version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "artistic-2.0": (
        "Licensed under the Artistic License, Version 2.0.",
        "This package is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.",
        "SPDX-License-Identifier: Artistic-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "bsl-1.0": (
        "Distributed under the Boost Software License, Version 1.0.",
        "Licensed under the Boost Software License, Version 1.0.",
        "SPDX-License-Identifier: BSL-1.0",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
    ),
    "cc-by-nd": (
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "Licensed under CC BY-ND 4.0.",
        "Licensed under CC BY-NC-ND 4.0.",
    ),
    "epl-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "Licensed under the Eclipse Public License, Version 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "gpl": (
        "Licensed under the GNU General Public License, version 2.",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Released under the GNU GPL version 2.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU Lesser General Public License, version 3.",
        "Released under the GNU LGPL version 3.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "proprietary": (
        "Copyright. All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced without prior written permission.",
        "This software is proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "This work has been dedicated to the public domain.",
        "To the extent possible under law, the author has waived all copyright under CC0 1.0 Universal.",
    ),
    "zlib": (
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "Licensed under the zlib License.",
        "SPDX-License-Identifier: Zlib",
    ),
}
# The names of licences as words and word pairs; one of the groups of a family must be there as a whole.
NAMES: dict[str, tuple[tuple[str, ...], ...]] = {
    "agpl": (("affero general",), ("agpl",), ("agpl-3.0-or-later",), ("agpl-3.0-only",), ("agpl-3.0",)),
    "apache-2.0": (("apache license", "2.0"), ("apache 2.0",), ("apache-2.0",)),
    "artistic-2.0": (("artistic license", "2.0"), ("artistic-2.0",)),
    "bsd": (("bsd-style",), ("bsd",), ("bsd-3-clause",), ("bsd-2-clause",)),
    "bsl-1.0": (("boost software", "1.0"), ("bsl-1.0",)),
    "cc-by": (("commons attribution",), ("commons attribution-sharealike",), ("cc by",), ("cc by-sa",), ("cc-by",), ("cc-by-sa",)),
    "cc-by-nc": (
        ("commons attribution-noncommercial",), ("commons attribution-noncommercial-sharealike",), ("cc by-nc",), ("cc by-nc-sa",), ("cc-by-nc",), ("cc-by-nc-sa",),
    ),
    "cc-by-nd": (
        ("commons attribution-noderivatives",), ("commons attribution-noncommercial-noderivatives",), ("cc by-nd",), ("cc by-nc-nd",), ("cc-by-nd",), ("cc-by-nc-nd",),
    ),
    "epl-2.0": (("eclipse public", "2.0"), ("epl-2.0",)),
    "gpl": (("gnu general",), ("gnu gpl",), ("gpl",), ("gplv2",), ("gplv3",), ("gpl-2.0-only",), ("gpl-2.0-or-later",), ("gpl-3.0-only",), ("gpl-3.0-or-later",)),
    "isc": (("isc",),),
    "lgpl": (("lesser general",), ("library general",), ("lgpl",), ("lgpl-2.1-only",), ("lgpl-2.1-or-later",), ("lgpl-3.0-only",), ("lgpl-3.0-or-later",)),
    "mit": (("mit",),),
    "mpl-2.0": (("mozilla public", "2.0"), ("mpl-2.0",)),
    "public-domain": (("public domain",), ("cc0",)),
    "zlib": (("zlib",),),
}
#: Words, joined by blanks, that deny a licence.
DENIAL = (
    r"\b(?:not|t|never|nor|neither|longer)(?: (?:yet|currently|been|be|being))? "
    r"(?:(?:re)?licen[cs]ed|released|distributed|available|covered|governed|offered|provided) (?:under|by)\b"
)
#: Words of the line before in which a denial may begin.
DENIAL_REACH = 4
# Sentences with licence words that are no licence notice.
COUNTEREXAMPLES = (
    "He lost his driving license last year.",
    "The license plate of the car was covered with mud.",
    "Permission to land was granted by the tower.",
    "A license is required to sell alcohol in this state.",
    "The copyright office moved to a new building.",
    "The warranty covers the engine for three years.",
    "The city was licensed to hold a weekly market in the middle ages.",
    "She asked for permission to leave the room.",
    "The fishing license can be bought at the lake.",
    "The court discussed copyright law and public policy.",
    "In the public domain of a modern city many people meet.",
    "The software license costs ten dollars a month.",
    "All rights of the tenants are listed in the contract.",
    "The permission of the owner must be asked before use.",
    "See the license for details.",
    "The copyright of the songs was sold to a company.",
)
# Made-up and other licence names; notices under them are no known licence.
FOREIGN = (
    "harbor", "opal", "northwind", "acme", "quartz", "openssl", "vim", "php", "ruby", "python software foundation", "microsoft public",
    "academic free", "common development and distribution", "sil open font", "european union public", "server side public",
)
#: A line without any of these words is no candidate.
ANCHOR = r"(?i)licen[cs]e|copyright|permission|redistribut|public domain|creative commons|rights reserved|proprietary|spdx|\b[al]?gpl\b|\bcc0\b"
#: The same for a paragraph, whose line breaks and comment signs may lie inside.
ANCHOR_WRAPPED = ANCHOR.replace(" ", r"[^a-zA-Z0-9]+")
WORD = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
UNKNOWN = "unknown"
CONFIRM = 0.5
#: Items that a list of units holds before a new block is begun.
_BLOCK = 256
_UNIT = "struct<first:int,last:int,family:string,probability:double,coverage:double>"
_ROUNDS, _RATE, _DECAY, _VARIANTS = 300, 3.0, 1e-3, 16


def words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def grams(text: str) -> list[str]:
    w = words(text)
    return sorted({*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))})


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]  # the last one is UNKNOWN
    weights: dict[str, list[float]]
    bias: list[float]
    threshold: float

    def probabilities(self, text: str) -> list[float]:
        z = np.array(self.bias)
        for g in grams(text):
            z = z + np.array(self.weights.get(g, [0.0] * len(self.bias)))
        p = np.exp(z - z.max())
        return list(p / p.sum())


def _named(family: str, text: str) -> bool:
    """Does a text hold a name of the family?"""
    own = set(grams(text))
    return any(own.issuperset(name) for name in NAMES.get(family, ()))


def _fit(x: np.ndarray, y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    w, b = np.zeros((x.shape[1], classes), np.float32), np.zeros(classes, np.float32)
    weight = 1 / np.bincount(y, minlength=classes)[y]
    weight = (weight / weight.sum()).astype(np.float32)
    for _ in range(_ROUNDS):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p *= weight[:, None]
        w -= _RATE * (x.T @ p + _DECAY * w)
        b -= _RATE * p.sum(0)
    return w, b


@lru_cache(maxsize=1)
def train() -> Model:
    """The same model every time: the examples and the seed are fixed."""
    random = np.random.default_rng(11)
    families = (*sorted(TEMPLATES), UNKNOWN)
    none = len(families) - 1
    fillers = [w for line in COUNTEREXAMPLES for w in words(line)]
    examples: list[tuple[list[str], int, bool]] = []  # n-grams, class, left out of the first fit

    def vary(text: str) -> str:
        w = words(text)
        kept = [x for x in w if random.random() > 0.08] or w
        at = int(random.integers(0, len(kept) + 1))
        extra = [fillers[i] for i in random.integers(0, len(fillers), int(random.integers(0, 6)))]
        return " ".join([*extra, *kept] if at % 2 else [*kept, *extra])

    def add(text: str, k: int, held: bool) -> None:
        examples.append((grams(text), k, held))
        examples.extend((grams(vary(text)), k, held) for _ in range(_VARIANTS))

    for k, family in enumerate(families[:-1]):
        for i, text in enumerate(TEMPLATES[family]):
            add(text, k, i == 1)
    for i, text in enumerate(COUNTEREXAMPLES):
        add(text, none, i % 4 == 1)
    for i, name in enumerate(FOREIGN):
        add(f"Licensed under the {name} License.", none, i % 4 == 1)
        add(f"Released under the {name} License, version 2.0.", none, i % 4 == 1)
        add(f"SPDX-License-Identifier: {name.replace(' ', '-')}", none, i % 4 == 1)
    licence_words = sorted({w for ts in TEMPLATES.values() for t in ts for w in words(t)})
    for i in range(20 * _VARIANTS):  # licence words without their order
        picked = [licence_words[i] for i in random.integers(0, len(licence_words), int(random.integers(1, 5)))]
        filler = [fillers[i] for i in random.integers(0, len(fillers), int(random.integers(4, 16)))]
        mixed = list(random.permutation([*picked, *filler]))
        examples.append((grams(" ".join(mixed)), none, i % 4 == 1))

    known = [t for ts in TEMPLATES.values() for t in ts] + list(COUNTEREXAMPLES) + list(FOREIGN)
    vocabulary = sorted({g for t in known for g in grams(t)} | {g for ns in NAMES.values() for n in ns for g in n})
    column = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(examples), len(vocabulary)), np.float32)
    for i, (gs, _, _) in enumerate(examples):
        x[i, [column[g] for g in gs if g in column]] = 1
    y = np.array([k for _, k, _ in examples])
    held = np.array([h for _, _, h in examples])
    first_w, first_b = _fit(x[~held], y[~held], len(families))
    z, own = x[held] @ first_w + first_b, y[held]

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), own]))

    t = float(min(np.geomspace(0.1, 10, 50), key=loss))
    p = np.exp((z - z.max(1, keepdims=True)) / t)
    p /= p.sum(1, keepdims=True)
    foreign = p[own == none][:, :-1].max(1)
    # a name or a whole grant confirms what is likelier than not; the quantile can only lower that
    threshold = float(min(0.5, max(0.3, np.quantile(foreign, 0.99))))
    w, b = _fit(x, y, len(families))
    weights = {g: [round(float(v), 4) for v in w[i] / t] for g, i in column.items()}
    return Model(families, weights, [round(float(v), 4) for v in b / t], round(threshold, 6))


def _literal(value: object, kind: str) -> Column:
    """A constant of a nested type; it is folded once when the plan is made."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _pairs(text: str) -> list[str]:
    return [g for g in grams(text) if " " in g]


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _pushed(acc: Column, x: Column) -> list[Column]:
    """Fields ``full, open`` of a list with one more item, kept in blocks so that an item costs no copy of all others."""
    room = F.size(acc["open"]) < _BLOCK
    return [
        F.when(room, acc["full"]).otherwise(F.concat(acc["full"], F.array(acc["open"]))).alias("full"),
        F.when(room, F.concat(acc["open"], F.array(x))).otherwise(F.array(x)).alias("open"),
    ]


def _listed(acc: Column) -> Column:
    return F.flatten(F.concat(acc["full"], F.array(acc["open"])))


def longest_template() -> int:
    return max(len(words(t)) for ts in TEMPLATES.values() for t in ts)


def paragraph_matches(text: Column, model: Model) -> Column:
    """Array of (line, family, probability, coverage): the notices of a text by their first line, and the candidate lines outside of them."""
    weights = _literal(model.weights, "map<string,array<double>>")
    vocabulary = _literal(sorted(model.weights), "array<string>")
    bias = F.array(*[F.lit(float(v)) for v in model.bias])
    labels = F.array(*[F.lit(f) for f in model.families])
    rules = {
        f: [{"pairs": _pairs(t), "words": words(t), "named": _named(f, t)} for t in ts] for f, ts in TEMPLATES.items()
    }
    templates = _literal(rules, "map<string,array<struct<pairs:array<string>,words:array<string>,named:boolean>>>")
    every = _literal([t for ts in rules.values() for t in ts], "array<struct<pairs:array<string>,words:array<string>,named:boolean>>")
    names = _literal(NAMES, "map<string,array<array<string>>>")
    longest = F.lit(longest_template())
    no_units = _literal([], f"array<{_UNIT}>")

    def largest_share(of: Column, own: Column, admitted: Callable[[Column], Column]) -> Column:
        def share(t: Column) -> Column:
            wanted = F.when(F.size(t["pairs"]) > 0, t["pairs"]).otherwise(t["words"])
            return F.when(admitted(t), F.size(F.array_intersect(wanted, own)) / F.size(wanted)).otherwise(F.lit(0.0))

        return F.coalesce(F.array_max(F.transform(of, share)), F.lit(0.0))

    def classified(first: Column, last: Column, own: Column, denied: Column) -> Column:
        """The unit of the lines from first to last with these known n-grams."""

        def scored(g: Column) -> Column:
            vectors = F.transform(g, lambda x: F.try_element_at(weights, x))
            return F.aggregate(vectors, bias, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))

        def decided(z: Column) -> Column:
            top = F.array_max(z)
            total = F.aggregate(z, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
            return F.struct(F.get(labels, (F.array_position(z, top) - 1).cast("int")).alias("family"), (F.lit(1.0) / total).alias("p"))

        def compared(c: Column) -> Column:
            held = F.exists(
                F.coalesce(F.try_element_at(names, c["family"]), F.array().cast("array<array<string>>")),
                lambda name: F.size(F.array_intersect(name, own)) == F.size(name),
            )
            of = F.try_element_at(templates, c["family"])
            share = F.coalesce(_bound(held, lambda h: largest_share(of, own, lambda t: ~t["named"] | h)), F.lit(0.0))
            return F.struct(c["family"].alias("family"), c["p"].alias("p"), share.alias("share"))

        def unit(c: Column) -> Column:
            sure = (c["p"] >= F.lit(model.threshold)) & (c["share"] >= F.lit(CONFIRM)) & ~denied & (c["family"] != UNKNOWN)
            return F.struct(
                first.alias("first"),
                last.alias("last"),
                F.when(sure, c["family"]).otherwise(F.lit(UNKNOWN)).alias("family"),
                F.round(c["p"], 4).alias("probability"),
                F.round(c["share"], 4).alias("coverage"),
            ).cast(_UNIT)

        return _bound(_bound(_bound(_bound(own, scored), decided), compared), unit)

    def confirmed(u: Column) -> Column:
        return u.isNotNull() & (u["family"] != UNKNOWN)

    def is_whole(u: Column) -> Column:
        return F.coalesce(confirmed(u) & (u["coverage"] == 1.0), F.lit(False))

    def split_up(lines: Column) -> Column:
        """Paragraphs that hold a licence word: (first line, lines)."""
        blanks = F.filter(
            F.transform(lines, lambda x, i: F.when(~F.regexp_like(x, F.lit("[A-Za-z0-9]")), i)), lambda i: i.isNotNull()
        )
        starts = F.transform(F.concat(F.array(F.lit(-1)), blanks), lambda i: i + 1)
        ends = F.concat(blanks, F.array(F.size(lines)))
        paragraphs = F.zip_with(
            starts, ends, lambda a, b: F.struct(a.alias("first"), F.slice(lines, a + 1, F.greatest(b - a, F.lit(0))).alias("lines"))
        )
        return F.filter(paragraphs, lambda p: F.regexp_like(F.array_join(p["lines"], "\n"), F.lit(ANCHOR_WRAPPED)))

    def with_words(p: Column) -> Column:
        own = p["lines"]
        lines = F.transform(
            own,
            lambda x, i: F.struct(
                F.regexp_extract_all(F.lower(x), F.lit(f"({WORD})"), 1).alias("words"),
                F.regexp_like(x, F.lit(ANCHOR)).alias("anchor"),
                # a phrase that begins here and ends in the next line
                F.regexp_like(F.concat_ws("\n", x, F.get(own, i + 1)), F.lit(ANCHOR_WRAPPED)).alias("marked"),
            ),
        )
        return F.struct(p["first"].alias("first"), lines.alias("lines"))

    def with_grams(p: Column) -> Column:
        own = p["lines"]

        def line(x: Column, i: Column) -> Column:
            w = x["words"]
            # the pair over the break belongs to the line that it ends in
            previous = F.coalesce(F.get(own, i - 1)["words"], F.array().cast("array<string>"))
            before = F.get(previous, F.size(previous) - 1)
            last = F.slice(previous, F.greatest(F.size(previous) - DENIAL_REACH + 1, F.lit(1)), F.lit(DENIAL_REACH))
            pairs = F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
            pairs = F.filter(pairs, lambda g: g.isNotNull())
            over = F.when(before.isNotNull(), F.array(F.concat(before, F.lit(" "), F.get(w, F.lit(0))))).otherwise(
                F.array().cast("array<string>")
            )
            return F.struct(
                x["anchor"].alias("anchor"),
                x["marked"].alias("marked"),
                F.size(w).alias("n"),
                F.array_intersect(F.concat(w, pairs), vocabulary).alias("grams"),
                F.array_intersect(over, vocabulary).alias("over"),
                F.regexp_like(F.array_join(F.concat(last, w), " "), F.lit(DENIAL)).alias("denied"),
            )

        return F.struct(p["first"].alias("first"), F.transform(own, line).alias("lines"))

    def with_singles(p: Column) -> Column:
        lines = F.transform(
            p["lines"],
            lambda x, i: F.struct(
                x["marked"].alias("marked"),
                x["n"].alias("n"),
                x["grams"].alias("grams"),
                x["over"].alias("over"),
                x["denied"].alias("denied"),
                F.when(x["anchor"], classified(i, i, x["grams"], x["denied"])).alias("single"),
            ),
        )
        together = F.array_distinct(F.flatten(F.transform(p["lines"], lambda x: F.concat(x["grams"], x["over"]))))
        return F.struct(p["first"].alias("first"), lines.alias("lines"), together.alias("together"))

    def with_units(p: Column) -> Column:
        """Per line the confirmed units that begin there, from short to long, each with a larger share than the one before."""
        own = p["lines"]

        def windows(x: Column, i: Column) -> Column:
            alone = F.filter(F.array(x["single"]), confirmed)
            start = F.struct(
                F.lit(0).alias("inside"),
                F.lit(True).alias("open"),
                x["marked"].alias("marked"),
                x["denied"].alias("denied"),
                x["grams"].alias("grams"),
                i.alias("last"),
                alone.alias("units"),
            )

            def more(acc: Column, y: Column) -> Column:
                inside = F.when(acc["last"] > i, acc["inside"] + F.get(own, acc["last"])["n"]).otherwise(F.lit(0))
                go = acc["open"] & ~is_whole(y["single"]) & (inside <= longest)

                def grown(grams: Column) -> Column:
                    marked, denied = acc["marked"] | y["marked"], acc["denied"] | y["denied"]
                    hopeful = marked & (largest_share(every, grams, lambda t: F.lit(True)) >= F.lit(CONFIRM))
                    unit = F.when(hopeful, classified(i, acc["last"] + 1, grams, denied))

                    def kept(u: Column) -> Column:
                        better = confirmed(u) & (
                            (F.size(acc["units"]) == 0) | (u["coverage"] > F.element_at(acc["units"], -1)["coverage"])
                        )
                        return F.when(better, F.concat(acc["units"], F.array(u))).otherwise(acc["units"])

                    return F.struct(
                        inside.alias("inside"),
                        F.lit(True).alias("open"),
                        marked.alias("marked"),
                        denied.alias("denied"),
                        grams.alias("grams"),
                        (acc["last"] + 1).alias("last"),
                        _bound(unit, kept).alias("units"),
                    )

                shut = F.struct(
                    acc["inside"].alias("inside"),
                    F.lit(False).alias("open"),
                    *[acc[c].alias(c) for c in ("marked", "denied", "grams", "last", "units")],
                )
                together = F.array_union(acc["grams"], F.concat(y["over"], y["grams"]))
                return F.when(go, _bound(together, grown)).otherwise(shut)

            # nothing is longer than the window bound allows: each line inside has a word
            near = F.slice(own, i + 2, longest + 2)
            grows = p["likely"] & ~is_whole(x["single"]) & (F.size(x["grams"]) > 0) & (x["marked"] | F.exists(near, lambda y: y["marked"]))
            return F.when(grows, F.aggregate(near, start, more, lambda acc: acc["units"])).otherwise(alone)

        lines = F.transform(own, lambda x, i: F.struct(x["single"].alias("single"), windows(x, i).alias("units")))
        entire = F.when(
            p["likely"] & (F.size(own) > 1),
            classified(F.lit(0), F.size(own) - 1, p["together"], F.exists(own, lambda x: x["denied"])),
        )
        return F.struct(p["first"].alias("first"), lines.alias("lines"), entire.alias("entire"))

    def judged(p: Column) -> Column:
        likely = largest_share(every, p["together"], lambda t: F.lit(True)) >= F.lit(CONFIRM)
        return F.struct(*[p[c].alias(c) for c in ("first", "lines", "together")], likely.alias("likely"))

    def choices(p: Column) -> Column:
        """Per line, from the last to the first, the unit to take if the line is free (NULL: none)."""
        zero = F.struct(
            F.array(F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("less"))).alias("near"),
            _literal([], f"array<array<{_UNIT}>>").alias("full"),
            no_units.alias("open"),
        )

        def step(acc: Column, x: Column) -> Column:
            def option(u: Column) -> Column:
                size = u["last"] - u["first"] + 1
                after = F.get(acc["near"], size - 1)
                gain = F.round(u["coverage"] * u["coverage"] * 1e8).cast("long")
                return F.struct(
                    (after["sum"] + gain).alias("sum"), (after["less"] - size).alias("less"), F.lit(1).alias("taken"), (-size).alias("order"), u.alias("unit")
                )

            skip = F.struct(
                F.get(acc["near"], F.lit(0))["sum"].alias("sum"),
                F.get(acc["near"], F.lit(0))["less"].alias("less"),
                F.lit(0).alias("taken"),
                F.lit(0).alias("order"),
                F.lit(None).cast(_UNIT).alias("unit"),
            )

            def after(best: Column) -> Column:
                state = F.struct(best["sum"].alias("sum"), best["less"].alias("less"))
                return F.struct(
                    F.slice(F.concat(F.array(state), acc["near"]), 1, longest + 4).alias("near"), *_pushed(acc, best["unit"])
                )

            return _bound(F.array_max(F.concat(F.transform(x["units"], option), F.array(skip))), after)

        taken = F.aggregate(F.reverse(p["lines"]), zero, step, _listed)
        return F.struct(p["first"].alias("first"), p["lines"].alias("lines"), p["entire"].alias("entire"), F.reverse(taken).alias("taken"))

    def reported(p: Column) -> Column:
        zero = F.struct(F.lit(0).alias("free"), _literal([], f"array<array<{_UNIT}>>").alias("full"), no_units.alias("open"))

        def step(acc: Column, x: Column) -> Column:
            at_start = F.when(x["i"] >= acc["free"], F.coalesce(x["unit"], x["single"]))
            return _bound(
                at_start,
                lambda u: F.when(
                    u.isNotNull(),
                    F.struct(F.greatest(acc["free"], u["last"] + 1).alias("free"), *_pushed(acc, u)),
                ).otherwise(acc),
            )

        rows = F.transform(
            p["lines"], lambda x, i: F.struct(i.alias("i"), x["single"].alias("single"), F.get(p["taken"], i).alias("unit"))
        )
        units = F.aggregate(rows, zero, step, _listed)
        none = ~F.exists(p["taken"], lambda u: u.isNotNull())
        units = F.when(none & F.coalesce(confirmed(p["entire"]), F.lit(False)), F.array(p["entire"])).otherwise(units)
        return F.transform(
            units,
            lambda u: F.struct(
                (p["first"] + u["first"]).alias("line"),
                u["family"].alias("family"),
                u["probability"].alias("probability"),
                u["coverage"].alias("coverage"),
            ),
        )

    lines = F.when(F.regexp_like(text, F.lit(ANCHOR_WRAPPED)), F.split(text, "\n")).otherwise(F.array().cast("array<string>"))
    found = _bound(lines, split_up)
    for do in (with_words, with_grams, with_singles, judged, with_units, choices, reported):
        found = F.transform(found, do)
    return F.array_sort(F.flatten(found))


def scan_licenses(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per document: ``doc_id, n_candidates, n_confirmed, families, matches``.

    ``n_candidates`` counts the notices and the lines with a licence word outside of them, ``families`` lists the confirmed
    families in order, ``matches`` is ``family:line`` for each notice by its first line (lines counted from 0).
    """
    model = train() if model is None else model
    found = docs.select("doc_id", paragraph_matches(text_of(), model).alias("_m"))
    sure = F.filter("_m", lambda m: m["family"] != UNKNOWN)
    return found.select(
        "doc_id",
        F.size("_m").cast("long").alias("n_candidates"),
        F.size(sure).cast("long").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda m: m["family"]))), ",").alias("families"),
        F.array_join(F.transform(sure, lambda m: F.concat(m["family"], F.lit(":"), m["line"].cast("string"))), ",").alias("matches"),
    )
