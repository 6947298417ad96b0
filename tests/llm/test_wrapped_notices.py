"""Licence notices wrapped over several lines, with other text and comment signs around them."""

from __future__ import annotations

import textwrap

import pytest

from surveyspan.llm import license_classifier

NOTICES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "cc-by-nc": "Unless noted otherwise this work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by": "The text of this work is licensed under a Creative Commons Attribution 4.0 International License.",
    "public-domain": "This is free and unencumbered software released into the public domain.",
}


def wrapped(text, width, sign):
    return "\n".join(sign + x for x in textwrap.wrap(text, width, break_long_words=False, break_on_hyphens=False))


@pytest.mark.parametrize("width", [72, 40, 20])
def test_wrapped_notices(spark, width):
    around = [("", ""), ("name.py - does things\n#\n", "\n\nimport os"), ("The river rose for three days.\n", "\nThen the market opened again.")]
    rows, want = [], {}
    for family, text in NOTICES.items():
        for before, after in around:
            for sign in ("", " * "):
                want[len(rows)] = (family, before.count("\n"))
                rows.append((len(rows), before + wrapped(text, width, sign) + after))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in license_classifier.scan_licenses(df).collect():
        family, line = want[r["doc_id"]]
        assert r["families"] == family, rows[r["doc_id"]]
        assert r["n_confirmed"] == 1, rows[r["doc_id"]]
        at = int(r["matches"].split(":")[1])
        assert line <= at <= line + wrapped(NOTICES[family], width, "").count("\n"), rows[r["doc_id"]]


def test_two_notices_in_one_paragraph(spark):
    text = "Licensed under the Apache License, Version 2.0.\n" + wrapped(NOTICES["gpl"], 60, "") + "\nReleased under the MIT License."
    got = license_classifier.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert got[0]["families"] == "apache-2.0,gpl,mit" and got[0]["n_confirmed"] == 3
