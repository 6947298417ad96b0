"""Vectors of several lengths in one table."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from surveyspan.llm import subspace_join
from tests.llm.test_tokens_vectors import vector_answer


@pytest.mark.parametrize("chunk", [8192, 7])
def test_every_length_is_joined(spark, chunk):
    r = np.random.default_rng(9)
    rows = []
    for width, n in ((8, 60), (5, 40), (2, 25), (1, 4), (3, 1)):
        base = r.normal(size=(4, width)) * 3
        rows += [(len(rows) + i, (base[i % 4] + r.normal(size=width) * 0.4).tolist()) for i in range(n)]
    rows += [(len(rows) + i, rows[70 + i][1]) for i in range(3)]
    want = Counter()
    for width in {len(v) for _, v in rows}:
        want += vector_answer([x for x in rows if len(x[1]) == width])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert Counter(tuple(x) for x in subspace_join.link_vectors(df, chunk=chunk).collect()) == want
