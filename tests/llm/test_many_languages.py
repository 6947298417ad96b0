"""More languages than a few dozen: each is learned."""

from __future__ import annotations

import numpy as np

from surveyspan.llm import language_id
from surveyspan.llm.tools import share_package


def test_every_language_is_learned(spark):
    share_package(spark)
    random = np.random.default_rng(3)
    rows = []
    for k in range(70):
        letters = random.permutation(list("abcdefghijklmnopqrstuvwxyz"))[:6]
        words = ["".join(random.choice(letters, 5)) for _ in range(12)]
        for _ in range(20 if k < 66 else 15):  # the last ones are the rarest
            rows.append((len(rows), " ".join(random.choice(words, 60)), f"l{k:02}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert model.languages == tuple(f"l{k:02}" for k in range(70))
    got = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    held = [(lang, got[i]["lang_pred"]) for i, _, lang in rows if got[i]["held_out"]]
    for some in (held, [x for x in held if x[0] >= "l64"]):
        assert sum(a == b for a, b in some) >= 0.9 * len(some) > 0


def test_rows_of_many_languages_are_bounded(spark, monkeypatch):
    share_package(spark)
    monkeypatch.setattr(language_id, "ROWS", 300)
    seen = []
    monkeypatch.setattr(language_id, "train", seen.extend)
    docs = spark.range(9000).selectExpr("id doc_id", "concat('word ', id) text", "concat('l', id % 10) lang")
    language_id.fit(docs)
    assert {r[0] for r in seen} == {f"l{k}" for k in range(10)} and 150 <= len(seen) <= 450
