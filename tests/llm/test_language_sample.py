"""The sample of every language at any size, places of segments, and scores against a plain recomputation."""

from __future__ import annotations

import math

import numpy as np
import pytest

from surveyspan.llm import language_id as li
from surveyspan.llm.tools import share_package


def test_no_share_is_ever_empty():
    sizes = {"small": 3, "large": 2_000_000_000, "huge": 10**10, "most": 10**15}
    bounds = dict(li.shares(sizes))
    assert bounds["small"] == 1 << li.DRAW_BITS
    for lang in ("large", "huge", "most"):
        expected = sizes[lang] * bounds[lang] / 2**li.DRAW_BITS
        assert 0 < bounds[lang] and expected == pytest.approx(li.PER_LANGUAGE, rel=1e-3)
    many = dict(li.shares({f"l{i}": 10**12 for i in range(200_000)}))
    assert min(many.values()) > 0
    assert dict(li.shares({"x": 10**25}))["x"] == 1


def test_a_language_whose_share_meets_no_row_is_still_learned(spark, monkeypatch):
    """Counts as of a table ten billion times as large: shares so small that no row of this one is drawn."""
    share_package(spark)
    monkeypatch.setattr(li, "shares", lambda sizes: [(k, 1) for k in sizes])
    words = {"a": "alpha aleph anna", "b": "berta bravo bob", "c": "cesar charlie carl"}
    rows = [(i, " ".join([words["abc"[i % 3]]] * 5), "abc"[i % 3]) for i in range(90)] + [(100, "123 456", "none"), (101, None, "void")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.fit(docs)
    assert model.languages == ("a", "b", "c")
    assert li.accepted(docs, model).count() > 0
    got = {r["doc_id"]: r["lang_pred"] for r in li.identify(docs, model).collect()}
    assert {got[i] for i in range(90)} <= set("abc") and got[100] == got[101] == "und"


@pytest.mark.parametrize("text", ["漢字仮名交" * 4000, "x" * 50_000, "word and words " * 3000, "é" * 9000])
def test_segments_come_from_the_whole_text(text):
    raw = text.encode()
    places = []
    for key in range(300):
        for s in li.segments(key, text):
            assert s.decode() and len(s) <= li.SEGMENT_BYTES and s in b" ".join(raw.split())
    numbered = "".join(f"{i:06}" for i in range(9000))  # no blanks, and each place is told by its digits
    for key in range(300):
        for s in li.segments(key, numbered):
            at = next(k for k in range(6) if s[k : k + 6].isdigit() and int(s[k + 6 : k + 12]) == int(s[k : k + 6]) + 1)
            places.append(int(s[at : at + 6]))
    assert np.histogram(places, 10, (0, 9000))[0].min() > 0.5 * len(places) / 10


def test_segments_of_odd_texts():
    assert li.segments(1, "") == [] and li.segments(1, "  \n ") == []
    assert li.segments(5, "one") == [b"one"] and li.segments(5, "one  two\n") == [b"one two"]
    assert b"end" in b"".join(li.segments(3, " " * 100_000 + "end"))


def plain_buckets(text):
    """Bucket numbers by Python integers."""
    folded = [b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in text.encode()]
    n, mask = len(folded), (1 << 32) - 1
    folded += [32, 32, 32]
    out = []
    for i in range(n):
        three = (folded[i] * 2654435761 + folded[i + 1] * 2246822519 + folded[i + 2] * 3266489917) & mask
        four = (three * 668265263 + folded[i + 3] * 374761393 + 1) & mask
        out += [((x ^ (x >> 15)) * 2654435761 & mask) >> 18 for x in (three, four)]
    return out


@pytest.mark.parametrize("languages", [3, li.DIMENSIONS + 5])
def test_scores_are_those_of_the_plain_sum(spark, monkeypatch, languages):
    share_package(spark)
    monkeypatch.setattr(li, "PIECE", 64)
    random = np.random.default_rng(languages)
    emb, weights = random.normal(0, 1, (li.BUCKETS, li.DIMENSIONS)), random.normal(0, 1, (li.DIMENSIONS, languages))
    bias = random.normal(0, 0.1, languages)
    names = tuple(f"l{i:02}" for i in range(languages))
    model = li.replace(li.Model.of(names, emb, weights, bias), temperature=0.3, threshold=0.4)
    assert (model.weights is None) == (languages <= li.DIMENSIONS)
    texts = ["Hello, World 12", "é漢字 ÀB", "x", "The quick brown fox jumps over the lazy dog. " * 9, "a1 b2\tc3\n" * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in li.identify(docs, model).collect()}
    for i, text in enumerate(texts):
        ids = plain_buckets(text)
        mean = np.sum([emb[b] for b in ids], axis=0) / len(ids)
        logits = (mean @ weights + bias) / 0.3
        best = int(np.argmax(logits))
        score = 1 / sum(math.exp(z - logits[best]) for z in logits)
        assert got[i]["lang_pred"] == names[best] and got[i]["score"] == pytest.approx(score, rel=1e-9)
        assert got[i]["rejected"] == (score < 0.4)
