"""Clusters and spelling variants against plain versions; edge cases; how much the bounds save."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry_module
from surveyspan.llm import ptolemaic_clusters as clusters
from surveyspan.llm import spelling_variants as spelling
from surveyspan.llm.tools import share_package
from tests.oracle_check import compare, connect

VECTOR = "vec_id long, embedding array<float>, label int, v int, known string, cluster long, _c int, row string"


def plain_clusters(rows, k, rounds, width=64):
    """(vec_id, cluster, distance) of (vec_id, vector) rows, all distances in Python integers."""
    kept = []
    for key, v in rows:
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v):
            kept.append((key, [math.floor(256 * float(np.float32(x))) for x in v]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(nearest(v)[1], []).append(v)
        for i, members in own.items():
            centroids[i] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    found = [(key, *reversed(nearest(v))) for key, v in kept]
    return found, centroids


def vector_rows(spark, rows):
    share_package(spark)
    return spark.createDataFrame([(k, v, 1, 2, "x", 3, 4, "r") for k, v in rows], VECTOR)


def check_clusters(spark, rows, k=40, rounds=5, width=64):
    want, centroids = plain_clusters(rows, k, rounds, width)
    got = clusters.cluster_vectors(vector_rows(spark, rows), k=k, rounds=rounds, width=width).collect()
    assert Counter((r["vec_id"], r["cluster"], r["distance"]) for r in got) == Counter(want)
    sums = Counter()
    for _, c, d in want:
        sums[c] += d
    for r in got:
        text = ",".join(map(str, centroids[r["cluster"]]))
        assert r["centroid_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["cluster_inertia"] == sums[r["cluster"]] and r["inertia"] == sum(sums.values())
    return got


def test_clusters_of_odd_rows(spark):
    random = np.random.default_rng(1)
    centres = random.normal(0, 1, (7, 64))
    rows = [(i, (centres[i % 7] + 0.1 * random.normal(0, 1, 64)).tolist()) for i in range(150)]
    nan, inf = float("nan"), float("inf")
    rows += [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65), (204, [nan] + [1.0] * 63)]
    rows += [(205, [1.0] * 63 + [inf]), (206, [None] + [1.0] * 63), (207, [0.0] * 64), (None, [0.5] * 64)]
    rows += [rows[3]] * 4 + [(3, rows[5][1]), (None, [0.25] * 64)] + [(300 + i, rows[9][1]) for i in range(30)]
    check_clusters(spark, rows)
    check_clusters(spark, rows[:9])
    check_clusters(spark, [(i, [1.0] * 64) for i in range(20)])
    assert clusters.cluster_vectors(vector_rows(spark, rows[150:155])).count() == 0
    empty = clusters.cluster_vectors(vector_rows(spark, rows).limit(0))
    assert empty.count() == 0 and empty.columns[:2] == ["vec_id", "cluster"]


def test_one_hot_cluster_and_another_width(spark):
    random = np.random.default_rng(2)
    rows = [(i, random.normal(0, 0.01, 3).tolist()) for i in range(200)]
    rows += [(200 + i, random.normal(5, 1, 3).tolist()) for i in range(40)]
    check_clusters(spark, rows, k=6, rounds=3, width=3)


def test_a_component_too_large_raises(spark):
    with pytest.raises(Exception, match="a component exceeds"):
        clusters.cluster_vectors(vector_rows(spark, [(1, [1e30] * 64)])).collect()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 12), st.integers(1, 9), st.sampled_from([1, 3, 1000, clusters.LARGEST - 1]))
def test_bounds_never_discard_the_nearest(seed, k, d, size):
    random = np.random.default_rng(seed)
    points = random.integers(-size, size + 1, (80, d))
    centroids = points[random.integers(0, len(points), k)]
    pivots = clusters.choose_pivots(centroids, clusters.PIVOTS)
    near = clusters.Nearest(centroids, pivots)
    c, squared, n = near.assign(points, clusters.distances(points, pivots))
    exact = ((points[:, None] - centroids[None]) ** 2).sum(2)
    assert np.array_equal(c, exact.argmin(1)) and np.array_equal(squared, exact.min(1))
    assert (near.bounds(clusters.distances(points, pivots)) <= exact).all() and (n >= 1).all() and (n <= k).all()


def test_most_distances_of_clustered_vectors_are_never_computed():
    random = np.random.default_rng(3)
    centroids = random.integers(-300, 300, (40, 64))
    points = centroids[random.integers(0, 40, 3000)] + random.integers(-8, 9, (3000, 64))
    pivots = clusters.choose_pivots(centroids, clusters.PIVOTS)
    _, _, n = clusters.Nearest(centroids, pivots).assign(points, clusters.distances(points, pivots))
    assert n.mean() < 4


def plain_counts(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) > len(a) + 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain_variants(counts):
    near = {w: [o for o in counts if one_edit(w, o)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), form[w] and counts[form[w]]))
    return out


WORD = st.text(alphabet="abé", min_size=1, max_size=7)


@settings(max_examples=12, deadline=None)
@given(st.dictionaries(WORD, st.integers(1, 40), max_size=150))
def test_variants_of_dense_words(spark, counts):
    share_package(spark)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = [tuple(r) for r in spelling.variants(words).collect()]
    assert Counter(got) == Counter(plain_variants(counts))


def test_every_length_of_chain(spark):
    counts = {"a" * (i + 1): 3 * 2**i for i in range(20)} | {"b" * 5: 3, "bbbb": 5}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert Counter(tuple(r) for r in spelling.variants(words).collect()) == Counter(plain_variants(counts))


def test_long_words(spark):
    """Prefixes on both sides of the length from which fingerprints stand for them."""
    random = np.random.default_rng(4)
    limit = spelling.WRITTEN_OUT
    counts = {"z" * 100_000: 3, "z" * 99_999: 7, "z" * 50_000 + "y" + "z" * 49_999: 20}
    for size in range(limit - 2, limit + 4):
        word = "".join(random.choice(list("abcé"), size))
        counts[word] = 50
        for at in (0, size // 2, size - 1):
            counts[word[:at] + "x" + word[at + 1 :]] = 5 + at
            counts[word[:at] + word[at + 1 :]] = 60 + at
            counts[word[:at] + "xx" + word[at:]] = 9
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert Counter(tuple(r) for r in spelling.variants(words).collect()) == Counter(plain_variants(counts))


def test_counts_of_odd_texts(spark, edge, empty):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    rows += [(20 + i, "Grüße GRÜSSE grÜsse Éclair éclair colour color Colour×x 漢字word " * 9) for i in range(60)]
    rows += [(100, "x" * 100_000 + " " + "y" * 100_000), (101, "Straße" * 30_000)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "text AS word", "2 AS prefix")
    want = plain_counts(rows)
    assert {r["word"]: r["n"] for r in spelling.word_counts(docs).collect()} == want
    got = [tuple(r) for r in spelling.spelling_variants(docs).collect()]
    assert Counter(got) == Counter(plain_variants(want))
    assert spelling.spelling_variants(empty).count() == 0


def test_variants_of_the_documents(spark, documents):
    want = plain_variants(plain_counts([(r["doc_id"], r["text"]) for r in documents.collect()]))
    assert Counter(tuple(r) for r in spelling.spelling_variants(documents).collect()) == Counter(want)


@pytest.mark.parametrize("name", ["op12_ptolemaic_clusters", "op13_permuterm_variants"])
def test_queries_agree_with_sql(spark, sf_dir, name):
    assert name in entry_module.oracle_sql()
    assert compare(spark, connect(sf_dir), sf_dir, name) == []
