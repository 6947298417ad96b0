"""Tolerant place names against all pairs by brute force."""

from __future__ import annotations

import random
import unicodedata

import pytest

from surveyspan.operators.places import best_places, close_names, tolerant_lookup


def folded(text):
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).strip().lower()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def slipped(rng, name, n):
    for _ in range(n):
        i = rng.randrange(len(name) + 1)
        kind = rng.randrange(3)
        name = name[:i] + rng.choice("abé ") * (kind != 0) + name[i + (kind != 1) :]
    return name


@pytest.mark.parametrize(("k", "per"), [(1, 1), (2, 1), (2, 4), (3, 3)])
def test_all_close_pairs_are_found(spark, k, per):
    rng = random.Random(k * 10 + per)
    places = {"".join(rng.choice("abcé ") for _ in range(rng.randint(0, 12))) for _ in range(120)} | {"Port-au-Prince", "Cap-Haïtien", "", "a"}
    names = {slipped(rng, rng.choice(sorted(places)), rng.randint(0, k + 1)) for _ in range(150)} | {"", "É", "cap haitien", "PORT-AU-PRINCE"}
    one = lambda xs: spark.createDataFrame([(x,) for x in sorted(xs)] * 2 + [(None,)], "t string")
    got = {tuple(r) for r in close_names(one(names), one(places), k, per).collect()}
    want = set()
    for n in names:
        for p in places:
            d = edits(folded(n), folded(p))
            if d <= min(k, len(folded(n)) // per):
                want.add((n, p, d))
    assert got == want
    best = {r["name"]: r for r in best_places(one(names), one(places), k, per).collect()}
    for n in names:
        near = [(-1 if n == p else d, p, d) for m, p, d in want if m == n]
        if not near:
            assert n not in best
            continue
        top = [x for x in near if x[0] == min(near)[0]]
        assert (best[n]["n_places"], best[n]["distance"]) == (len(top), top[0][2])
        assert best[n]["place"] == (top[0][1] if len(top) == 1 else None)


def test_rows_keep_their_order_of_columns_and_ambiguous_names_are_told(spark):
    cities = spark.createDataFrame(
        [("Jeremie", 1), (" cap-haitien ", 2), ("Saint-Marc", 3), ("Saint-Mark", 4), ("Nowhere at all", 5), (None, 6), ("Jeremie", 7)], "city string, n int"
    )
    gazetteer = spark.createDataFrame(
        [("Jérémie", -74.1), ("Cap-Haïtien", -72.2), ("Saint-Marc", -72.7), ("Saint-Mars", -1.0), (None, 0.0)], "loc string, lon double"
    )
    got = tolerant_lookup(cities, "city", gazetteer)
    assert got.columns == ["city", "n", "loc", "distance", "n_places", "lon"]
    found = {r["n"]: (r["loc"], r["distance"], r["n_places"], r["lon"]) for r in got.collect()}
    assert found == {
        1: ("Jérémie", 0, 1, -74.1), 7: ("Jérémie", 0, 1, -74.1), 2: ("Cap-Haïtien", 0, 1, -72.2), 3: ("Saint-Marc", 0, 1, -72.7),
        4: (None, 1, 2, None), 5: (None, None, 0, None), 6: (None, None, 0, None),
    }
    with pytest.raises(Exception, match="not unique"):
        tolerant_lookup(cities, "city", gazetteer.unionByName(gazetteer)).collect()


def test_only_names_that_share_a_piece_are_compared(spark):
    places = spark.range(3000).selectExpr("concat('place number ', lpad(cast(id * 7919 % 100000 as string), 6, '0')) AS p")
    names = spark.range(1).selectExpr("'plaza number 007919' AS n")
    assert best_places(names, places).collect()[0]["n_places"] == 1
    plan = close_names(names, places)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan
