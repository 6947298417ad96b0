from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from surveyspan.operators import order
from surveyspan.operators.design import SurveyDesign
from surveyspan.operators.joins import keyed_join, lookup, place_lookup, unique_lookup, with_scalar
from surveyspan.operators.reshape import codes_with, codes_without, long_form
from surveyspan.plans import audit, cholera, geography, tables
from surveyspan.staging import _bytes, broadcast_if_small

EST = "avg double, se double, ci double, lb double, ub double, N bigint, unweighted_avg double"


def est(spark, key, values):
    rows = [(k, v, 0.01, 0.02, v - 0.02 if v is not None else None, v + 0.02 if v is not None else None, 5, v) for k, v in values]
    return spark.createDataFrame(rows, f"{key} string, {EST}")


def test_keyed_join_matches_missing_keys(spark):
    left = spark.createDataFrame([(1, None, "a"), (2, 0, "b"), (3, 1, "c")], "k int, u int, v string")
    right = spark.createDataFrame([(1, None, "p"), (2, 1, "q"), (4, 0, "r")], "k int, u int, v string")
    got = {tuple(r) for r in keyed_join(left, right, ["k", "u"], "left").collect()}
    assert got == {(1, None, "a", "p"), (2, 0, "b", None), (3, 1, "c", None)}
    full = keyed_join(left, right, ["k", "u"], "full", suffixes=(" l", " r"))
    assert full.columns == ["k", "u", "v l", "v r"]
    assert {tuple(r) for r in full.collect()} >= {(4, 0, None, "r"), (2, 1, None, "q"), (1, None, "a", "p")}
    assert full.count() == 5
    rightwards = {tuple(r) for r in keyed_join(left, right, ["k", "u"], "right").collect()}
    assert rightwards == {(1, None, "a", "p"), (2, 1, None, "q"), (4, 0, None, "r")}


def test_keyed_join_with_unlike_names(spark):
    left = spark.createDataFrame([("n", 1.0)], "region string, x double")
    right = spark.createDataFrame([("n", 7), ("m", 8)], "`map name` string, y int")
    assert {tuple(r) for r in keyed_join(left, right, {"region": "map name"}, "full").collect()} == {("n", 1.0, 7), ("m", None, 8)}


def test_unique_lookup(spark):
    good = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    assert {tuple(r) for r in unique_lookup(good, ["k"]).collect()} == {("a", 1), (None, 2)}
    with pytest.raises(Exception, match="not unique: a"):
        unique_lookup(good.unionByName(spark.createDataFrame([("a", 3)], good.schema)), ["k"]).collect()


def test_lookup_passes_unknown_codes(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "x int")
    names = spark.createDataFrame([(1, "one")], "code int, label string")
    assert [r[0] for r in lookup(df, "x", names).orderBy(F.col("x").asc_nulls_last()).collect()] == ["5", "one", None]


def test_place_lookup_and_scalar(spark):
    cities = spark.createDataFrame([("Jacmel",), ("Nowhere",)], "city string")
    places = spark.createDataFrame([("Jacmel, HT", -72.5, 18.2)], "loc string, lon double, lat double")
    got = {r["city"]: (r["loc"], r["lon"]) for r in place_lookup(cities, "city", places, "HT").collect()}
    assert got == {"Jacmel": ("Jacmel, HT", -72.5), "Nowhere": ("Nowhere, HT", None)}
    national = est(spark, "x", [("all", 0.5)])
    areas = est(spark, "area", [("a", 0.1), ("b", 0.9)])
    joined = tables.with_national(areas, national)
    assert {r["national_avg"] for r in joined.collect()} == {0.5}
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(Exception):
        with_scalar(areas, areas, "avg", "x").collect()  # more than one row


def test_broadcast_only_when_small(spark):
    small = spark.range(10)
    plan = spark.range(5).join(broadcast_if_small(small, 10_000), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    plan = spark.range(5).join(broadcast_if_small(small, 10), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in plan
    assert [_bytes(t) for t in ("10485760b", "10MB", "2g", "-1", "1024")] == [10485760, 10485760, 2147483648, -1, 1024]


def test_row_numbers(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("hot"), F.col("id"))
    numbered = order.row_numbers(df, [F.col("hot").asc(), F.col("id").desc()], "row")
    rows = sorted(numbered.collect(), key=lambda r: r["row"])
    assert [r["row"] for r in rows] == list(range(1, 1001))
    assert [(r["hot"], r["id"]) for r in rows] == sorted(((r["hot"], r["id"]) for r in rows), key=lambda t: (t[0], -t[1]))


def test_sorting_puts_missing_last(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "x int")
    assert [r[0] for r in order.ascending(df, "x").collect()] == [1, 2, None]
    assert [r[0] for r in order.descending(df, "x").collect()] == [2, 1, None]


def test_code_sets_and_long_form(spark):
    a = spark.createDataFrame([(1,), (2,), (2,), (3,)], "code int")
    b = spark.createDataFrame([(3,), (4,)], "code int")
    assert sorted(r[0] for r in codes_without(a, b).collect()) == [1, 2]
    assert sorted(r[0] for r in codes_with(a, b).collect()) == [1, 2, 2, 3, 3, 4]
    wide = spark.createDataFrame([("n", 1.0, None)], "k string, `a b` double, c double")
    assert {tuple(r) for r in long_form(wide, ["k"], ["a b", "c"]).collect()} == {("n", "a b", 1.0), ("n", "c", None)}


def test_parent_summary(spark):
    child = est(spark, "admin2", [("d1", 0.2), ("d2", 0.6), ("d3", 0.4), (None, None)])
    parent = est(spark, "admin1", [("P", 0.3), ("Q", 0.7), (None, None)])
    names = spark.createDataFrame([("d1", "P"), ("d2", "Q"), ("d9", "Q")], "admin2 string, admin1 string")
    rows = {r["admin2"]: r for r in tables.with_parent_summary(child, names, parent).collect()}
    assert (rows["d1"]["admin1"], rows["d1"]["admin1_avg"], rows["d1"]["admin1_order"]) == ("P", 0.3, 2)
    assert (rows["d2"]["admin1_lb"], rows["d2"]["admin1_order"]) == (pytest.approx(0.68), 1)
    assert (rows["d3"]["admin1"], rows["d3"]["admin1_order"]) == (None, None) and None in rows
    doubled = names.unionByName(spark.createDataFrame([("d1", "Q")], names.schema))
    with pytest.raises(Exception, match="not unique"):
        tables.with_parent_summary(child, doubled, parent).collect()


def test_urban_rural_gap(spark):
    rows = []
    for region, urban, share in [("A", "urban", 3), ("A", "rural", 1), ("B", "urban", 2), ("B", "rural", 2), ("C", "urban", 4)]:
        for psu in (1, 2):
            for i in range(4):
                rows.append((1, psu, 1.0, float(i < share), region, f"{region}_and_{urban}"))
    df = spark.createDataFrame(rows, "h int, c int, w double, y double, region_name string, region_urban string")
    gap = tables.urban_rural_gap(df, SurveyDesign("c", "h", "w"), "y")
    got = {(r["region"], r["urban"]): (r["avg"], r["lagged"], r["region_avg"], r["region_order"]) for r in gap.collect()}
    assert got == {
        ("A", "rural"): (0.25, None, 0.5, 1),
        ("A", "urban"): (0.75, 0.25, 0.5, 1),
        ("B", "rural"): (0.5, None, 0.5, 2),
        ("B", "urban"): (0.5, 0.5, 0.5, 2),
        ("C", "urban"): (1.0, None, 1.0, 3),
    }


def test_compare_indicators(spark):
    a, b = est(spark, "r", [("x", 0.1), ("y", 0.4)]), est(spark, "r", [("y", 0.3), ("z", 0.8)])
    got = {(r["r"], r["indicator"]): (r["value"], r["label_colour"], r["r_order"]) for r in tables.compare_indicators(a, b, "r", "first one", "second").collect()}
    assert got == {
        ("x", "first one"): (0.1, "dark", 1),
        ("x", "second"): (None, None, 1),
        ("y", "first one"): (0.4, "light", 2),
        ("y", "second"): (0.3, "dark", 2),
        ("z", "first one"): (None, None, 3),
        ("z", "second"): (0.8, "light", 3),
    }


def test_dot_table_and_bands(spark):
    child = est(spark, "admin2", [("d1", 0.2), ("d2", 0.1), (None, 0.3)]).withColumns(
        {"admin1": F.lit("P"), "admin1_lb": F.lit(0.1), "admin1_ub": F.lit(0.3), "admin1_avg": F.lit(0.2)}
    )
    got = {r["admin2"]: (r["admin2_order"], r["avg_label"]) for r in tables.dot_table(child, "admin2").collect()}
    assert got == {"d1": (2, "20%"), "d2": (1, "10%")}
    assert [tuple(r) for r in tables.comparison_bands(child).collect()] == [("P", 0.1, 0.3, 0.2)]


def test_reconcile(spark):
    got = {r["r"]: r["difference"] for r in audit.reconcile(est(spark, "r", [("a", 0.5), ("b", 0.5)]), est(spark, "r", [("a", 0.25), ("c", 1.0)]), "r").collect()}
    assert got == {"a": 0.25, "b": None, "c": None}


def test_cluster_geography(spark):
    shared = "DHSCLUST bigint, URBAN_RURA string, LATNUM double, LONGNUM double, ADM1NAME string"
    a2 = spark.createDataFrame([(1, "U", 18.1, -72.0, "Ouest", "Arr", 4), (2, "R", 0.0, -72.5, "Sud", "Brr", 5)], shared + ", NAME_2 string, ID_2 int")
    a3 = spark.createDataFrame([(1, "U", 18.1000001, -72.0, "Ouest", "P1", "Com", "C1"), (3, "X", 0.0, 0.0, "Nord", "P3", "Don", "C3")], shared + ", A1_PCode string, A2_Name string, A2_PCode string")
    rows = {r["cluster_id"]: r for r in geography.cluster_geography(a2, a3).collect()}
    assert len(rows) == 3  # the rounding difference in latitude splits no cluster
    assert (rows[1]["lat"], rows[1]["admin2"], rows[1]["admin3"], rows[1]["urban"]) == (18.1, "Arr", "Com", 1)
    assert (rows[2]["lat"], rows[2]["lon"], rows[2]["admin3"], rows[2]["urban"]) == (None, -72.5, None, 0)
    assert (rows[3]["admin1"], rows[3]["admin2"], rows[3]["lat"], rows[3]["urban"]) == ("Nord", None, None, None)


def test_case_rates_and_series(spark):
    cases = spark.createDataFrame(
        [("A", "2015-01-01", 10, 1), ("A", "2015-02-01", 30, 0), ("Grande-Anse", "2015-01-01", 5, None), ("B", "2015-01-01", 7, 2), ("C", "2015-01-01", None, None)],
        "Departement string, Month string, Cases bigint, Deaths bigint",
    ).withColumn("Month", F.to_date("Month"))
    people = spark.createDataFrame([("A", 20_000), ("Grande Anse", 1000), ("C", 500), ("Z", 0)], "Departement string, pop bigint")
    got = [tuple(r) for r in cholera.case_rates(cases, people).collect()]
    assert [g[0] for g in got][:2] == ["Grande-Anse", "A"]
    table = {g[0]: g[1:] for g in got}
    assert table["Grande-Anse"][:2] == (5, 0) and table["Grande-Anse"][2] == pytest.approx(0.005)
    assert table["A"][:3] == (40, 1, pytest.approx(0.0015)) and table["A"][3] == pytest.approx(0.0015 / 0.00059)
    assert table["B"] == (7, 2, None, None) and table["C"] == (0, 0, None, None)
    series = [tuple(r)[0:1] + (str(r["Month"]), r["cases"]) for r in cholera.monthly_series(cases).collect()]
    assert series[:2] == [("A", "2015-01-01", 10), ("A", "2015-02-01", 30)]
    national = [(str(r["Month"]), r["cases"], r["deaths"]) for r in cholera.monthly_series(cases, None).collect()]
    assert national == [("2015-01-01", 22, 3), ("2015-02-01", 30, 0)]
