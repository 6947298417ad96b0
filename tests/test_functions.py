from __future__ import annotations

import unicodedata

import pytest
from pyspark.sql import functions as F

from surveyspan import functions as fn


def one(spark, rows, schema, *columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*columns).collect()]


def test_conditions_on_missing_values(spark):
    x = F.col("x")
    got = one(
        spark, [(1,), (2,), (None,)], "x int",
        fn.ifelse(x == 1, "a", "b"),
        fn.if_else(x == 1, "a", "b", "m"),
        fn.case_when((x == 1, "a"), default="z"),
        fn.is_in(x, [1, 5]),
        ~fn.is_in(x, [1, 5]),
        fn.na_if(x, 2, 9),
        fn.replace_where(x, 7, x == 1),
    )
    assert got == [
        ("a", "a", "a", True, False, 1, 7),
        ("b", "b", "z", False, True, None, 2),
        (None, "m", "z", False, True, None, None),
    ]


def test_case_when_needs_a_branch():
    with pytest.raises(ValueError):
        fn.case_when()


def test_recode_sets_and_top_code(spark):
    x = F.col("x")
    got = one(
        spark, [(95,), (3,), (40,), (None,)], "x int",
        fn.recode_sets(x, {"low": range(10), "top": (95,)}), fn.top_code(x, 95, 10),
    )
    assert got == [("top", 10), ("low", 3), (None, 40), (None, None)]


def test_title_case_and_trim(spark):
    t = F.col("t")
    rows = [("reste-ouest",), ("aire metropolitaine",), ("  SUD \t",), ("grand'anse",), (None,)]
    got = one(spark, rows, "t string", fn.title_case(t), fn.trim_text(t))
    assert [g[0] for g in got] == ["Reste-Ouest", "Aire Metropolitaine", "  Sud \t", "Grand'anse", None]
    assert [g[1] for g in got] == ["reste-ouest", "aire metropolitaine", "SUD", "grand'anse", None]


def test_glue_keeps_missing(spark):
    assert one(spark, [("a",), (None,)], "t string", fn.glue(F.col("t"), ", x")) == [("a, x",), (None,)]


def test_split_pair(spark):
    rows = [("A_and_urban",), ("plain",), (None,), ("a.b|c",)]
    got = one(spark, rows, "t string", *fn.split_pair(F.col("t"), "_and_", "l", "r"))
    assert got == [("A", "urban"), ("plain", None), (None, None), ("a.b|c", None)]
    assert one(spark, [("a.b|c",)], "t string", *fn.split_pair(F.col("t"), ".", "l", "r")) == [("a", "b|c")]


def test_percent(spark):
    got = one(spark, [(0.1234,), (1.0,), (None,)], "x double", fn.percent(F.col("x")), fn.percent(F.col("x"), 1))
    assert got == [("12%", "12.3%"), ("100%", "100.0%"), (None, None)]


def test_accent_key_matches_all_spellings(spark):
    composed = "Aire Métropolitaine"
    names = [composed, unicodedata.normalize("NFD", composed), "aire metropolitaine ", "AIRE MÉTROPOLITAINE"]
    got = one(spark, [(n,) for n in names], "t string", fn.accent_key(F.col("t")))
    assert set(got) == {("aire metropolitaine",)}


def test_same_text_collation(spark):
    df = spark.createDataFrame([("Jérémie", "jeremie"), ("Jacmel", "Hinche")], "a string, b string")
    assert [r[0] for r in df.select(fn.same_text(F.col("a"), F.col("b"))).collect()] == [True, False]


def test_respell(spark):
    got = one(spark, [("Grande Anse",), ("Sud",), (None,)], "t string", fn.respell(F.col("t"), {"Grande Anse": "Grande-Anse"}))
    assert got == [("Grande-Anse",), ("Sud",), (None,)]


@pytest.mark.parametrize(
    "value, digits, expected",
    [(0.0012345, 2, 0.0012), (987.0, 2, 990.0), (0.0, 2, 0.0), (-45678.0, 3, -45700.0), (1.0, 2, 1.0), (0.00059, 1, 0.0006)],
)
def test_signif(spark, value, digits, expected):
    assert one(spark, [(value,)], "x double", fn.signif(F.col("x"), digits))[0][0] == pytest.approx(expected, rel=1e-12)


def test_signif_missing(spark):
    assert one(spark, [(None,)], "x double", fn.signif(F.col("x"), 2)) == [(None,)]


def test_ratio_casts_and_nan(spark):
    df = spark.createDataFrame([(1.0, 0.0, "7"), (float("nan"), 2.0, "x")], "a double, b double, t string")
    clean = fn.nan_to_null(df)
    got = [tuple(r) for r in clean.select("a", fn.ratio(F.col("a"), F.col("b")), fn.to_integer(F.col("t"))).collect()]
    assert got == [(1.0, None, 7), (None, None, None)]


def test_implied_decimals(spark):
    df = fn.implied_decimals(spark.createDataFrame([(1500000, -250000)], "w bigint, x bigint"), {"w": 1e6, "x": 1e5})
    assert tuple(df.first()) == (1.5, -2.5)


@pytest.mark.parametrize("sets", [{1: [10], 2: [-3]}, {1: [10, 5000], 2: [-3]}, {1: [10, 3_000_000_000], 2: [-3]}])
def test_code_class_has_one_rule_for_all_lists(spark, sets):
    rows = [(10.0,), (10.5,), (-3.0,), (None,), (11.0,)]
    assert [r[0] for r in one(spark, rows, "x double", fn.code_class(F.col("x"), sets))] == [1, None, 2, None, None]
