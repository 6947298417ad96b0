"""Look-ups, full map joins, row numbers, medians and label tables: results, plans, and names that clash."""

from __future__ import annotations

import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from surveyspan.operators import order
from surveyspan.operators.joins import attach, keyed_join, lookup, lookup_join, place_lookup, whole_join
from surveyspan.plans import geography
from surveyspan.sources.codebook import (
    Variable,
    attach_codebook,
    decode_labels,
    decode_with_table,
    label_table,
    read_codebook,
)
from surveyspan.sources.tables import classify, read_code_classes


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lookup_join_matches_missing_keys_and_refuses_repeats(spark):
    left = spark.createDataFrame([(1, "a", 5), (None, "a", 6), (2, None, 7), (3, "x", 8)], "k int, u string, v int")
    right = spark.createDataFrame([(1, "a", 1.0), (None, "a", 2.0), (2, None, 3.0)], "k bigint, u string, v double")
    got = lookup_join(left, right, ["k", "u"])
    assert got.columns == ["k", "u", "v_x", "v_y"]
    assert {tuple(r) for r in got.collect()} == {(1, "a", 5, 1.0), (None, "a", 6, 2.0), (2, None, 7, 3.0), (3, "x", 8, None)}
    assert {tuple(r) for r in keyed_join(left, right, ["k", "u"]).collect()} == {tuple(r) for r in got.collect()}
    with pytest.raises(Exception, match="k, u is not unique: NULL, a"):
        lookup_join(left, right.unionByName(right.filter("k is null")), ["k", "u"]).collect()
    unlike = right.withColumn("k", F.col("k").cast("double"))
    assert {tuple(r) for r in lookup_join(left, unlike, ["k", "u"]).collect()} == {tuple(r) for r in got.collect()}


@pytest.mark.parametrize("which", ["lookup_join", "lookup", "place_lookup", "attach", "map_table"])
def test_a_lookup_is_exchanged_once(spark, no_broadcast, which):
    left = spark.range(50).select(F.col("id").alias("k"), F.col("id").cast("string").alias("city"))
    right = spark.range(9).select(F.col("id").alias("k"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("label"))
    if which == "lookup_join":
        got = lookup_join(left, right, "k")
    elif which == "lookup":
        got = lookup(left, "k", right, code="k")
    elif which == "attach":
        got = attach(left, right, {"k": "k"}, {"label": "name"})
    elif which == "map_table":
        got = geography.map_table(right, left, "k", "k")
    else:
        got = place_lookup(left, "city", right.select(F.concat(F.col("k").cast("string"), F.lit(", HT")).alias("loc"), "label"), "HT")
    text = plan(got)
    assert text.count("Exchange hashpartitioning") == 2, text
    assert got.count() == 50


def test_full_map_join_is_taken_apart(spark, no_broadcast):
    layer = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "name string, ring int")
    values = spark.createDataFrame([("a", 0.5), ("z", 0.7), (None, 0.9)], "name string, avg double")
    got = geography.full_map_table(values, layer, ["name"])
    want = {("a", 1, 0.5), ("b", 2, None), ("b", 3, None), (None, 4, 0.9), ("z", None, 0.7)}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert {tuple(r) for r in keyed_join(layer, values, ["name"], "full").collect()} == want
    assert "FullOuter" not in plan(got)
    for repeated in (("a", 0.1), ("z", 0.1)):
        doubled = values.unionByName(spark.createDataFrame([repeated], values.schema))
        with pytest.raises(Exception, match="not unique"):
            geography.full_map_table(doubled, layer, ["name"]).collect()


def test_names_that_joins_use_inside_survive(spark):
    left = spark.createDataFrame([(1, 2, 3, 4, 5)], "k int, _left_keys int, _own int, l0 int, `a.b` int")
    right = spark.createDataFrame([(1, 6, 7, 8)], "k int, _right_key0 int, _key int, r0 int")
    want = [(1, 2, 3, 4, 5, 6, 7, 8)]
    for join in (keyed_join, lookup_join, whole_join):
        got = join(left, right, "k")
        assert [tuple(r) for r in got.collect()] == want
        assert got.columns == [*left.columns, "_right_key0", "_key", "r0"]


@pytest.mark.parametrize("keys", [None, ["k", "id"]])
def test_row_numbers_keep_every_column(spark, keys):
    df = spark.range(500).select(
        (F.col("id") % 7).alias("k"), "id", *[F.col("id").alias(n) for n in ("_part", "_seq", "_n", "_before", "_rows", "_first")]
    )
    got = order.row_numbers(df, [F.col("k").desc(), F.col("id").asc()], "row", keys)
    assert got.columns == [*df.columns, "row"]
    rows = sorted(got.collect(), key=lambda r: r["row"])
    assert [r["row"] for r in rows] == list(range(1, 501))
    assert [(r["k"], r["id"]) for r in rows] == sorted(((i % 7, i) for i in range(500)), key=lambda t: (-t[0], t[1]))
    assert all(r["_part"] == r["_seq"] == r["_n"] == r["_before"] == r["_rows"] == r["_first"] == r["id"] for r in rows)


def test_numbers_of_tied_and_missing_keys(spark):
    rows = [(None, "a"), (2, "b"), (2, "c"), (1, "d"), (None, "e"), (2, "f")]
    df = spark.createDataFrame(rows, "k int, name string")
    got = order.row_numbers(df, [F.col("k").asc_nulls_last()], "row", ["k"]).collect()
    assert sorted((r["row"], r["k"]) for r in got if r["k"]) == [(1, 1), (2, 2), (3, 2), (4, 2)]
    assert sorted(r["row"] for r in got) == [1, 2, 3, 4, 5, 6] and {r["name"] for r in got} == set("abcdef")
    assert order.row_numbers(df.limit(0), [F.col("k").asc()], "row", ["k"]).count() == 0


def test_staged_rows_are_narrow(spark, monkeypatch):
    staged = []
    monkeypatch.setattr(order, "stage", lambda df: staged.append(df.columns) or df)
    wide = spark.range(10).select("id", *[F.lit("x" * 100).alias(f"c{i}") for i in range(30)])
    order.row_numbers(wide, [F.col("id").asc()], "row", ["id"])
    assert len(staged[0]) == 4


@pytest.mark.parametrize("seed", range(4))
def test_medians(spark, monkeypatch, seed):
    monkeypatch.setattr(order, "FEW", 5)
    monkeypatch.setattr(order, "_ACCURACY", 50)
    draw = random.Random(seed)
    kinds = [
        [draw.gauss(0, 1) for _ in range(draw.randint(1, 400))],
        [float(draw.randint(0, 3)) for _ in range(200)],
        [10.0 ** draw.randint(-300, 300) * draw.choice((-1, 1)) for _ in range(150)],
        [5.0] * 77 + [draw.random() for _ in range(80)],
        [1.0, 2.0],
        [float("inf"), 3.0, float("-inf"), 4.0],
    ]
    for values in kinds:
        df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 3, "v double").repartition(3)
        assert order.exact_median(df, "v").first()[0] == pytest.approx(statistics.median(values), rel=1e-15)
        for rank in {1, len(values), (len(values) + 3) // 3}:
            assert order.select_rank(df.filter("v is not null"), rank) == sorted(values)[rank - 1]
    assert order.exact_median(spark.createDataFrame([(None,)], "v double"), "v", "m p").first()["m p"] is None


def test_a_median_sorts_nothing(spark):
    df = spark.range(100_000).select((F.col("id") * 7919 % 100_003).cast("double").alias("v"), F.lit("wide").alias("other"))
    values = df.select("v")
    assert order.select_rank(values, 500) == sorted(i * 7919 % 100_003 for i in range(100_000))[499]
    assert "Sort" not in plan(values.select(F.percentile_approx("v", [0.4, 0.6], 10_000)))


# --- labels and classes ---------------------------------------------------------


def test_repeated_labels(spark):
    df = spark.createDataFrame([(1, 1.0, "1"), (2, 2.5, "x"), (None, None, None), (3, 2.0, "2")], "a int, b double, c string")
    twice = [Variable(c, None, {"yes": 1, "oui": 1, "no": 2}) for c in "abc"]
    got = decode_labels(df, ["a", "b", "c"], twice).collect()
    assert [tuple(r) for r in got] == [("yes", "yes", "yes"), ("no", "2.5", "x"), (None, None, None), ("3", "no", "no")]
    assert [tuple(r) for r in decode_labels(attach_codebook(df, twice), ["a", "b", "c"]).collect()] == [tuple(r) for r in got]


def test_label_table_gives_what_literals_give(spark):
    df = spark.createDataFrame([(i % 5, i / 2, str(i % 3)) for i in range(40)] + [(None, None, None)], "a int, b double, `c.d` string")
    variables = [Variable("a", None, {"zero": 0, "one": 1}), Variable("b", None, {"one": 1, "two": 2}), Variable("c.d", None, {"none": 0})]
    want = decode_labels(df, ["a", "b", "c.d"], variables).collect()
    got = decode_with_table(df, ["a", "b", "c.d"], label_table(variables, spark))
    assert got.columns == df.columns and sorted(map(str, got.collect())) == sorted(map(str, want))
    doubled = spark.createDataFrame([("a", 1, "b"), ("a", 1, "a"), ("a", None, "n")], "variable string, code int, label string")
    assert {r["a"] for r in decode_with_table(df, ["a"], doubled).collect()} == {"0", "a", "2", "3", "4", None}


def test_very_many_labels(spark):
    labels = spark.range(100_000).select(
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("variable"), F.col("id").alias("code"),
        F.concat(F.lit("label "), F.col("id").cast("string")).alias("label"),
    )
    df = spark.range(2000).select((F.col("id") * 50).alias("a"), (F.col("id") * 50 + 1).alias("b"), F.lit(1).alias("_label"))
    got = decode_with_table(df, ["a", "b"], labels)
    assert got.filter("a = concat('label ', substr(a, 7)) and b = concat('label ', substr(b, 7))").count() == 2000
    assert got.columns == ["a", "b", "_label"]


def test_codebook_of_many_variables(spark):
    book = spark.range(30_000).select(
        F.concat(F.lit("v"), F.col("id").cast("string")).alias("var"), F.lit("text").alias("varDescrip"),
        F.create_map(F.lit("x"), F.col("id")).alias("varValues"),
    )
    assert {(v.name, v.values["x"]) for v in read_codebook(book, ["v7", "v29999", "w"])} == {("v7", 7), ("v29999", 29999)}


def test_classes_of_any_length(spark):
    table = spark.range(30_000).select(F.col("id").alias("code"), (F.col("id") % 3).alias("improved"))
    df = spark.createDataFrame([(5, "a"), (29_999, "b"), (30_000, "c"), (None, "d")], "src int, improved string")
    got = classify(df, "src", table.unionByName(table), "cls")
    assert {tuple(r) for r in got.collect()} == {(5, "a", 2), (29_999, "b", 2), (30_000, "c", None), (None, "d", None)}
    assert len(read_code_classes(table)[1]) == 10_000
    with pytest.raises(Exception, match="not unique"):
        classify(df, "src", table.unionByName(table.selectExpr("code", "improved + 1 AS improved")), "cls").collect()


def test_exchange_of_a_label_table_is_shared(spark, no_broadcast):
    labels = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "variable string, code int, label string")
    df = spark.range(5).select(F.col("id").alias("a"), F.col("id").alias("b"))
    assert len(re.findall("HashAggregate", plan(decode_with_table(df, ["a", "b"], labels)))) == 0  # staged once before
