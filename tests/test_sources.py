from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from surveyspan.plans.geography import admin_lookup, centroid_labels, full_map_table, map_table, trimmed_commune_names
from surveyspan.plans.cholera import priority_communes
from surveyspan.plans.sanitation import TOILET_TYPES, ToiletClasses
from surveyspan.sources import polygons, sinks, tables
from surveyspan.sources.codebook import (
    Variable,
    attach_codebook,
    codebook_table,
    decode_labels,
    labelled_recode,
    read_codebook,
    strip_metadata,
    value_label_export,
    value_labels,
)

RING = "array<array<struct<x:double,y:double>>>"


def square(x, y, side):
    return [(x, y), (x, y + side), (x + side, y + side), (x + side, y), (x, y)]


@pytest.fixture(scope="module")
def layer(spark):
    rows = [
        (1, "L'Artibonite", " Gonaive ", "Gonaives", [square(0.0, 0.0, 1.0), square(5.0, 5.0, 0.5)]),
        (2, "Sud", "Cayes", "Cayes", [square(2.0, 2.0, 2.0)[:-1]]),  # ring not closed
    ]
    return spark.createDataFrame(rows, f"id int, NAME_1 string, A2_Name string, NAME_2 string, rings {RING}")


def test_codebook_round_trip(spark, tmp_path):
    df = attach_codebook(
        spark.createDataFrame([(11, 1.0), (99, float("nan"))], "hv205 int, x double"),
        [Variable("hv205", "toilet", TOILET_TYPES), Variable("absent", "ignored")],
    )
    sinks.write_parquet(df, str(tmp_path / "data"))
    sinks.write_parquet(codebook_table(df), str(tmp_path / "book"))
    assert spark.read.parquet(str(tmp_path / "data")).schema["hv205"].metadata["label"] == "toilet"
    book = spark.read.parquet(str(tmp_path / "book"))
    assert {v.name: len(v.values) for v in read_codebook(book)} == {"hv205": 18, "x": 0}
    again = tables.read_microdata(spark, str(tmp_path / "data"), str(tmp_path / "book"))
    assert again.filter("x IS NULL").count() == 1  # NaN became NULL
    assert value_labels(book, "hv205").filter("code = 15").first()["label"] == "flush, don't know where"
    decoded = decode_labels(again, ["hv205"])
    assert sorted(r[0] for r in decoded.select("hv205").collect()) == ["99", "flush to piped sewer system"]
    assert [r[0] for r in decode_labels(again, ["x"], [Variable("x", None, {"one": 1})]).select("x").collect()].count("one") == 1
    assert strip_metadata(again).schema["hv205"].metadata == {}
    coded = labelled_recode(again, "kind", F.lit(1), "kind of toilet", {"improved": 1})
    assert coded.schema["kind"].metadata == {"label": "kind of toilet", "labels": {"improved": 1}}
    assert value_label_export(spark, TOILET_TYPES).count() == 18


def test_classification_file_with_bare_carriage_returns(spark, tmp_path):
    path = tmp_path / "classes.csv"
    path.write_text('toilet_type,code,improved\rflush toilet,10,Improved\r"flush, don\'t know where",15,Improved\rno facility,30,open defecation\rother,96,Unimproved', newline="")
    table = tables.read_delimited(spark, str(path), tables.TOILET_CLASS_SCHEMA)
    assert table.count() == 4 and table.filter("code = 15").first()[0] == "flush, don't know where"
    assert ToiletClasses.from_classes(tables.read_code_classes(table)) == ToiletClasses((10, 15), (96,), (30,))


def test_blank_header_keeps_leading_spaces(spark, tmp_path):
    path = tmp_path / "water.csv"
    path.write_text(",code,improved\rpiped water,10,1\r    piped into dwelling,11,1", newline="")
    rows = tables.read_delimited(spark, str(path), tables.WATER_CLASS_SCHEMA).collect()
    assert [r[0] for r in rows] == ["piped water", "    piped into dwelling"]


def test_sheet_export(spark, tmp_path):
    path = tmp_path / "sheet.csv"
    path.write_text("List of communes,,\ncommune,cases,month\nA,12,2015-01-01\nB,n/a,2015-02-01\n")
    got = [tuple(map(str, r)) for r in tables.read_sheet_export(spark, str(path), "commune string, cases double, month date", lead_rows=True).collect()]
    assert got == [("A", "12.0", "2015-01-01"), ("B", "None", "2015-02-01")]
    folder = tmp_path / "several"
    folder.mkdir()
    (folder / "a.csv").write_text("Title,,\ncommune,cases,month\nA,1,2015-01-01\nNippes,,\ncommune,cases,month\n")
    (folder / "b.csv").write_text("Title,,\nMore,,\ncommune,cases,month\nB,2,2015-01-01\n")
    kept = tables.read_sheet_export(spark, str(folder), "commune string, cases double, month date", lead_rows=True)
    assert sorted((r[0], r[1]) for r in kept.collect()) == [("A", 1.0), ("B", 2.0), ("Nippes", None), ("commune", None)]
    plain = tmp_path / "plain.csv"
    plain.write_text("Departement,Month,Cases,Deaths\nSud,2015-01-01,3,\n")
    row = tables.read_sheet_export(spark, str(plain), tables.MONTHLY_CASES_SCHEMA).first()
    assert (row["Departement"], str(row["Month"]), row["Cases"], row["Deaths"]) == ("Sud", "2015-01-01", 3.0, None)
    assert tables.secondary_cities(spark).count() == 13


def test_csv_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", 1), ("c", 3)], "k string, v int")
    sinks.write_csv(df, str(tmp_path / "plain"))
    assert spark.read.csv(str(tmp_path / "plain"), header=True).count() == 3
    sinks.write_numbered_csv(df, str(tmp_path / "numbered"), [F.col("k").asc()])
    got = {tuple(r) for r in spark.read.csv(str(tmp_path / "numbered"), header=True, inferSchema=True).collect()}
    assert got == {(1, "a", 1), (2, "b", 2), (3, "c", 3)}


def test_vertices(layer):
    rows = polygons.polygon_vertices(layer).filter("id = 1").orderBy("order").collect()
    assert [r["order"] for r in rows] == list(range(1, 11))
    assert [(r["piece"], r["group"]) for r in rows] == [(1, "1.1")] * 5 + [(2, "1.2")] * 5
    assert (rows[5]["long"], rows[5]["lat"], rows[5]["NAME_2"]) == (5.0, 5.0, "Gonaives")
    main = polygons.select_pieces(polygons.polygon_vertices(layer), [1, 2])
    assert main.count() == 9


def test_attributes_from_a_second_table(spark, layer):
    bare = polygons.polygon_vertices(layer.select("id", "rings"))
    joined = polygons.attach_attributes(bare, layer.select("id", "NAME_2"))
    assert {r["NAME_2"] for r in joined.collect()} == {"Gonaives", "Cayes"} and joined.count() == bare.count()


def test_centroids(layer):
    got = {r["id"]: (r["long"], r["lat"], r["label"]) for r in polygons.polygon_centroids(layer, "NAME_2").collect()}
    assert got == {1: (0.5, 0.5, "Gonaives"), 2: (3.0, 3.0, "Cayes")}
    with pytest.warns(UserWarning, match="not in the polygon layer"):
        assert polygons.polygon_centroids(layer, "nothing").columns == ["id", "long", "lat"]


def test_centroid_needs_no_shuffle(layer):
    assert "Exchange" not in polygons.polygon_centroids(layer, "NAME_2")._jdf.queryExecution().executedPlan().toString()


def test_layer_export(spark, layer, tmp_path):
    polygons.export_layer(layer, str(tmp_path), "arr", "NAME_2")
    vertices = spark.read.csv(str(tmp_path / "arr.csv"), header=True, inferSchema=True)
    assert vertices.count() == 14 and vertices.agg(F.max("row")).first()[0] == 14
    assert spark.read.csv(str(tmp_path / "arr_centroids.csv"), header=True).count() == 2


def test_maps(spark, layer):
    vertices = polygons.polygon_vertices(layer)
    areas = spark.createDataFrame([("Gonaives", 0.25), ("Elsewhere", 0.5)], "admin2 string, avg double")
    mapped = map_table(areas, vertices, "admin2", "NAME_2")
    assert mapped.count() == 14 and mapped.filter("avg = 0.25").count() == 10
    full = full_map_table(areas, vertices, {"NAME_2": "admin2"})
    assert full.count() == 15 and full.filter("id IS NULL").first()["NAME_2"] == "Elsewhere"
    labels = centroid_labels(polygons.polygon_centroids(layer, "NAME_2"), mapped, "NAME_2", "avg")
    assert {r["label"]: r["var_pct"] for r in labels.collect()} == {"Gonaives": "25%", "Cayes": None}
    with pytest.raises(Exception, match="not unique"):
        map_table(areas.union(areas), vertices, "admin2", "NAME_2").collect()


def test_admin_lookup(layer):
    assert {tuple(r) for r in admin_lookup(layer).collect()} == {("Artibonite", "Gonaives"), ("Sud", "Cayes")}


def test_priority_communes_on_polygons(spark, layer):
    vertices = trimmed_commune_names(polygons.polygon_vertices(layer), departement="NAME_1")
    raw = spark.createDataFrame(
        [("Gonaive ", "L'Artibonite ", "Phase 1", "A"), ("Lost", "Nord", "Phase 2", "B")],
        "commune string, `Departement ` string, Priority string, `Cholera Response (Mid-term Plan)` string",
    )
    full = priority_communes(raw, vertices)
    assert full.count() == 15 and full.filter("prevalence2016 = 3").count() == 10
    assert priority_communes(raw, vertices, "left").count() == 11


def test_wide_codebook_and_labels_on_doubles(spark, tmp_path):
    import time

    names = [f"v{i}" for i in range(2000)]
    wide = spark.createDataFrame([tuple(range(2000))], ", ".join(f"{n} long" for n in names))
    start = time.time()
    labelled = attach_codebook(wide, [Variable(n, n, {"zero": 0}) for n in names])
    assert time.time() - start < 15
    assert all(f.metadata["labels"] == {"zero": 0} for f in labelled.schema.fields)
    assert not any(f.metadata for f in strip_metadata(labelled).schema.fields)

    doubles = spark.createDataFrame([(1.0, float("nan"))], "`a.b` double, c double")
    path = str(tmp_path / "labelled")
    attach_codebook(doubles, [Variable("a.b", "dotted", {"one": 1})]).write.parquet(path)
    again = tables.read_microdata(spark, path)
    assert again.schema["a.b"].metadata["labels"] == {"one": 1} and again.first()["c"] is None


def test_decode_matches_whole_values_only(spark):
    df = spark.createDataFrame([(1.0,), (1.5,), (3e9,), (None,)], "x double")
    got = [r[0] for r in decode_labels(df, ["x"], [Variable("x", None, {"one": 1, "big": 3_000_000_000})]).collect()]
    assert got == ["one", "1.5", "big", None]
