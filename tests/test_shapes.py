"""Polygon layers written byte by byte here and read by the source; round trips; projections."""

from __future__ import annotations

import datetime
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyspan.functions.projection import TransverseMercator, convert_rings, to_geographic, to_projected
from surveyspan.sources import polygons, shapes


def raw_polygon(rings, kind=5):
    points = [p for r in rings for p in r]
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    starts, at = [], 0
    for r in rings:
        starts.append(at)
        at += len(r)
    out = struct.pack("<i4d2i", kind, min(xs), min(ys), max(xs), max(ys), len(rings), len(points))
    out += struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
    if kind == 15:  # heights and their range
        out += struct.pack("<2d", 0, 0) + struct.pack(f"<{len(points)}d", *[0] * len(points))
    return out


def write_raw(base, contents, rows, fields, gap=0, upper=False, cpg=None):
    """A layer in the public format; ``gap`` leaves unused bytes between records."""
    at, shp, shx = 100, b"", b""
    for number, c in enumerate(contents, 1):
        shx += struct.pack(">2i", at // 2, len(c) // 2)
        record = struct.pack(">2i", number, len(c) // 2) + c + b"\xff" * gap
        shp += record
        at += len(record)
    head = lambda n: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, n // 2) + struct.pack("<2i8d", 1000, 5, *[0] * 8)
    width = 1 + sum(w for _, _, w, _ in fields)
    dbf = struct.pack("<4BIHH20x", 3, 99, 1, 1, len(rows), 33 + 32 * len(fields), width)
    dbf += b"".join(struct.pack("<11sc4xBB14x", n, k, w, d) for n, k, w, d in fields) + b"\r" + b"".join(rows) + b"\x1a"
    files = {".shp": head(100 + len(shp)) + shp, ".shx": head(100 + len(shx)) + shx, ".dbf": dbf}
    if cpg:
        files[".cpg"] = cpg
    for suffix, content in files.items():
        with open(base + (suffix.upper() if upper and suffix != ".shp" else suffix), "wb") as f:
            f.write(content)


def square(x, y, side=1.0):
    return [(x, y), (x, y + side), (x + side, y + side), (x + side, y), (x, y)]


FIELDS = [(b"NAME_1", b"C", 8, 0), (b"ID_2", b"N", 5, 0), (b"share", b"N", 8, 3), (b"on", b"L", 1, 0), (b"day", b"D", 8, 0), (b"id", b"C", 3, 0)]


def row(name, number, share, on, day, key, flag=b" "):
    cells = (name.ljust(8), number.rjust(5), share.rjust(8), on, day.ljust(8), key.ljust(3))
    return flag + b"".join(cells)


@pytest.mark.parametrize(("gap", "upper"), [(0, False), (6, True)])
def test_records_of_every_kind(spark, tmp_path, gap, upper):
    contents = [
        raw_polygon([square(0, 0), square(5, 5, 0.5)]),
        struct.pack("<i", 0),
        raw_polygon([square(1, 1)], kind=15),
        struct.pack("<i2d", 1, 3.5, -4.5),
        raw_polygon([square(9, 9)]),
        struct.pack("<i4di", 8, 0, 0, 1, 1, 2) + struct.pack("<4d", 0, 0, 1, 1),
    ]
    rows = [
        row("Été".encode("latin-1"), b"12", b"1.250", b"T", b"20120304", b"a"),
        row(b"", b"", b"*****", b"?", b"", b""),
        row(b" lead", b"-7", b"-1e2", b"n", b"00000000"[:0], b"c"),
        row(b"x", b"3", b".5", b"Y", b"19991231", b"d"),
        row(b"gone", b"1", b"1", b"T", b"", b"e", flag=b"*"),
        row(b"12345678", b"99999", b"0", b"F", b"", b"f"),
    ]
    base = str(tmp_path / "layer")
    write_raw(base, contents, rows, FIELDS, gap, upper)
    got = shapes.read_layer(spark, base + ".shp", recordBytes="120")
    assert got.columns == ["id", "NAME_1", "ID_2", "share", "on", "day", "id_attribute", "rings"]
    kinds = [f.dataType.simpleString() for f in got.schema.fields]
    assert kinds[:7] == ["bigint", "string", "bigint", "double", "boolean", "date", "string"]
    assert got.rdd.getNumPartitions() > 2
    found = {r["id"]: r for r in got.collect()}
    assert sorted(found) == [0, 1, 2, 3, 5]
    attributes = {k: tuple(r)[1:7] for k, r in found.items()}
    assert attributes == {
        0: ("Été", 12, 1.25, True, datetime.date(2012, 3, 4), "a"),
        1: (None, None, None, None, None, None),
        2: (" lead", -7, -100.0, False, None, "c"),
        3: ("x", 3, 0.5, True, datetime.date(1999, 12, 31), "d"),
        5: ("12345678", 99999, 0.0, False, None, "f"),
    }
    rings = {k: r["rings"] and [[tuple(p) for p in ring] for ring in r["rings"]] for k, r in found.items()}
    assert rings == {
        0: [square(0, 0), square(5, 5, 0.5)], 1: None, 2: [square(1, 1)], 3: [[(3.5, -4.5)]], 5: [[(0.0, 0.0), (1.0, 1.0)]]
    }


def test_many_records_of_unequal_size(spark, tmp_path):
    draw = np.random.default_rng(5)
    wanted = []
    for i in range(400):
        n = 3 if i % 50 else 4000
        wanted.append([[tuple(map(float, p)) for p in draw.normal(0, 9, (n, 2))] for _ in range(1 + i % 3)])
    base = str(tmp_path / "big")
    write_raw(base, [raw_polygon(w) for w in wanted], [b" " + str(i).rjust(5).encode() for i in range(400)], [(b"n", b"N", 5, 0)])
    got = shapes.read_layer(spark, base + ".shp", recordBytes="200000")
    layer = shapes.read_layer_shape(base + ".shp", "latin-1", 0)
    cuts = shapes.cut_layer(layer, 200_000)
    assert got.rdd.getNumPartitions() == len(cuts) > 4 and [a for a, _ in cuts[1:]] == [b for _, b in cuts[:-1]]
    rows = got.collect()
    assert len(rows) == 400 and all(r["id"] == r["n"] for r in rows)
    assert all([[tuple(p) for p in ring] for ring in r["rings"]] == wanted[r["n"]] for r in rows)
    vertices = polygons.polygon_vertices(got)
    assert vertices.count() == sum(len(ring) for w in wanted for ring in w)
    centre = {r["id"]: (r["long"], r["lat"]) for r in polygons.polygon_centroids(got.filter("n < 20")).collect()}
    plain = spark.createDataFrame(
        [(i, [[{"x": x, "y": y} for x, y in ring] for ring in wanted[i]]) for i in range(20)], got.select("id", "rings").schema
    )
    assert centre == {r["id"]: (r["long"], r["lat"]) for r in polygons.polygon_centroids(plain).collect()}


def table(spark, n=60):
    rows = [
        (i, f" né {i}", i / 7, i % 2 == 0, datetime.date(2000, 1, 1 + i % 28), None if i % 9 == 0 else
         [[{"x": -72.0 + i / 10 + dx, "y": 18.0 + dy} for dx, dy in square(0, 0, 0.1)] for _ in range(1 + i % 2)])
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "key long, name string, share double, on boolean, day date, rings array<array<struct<x:double,y:double>>>")


def test_round_trip_in_geographic_coordinates(spark, tmp_path):
    df = table(spark).repartition(4)
    path = str(tmp_path / "out")
    shapes.write_layer(df, path)
    got = shapes.read_layer(spark, path)
    assert sorted(r["id"] for r in got.collect()) == list(range(60))
    assert sorted(map(str, got.select(df.columns).collect())) == sorted(map(str, df.collect()))
    shapes.write_layer(df.filter("key < 7"), path, mode="overwrite")
    assert shapes.read_layer(spark, path).count() == 7


def test_round_trip_through_a_projection(spark, tmp_path):
    path = str(tmp_path / "utm")
    zone = TransverseMercator.utm(18)
    shapes.write_layer(table(spark), path, zone)
    assert shapes.layer_projection(path) == zone
    flat = shapes.read_layer(spark, path, reproject=False)
    east = flat.filter("rings is not null").select(F.col("rings")[0][0]["x"].alias("x")).collect()
    assert all(700_000 < r["x"] < 1_500_000 for r in east)
    back = {r["key"]: r["rings"] for r in shapes.read_layer(spark, path).collect()}
    for r in table(spark).collect():
        assert (r["rings"] is None) == (back[r["key"]] is None)
        for ring, other in zip(r["rings"] or [], back[r["key"]] or [], strict=True):
            assert np.allclose(np.array(ring), np.array(other), rtol=0, atol=1e-10)


def test_what_cannot_be_kept_is_refused(spark, tmp_path):
    rings = "cast(null as array<array<struct<x:double,y:double>>>) AS rings"
    for column in ("1 AS a_very_long_name", "array(1) AS a", "repeat('x', 300) AS a", "1L << 62 AS a"):
        with pytest.raises(Exception, match="at most 10 bytes|no counterpart|holds a"):
            shapes.write_layer(spark.range(1).selectExpr(column, rings), str(tmp_path / "bad"))
    with pytest.raises(Exception, match="is needed"):
        shapes.write_layer(spark.range(1), str(tmp_path / "bad"))


def test_broken_layers_say_so(spark, tmp_path):
    base = str(tmp_path / "l")
    write_raw(base, [raw_polygon([square(0, 0)])] * 2, [b" 1"] * 3, [(b"n", b"N", 1, 0)])
    with pytest.raises(Exception, match="holds 3 records"):
        shapes.read_layer(spark, base + ".shp").collect()
    write_raw(base, [raw_polygon([square(0, 0)])] * 2, [b" 1"] * 2, [(b"n", b"N", 1, 0)])
    content = bytearray(open(base + ".shp", "rb").read())
    content[103] = 9
    open(base + ".shp", "wb").write(bytes(content))
    with pytest.raises(Exception, match="another record"):
        shapes.read_layer(spark, base + ".shp").collect()


# --- projections ----------------------------------------------------------------


def points(spark, pairs):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pairs)], "i int, long double, lat double")


def as_pairs(df):
    return [(r["long"], r["lat"]) for r in sorted(df.collect(), key=lambda r: r["i"])]


def test_known_coordinates(spark):
    """The meridian's length to 45 and 90 degrees on WGS 84, and the false easting."""
    zone = TransverseMercator(-75.0)
    got = as_pairs(to_projected(points(spark, [(-75, 0), (-75, 45), (-75, 90), (-75, -45)]), zone))
    want = [(500_000, 0), (500_000, 4984944.378 * 0.9996), (500_000, 10001965.729 * 0.9996), (500_000, -4984944.378 * 0.9996)]
    assert np.allclose(got, want, rtol=0, atol=2e-3)


@pytest.mark.parametrize(
    "projection",
    [TransverseMercator.utm(18), TransverseMercator.utm(33, south=True), TransverseMercator(-75.0, 18.0, 1.0, 0.0, 1000.0, 6378206.4, 294.978698214, 0.3048)],
)
def test_there_and_back(spark, projection):
    draw = np.random.default_rng(8)
    pairs = [(float(projection.central_meridian + dx), float(y)) for dx, y in zip(draw.uniform(-12, 12, 300), draw.uniform(-84, 84, 300), strict=True)]
    df = points(spark, pairs)
    flat = to_projected(df, projection)
    assert np.abs(np.array(as_pairs(to_geographic(flat, projection))) - np.array(pairs)).max() < 1e-9
    ringed = spark.createDataFrame([([[{"x": x, "y": y} for x, y in pairs]],)], "rings array<array<struct<x:double,y:double>>>")
    there = ringed.select(convert_rings(F.col("rings"), projection, inverse=False).alias("rings"))
    assert np.allclose([tuple(p) for p in there.first()["rings"][0]], as_pairs(flat), rtol=1e-12)
    back = there.select(convert_rings(F.col("rings"), projection).alias("rings")).first()["rings"][0]
    assert np.abs(np.array([tuple(p) for p in back]) - np.array(pairs)).max() < 1e-9


def test_the_map_is_conformal_and_true_to_scale(spark):
    """Independent of the series: local scale is the same in all directions, and the stated one on the meridian."""
    zone, h = TransverseMercator.utm(18), 1e-4
    a, f = zone.semi_major, 1 / zone.inverse_flattening
    e2 = f * (2 - f)
    for lon, lat in [(-75.0, 18.5), (-72.3, 18.5), (-70.0, 55.0)]:
        base, east, north = (np.array(p) for p in as_pairs(to_projected(points(spark, [(lon, lat), (lon + h, lat), (lon, lat + h)]), zone)))
        phi = math.radians(lat)
        w = math.sqrt(1 - e2 * math.sin(phi) ** 2)
        metres_east = math.radians(h) * a * math.cos(phi) / w
        metres_north = math.radians(h) * a * (1 - e2) / w**3
        u, v = (east - base) / metres_east, (north - base) / metres_north
        assert abs(np.linalg.norm(u) - np.linalg.norm(v)) < 1e-5 and abs(u @ v) < 1e-5
        if lon == -75.0:
            assert abs(np.linalg.norm(v) - 0.9996) < 1e-5


def test_missing_points_and_texts(spark):
    df = spark.createDataFrame([(0, None, 1.0), (1, 2.0, None), (2, float("nan"), 3.0)], "i int, long double, lat double")
    got = as_pairs(to_projected(df, TransverseMercator.utm(18)))
    assert got[0] == (None, None) and got[1] == (None, None) and all(x is None or x != x for x in got[2])
    assert TransverseMercator.from_wkt('GEOGCS["WGS 84",DATUM["d",SPHEROID["s",6378137,298.257]]]') is None
    with pytest.raises(ValueError, match="not Transverse Mercator"):
        TransverseMercator.from_wkt('PROJCS["x",GEOGCS["g"],PROJECTION["Lambert_Conformal_Conic"]]')
    odd = TransverseMercator(-75.0, 18.0, 1.0, 10.0, 1000.0, 6378206.4, 294.978698214, 0.3048)
    assert TransverseMercator.from_wkt(odd.wkt()) == odd


def test_steps_are_not_computed_twice(spark):
    text = to_geographic(points(spark, [(0, 0)]), TransverseMercator.utm(18))._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("SINH(") + text.count("sinh(") < 40
