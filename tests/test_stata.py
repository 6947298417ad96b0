"""Labelled microdata files: written by another library and read here, and the other way round."""

from __future__ import annotations

import datetime
import os
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from surveyspan.sources import stata
from surveyspan.sources.codebook import Variable, attach_codebook, decode_labels

LABELS = {"hv205": {1: "flush", 2: "pit", 3: "pit", 9: "missing"}, "hv025": {1: "urban", 2: "rural"}}


def frame(n: int) -> pd.DataFrame:
    i = np.arange(n)
    return pd.DataFrame(
        {
            "hhid": [f"é{k}-x" if k % 3 else "" for k in i],
            "hv205": (i % 4).astype(np.int8),
            "hv025": (1 + i % 2).astype(np.int16),
            "hv005": (i * 1_000_003 % 2_000_000_000).astype(np.int32),
            "ratio": (i / 7).astype(np.float32),
            "score": np.where(i % 5 == 0, np.nan, i / 3.0),
            "day": pd.Timestamp("1959-12-30") + pd.to_timedelta(i, unit="D"),
            "moment": pd.Timestamp("2012-05-01 10:00:00.5") + pd.to_timedelta(i * 977, unit="s"),
        }
    )


def write(df, path, version):
    df.to_stata(
        path,
        write_index=False,
        version=version,
        convert_dates={"day": "td", "moment": "tc"},
        value_labels=LABELS,
        variable_labels={"hv205": "type of toilet", "score": "wealth"},
    )


@pytest.mark.parametrize("version", [114, 117, 118, 119])
def test_values_types_and_labels(spark, tmp_path, version):
    path = str(tmp_path / "survey.dta")
    want = frame(1000)
    write(want, path, version)
    got = stata.read_labelled(spark, path, recordBytes="3000")
    assert got.rdd.getNumPartitions() > 10
    kinds = {f.name: f.dataType.simpleString() for f in got.schema.fields}
    assert kinds == {
        "hhid": "string", "hv205": "tinyint", "hv025": "smallint", "hv005": "int", "ratio": "float",
        "score": "double", "day": "date", "moment": "timestamp_ntz",
    }
    rows = got.toPandas().sort_values(["moment"]).reset_index(drop=True)
    for name in ("hhid", "hv205", "hv025", "hv005", "ratio", "score"):
        assert rows[name].equals(want[name]) or np.allclose(rows[name], want[name], equal_nan=True)
    assert list(pd.to_datetime(rows["day"])) == list(want["day"])
    assert (rows["moment"] - want["moment"]).abs().max() <= pd.Timedelta(milliseconds=1)
    meta = {f.name: f.metadata for f in got.schema.fields}
    assert meta["hv205"]["label"] == "type of toilet" and meta["score"] == {"label": "wealth"}
    assert meta["hv025"] == {"labels": {"urban": 1, "rural": 2}}
    assert meta["hv205"]["labels"] == {"flush": 1, "pit": 2, "missing": 9}
    assert meta["hv205"]["codes"] == {"1": "flush", "2": "pit", "3": "pit", "9": "missing"}
    decoded = decode_labels(got, ["hv205", "hv025"]).groupBy("hv205").count().collect()
    assert {r["hv205"]: r["count"] for r in decoded} == {"0": 250, "flush": 250, "pit": 500}


def big_endian(raw: bytes, count: int, n: int) -> bytes:
    """A hand-made file of layout 118 in the other byte order: one byte, one int and one double per record."""
    head = b"<stata_dta><header><release>118</release><byteorder>MSF</byteorder><K>" + struct.pack(">H", 3)
    head += b"</K><N>" + struct.pack(">Q", n) + b"</N><label>" + struct.pack(">H", 2) + b"ab</label><timestamp>\0</timestamp></header>"
    names = b"".join(x.ljust(129, b"\0") for x in (b"b", b"h", b"d"))
    parts = [
        b"<variable_types>" + struct.pack(">3H", 65530, 65529, 65526) + b"</variable_types>",
        b"<varnames>" + names + b"</varnames>",
        b"<sortlist>" + bytes(8) + b"</sortlist>",
        b"<formats>" + b"".join(x.ljust(57, b"\0") for x in (b"%8.0g",) * 3) + b"</formats>",
        b"<value_label_names>" + bytes(3 * 129) + b"</value_label_names>",
        b"<variable_labels>" + bytes(3 * 321) + b"</variable_labels>",
        b"<characteristics></characteristics>",
        b"<data>" + raw + b"</data>",
        b"<strls></strls>",
        b"<value_labels></value_labels>",
    ]
    at, places = len(head) + 11 + 112, [0, len(head)]
    for p in parts:
        places.append(at)
        at += len(p)
    return head + b"<map>" + struct.pack(">14Q", *places, at, at + 12) + b"</map>" + b"".join(parts) + b"</stata_dta>"


def test_missing_codes_and_byte_order(spark, tmp_path):
    code = lambda k: 2.0**1023 * (1 + k / 4096)
    rows = [(1, -5, 0.5), (100, 32740, -1e300), (101, 32741, code(0)), (102, 32742, code(1)), (127, 32767, code(26))]
    raw = b"".join(struct.pack(">bhd", *r) for r in rows)
    path = str(tmp_path / "x.dta")
    with open(path, "wb") as out:
        out.write(big_endian(raw, 3, len(rows)))
    got = stata.read_labelled(spark, path, missing_codes=True).collect()
    assert [tuple(r) for r in got] == [
        (1, None, -5, None, 0.5, None),
        (100, None, 32740, None, -1e300, None),
        (None, ".", None, ".", None, "."),
        (None, ".a", None, ".a", None, ".a"),
        (None, ".z", None, ".z", None, ".z"),
    ]
    assert stata.read_labelled(spark, path, columns=["d", "b"]).columns == ["d", "b"]


def test_float_missing_codes(spark, tmp_path):
    path = str(tmp_path / "f.dta")
    pd.DataFrame({"x": np.array([1.5, np.nan], np.float32), "y": [np.nan, 2.5]}).to_stata(path, write_index=False)
    got = stata.read_labelled(spark, path, missing_codes=True).select("x", "x__missing", "y", "y__missing").collect()
    assert [tuple(r) for r in got] == [(1.5, None, None, "."), (None, ".", 2.5, None)]


def table(spark):
    day = datetime.date(2012, 3, 4)
    rows = [
        (i, "né " * (i % 4), i % 3, None if i % 7 == 0 else i / 3, i % 2 == 0, day + datetime.timedelta(i), datetime.datetime(2012, 1, 1, 0, 0, i % 60, 250000))
        for i in range(500)
    ] + [(None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, name string, kind int, x double, flag boolean, day date, moment timestamp_ntz")
    return attach_codebook(df, [Variable("kind", "sort of thing", {"a": 0, "b": 1, "c": 2}), Variable("x", "a number")])


def test_round_trip(spark, tmp_path, monkeypatch):
    df = table(spark).repartition(5)
    path = str(tmp_path / "out")
    stata.write_labelled(df, path)
    got = stata.read_labelled(spark, path)
    want = {
        (None if r["id"] is None else float(r["id"]), r["name"] or "", r["kind"], r["x"], None if r["flag"] is None else int(r["flag"]), r["day"], r["moment"])
        for r in df.collect()
    }
    assert {tuple(r) for r in got.collect()} == want and got.count() == 501
    meta = {f.name: f.metadata for f in got.schema.fields}
    assert meta["kind"] == {"label": "sort of thing", "labels": {"a": 0, "b": 1, "c": 2}} and meta["x"] == {"label": "a number"}
    whole = pd.concat(pd.read_stata(os.path.join(path, f), convert_categoricals=False) for f in os.listdir(path))
    assert sorted(whole["id"].dropna()) == [float(i) for i in range(500)] and whole["x"].isna().sum() == 73
    labelled = pd.read_stata(os.path.join(path, sorted(os.listdir(path))[0]))
    assert set(labelled["kind"].dropna()) <= {"a", "b", "c"}
    assert sorted((r["variable"], r["code"], r["label"]) for r in stata.label_rows(spark, path).collect()) == [
        ("kind", 0, "a"), ("kind", 1, "b"), ("kind", 2, "c")
    ]
    stata.write_labelled(df.filter("id < 9"), path, mode="overwrite")
    assert stata.read_labelled(spark, path).count() == 9
    stata.write_labelled(df.filter("id < 0"), str(tmp_path / "none"))
    none = stata.read_labelled(spark, str(tmp_path / "none"))
    assert none.count() == 0 and none.columns == df.columns


def test_what_cannot_be_kept_is_refused(spark, tmp_path):
    for column in ("cast(1L << 60 as long)", "2147483640", "repeat('x', 3000)", "1e308 * 1.5"):
        with pytest.raises(Exception, match="column v holds"):
            stata.write_labelled(spark.range(1).select(F.expr(column).alias("v")), str(tmp_path / "bad"))
    with pytest.raises(Exception, match="no counterpart"):
        stata.write_labelled(spark.range(1).select(F.array("id").alias("v")), str(tmp_path / "bad"))


def test_broken_files_say_so(spark, tmp_path):
    whole = str(tmp_path / "whole.dta")
    write(frame(50), whole, 118)
    with open(whole, "rb") as f:
        content = f.read()
    for name, cut in (("cut.dta", content[:400]), ("else.dta", b"PK" + content)):
        with open(tmp_path / name, "wb") as f:
            f.write(cut)
        with pytest.raises(Exception, match="the file ends|is not a labelled|expected"):
            stata.read_labelled(spark, str(tmp_path / name)).collect()
    with pytest.raises(Exception, match="different variables"):
        frame(5)[["hv005"]].to_stata(tmp_path / "z.dta", write_index=False)
        os.remove(tmp_path / "cut.dta")
        os.remove(tmp_path / "else.dta")
        stata.read_labelled(spark, str(tmp_path)).collect()
