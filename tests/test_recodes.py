from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from surveyspan.plans import child, cholera, geography, households, sanitation, water
from surveyspan.plans.audit import audit_recode
from surveyspan.sources.tables import read_code_classes

# Recorded frequencies of water-source codes in the analysed households.
WATER_COUNTS = {
    11: 136, 12: 358, 13: 502, 14: 2367, 31: 85, 32: 520, 33: 66, 34: 433, 41: 820, 42: 3594, 43: 183,
    51: 220, 61: 95, 62: 195, 71: 572, 72: 1649, 96: 38, 99: 18,
}


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in df.select(expression(F.col("x"))).collect()]


def test_urban_flags(spark):
    assert column(spark, [1, 2, 9, None], "int", households.urban_flag) == [1, 0, None, None]
    assert column(spark, ["U", "R", "X", None], "string", geography.urban_letter_flag) == [1, 0, None, None]


def test_coordinates(spark):
    assert column(spark, [0.0, 18.5, None], "double", geography.known_coordinate) == [None, 18.5, None]


def test_minutes_to_water(spark):
    got = column(spark, [0, 30, 996, 998, 999, None], "int", households.minutes_to_water)
    assert got == [0, 30, 0, None, None, None]


def test_region_spelling(spark):
    names = ["aire metropolitaine", "grand'anse", "reste-ouest", "nord", None]
    got = column(spark, names, "string", lambda c: households.spelled_region(c, households.REGION_SPELLINGS))
    assert got == ["Aire Métropolitaine", "Grande-Anse", "Reste-Ouest", "Nord", None]


def test_region_urban(spark):
    df = spark.createDataFrame([("Nord", 1), ("Nord", 0), ("Nord", None), (None, 1)], "r string, u int")
    got = [r[0] for r in df.select(households.region_urban(F.col("r"), F.col("u"))).collect()]
    assert got == ["Nord_and_urban", "Nord_and_rural", None, None]


RAW_ROW = dict(
    hhid="1", hv001=7, hv002=1, hv005=1234567, hv021=7, hv022=1, shlocnew3=1, hv025=1, shregnew=3, hv006=5,
    hv201=11, hv204=20, hv205=22, hv225=0, hv238=2, hv271=-150000,
)


def household_frame(spark, *changes, rules=None):
    rows = [{**RAW_ROW, **c} for c in changes]
    schema = ", ".join(f"{k} {'string' if k == 'hhid' else 'bigint'}" for k in RAW_ROW)
    raw = spark.createDataFrame([tuple(r[k] for k in RAW_ROW) for r in rows], schema)
    regions = spark.createDataFrame([(3, "nord"), (12, "camps")], "code bigint, label string")
    dhs = spark.createDataFrame([(1, "rural")], "code bigint, label string")
    return households.household_table(raw, regions, dhs, rules=rules)


def test_household_table(spark):
    df = household_frame(
        spark,
        {},
        {"hhid": "2", "shregnew": 12},
        {"hhid": "3", "hv201": 99, "hv205": 99, "hv225": 9, "hv238": 98, "hv025": 3, "shlocnew3": 8},
        {"hhid": "4", "hv238": 99, "hv204": 996, "hv201": None, "shregnew": 4},
        {"hhid": "5", "hv238": 95, "shregnew": None},
    )
    rows = {r["hhid"]: r for r in df.collect()}
    assert set(rows) == {"1", "3", "4"}  # camps and unknown regions are dropped
    first = rows["1"]
    assert (first["sample_wt"], first["wealth_idx"], first["urban"]) == (1.234567, -1.5, 1)
    assert (first["region_name"], first["dhs_region"], first["region_urban"]) == ("Nord", "rural", "Nord_and_urban")
    third = rows["3"]
    assert [third[c] for c in ("water_source", "toilet_source", "share_toilet", "num_share_toilet", "urban")] == [None] * 5
    assert (third["hv201"], third["hv205"], third["dhs_region"]) == (99, 99, "8")
    assert (rows["4"]["num_share_toilet"], rows["4"]["time2water"], rows["4"]["region_name"]) == (None, 0, "4")


def test_alternate_household_rules(spark):
    df = household_frame(spark, {}, {"hhid": "2", "shregnew": 12, "hv238": 95}, rules=households.HouseholdRules.alternate())
    assert {(r["hhid"], r["num_share_toilet"]) for r in df.collect()} == {("1", 2), ("2", 10)}


def test_toilet_lists_cover_all_codes():
    listed = sanitation.IMPROVED_TOILETS + sanitation.UNIMPROVED_TOILETS + sanitation.OPEN_DEFECATION
    assert sorted(listed) == sorted(sanitation.TOILET_TYPES.values())
    assert sorted(water.IMPROVED_WATER + water.UNIMPROVED_WATER) == sorted(water.WATER_TYPES.values())


@pytest.mark.parametrize(
    "source, share, kind, primary, detail, alternate",
    [
        (11, 0, "improved", 1, "improved-unshared", 1),
        (22, 1, "improved", 0, "improved-shared", 0),
        (41, None, "improved", None, None, 0),
        (23, None, "unimproved", 0, "unimproved", 0),
        (96, 0, "unimproved", 0, "unimproved", 0),
        (31, None, "open defecation", 0, "open defecation", 0),
        (55, 0, None, None, None, 0),
        (None, 1, None, None, None, 0),
    ],
)
def test_sanitation(spark, source, share, kind, primary, detail, alternate):
    df = spark.createDataFrame([(source, share)], "toilet_source int, share_toilet int")
    row = sanitation.sanitation_indicators(df).first()
    assert (row["toilet_type"], row["improved_toilet"], row["impr_toilet_type"]) == (kind, primary, detail)
    assert sanitation.sanitation_indicators(df, rules="alternate").first()["improved_toilet"] == alternate


@pytest.mark.parametrize(
    "source, minutes, flags, kind, alternate",
    [
        (11, 30, (1, 1, 1), "improved", (1, 1, 1)),
        (11, 31, (1, 0, 1), "improved", (1, 0, 1)),
        (11, None, (1, None, 1), "improved", (1, None, 1)),
        (42, 5, (0, 0, 0), "unimproved", (0, 0, 0)),
        (71, 5, (0, 0, 1), "bottled", (0, 0, 1)),
        (72, 5, (0, 0, 1), "bottled", (0, 0, 1)),
        (55, 5, (None, None, None), None, (0, 0, 0)),
        (None, 5, (None, None, None), None, (None, None, None)),
    ],
)
def test_water(spark, source, minutes, flags, kind, alternate):
    df = spark.createDataFrame([(source, minutes)], "water_source int, time2water int")
    names = ("improved_water", "impr_water_under30min", "impr_water_dhs")
    row = water.water_indicators(df).first()
    assert tuple(row[n] for n in names) == flags and row["impr_water_type"] == kind
    other = water.water_indicators(df, rules="alternate").first()
    assert tuple(other[n] for n in names) == alternate


@pytest.mark.parametrize("module", [sanitation.sanitation_indicators, water.water_indicators])
def test_unknown_rules_are_refused(spark, module):
    with pytest.raises(ValueError):
        module(spark.createDataFrame([(1, 1)], "toilet_source int, water_source int"), rules="other")


def test_water_histogram(spark):
    df = spark.createDataFrame(list(WATER_COUNTS.items()), "water_source int, n int").withColumn("time2water", F.lit(1))
    clean = df.withColumn("water_source", F.nullif("water_source", F.lit(99)))
    coded = water.water_indicators(clean)
    total = coded.agg(
        F.sum("n").alias("all"),
        *[F.sum(F.when(F.col("impr_water_type") == k, F.col("n"))).alias(k) for k in ("improved", "unimproved", "bottled")],
        F.sum(F.when(F.col("impr_water_type").isNull(), F.col("n"))).alias("missing"),
        F.sum(F.when(F.col("improved_water") == 0, F.col("n"))).alias("not_improved"),
        F.sum(F.when(F.col("impr_water_dhs") == 1, F.col("n"))).alias("dhs"),
    ).first()
    assert tuple(total) == (11851, 5008, 4604, 2221, 18, 6825, 7229)


def test_classes_from_table(spark):
    rows = [(c, 1) for c in water.IMPROVED_WATER] + [(c, 0) for c in water.UNIMPROVED_WATER]
    found = water.WaterClasses.from_classes(read_code_classes(spark.createDataFrame(rows, "code int, improved int")))
    assert (found.improved, found.unimproved) == (tuple(sorted(water.IMPROVED_WATER)), tuple(sorted(water.UNIMPROVED_WATER)))
    assert found.unimproved_piped == (30, 33, 34, 40, 42, 43, 61, 62, 96)
    with pytest.raises(ValueError):
        read_code_classes(spark.createDataFrame(rows, "code int, improved int"), limit=5)


CHILD = dict(
    caseid="1", v001=1, v002=1, v005=1000000, v021=1, v022=1, v025=2, sregnew=1, v006=3, v191=100000, hw1=10, b8=1,
    b4=1, h11=0, hw70=-250, hw13=0,
)


def child_frame(spark, *changes):
    rows = [{**CHILD, **c} for c in changes]
    schema = ", ".join(f"{k} {'string' if k == 'caseid' else 'bigint'}" for k in CHILD)
    raw = spark.createDataFrame([tuple(r[k] for k in CHILD) for r in rows], schema)
    return child.child_table(raw, spark.createDataFrame([(1, "sud-est")], "code bigint, label string"))


def test_child_table(spark):
    df = child_frame(
        spark,
        {},
        {"caseid": "2", "b4": 2, "h11": 2, "hw70": -301, "hw13": 3},
        {"caseid": "3", "b4": 9, "h11": 8, "hw70": 9996, "hw13": None},
        {"caseid": "4", "h11": None, "hw70": None},
        {"caseid": "5", "h11": 1, "hw70": -200},
        {"caseid": "6", "b8": 5},
        {"caseid": "7", "b8": None},
        {"caseid": "8", "sregnew": 12},
    )
    rows = {r["caseid"]: r for r in df.collect()}
    assert set(rows) == {"1", "2", "3", "4", "5"}
    picked = ("sex", "diarrhea", "stunting_score", "stunted", "sev_stunted", "stunting_eligible")
    assert [tuple(rows[k][c] for c in picked) for k in "12345"] == [
        ("male", 0, -2.5, 1, 0, True),
        ("female", 1, -3.01, 1, 1, False),
        (None, None, None, None, None, None),
        ("male", None, None, None, None, True),
        ("male", 1, -2.0, 0, 0, True),
    ]
    assert rows["1"]["region_name"] == "sud-est" and rows["1"]["urban"] == 0
    assert {r["caseid"] for r in child.measured(df).collect()} == {"1", "5"}
    summary = {r["region_name"]: r for r in child.stunting_summary(df, "region_name").collect()}
    assert summary["sud-est"]["n"] == 3 and summary["sud-est"]["mean_stunted"] == pytest.approx(2 / 3)


def test_commune_priorities(spark):
    columns = f"commune string, `{cholera.DEPARTEMENT_COLUMN}` string, Priority string, `{cholera.RESPONSE_COLUMN}` string"
    raw = spark.createDataFrame(
        [(" Mirebalais ", "Centre ", "Phase 1", "A"), ("Hinche", "Centre", "Phase 2", "C"), ("X", "Y", "Phase 3", None), ("note", None, None, "B")],
        columns,
    )
    got = {tuple(r) for r in cholera.commune_priorities(raw).collect()}
    assert got == {
        ("Mirebalais", "Centre", "Phase 1", "A", 3, 2),
        ("Hinche", "Centre", "Phase 2", "C", 1, 1),
        ("X", "Y", "Phase 3", None, None, None),
    }


def test_audit_recode(spark):
    df = spark.createDataFrame([(998, None), (996, 0), (5, 5), (5, 5), (None, None)], "raw int, new int")
    got = {tuple(r) for r in audit_recode(df, "raw", "new").collect()}
    assert got == {(998, None, 1, 1), (996, 0, 1, 0), (5, 5, 2, 0), (None, None, 1, 0)}


def test_camp_filter_and_pruning_reach_the_scan(spark, tmp_path):
    schema = ", ".join(f"{k} {'string' if k == 'hhid' else 'bigint'}" for k in RAW_ROW)
    path = str(tmp_path / "raw")
    spark.createDataFrame([tuple(RAW_ROW.values())], schema).write.parquet(path)
    regions = spark.createDataFrame([(3, "nord")], "code bigint, label string")
    hh = households.household_table(spark.read.parquet(path), regions, regions)
    slim = sanitation.sanitation_indicators(hh).select("region_name", "improved_toilet")
    plan = slim._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "Not(EqualTo(shregnew,12))" in scan
    read = scan.split("ReadSchema: ")[1]
    assert "hv205" in read and "hv225" in read and "hv271" not in read and "hv204" not in read
