from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyspan.operators import counts
from surveyspan.operators.design import SurveyDesign, design_summary
from surveyspan.operators.estimate import (
    cluster_totals,
    domain_families,
    domain_table,
    estimate_many,
    estimates,
    point_estimate,
    wide_totals,
)
from surveyspan.staging import stage

SCHEMA = "h int, c int, w double, y double, d string, e string"
DESIGN = SurveyDesign("c", "h", "w")


def brute_force(rows, domain=None, design_rows=None):
    """Mean and standard error with every PSU of the design written out, zeros included."""
    inside = [r for r in rows if r[3] is not None and (domain is None or r[4] == domain)]
    total = sum(r[2] for r in inside)
    avg = sum(r[2] * r[3] for r in inside) / total
    psus = sorted({(r[0], r[1]) for r in (design_rows or rows)})
    z = {p: 0.0 for p in psus}
    for r in inside:
        z[(r[0], r[1])] += r[2] * (r[3] - avg) / total
    variance = 0.0
    for h in {p[0] for p in psus}:
        values = np.array([z[p] for p in psus if p[0] == h])
        variance += len(values) * values.var(ddof=1)
    return avg, math.sqrt(variance)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    for h in range(4):
        for c in range(5):
            for _ in range(rng.randint(3, 9)):
                y = None if rng.random() < 0.15 else float(rng.random() < 0.2 + 0.1 * h)
                d = rng.choice(["a", "b", None]) if c != 4 else "b"
                out.append((h, c, rng.uniform(0.5, 3.0), y, d, "x" if h < 2 else "y"))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).cache()


def by_key(table, key):
    return {r[key]: r for r in table.collect()}


def test_tiny_design_by_hand(spark):
    # One stratum, two PSUs with equal weights: means 1 and 0, so avg 0.5 and
    # z = +-0.25; variance 2/(2-1) * (2 * 0.0625) = 0.25.
    rows = [(1, 1, 1.0, 1.0, "a", "x"), (1, 1, 1.0, 1.0, "a", "x"), (1, 2, 1.0, 0.0, "a", "x"), (1, 2, 1.0, 0.0, "a", "x")]
    r = point_estimate(spark.createDataFrame(rows, SCHEMA), DESIGN, "y").first()
    assert tuple(r) == (0.5, 0.5, 1.0, -0.5, 1.5, 4, 0.5)


def test_national_and_domains_match_brute_force(df, rows):
    national = point_estimate(df, DESIGN, "y").first()
    assert (national["avg"], national["se"]) == pytest.approx(brute_force(rows), rel=1e-12)
    found = by_key(point_estimate(df, DESIGN, "y", "d"), "d")
    for d in ("a", "b"):
        avg, se = brute_force(rows, d)
        r = found[d]
        assert (r["avg"], r["se"]) == pytest.approx((avg, se), rel=1e-12)
        assert (r["ci"], r["lb"], r["ub"]) == pytest.approx((2 * se, avg - 2 * se, avg + 2 * se), rel=1e-12)
        plain = [x[3] for x in rows if x[4] == d and x[3] is not None]
        assert r["N"] == len(plain) and r["unweighted_avg"] == pytest.approx(sum(plain) / len(plain))


def test_missing_domain_keeps_only_its_size(df, rows):
    r = by_key(point_estimate(df, DESIGN, "y", "d"), "d")[None]
    plain = [x[3] for x in rows if x[4] is None and x[3] is not None]
    assert [r[c] for c in ("avg", "se", "ci", "lb", "ub")] == [None] * 5
    assert r["N"] == len(plain) and r["unweighted_avg"] == pytest.approx(sum(plain) / len(plain))


def test_weight_scale_changes_nothing(df):
    a = by_key(point_estimate(df, DESIGN, "y", "d"), "d")
    b = by_key(point_estimate(df.withColumn("w", F.col("w") * 1000), DESIGN, "y", "d"), "d")
    for d in ("a", "b"):
        assert (a[d]["avg"], a[d]["se"]) == pytest.approx((b[d]["avg"], b[d]["se"]), rel=1e-9)


def test_domain_that_is_a_psu_has_no_error(df):
    keyed = df.withColumn("psu", F.col("h") * 10 + F.col("c"))
    table = point_estimate(keyed, SurveyDesign("psu", "h", "w"), "y", "psu")
    assert table.schema["psu"].dataType.simpleString() == "int"
    assert all(r["se"] == pytest.approx(0.0, abs=1e-12) for r in table.collect())


def test_one_stratum_each_row_a_psu_is_the_simple_formula(spark):
    ys = [0.0, 1.0, 1.0, 4.0, 2.0, 7.0]
    frame = spark.createDataFrame([(1, i, 1.0, y, "a", "x") for i, y in enumerate(ys)], SCHEMA)
    r = point_estimate(frame, DESIGN, "y", deff=True).first()
    assert r["se"] == pytest.approx(np.std(ys, ddof=1) / math.sqrt(len(ys)))
    assert r["deff"] == pytest.approx(1.0)


def test_many_equals_single_runs(df):
    more = df.withColumn("y2", 1 - F.col("y"))
    many = estimate_many(more, DESIGN, ["y", "y2"], ["d", "e"])
    for var in ("y", "y2"):
        for by in ("d", "e", None):
            a = sorted((tuple(r) for r in domain_table(many, var, by).collect()), key=str)
            b = sorted((tuple(r) for r in point_estimate(more, DESIGN, var, by).collect()), key=str)
            assert len(a) == len(b)
            for x, y in zip(a, b):
                assert all(p == q or p == pytest.approx(q, rel=1e-10, abs=1e-14) for p, q in zip(x, y))


def test_late_geography_equals_early(spark, df):
    geo = spark.createDataFrame([(i, f"g{i % 2}" if i else None) for i in range(5)], "c int, g string")
    early = point_estimate(df.join(geo, "c", "left"), DESIGN, "y", "g")
    late = point_estimate(df, DESIGN, "y", "g", attach=geo, on=["c"])
    a, b = by_key(early, "g"), by_key(late, "g")
    assert set(a) == set(b) == {"g0", "g1", None}
    for k in a:
        for c in early.columns[1:]:
            assert a[k][c] == b[k][c] or a[k][c] == pytest.approx(b[k][c], rel=1e-10)


def test_late_geography_must_be_unique(spark, df):
    geo = spark.createDataFrame([(1, "g1"), (1, "g2")], "c int, g string")
    with pytest.raises(Exception, match="not unique"):
        point_estimate(df, DESIGN, "y", "g", attach=geo, on=["c"]).collect()


def test_population_of_the_design(df, rows):
    subset = df.filter((F.col("c") != 0) | (F.col("h") != 0))
    kept = [r for r in rows if (r[1] != 0) or (r[0] != 0)]
    whole = point_estimate(subset, DESIGN, "y", population=df).first()
    assert (whole["avg"], whole["se"]) == pytest.approx(brute_force(kept, design_rows=rows), rel=1e-12)
    alone = point_estimate(subset, DESIGN, "y").first()
    assert (alone["avg"], alone["se"]) == pytest.approx(brute_force(kept), rel=1e-12)


def test_keep_missing_values(df, rows):
    r = by_key(point_estimate(df, DESIGN, "y", "d", omit_null=False), "d")
    assert (r["a"]["avg"], r["a"]["se"], r["a"]["unweighted_avg"]) == (None, None, None)
    assert r["a"]["N"] == len([x for x in rows if x[4] == "a"])


@pytest.mark.parametrize("rule", ["remove", "adjust"])
def test_stratum_with_one_psu(spark, rows, rule):
    lone = [*rows, (9, 1, 2.0, 1.0, "a", "x"), (9, 1, 1.0, 0.0, "a", "x")]
    frame = spark.createDataFrame(lone, SCHEMA)
    r = point_estimate(frame, SurveyDesign("c", "h", "w", rule), "y").first()
    used = [x for x in lone if x[3] is not None]
    total = sum(x[2] for x in used)
    avg = sum(x[2] * x[3] for x in used) / total
    variance = 0.0
    for h in range(4):
        z = [sum(x[2] * (x[3] - avg) / total for x in used if (x[0], x[1]) == (h, c)) for c in range(5)]
        variance += 5 * np.var(z, ddof=1)
    if rule == "adjust":
        variance += (sum(x[2] * (x[3] - avg) for x in used if x[0] == 9) / total) ** 2
    assert (r["avg"], r["se"]) == pytest.approx((avg, math.sqrt(variance)), rel=1e-12)


def test_stratum_with_one_psu_fails_by_default(spark, rows):
    frame = spark.createDataFrame([*rows, (9, 1, 2.0, 1.0, "a", "x")], SCHEMA)
    with pytest.raises(Exception, match="only one PSU in stratum 9"):
        point_estimate(frame, DESIGN, "y").collect()
    with pytest.raises(ValueError):
        SurveyDesign(lonely_psu="other")


@pytest.mark.parametrize("column, role", [("w", "weight"), ("h", "stratum"), ("c", "PSU")])
def test_missing_design_value_is_an_error(df, column, role):
    broken = df.withColumn(column, F.when(F.col("d") == "b", F.col(column)))
    with pytest.raises(Exception, match=f"NULL {role}"):
        point_estimate(broken, DESIGN, "y").collect()


def test_all_values_missing_and_empty_input(df):
    blank = df.withColumn("y", F.lit(None).cast("double"))
    r = by_key(point_estimate(blank, DESIGN, "y", "d"), "d")
    assert set(r) == {"a", "b"} and r["a"]["avg"] is None and r["a"]["se"] is None and r["a"]["N"] == 0
    assert point_estimate(df.filter("false"), DESIGN, "y", "d").collect() == []


def test_bad_arguments(df):
    with pytest.raises(ValueError, match="not found"):
        point_estimate(df, DESIGN, "nope")
    with pytest.raises(ValueError, match="reserved"):
        cluster_totals(df.withColumn("national", F.lit(1)), DESIGN, ["y"], ["national"])
    with pytest.raises(ValueError, match="attach"):
        cluster_totals(df, DESIGN, ["y"], ["g"], attach=df)


def test_deviations_sum_to_zero(df):
    totals = stage(cluster_totals(df, DESIGN, ["y"], ["d"])).filter("domain IS NOT NULL")
    avg = totals.groupBy("by_var", "domain").agg((F.sum("swy") / F.sum("sw")).alias("a"))
    sums = totals.join(avg, ["by_var", "domain"]).groupBy("by_var", "domain").agg(F.sum(F.expr("swy - a * sw")).alias("z"))
    assert all(abs(r["z"]) < 1e-9 for r in sums.collect())


def test_fact_is_scanned_once_without_python(spark, sf_dir):
    from surveyspan.catalog import surrogate as sv

    hh, geo = sv.indicators(spark, sf_dir), sv.geography(spark, sf_dir)
    totals = cluster_totals(
        hh, sv.DESIGN, ["improved_toilet", "improved_water"], ["admin1", "admin2", "region_name"], attach=geo, on=["cluster_id", "urban"]
    )
    plan = totals._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan and "Window" not in plan
    scan = next(line for line in plan.splitlines() if "lineitem.parquet" in line)
    schema = scan.split("ReadSchema: ")[1]
    assert "l_extendedprice" not in schema and "l_shipdate" not in schema  # unused columns are not read
    # The staged rows feed everything else, so the fact file is out of the plan.
    after = estimates(stage(totals), sv.DESIGN)._jdf.queryExecution().executedPlan().toString()
    assert "parquet" not in after and "Window" not in after and "NestedLoop" not in after


def test_design_summary(df, rows):
    found = by_key(design_summary(df, DESIGN), "stratum")
    for h in range(4):
        mine = [r for r in rows if r[0] == h]
        assert (found[h]["n_psu"], found[h]["n_rows"]) == (5, len(mine))
        assert found[h]["weight_total"] == pytest.approx(sum(r[2] for r in mine))


def test_counts_and_shares(df, rows):
    total = {(r["d"], r["y"]): r for r in counts.share_of_total(df, ["d", "y"]).collect()}
    n = sum(1 for r in rows if r[4] is None and r[3] is None)
    assert total[(None, None)]["n"] == n and total[(None, None)]["share"] == pytest.approx(n / len(rows))
    assert sum(r["n"] for r in total.values()) == len(rows)
    shares = by_key(counts.share_in_group(df, "d", "y", 1.0), "d")
    inside = [r for r in rows if r[4] == "a"]
    assert shares["a"]["pct"] == pytest.approx(sum(1 for r in inside if r[3] == 1.0) / len(inside))
    cross = by_key(counts.crosstab(df, "d", "y", [0.0, 1.0, None]), "d")
    assert cross["b"]["y_missing"] == sum(1 for r in rows if r[4] == "b" and r[3] is None)
    per = by_key(counts.domain_counts(df, "y", "d", "yes", "all rows"), "d")
    assert per["a"]["all rows"] == sum(1 for r in inside if r[3] is not None)


def test_total_share_scans_once(df, spark, sf_dir):
    from surveyspan.catalog import surrogate as sv

    shares = counts.share_of_total(sv.table(spark, sf_dir, "lineitem"), ["l_returnflag"])
    shares.collect()
    plan = shares._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "Reused" in plan


def test_far_domains_keep_their_standard_errors(spark):
    rows, want = [], {}
    for d, level in (("A", 1e6), ("B", 0.0)):
        values = {}
        for h in range(2):
            for c in range(8):
                y = level + ((c * 7 + h * 3) % 5) / 3
                rows.append((d, f"s{h}", f"{d}{h}{c}", 1.0, y))
                values[(h, c)] = y
        mean = math.fsum(values.values()) / 16
        total = 0.0
        for h in range(2):
            z = [(values[(h, c)] - mean) / 16 for c in range(8)]
            # the stratum holds the PSUs of both domains; the others have z = 0
            total += 16 / 15 * (math.fsum(v * v for v in z) - math.fsum(z) ** 2 / 16)
        want[d] = math.sqrt(total)
    df = spark.createDataFrame(rows, "d string, h string, c string, w double, y double")
    table = point_estimate(df, SurveyDesign(psu="c", stratum="h", weight="w"), "y", "d")
    for r in table.collect():
        assert r["se"] == pytest.approx(want[r["d"]], rel=1e-9)


def test_long_crosstab_has_no_limit(spark):
    df = spark.range(3000).selectExpr("id % 2 AS a", "id AS b")
    assert counts.crosstab(df, "a", "b").count() == 3000


# --- families of domain columns ---------------------------------------------------


@pytest.fixture(scope="module")
def crossed(spark):
    """Regions and districts of PSUs; ages and age bands, and a sex, that cut across them."""
    rng = random.Random(3)
    rows = []
    for h in range(3):
        for c in range(6):
            for _ in range(40):
                age = rng.choice([None, *range(30)])
                rows.append((h, c, rng.uniform(0.5, 2), None if rng.random() < 0.1 else rng.random(), rng.random(), f"r{h % 2}",
                             None if c == 5 else f"d{h}{c % 2}", age, None if age is None else age // 10, rng.choice("mf")))
    return spark.createDataFrame(rows, "h int, c int, w double, y double, x double, region string, district string, age int, band int, sex string").cache()


FAMILIES = [["region", "district"], ["age", "band"], ["sex"]]


def test_families_give_the_estimates_of_single_runs(crossed):
    by = ["region", "district", "age", "band", "sex"]
    psu = SurveyDesign("psu", "h", "w")
    df = crossed.withColumn("psu", F.col("h") * 10 + F.col("c"))
    many = estimate_many(df, psu, ["y", "x"], by, families=FAMILIES, deff=True)
    for v in ("y", "x"):
        for b in [None, *by]:
            kind = "string" if b in (None, "region", "district", "sex") else "int"
            mine = {r[b] if b else None: r for r in domain_table(many, v, b, kind).collect()}
            alone = {r[b] if b else None: r for r in point_estimate(df, psu, v, b, deff=True).collect()}
            assert set(mine) == set(alone)
            for k, r in alone.items():
                for c in ("avg", "se", "ci", "lb", "ub", "N", "unweighted_avg", "deff"):
                    assert mine[k][c] == r[c] or mine[k][c] == pytest.approx(r[c], rel=1e-9)


def test_crossing_families_are_no_product(crossed):
    psu = SurveyDesign("psu", "h", "w")
    df = crossed.withColumn("psu", F.col("h") * 10 + F.col("c"))
    totals = wide_totals(df, psu, ["y"], ["region", "district", "age", "band", "sex"], families=FAMILIES)
    plan = totals._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Expand") == 1 and "NestedLoop" not in plan
    finest = plan[plan.index("Expand") :].splitlines()[0]
    assert finest.count("[") <= 5  # one projection per family
    sizes = {r["by_id"]: r["count"] for r in totals.groupBy("by_id").count().collect()}
    assert sizes[-1] == 18 and sizes[0] == 18 and sizes[4] <= 36


def test_late_geography_beside_a_crossing_family(spark, crossed):
    psu = SurveyDesign("psu", "h", "w")
    df = crossed.withColumn("psu", F.col("h") * 10 + F.col("c"))
    geo = spark.createDataFrame([(i, f"z{i % 4}") for i in range(40)], "psu int, zone string")
    many = estimate_many(df, psu, ["y"], ["zone", "sex"], attach=geo, on=["psu"], families=[["zone"], ["sex"]])
    early = estimate_many(df.join(geo, "psu"), psu, ["y"], ["zone", "sex"])
    key = lambda r: (r["by_var"], str(r["domain"]))
    for a, b in zip(sorted(many.collect(), key=key), sorted(early.collect(), key=key), strict=True):
        assert key(a) == key(b) and a["se"] == pytest.approx(b["se"], rel=1e-9) and a["N"] == b["N"]


def test_families_are_found(crossed):
    psu = SurveyDesign("psu", "h", "w")
    df = crossed.withColumn("psu", F.col("h") * 10 + F.col("c"))
    found = domain_families(df, psu, ["sex", "band", "district", "age", "region"])
    assert sorted(map(sorted, found)) == [["age", "band"], ["district", "region"], ["sex"]]
    assert [f for f in found if "age" in f] == [["age", "band"]]
    assert domain_families(df, psu, []) == [[]] and domain_families(df, psu, ["sex"]) == [["sex"]]
    with pytest.raises(ValueError, match="families"):
        wide_totals(df, psu, ["y"], ["sex", "age"], families=[["sex"]])
