from __future__ import annotations

import pytest

import __spark_entry__ as entry_module
from surveyspan.catalog.queries import QUERIES
from tests.oracle_check import compare, connect


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns[:3] == ["admin1", "avg", "se"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, duck, sf_dir, name):
    assert name in entry_module.oracle_sql()
    assert compare(spark, duck, sf_dir, name) == []


def test_full_report(spark, sf_dir):
    from surveyspan.catalog import surrogate as sv
    from surveyspan.catalog.queries import _nation_names
    from surveyspan.plans.report import ESTIMATES, household_report

    hh, geo = sv.indicators(spark, sf_dir), sv.geography(spark, sf_dir)
    tables = household_report(hh, sv.DESIGN, geo, _nation_names(spark, sf_dir))
    assert set(tables) == {*ESTIMATES, "toilet_districts", "water_districts", "toilet_gap", "water_gap", "comparison"}
    national = tables["toilet_national"].first()["avg"]
    assert {r["national_avg"] for r in tables["toilet_admin3"].collect()} == {national}
    assert tables["toilet_districts"].columns[:2] == ["admin1", "admin2"]
    assert tables["water_gap"].filter("urban = 'urban'").count() > 0


@pytest.mark.parametrize("name", ["map_table", "map_table_admin2", "case_rate_map", "priority_communes"])
def test_no_vertex_is_shuffled(spark, sf_dir, name):
    """Areas meet polygons, not vertices: nothing is exchanged or joined above the explode."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    explodes = [i for i, line in enumerate(plan) if "Generate posexplode" in line]
    joins = [i for i, line in enumerate(plan) if "Join " in line]
    assert explodes and joins and max(explodes) < min(joins)
