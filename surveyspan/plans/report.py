"""The complete household analysis: every published table from one pass over the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspan.functions import case_when
from surveyspan.operators.design import SurveyDesign
from surveyspan.operators.estimate import CONTRACT, NATIONAL, estimate_many
from surveyspan.plans.households import GEO_KEYS
from surveyspan.plans.tables import compare_indicators, gap_table, with_national, with_parent_summary
from surveyspan.staging import stage

SANITATION, NEAR_WATER, DHS_WATER = "improved_toilet", "impr_water_under30min", "impr_water_dhs"
DOMAINS = ["dhs_region", "region_name", "admin1", "admin2", "admin3", "cluster_id", "region_urban"]

# Table name: indicator and domain column (None is the whole country).
ESTIMATES = {
    "toilet_national": (SANITATION, None),
    "toilet_dhs_region": (SANITATION, "dhs_region"),
    "toilet_region": (SANITATION, "region_name"),
    "toilet_admin1": (SANITATION, "admin1"),
    "toilet_admin2": (SANITATION, "admin2"),
    "toilet_cluster": (SANITATION, "cluster_id"),
    "toilet_admin3": (SANITATION, "admin3"),
    "toilet_region_urban": (SANITATION, "region_urban"),
    "water_national": (NEAR_WATER, None),
    "water_dhs_region": (DHS_WATER, "dhs_region"),
    "water_region": (NEAR_WATER, "region_name"),
    "water_bottled_region": (DHS_WATER, "region_name"),
    "water_admin1": (NEAR_WATER, "admin1"),
    "water_admin2": (NEAR_WATER, "admin2"),
    "water_admin3": (NEAR_WATER, "admin3"),
    "water_region_urban": (NEAR_WATER, "region_urban"),
}


def household_estimates(hh: DataFrame, design: SurveyDesign, geo: DataFrame) -> DataFrame:
    """All estimate tables stacked: ``table_name, domain`` and the estimate columns.

    ``hh`` carries the sanitation and water indicators, ``geo`` the clusters'
    geography. The households are read once.
    """
    many = estimate_many(hh, design, [SANITATION, NEAR_WATER, DHS_WATER], DOMAINS, attach=geo, on=GEO_KEYS)
    name = case_when(
        *[
            ((F.col("variable") == var) & (F.col("by_var") == (by or NATIONAL)), table)
            for table, (var, by) in ESTIMATES.items()
        ]
    )
    named = many.withColumn("table_name", name).filter(F.col("table_name").isNotNull())
    return named.select("table_name", "domain", *CONTRACT)


def estimate_table(stacked: DataFrame, table: str) -> DataFrame:
    """One table of :func:`household_estimates`, its domain under its own name."""
    chosen = stacked.filter(F.col("table_name") == table).drop("table_name")
    by = ESTIMATES[table][1]
    return chosen.withColumnRenamed("domain", by) if by else chosen.drop("domain")


def household_report(hh: DataFrame, design: SurveyDesign, geo: DataFrame, names: DataFrame) -> dict[str, DataFrame]:
    """All estimate tables by name, plus the tables built on them.

    ``names`` gives the region of every district. The stacked estimates are staged,
    so the dozen small tables below do not repeat the variance work.
    """
    stacked = stage(household_estimates(hh, design, geo))
    tables = {name: estimate_table(stacked, name) for name in ESTIMATES}
    for kind in ("toilet", "water"):
        tables[f"{kind}_districts"] = with_parent_summary(tables[f"{kind}_admin2"], names, tables[f"{kind}_admin1"])
        tables[f"{kind}_gap"] = gap_table(
            tables[f"{kind}_region_urban"], tables[f"{kind}_region"], "region_urban", "region_name"
        )
        tables[f"{kind}_admin3"] = with_national(tables[f"{kind}_admin3"], tables[f"{kind}_national"])
    tables["comparison"] = compare_indicators(
        tables["toilet_region"], tables["water_region"], "region_name", "improved latrines", "improved water"
    )
    return tables
