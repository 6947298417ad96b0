"""Household table: select, clean, decode, attach cluster geography."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspan.functions import case_when, glue, implied_decimals, is_in, na_if, respell, title_case, top_code
from surveyspan.operators.joins import keyed_join, lookup, quoted, unique_lookup
from surveyspan.staging import broadcast_if_small

# Raw survey variables behind the household columns.
HOUSEHOLD_COLUMNS = {
    "hhid": "hhid",
    "cluster_id": "hv001",
    "hh_num": "hv002",
    "sample_wt": "hv005",
    "prim_sampling_unit": "hv021",
    "sample_strata": "hv022",
    "dhs_region": "shlocnew3",
    "urban": "hv025",
    "region": "shregnew",
    "interview_month": "hv006",
    "hv201": "hv201",
    "hv204": "hv204",
    "hv205": "hv205",
    "hv225": "hv225",
    "hv238": "hv238",
    "wealth_idx": "hv271",
}
HOUSEHOLD_CLONES = {
    "time2water": "hv204",
    "water_source": "hv201",
    "toilet_source": "hv205",
    "share_toilet": "hv225",
    "num_share_toilet": "hv238",
}
SENTINELS = {
    "water_source": (99,),
    "toilet_source": (99,),
    "share_toilet": (9,),
    "num_share_toilet": (98, 99),
}
DIVISORS = {"sample_wt": 1e6, "wealth_idx": 1e5}
CAMP_REGION = 12
TIME_MISSING = (998, 999)
TIME_ON_PREMISES = 996
TOP_CODE = 95
TOP_CODE_VALUE = 10
GEO_KEYS = ["cluster_id", "urban"]
REGION_SPELLINGS = {"aire metropolitaine": "Aire Métropolitaine", "grand'anse": "Grande-Anse"}


@dataclass(frozen=True)
class HouseholdRules:
    """Everything about the household recodes that another survey may set differently.

    ``alternate()`` is the second published rule set: camps stay in, and the
    number of households sharing a toilet is top-coded.
    """

    columns: Mapping[str, str] = field(default_factory=lambda: dict(HOUSEHOLD_COLUMNS))
    clones: Mapping[str, str] = field(default_factory=lambda: dict(HOUSEHOLD_CLONES))
    sentinels: Mapping[str, tuple] = field(default_factory=lambda: dict(SENTINELS))
    divisors: Mapping[str, float] = field(default_factory=lambda: dict(DIVISORS))
    spellings: Mapping[str, str] = field(default_factory=lambda: dict(REGION_SPELLINGS))
    excluded_region: int | None = CAMP_REGION
    top_coded: bool = False

    @classmethod
    def alternate(cls) -> HouseholdRules:
        return cls(excluded_region=None, top_coded=True)


def urban_flag(code: Column) -> Column:
    """1 urban, 0 rural; any other code is missing."""
    return case_when((code == 1, 1), (code == 2, 0))


def minutes_to_water(code: Column) -> Column:
    return F.when(code.isin(*TIME_MISSING), None).when(code == TIME_ON_PREMISES, 0).otherwise(code)


def spelled_region(label: Column, spellings: Mapping[str, str]) -> Column:
    """Map spelling of a region label: listed names as given, the rest in title case."""
    return F.when(is_in(label, spellings), respell(label, dict(spellings))).otherwise(title_case(label))


def region_urban(region_name: Column, urban: Column) -> Column:
    suffix = case_when((urban == 1, "_and_urban"), (urban == 0, "_and_rural"))
    return glue(region_name, suffix)


def household_table(
    raw: DataFrame,
    region_labels: DataFrame,
    dhs_labels: DataFrame,
    geo: DataFrame | None = None,
    rules: HouseholdRules | None = None,
) -> DataFrame:
    """Analysis-ready households, one narrow projection over the raw scan.

    The label tables hold ``(code, label)``. ``geo`` is matched on cluster and
    urban flag, a missing flag matching a missing flag. It is broadcast only after a
    check of its size. For estimates it can be left out here and attached to the PSU
    totals instead (``estimate_many(..., attach=geo)``), which never touches the facts.
    """
    rules = rules or HouseholdRules()
    chosen = raw.select(*[quoted(src).alias(dst) for dst, src in rules.columns.items()])
    if rules.excluded_region is not None:
        chosen = chosen.filter(F.col("region") != rules.excluded_region)
    copied = chosen.withColumns({new: F.col(old) for new, old in rules.clones.items()})
    cleaned = implied_decimals(copied, rules.divisors).withColumns(
        {
            "urban": urban_flag(F.col("urban")),
            "time2water": minutes_to_water(F.col("time2water")),
            **{c: na_if(F.col(c), *codes) for c, codes in rules.sentinels.items()},
        }
    )
    if rules.top_coded:
        cleaned = cleaned.withColumn(
            "num_share_toilet", top_code(F.col("num_share_toilet"), TOP_CODE, TOP_CODE_VALUE)
        )
    # Spelling is fixed once per label, not once per household.
    spelled = region_labels.withColumn("label", spelled_region(F.col("label"), rules.spellings))
    decoded = lookup(cleaned, "region", spelled, into="region_name")
    decoded = lookup(decoded, "dhs_region", dhs_labels)
    named = decoded.withColumn("region_urban", region_urban(F.col("region_name"), F.col("urban")))
    if geo is None:
        return named
    return keyed_join(named, broadcast_if_small(unique_lookup(geo, GEO_KEYS)), GEO_KEYS, "left")
