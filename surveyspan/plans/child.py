"""Children under five: diarrhea and stunting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspan.functions import case_when, if_else, implied_decimals, recode_sets, title_case
from surveyspan.operators.counts import group_means
from surveyspan.operators.design import SurveyDesign
from surveyspan.operators.estimate import point_estimate
from surveyspan.operators.joins import lookup, quoted
from surveyspan.plans.households import CAMP_REGION, DIVISORS, urban_flag

# Raw survey variables behind the child columns.
CHILD_COLUMNS = {
    "caseid": "caseid",
    "cluster_id": "v001",
    "hh_num": "v002",
    "sample_wt": "v005",
    "prim_sampling_unit": "v021",
    "sample_strata": "v022",
    "urban": "v025",
    "region": "sregnew",
    "interview_month": "v006",
    "wealth_idx": "v191",
    "age_months": "hw1",
    "age_yrs": "b8",
    "b4": "b4",
    "h11": "h11",
    "hw70": "hw70",
    "hw13": "hw13",
}
INVALID_SCORE = 9996
AGE_LIMIT = 5
STUNTED_BELOW = -2
SEVERELY_STUNTED_BELOW = -3


def height_score(code: Column) -> Column:
    """Height-for-age in standard deviations; codes from 9996 on are no measurement."""
    return if_else(code < INVALID_SCORE, code / F.lit(100.0), None)


def below(score: Column, limit: float) -> Column:
    return if_else(score < limit, 1, 0)


def child_table(raw: DataFrame, region_labels: DataFrame, map_spelling: bool = False) -> DataFrame:
    """Children under five outside camps with decoded and derived columns."""
    chosen = raw.select(*[quoted(src).alias(dst) for dst, src in CHILD_COLUMNS.items()]).filter(
        (F.col("age_yrs") < AGE_LIMIT) & (F.col("region") != CAMP_REGION)
    )
    scored = implied_decimals(chosen, DIVISORS).withColumns(
        {
            "urban": urban_flag(F.col("urban")),
            "sex": case_when((F.col("b4") == 1, "male"), (F.col("b4") == 2, "female")),
            "diarrhea": recode_sets(F.col("h11"), {1: (1, 2), 0: (0,)}),
            "stunting_eligible": F.col("hw13") == 0,
            "stunting_score": height_score(F.col("hw70")),
        }
    )
    flagged = scored.withColumns(
        {
            "stunted": below(F.col("stunting_score"), STUNTED_BELOW),
            "sev_stunted": below(F.col("stunting_score"), SEVERELY_STUNTED_BELOW),
        }
    )
    labels = region_labels.withColumn("label", title_case(F.col("label"))) if map_spelling else region_labels
    return lookup(flagged, "region", labels, into="region_name")


def stunting_summary(children: DataFrame, by: str) -> DataFrame:
    """Plain means of both stunting flags and of the score, with the row count."""
    return group_means(children, by, ["sev_stunted", "stunted", "stunting_score"], "stunting_score")


def measured(children: DataFrame) -> DataFrame:
    """Children who were measured and have a valid score."""
    return children.filter(F.col("stunting_eligible") & F.col("stunting_score").isNotNull())


def stunting_estimates(
    children: DataFrame, design: SurveyDesign, by: str | None = None, *, subset_design: bool = True, deff: bool = True
) -> DataFrame:
    """Stunting rate with standard error and design effect.

    ``subset_design`` declares the design on the measured children alone. Switched
    off, the PSU counts come from all children (domain estimation): the children
    without a measurement then stay in, with no value, so one scan serves both.
    """
    if subset_design:
        return point_estimate(measured(children), design, "stunted", by, deff=deff)
    counted = children.withColumn("stunted", F.when(F.col("stunting_eligible"), F.col("stunted")))
    return point_estimate(counted, design, "stunted", by, deff=deff).filter(F.col("N") > 0)
