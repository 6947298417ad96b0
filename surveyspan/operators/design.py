"""Declaration of a stratified one-stage cluster design."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspan.operators.joins import quoted

LONELY_PSU_RULES = ("fail", "remove", "adjust")


@dataclass(frozen=True)
class SurveyDesign:
    """Names of the design columns; holds no data, so it never goes stale.

    A PSU is identified by (stratum, psu). ``lonely_psu`` says what a stratum with
    a single PSU does: ``fail`` raises, ``remove`` gives it no variance, ``adjust``
    measures it against the overall mean.
    """

    psu: str = "prim_sampling_unit"
    stratum: str = "sample_strata"
    weight: str = "sample_wt"
    lonely_psu: str = "fail"

    def __post_init__(self) -> None:
        if self.lonely_psu not in LONELY_PSU_RULES:
            raise ValueError(f"lonely_psu must be one of {LONELY_PSU_RULES}")


def design_summary(df: DataFrame, design: SurveyDesign) -> DataFrame:
    """PSUs, rows and weight per stratum. Pre-aggregated per PSU, so a large
    stratum is never counted in one task."""
    per_psu = df.groupBy(
        quoted(design.stratum).alias("stratum"), quoted(design.psu).alias("psu")
    ).agg(F.count("*").alias("n"), F.sum(quoted(design.weight)).alias("w"))
    return per_psu.groupBy("stratum").agg(
        F.count("psu").alias("n_psu"),
        F.sum("n").alias("n_rows"),
        F.sum("w").alias("weight_total"),
    )
