"""Checks on recodes and on the two rule sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspan.operators.joins import keyed_join, quoted


def audit_recode(df: DataFrame, raw: str, new: str) -> DataFrame:
    """Rows per pair of raw and recoded value, with the pairs that lost a value marked."""
    return df.groupBy(quoted(raw).alias("raw"), quoted(new).alias("recoded")).agg(
        F.count("*").alias("n"),
        F.count(F.when(quoted(raw).isNotNull() & quoted(new).isNull(), 1)).alias("became_missing"),
    )


def reconcile(primary: DataFrame, alternate: DataFrame, key: str) -> DataFrame:
    """Estimates under two rule sets side by side, with their difference."""
    a = primary.select(quoted(key), *[F.col(c).alias(f"{c}_primary") for c in ("avg", "se", "N")])
    b = alternate.select(quoted(key), *[F.col(c).alias(f"{c}_alternate") for c in ("avg", "se", "N")])
    both = keyed_join(a, b, key, "full")
    return both.withColumn("difference", F.col("avg_primary") - F.col("avg_alternate"))
