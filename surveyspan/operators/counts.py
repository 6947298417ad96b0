"""Counts, shares and cross-tabulations. Every step aggregates before it compares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surveyspan.functions import percent
from surveyspan.operators.joins import quoted


def group_count(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows per group; NULL is a group."""
    return df.groupBy(*[quoted(c) for c in by]).agg(F.count("*").alias("n"))


def share_of_total(df: DataFrame, by: Sequence[str], digits: int = 1) -> DataFrame:
    """Rows per group and their share of all rows."""
    counts = group_count(df, by)
    total = counts.agg(F.sum("n")).scalar()
    share = F.col("n") / total
    return counts.withColumn("share", share).withColumn("pct", percent(F.col("share"), digits))


def share_in_group(df: DataFrame, group: str, var: str, keep=1) -> DataFrame:
    """Share of rows with ``var = keep`` inside each group.

    Rows without a value stay in the denominator. The window runs over the
    counted table: one row per value of ``var`` in a group.
    """
    counts = group_count(df, [group, var])
    inside = F.sum("n").over(Window.partitionBy(quoted(group)))
    return counts.withColumn("pct", F.col("n") / inside).filter(quoted(var) == F.lit(keep))


def group_means(df: DataFrame, by: str, columns: Sequence[str], present: str) -> DataFrame:
    """Plain means and the row count per group, over rows where ``present`` is known."""
    known = quoted(present).isNotNull()
    return (
        df.groupBy(quoted(by))
        .agg(
            *[F.avg(F.when(known, quoted(c))).alias(f"mean_{c}") for c in columns],
            F.count(F.when(known, 1)).alias("n"),
        )
        .filter(F.col("n") > 0)
    )


def domain_counts(
    df: DataFrame, var: str, by: str, total_name: str = "positive", rows_name: str = "total"
) -> DataFrame:
    """Sum of a 0/1 indicator and number of rows per domain, missing values removed.

    They are left out by the aggregates, and domains without any value afterwards: a
    filter before would push the whole recode of the indicator down into the scan.
    """
    counted = df.groupBy(quoted(by)).agg(
        F.sum(quoted(var)).alias(total_name), F.count(quoted(var)).alias(rows_name)
    )
    return counted.filter(quoted(rows_name) > 0)


def crosstab(df: DataFrame, rows: str, columns: str, values: Sequence | None = None) -> DataFrame:
    """Counts by two columns; NULL stays a real key.

    ``values`` lists the column values to spread (``None`` for missing), one column each. Left out, the
    counts come in long form, one row per pair, whatever the number of values.
    """
    if values is None:
        return group_count(df, [rows, columns])

    def name(v) -> str:
        return "missing" if v is None else str(v)

    return df.groupBy(quoted(rows)).agg(
        *[
            F.count(F.when(quoted(columns).eqNullSafe(F.lit(v)), 1)).alias(f"{columns}_{name(v)}")
            for v in values
        ]
    )


def distinct_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[quoted(c) for c in columns]).distinct()
