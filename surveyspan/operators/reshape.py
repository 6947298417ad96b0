"""Set operations on code lists and wide-to-long reshaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from surveyspan.operators.joins import quoted


def codes_without(codes: DataFrame, removed: DataFrame) -> DataFrame:
    """Distinct codes of the first table that are absent from the second."""
    return codes.subtract(removed)


def codes_with(codes: DataFrame, added: DataFrame) -> DataFrame:
    """Rows of both code tables, matched by column name."""
    return codes.unionByName(added)


def long_form(
    df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "indicator", value: str = "value"
) -> DataFrame:
    """One row per id and value column; missing values stay as rows."""
    return df.unpivot([quoted(c) for c in ids], [quoted(c) for c in values], name, value)
