"""CSV and Parquet outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from surveyspan.operators.joins import quoted
from surveyspan.operators.order import row_numbers


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """Header line, one file per partition."""
    df.write.mode(mode).option("header", True).csv(path)


def write_numbered_csv(
    df: DataFrame, path: str, order: Sequence[Column], mode: str = "error", keys: Sequence[str] | None = None
) -> None:
    """CSV with a leading row-number column over an explicit order; ``keys`` as in :func:`row_numbers`."""
    numbered = row_numbers(df, order, "row", keys)
    write_csv(numbered.select("row", *[quoted(c) for c in df.columns if c != "row"]), path, mode)


def write_parquet(df: DataFrame, path: str, mode: str = "error", partition_by: Sequence[str] = ()) -> None:
    """Parquet keeps column labels (metadata) for a later read."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
