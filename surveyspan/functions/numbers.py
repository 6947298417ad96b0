"""Scaling, rounding and safe ratios."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def implied_decimals(df: DataFrame, divisors: Mapping[str, float]) -> DataFrame:
    """Divide integer-coded columns by their scale, e.g. ``{"sample_wt": 1e6}``."""
    return df.withColumns({c: F.col(f"`{c}`") / F.lit(float(d)) for c, d in divisors.items()})


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient that is NULL, not an error, for a zero denominator."""
    return F.try_divide(numerator, denominator)


def signif(column: Column, digits: int = 2) -> Column:
    """Round to significant digits; zero stays zero, NULL stays NULL."""
    shift = F.lit(digits - 1) - F.floor(F.log10(F.abs(column)))
    up = F.pow(F.lit(10.0), shift)
    down = F.pow(F.lit(10.0), -shift)
    rounded = F.when(shift < 0, F.rint(column / down) * down).otherwise(F.rint(column * up) / up)
    return F.when(column == 0, F.lit(0.0)).when(column.isNotNull(), rounded)


def to_integer(column: Column) -> Column:
    """Integer cast that gives NULL for text that is no number."""
    return column.try_cast("bigint")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Make NULL the only missing value at ingest; labels stay on their columns."""

    def cleaned(f) -> Column:
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() not in ("double", "float"):
            return c
        return F.when(~F.isnan(c), c).alias(f.name, metadata=f.metadata)

    return df.select(*[cleaned(f) for f in df.schema.fields])
