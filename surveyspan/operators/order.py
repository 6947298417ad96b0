"""Sorting with NULL last, and row numbers that need no single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surveyspan.operators.joins import keyed_join, quoted
from surveyspan.staging import stage


def descending(df: DataFrame, *columns: str) -> DataFrame:
    return df.orderBy(*[quoted(c).desc_nulls_last() for c in columns])


def ascending(df: DataFrame, *columns: str) -> DataFrame:
    """Spark's own ascending sort puts NULL first; here it comes last."""
    return df.orderBy(*[quoted(c).asc_nulls_last() for c in columns])


def _fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name in df.columns:
        name = f"_{name}"
    return name


def row_numbers(df: DataFrame, order: Sequence[Column], into: str = "row", keys: Sequence[str] | None = None) -> DataFrame:
    """Number all rows 1..n in the given total order.

    With ``keys``, the names of the columns that ``order`` uses, only these are sorted and staged: the distinct keys with their
    counts are range-partitioned and sorted, each adds the counts before it, and the rows look their key's number up.
    Without ``keys`` the whole rows are sorted and staged.

    Only the per-partition counts pass through one task. Give tie-breakers in
    ``order``: they make the numbering repeatable and also split a hot leading key.
    """
    part, seq, before = _fresh(df, "_part"), _fresh(df, "_seq"), _fresh(df, "_before")

    def sorted_parts(rows: DataFrame) -> DataFrame:
        return stage(
            rows.repartitionByRange(*order)
            .sortWithinPartitions(*order)
            .withColumn(part, F.spark_partition_id())
            .withColumn(seq, F.monotonically_increasing_id())
        )

    def with_offsets(placed: DataFrame, size: Column, first: Column) -> DataFrame:
        # One row per shuffle partition, so this window is bounded by that setting.
        counts = placed.groupBy(F.col(part).alias("_opart")).agg(size.alias("_n"), first.alias("_first"))
        earlier = Window.orderBy("_opart").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select(
            "_opart", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift")
        )
        return placed.join(F.broadcast(offsets), F.col(part) == F.col("_opart"))

    if keys is None:
        whole = with_offsets(sorted_parts(df), F.count("*"), F.min(seq))
        number = (F.col(seq) + F.col("_shift") + 1).alias(into)
        return whole.select(*[quoted(c) for c in df.columns if c != into], number)
    rows = _fresh(df, "_rows")
    names = [quoted(k) for k in keys]
    placed = sorted_parts(df.select(*names).groupBy(*names).agg(F.count("*").alias(rows)))
    own = Window.partitionBy(part).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn(before, F.coalesce(F.sum(rows).over(own), F.lit(0)))
    numbered = with_offsets(local, F.sum(rows), F.max(F.lit(0))).select(*names, (F.col(before) + F.col("_shift")).alias(before))
    tied = Window.partitionBy(*names).orderBy(*names)
    row = (F.col(before) + F.row_number().over(tied)).alias(into)
    return keyed_join(df, numbered, list(keys), "left").select(*[quoted(c) for c in df.columns if c != into], row)


def level_order(levels: DataFrame, level: str, order: Sequence[Column], into: str) -> DataFrame:
    """``(level, ordinal)`` for the distinct non-NULL levels of a result table."""
    named = levels.filter(quoted(level).isNotNull())
    return row_numbers(named, [*order, quoted(level).asc()], into).select(quoted(level), F.col(into))


def with_level_order(df: DataFrame, ordinals: DataFrame, level: str) -> DataFrame:
    """Attach the ordinal of an ordered category; values that are no level get NULL."""
    return keyed_join(df, ordinals, level, "left")


#: Values that the last step of a selection may hold on the driver.
FEW = 10_000
#: Share of the values on either side of a rank between the bracketing quantiles, and their accuracy.
_MARGIN, _ACCURACY = 5e-4, 10_000


def select_rank(values: DataFrame, rank: int) -> float | None:
    """The ``rank``-th smallest (from 1) of a one-column table of known numbers, without sorting it.

    Each round takes two mergeable quantile estimates that bracket the rank and counts exactly what lies below,
    on and between them; the next round looks only between. A round leaves about a thousandth of the
    values, and a value that many rows share is found as soon as it is a bracket. Every pass is a scan with
    partial aggregation; at most ``FEW`` values reach the driver at the end.
    """
    column = values.columns[0]
    v = quoted(column)
    inside, total, below = values, values.count(), 0
    if not 1 <= rank <= total:
        return None
    while total > FEW:
        share = (rank - below) / total
        spread = [max(0.0, share - _MARGIN), min(1.0, share + _MARGIN)]
        low, high = inside.select(F.percentile_approx(v, spread, _ACCURACY)).first()[0]
        a, b = F.lit(low), F.lit(high)
        under, upto_low, upto_high = (below + c for c in inside.select(
            F.count_if(v < a), F.count_if(v <= a), F.count_if(v < b)
        ).first())
        if under < rank <= upto_low:
            return low
        if rank <= under:
            inside, total = inside.filter(v < a), under - below
        elif rank <= upto_high:
            inside, total, below = inside.filter((v > a) & (v < b)), upto_high - upto_low, upto_low
        else:
            on = inside.select(F.count_if(v == b)).first()[0]
            if rank <= upto_high + on:
                return high
            inside, total, below = inside.filter(v > b), total - (upto_high + on - below), upto_high + on
    rest = sorted((r[0] for r in inside.collect()), key=lambda x: (x != x, x))
    return rest[rank - below - 1]


def exact_median(df: DataFrame, value: str, into: str = "median") -> DataFrame:
    """One row with the exact median of the known values, NULL when there is none.

    Spark's ``median`` gathers every distinct value in one task; here the middle ranks are
    selected by narrow scans (:func:`select_rank`). With an even count it is the mean of the two middle values.
    """
    known = df.select(quoted(value).cast("double").alias("v")).filter(F.col("v").isNotNull())
    few = [r[0] for r in known.limit(FEW + 1).collect()]
    if len(few) <= FEW:  # small tables take one job
        few.sort(key=lambda x: (x != x, x))
        middle = [few[(len(few) - 1) // 2], few[len(few) // 2]] if few else []
    else:
        n = known.count()
        middle = [select_rank(known, r) for r in sorted({(n + 1) // 2, n // 2 + 1})]
    median = sum(middle) / len(middle) if middle else None
    return df.sparkSession.createDataFrame([(median,)], f"`{into}` double")
