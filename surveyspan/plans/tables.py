"""Result tables built on the estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surveyspan.functions import percent, split_pair
from surveyspan.operators.design import SurveyDesign
from surveyspan.operators.estimate import domain_table, estimate_many
from surveyspan.operators.joins import keyed_join, lookup_join, quoted, with_scalar
from surveyspan.operators.order import exact_median, level_order, with_level_order
from surveyspan.operators.reshape import long_form
from surveyspan.staging import stage


def with_parent_summary(
    child: DataFrame, names: DataFrame, parent: DataFrame, child_key: str = "admin2", parent_key: str = "admin1"
) -> DataFrame:
    """District estimates with their region's mean and interval.

    ``names`` gives the parent of each child and must be unique by child. The
    ordinal ``<parent>_order`` ranks the regions from best to worst.
    """
    placed = lookup_join(child, names.select(child_key, parent_key), child_key)
    band = parent.select(
        quoted(parent_key),
        *[F.col(c).alias(f"{parent_key}_{c}") for c in ("avg", "lb", "ub")],
    )
    joined = keyed_join(placed, band, parent_key, "left")
    order = level_order(parent, parent_key, [F.col("avg").desc_nulls_last()], f"{parent_key}_order")
    return with_level_order(joined, order, parent_key)


def district_table(
    df: DataFrame,
    design: SurveyDesign,
    var: str,
    names: DataFrame,
    child_key: str = "admin2",
    parent_key: str = "admin1",
    **options,
) -> DataFrame:
    """:func:`with_parent_summary` from the microdata: both levels from one scan.

    ``options`` go to :func:`estimate_many`.
    """
    many = stage(estimate_many(df, design, [var], [child_key, parent_key], **options))
    return with_parent_summary(
        domain_table(many, var, child_key), names, domain_table(many, var, parent_key), child_key, parent_key
    )


def urban_rural_gap(
    df: DataFrame,
    design: SurveyDesign,
    var: str,
    region: str = "region_name",
    region_urban: str = "region_urban",
    separator: str = "_and_",
    **options,
) -> DataFrame:
    """Urban and rural estimates per region with the other one beside it.

    ``lagged`` is the value of the preceding row in (rural, urban) order inside
    the region, so urban rows show the rural mean; ``region_order`` ranks the
    regions that have an urban part by their overall mean.
    """
    many = stage(estimate_many(df, design, [var], [region_urban, region], **options))
    return gap_table(domain_table(many, var, region_urban), domain_table(many, var, region), region_urban, region, separator)


def gap_table(
    split_estimates: DataFrame, region_estimates: DataFrame, region_urban: str, region: str, separator: str = "_and_"
) -> DataFrame:
    """:func:`urban_rural_gap` from the two estimate tables."""
    split = split_estimates.select(
        *split_pair(quoted(region_urban), separator, "region", "urban"), "*"
    ).drop(region_urban)
    inside = Window.partitionBy("region").orderBy(F.col("urban").asc_nulls_last())
    paired = split.withColumn("lagged", F.lag("avg").over(inside))
    means = region_estimates.select(quoted(region).alias("region"), F.col("avg").alias("region_avg"))
    joined = keyed_join(paired, means, "region", "left")
    urban_rows = joined.filter(F.col("urban") == "urban").select("region", "region_avg")
    order = level_order(urban_rows, "region", [F.col("region_avg").asc_nulls_last()], "region_order")
    return with_level_order(joined, order, "region")


def compare_indicators(
    first: DataFrame, second: DataFrame, key: str, first_name: str, second_name: str
) -> DataFrame:
    """Two estimate tables side by side in long form.

    ``label_colour`` is dark below the median of all values and light from it on
    (missing values do not enter the median); ``<key>_order`` ranks the areas by the
    first indicator.
    """
    a = first.select(quoted(key), F.col("avg").alias(first_name))
    b = second.select(quoted(key), F.col("avg").alias(second_name))
    wide = stage(keyed_join(a, b, key, "full"))  # read three times, one row per area
    longer = long_form(wide, [key], [first_name, second_name])
    middle = exact_median(longer, "value", "middle")
    banded = (
        with_scalar(longer, middle, "middle", "middle")
        .withColumn(
            "label_colour",
            F.when(F.col("value") < F.col("middle"), "dark").when(F.col("value").isNotNull(), "light"),
        )
        .drop("middle")
    )
    order = level_order(wide, key, [quoted(first_name).asc_nulls_last()], f"{key}_order")
    return with_level_order(banded, order, key)


def with_national(estimates: DataFrame, national: DataFrame, into: str = "national_avg") -> DataFrame:
    """The whole-design mean on every row, e.g. as a reference line."""
    return with_scalar(estimates, national, "avg", into)


def dot_table(estimates: DataFrame, y: str, digits: int = 0) -> DataFrame:
    """Plot rows: areas with a name, their rank from lowest to highest, and a label."""
    named = estimates.filter(quoted(y).isNotNull())
    order = level_order(named, y, [F.col("avg").asc_nulls_last()], f"{y}_order")
    return with_level_order(named, order, y).withColumn("avg_label", percent(F.col("avg"), digits))


def comparison_bands(estimates: DataFrame, y: str = "admin2", facet: str = "admin1") -> DataFrame:
    """One reference band per facet."""
    band = [facet, *[f"{facet}_{c}" for c in ("lb", "ub", "avg")]]
    return estimates.filter(quoted(y).isNotNull()).select(*band).dropDuplicates(band)
