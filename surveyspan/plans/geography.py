"""Cluster coordinates, the admin hierarchy and map-ready tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspan.functions import case_when, percent, respell, trim_text
from surveyspan.operators.counts import distinct_rows
from surveyspan.operators.joins import keyed_join, lookup_join, quoted, whole_join

# Columns of the cluster file behind the geography table.
GEO_COLUMNS = {
    "cluster_id": "DHSCLUST",
    "urban": "URBAN_RURA",
    "lat": "LATNUM",
    "lon": "LONGNUM",
    "admin1": "ADM1NAME",
    "A1_PCode": "A1_PCode",
    "admin2": "NAME_2",
    "ID_2": "ID_2",
    "admin3": "A2_Name",
    "A2_PCode": "A2_PCode",
}
ADMIN1_SPELLINGS = {"L'Artibonite": "Artibonite"}


def urban_letter_flag(letter: Column) -> Column:
    return case_when((letter == "U", 1), (letter == "R", 0))


def known_coordinate(value: Column) -> Column:
    """Exactly zero marks a cluster whose position is unknown."""
    return F.nullif(value, F.lit(0.0))


def cluster_geography(
    admin2: DataFrame,
    admin3: DataFrame,
    keys: Sequence[str] = ("DHSCLUST",),
    columns: Mapping[str, str] = GEO_COLUMNS,
) -> DataFrame:
    """One row per cluster from two spatial-join outputs.

    Joined in full on the cluster id. Columns both sides carry are taken from the
    first side and filled from the second: matching on them as well (coordinates
    are doubles) could split one cluster into two rows.
    """
    shared = [c for c in admin2.columns if c in admin3.columns and c not in keys]
    both = keyed_join(admin2, admin3, keys, "full", suffixes=("", "__second"))
    merged = both.withColumns({c: F.coalesce(quoted(c), quoted(f"{c}__second")) for c in shared})
    chosen = merged.select(*[quoted(src).alias(dst) for dst, src in columns.items()])
    return chosen.withColumns(
        {
            "urban": urban_letter_flag(F.col("urban")),
            "lat": known_coordinate(F.col("lat")),
            "lon": known_coordinate(F.col("lon")),
        }
    )


def admin_lookup(layer: DataFrame, admin1: str = "NAME_1", admin2: str = "NAME_2", spellings=ADMIN1_SPELLINGS) -> DataFrame:
    """Distinct (admin1, admin2) pairs with survey spellings."""
    named = layer.select(quoted(admin1).alias("admin1"), quoted(admin2).alias("admin2"))
    pairs = distinct_rows(named, ["admin1", "admin2"])
    return pairs.withColumn("admin1", respell(F.col("admin1"), dict(spellings)))


def trimmed_commune_names(layer: DataFrame, commune: str = "A2_Name", departement: str = "A1_Name") -> DataFrame:
    return layer.withColumns(
        {"commune": trim_text(quoted(commune)), "departement": trim_text(quoted(departement))}
    )


def map_table(estimates: DataFrame, layer: DataFrame, name: str, layer_name: str) -> DataFrame:
    """Every polygon with the estimate of its area; areas without estimate keep NULL.

    The estimates are checked to hold one row per name, so no polygon is repeated. Give the polygons
    and take their vertices (:func:`polygon_vertices`) afterwards: then no vertex is shuffled.
    """
    return lookup_join(layer, estimates, {layer_name: name})


def full_map_table(values: DataFrame, layer: DataFrame, on: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """Polygons and area values, keeping areas that have no polygon as well.

    The values hold one row per area, a second one raises, so no polygon is repeated.
    ``polygon_vertices(..., keep_empty=True)`` makes the vertex table of it.
    """
    return whole_join(layer, values, on)


def centroid_labels(centroids: DataFrame, mapped: DataFrame, name: str, fill: str, digits: int = 0) -> DataFrame:
    """Centroids with the mean of ``fill`` over their area as a percent label."""
    means = mapped.groupBy(quoted(name).alias("label")).agg(F.avg(quoted(fill)).alias("mean_value"))
    labelled = means.select("label", percent(F.col("mean_value"), digits).alias("var_pct"))
    return keyed_join(centroids, labelled, "label", "left")
