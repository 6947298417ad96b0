"""Polygon layers as tables of rings.

A layer is ``id``, attribute columns and ``rings array<array<struct<x,y>>>`` in
longitude/latitude. All geometry is array arithmetic on the row that holds the
polygon, so nothing is shuffled and a polygon with very many vertices is one row,
never one oversized group.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspan.operators.joins import lookup_join, quoted
from surveyspan.sources.sinks import write_numbered_csv


def polygon_vertices(
    layer: DataFrame, rings: str = "rings", id_column: str = "id", keep_empty: bool = False
) -> DataFrame:
    """One row per vertex: ``long, lat, order, piece, group, id`` and the attributes.

    ``order`` runs on through all pieces of a polygon, ``piece`` counts its rings from 1.
    Attributes are joined to the layer before this, so that joins move one row per polygon. With
    ``keep_empty`` a row without rings stays, with NULL in place of a vertex.
    """
    explode = F.posexplode_outer if keep_empty else F.posexplode
    attributes = [c for c in layer.columns if c not in (rings, id_column)]
    sizes = F.transform(quoted(rings), lambda r: F.size(r))
    pieces = layer.select(
        quoted(id_column).alias("id"),
        *[quoted(a) for a in attributes],
        sizes.alias("_sizes"),
        explode(quoted(rings)).alias("_p", "_ring"),
    )
    before = F.aggregate(F.slice("_sizes", 1, F.col("_p")), F.lit(0), lambda total, n: total + n)
    points = pieces.select(
        "id",
        *[quoted(a) for a in attributes],
        (F.col("_p") + 1).alias("piece"),
        before.alias("_before"),
        explode("_ring").alias("_v", "_xy"),
    )
    return points.select(
        F.col("_xy.x").alias("long"),
        F.col("_xy.y").alias("lat"),
        (F.col("_before") + F.col("_v") + 1).alias("order"),
        "piece",
        F.when(
            F.col("piece").isNotNull(),
            F.concat_ws(".", F.col("id").cast("string"), F.col("piece").cast("string")),
        ).alias("group"),
        "id",
        *[quoted(a) for a in attributes],
    )


def attach_attributes(vertices: DataFrame, attributes: DataFrame, id_column: str = "id") -> DataFrame:
    """Vertices with the attribute row of their polygon, for layers kept in two tables."""
    return lookup_join(vertices, attributes, id_column)


def select_pieces(vertices: DataFrame, ids: Sequence, piece: int = 1) -> DataFrame:
    """Only some polygons, and of those one ring."""
    return vertices.filter(quoted("id").isin(*ids) & (quoted("piece") == piece))


def _ring_moments(ring: Column) -> Column:
    """Signed area and first moments of one ring (shoelace), relative to its first vertex."""
    x0, y0 = ring[0]["x"], ring[0]["y"]
    here = F.transform(ring, lambda p: F.struct((p["x"] - x0).alias("x"), (p["y"] - y0).alias("y")))
    after = F.concat(F.slice(here, 2, F.greatest(F.size(here) - 1, F.lit(0))), F.slice(here, 1, 1))

    def edge(p: Column, q: Column) -> Column:
        cross = p["x"] * q["y"] - q["x"] * p["y"]
        return F.struct(
            cross.alias("c"), ((p["x"] + q["x"]) * cross).alias("mx"), ((p["y"] + q["y"]) * cross).alias("my")
        )

    edges = F.zip_with(here, after, edge)

    def total(name: str) -> Column:
        return F.aggregate(edges, F.lit(0.0), lambda acc, e: acc + e[name])

    area2 = total("c")
    return F.struct(
        F.abs(area2).alias("size"),
        (x0 + F.try_divide(total("mx"), area2 * 3.0)).alias("long"),
        (y0 + F.try_divide(total("my"), area2 * 3.0)).alias("lat"),
    )


def polygon_centroids(
    layer: DataFrame, label: str | None = None, rings: str = "rings", id_column: str = "id"
) -> DataFrame:
    """``id, long, lat[, label]``: the centroid of each polygon's largest ring."""
    moments = F.transform(quoted(rings), _ring_moments)
    largest = F.array_max(moments)  # structs compare by their first field, the size
    columns = [quoted(id_column).alias("id"), largest.alias("_c")]
    if label is not None:
        if label in layer.columns:
            columns.append(quoted(label).alias("label"))
        else:
            warnings.warn(f"label column {label} is not in the polygon layer", stacklevel=2)
    found = layer.select(*columns)
    extra = ["label"] if "label" in found.columns else []
    return found.select("id", F.col("_c.long").alias("long"), F.col("_c.lat").alias("lat"), *extra)


def export_layer(layer: DataFrame, folder: str, name: str, label: str | None = None) -> None:
    """Numbered CSV exports of the vertex table and of the centroids."""
    write_numbered_csv(
        polygon_vertices(layer), f"{folder}/{name}.csv", [quoted("id").asc(), quoted("order").asc()], keys=["id", "order"]
    )
    write_numbered_csv(polygon_centroids(layer, label), f"{folder}/{name}_centroids.csv", [quoted("id").asc()], keys=["id"])
