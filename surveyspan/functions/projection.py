"""Transverse Mercator coordinates to longitude and latitude and back, as column expressions.

The series in the third flattening n up to its sixth power (Krueger 1912; Karney 2011, J. Geodesy 85, 475-485), exact to
nanometres within some 35 degrees of the central meridian. Coordinates stay on their ellipsoid: no datum shift. NULL stays NULL.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspan.operators.joins import quoted

# Coefficients of the published series; row j holds those of n**j, n**(j+1), ... up to n**6.
_FORWARD = (
    (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800),
    (13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
    (61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
    (49561 / 161280, -179 / 168, 6601661 / 7257600),
    (34729 / 80640, -3418889 / 1995840),
    (212378941 / 319334400,),
)
_INVERSE = (
    (1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800),
    (1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720),
    (17 / 480, -37 / 840, -209 / 4480, 5569 / 90720),
    (4397 / 161280, -11 / 504, -830251 / 7257600),
    (4583 / 161280, -108847 / 3991680),
    (20648693 / 638668800,),
)
_LATITUDE = (
    (2, -2 / 3, -2, 116 / 45, 26 / 45, -2854 / 675),
    (7 / 3, -8 / 5, -227 / 45, 2704 / 315, 2323 / 945),
    (56 / 15, -136 / 35, -1262 / 105, 73814 / 2835),
    (4279 / 630, -332 / 35, -399572 / 14175),
    (4174 / 315, -144838 / 6237),
    (601676 / 22275,),
)


@dataclass(frozen=True)
class TransverseMercator:
    """A projected coordinate system; the ellipsoid is WGS 84 unless given. ``unit`` is its length unit in metres."""

    central_meridian: float
    latitude_of_origin: float = 0.0
    scale: float = 0.9996
    false_easting: float = 500_000.0
    false_northing: float = 0.0
    semi_major: float = 6_378_137.0
    inverse_flattening: float = 298.257223563
    unit: float = 1.0

    @classmethod
    def utm(cls, zone: int, south: bool = False) -> TransverseMercator:
        return cls(6.0 * zone - 183.0, false_northing=1e7 if south else 0.0)

    @classmethod
    def from_wkt(cls, text: str) -> TransverseMercator | None:
        """The projection of a layer's .prj text; None when its coordinates are geographic already."""
        if re.match(r"\s*GEOGCS\b", text):
            return None
        kind = re.search(r'PROJECTION\s*\[\s*"([^"]*)"', text)
        if not kind or kind[1].lower().replace(" ", "_") not in ("transverse_mercator", "gauss_kruger"):
            raise ValueError(f"projection {kind[1] if kind else 'unknown'} is not Transverse Mercator")
        found = {k.lower(): float(v) for k, v in re.findall(r'PARAMETER\s*\[\s*"([^"]*)"\s*,\s*([^\]\s]+)', text)}
        ellipsoid = re.search(r'SPHEROID\s*\[\s*"[^"]*"\s*,\s*([^,\s]+)\s*,\s*([^,\]\s]+)', text)
        units = re.findall(r'UNIT\s*\[\s*"[^"]*"\s*,\s*([^,\]\s]+)', text)
        unit = float(units[-1]) if len(units) > 1 else 1.0
        return cls(
            found["central_meridian"],
            found.get("latitude_of_origin", 0.0),
            found.get("scale_factor", 1.0),
            found.get("false_easting", 0.0) * unit,
            found.get("false_northing", 0.0) * unit,
            float(ellipsoid[1]) if ellipsoid else 6_378_137.0,
            float(ellipsoid[2]) if ellipsoid else 298.257223563,
            unit,
        )

    def wkt(self) -> str:
        parameters = {
            "False_Easting": self.false_easting / self.unit,
            "False_Northing": self.false_northing / self.unit,
            "Central_Meridian": self.central_meridian,
            "Scale_Factor": self.scale,
            "Latitude_Of_Origin": self.latitude_of_origin,
        }
        listed = ",".join(f'PARAMETER["{k}",{v!r}]' for k, v in parameters.items())
        return (
            f'PROJCS["Transverse Mercator",GEOGCS["Geographic",DATUM["Datum",SPHEROID["Ellipsoid",{self.semi_major!r},'
            f'{self.inverse_flattening!r}]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]],'
            f'PROJECTION["Transverse_Mercator"],{listed},UNIT["Length",{self.unit!r}]]'
        )

    @property
    def _n(self) -> float:
        f = 1 / self.inverse_flattening
        return f / (2 - f)

    @property
    def _eccentricity(self) -> float:
        f = 1 / self.inverse_flattening
        return math.sqrt(f * (2 - f))

    @property
    def radius(self) -> float:
        """Of the rectifying sphere, times the scale on the central meridian."""
        n = self._n
        return self.scale * self.semi_major / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)

    def terms(self, table: tuple) -> list[float]:
        n = self._n
        return [sum(c * n ** (j + k + 1) for k, c in enumerate(row)) for j, row in enumerate(table)]

    @property
    def origin(self) -> float:
        """Northing of the latitude of origin on the central meridian, before the false northing."""
        phi = math.radians(self.latitude_of_origin)
        e = self._eccentricity
        conformal = math.atan(math.sinh(math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi))))
        return self.radius * (conformal + sum(t * math.sin(2 * (j + 1) * conformal) for j, t in enumerate(self.terms(_FORWARD))))

    # Steps in which each value is used several times by the next, so that callers may name or bind them between.

    def _sphere(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """(conformal tangent, longitude from the central meridian)."""
        e = F.lit(self._eccentricity)
        sine = F.sin(F.radians(lat))
        return F.sinh(F.atanh(sine) - e * F.atanh(e * sine)), F.radians(lon - F.lit(self.central_meridian))

    @staticmethod
    def _angles(t: Column, turn: Column) -> tuple[Column, Column]:
        cosine = F.cos(turn)
        return F.atan2(t, cosine), F.asinh(F.sin(turn) / F.sqrt(t * t + cosine * cosine))

    def _bent(self, a: Column, b: Column, table: tuple, sign: float) -> tuple[Column, Column]:
        up, right = a, b
        for j, term in enumerate(self.terms(table), 1):
            k = F.lit(2.0 * j)
            up = up + F.lit(sign * term) * F.sin(k * a) * F.cosh(k * b)
            right = right + F.lit(sign * term) * F.cos(k * a) * F.sinh(k * b)
        return up, right

    def _plane(self, up: Column, right: Column) -> tuple[Column, Column]:
        x = F.lit(self.radius) * right + F.lit(self.false_easting)
        y = F.lit(self.radius) * up + F.lit(self.false_northing - self.origin)
        return x / F.lit(self.unit), y / F.lit(self.unit)

    def _from_plane(self, x: Column, y: Column) -> tuple[Column, Column]:
        up = (y * F.lit(self.unit) - F.lit(self.false_northing - self.origin)) / F.lit(self.radius)
        return up, (x * F.lit(self.unit) - F.lit(self.false_easting)) / F.lit(self.radius)

    @staticmethod
    def _conformal(up: Column, right: Column) -> tuple[Column, Column]:
        """(conformal latitude, longitude from the central meridian)."""
        cosine, sinh = F.cos(up), F.sinh(right)
        return F.atan2(F.sin(up), F.sqrt(sinh * sinh + cosine * cosine)), F.atan2(sinh, cosine)

    def _degrees(self, conformal: Column, turn: Column) -> tuple[Column, Column]:
        lat = conformal
        for j, term in enumerate(self.terms(_LATITUDE), 1):
            lat = lat + F.lit(term) * F.sin(F.lit(2.0 * j) * conformal)
        return F.degrees(turn) + F.lit(self.central_meridian), F.degrees(lat)

    def steps(self, inverse: bool) -> list:
        """Functions (a, b) -> (a, b) that lead from one kind of coordinates to the other."""
        if inverse:
            return [self._from_plane, lambda a, b: self._bent(a, b, _INVERSE, -1.0), self._conformal, self._degrees]
        return [self._sphere, self._angles, lambda a, b: self._bent(a, b, _FORWARD, 1.0), self._plane]


def _converted(df: DataFrame, projection: TransverseMercator, x: str, y: str, inverse: bool) -> DataFrame:
    """Replace two columns step by step. Each step is a projection of its own, so nothing is computed twice."""
    out = df
    for step in projection.steps(inverse):
        a, b = step(quoted(x), quoted(y))
        out = out.withColumns({x: a, y: b})
    return out


def to_geographic(df: DataFrame, projection: TransverseMercator, x: str = "long", y: str = "lat") -> DataFrame:
    """Replace easting and northing by longitude and latitude in degrees."""
    return _converted(df, projection, x, y, inverse=True)


def to_projected(df: DataFrame, projection: TransverseMercator, x: str = "long", y: str = "lat") -> DataFrame:
    """Replace longitude and latitude by easting and northing."""
    return _converted(df, projection, x, y, inverse=False)


def convert_rings(rings: Column, projection: TransverseMercator, inverse: bool = True) -> Column:
    """All vertices of ``array<array<struct<x,y>>>`` in the other kind of coordinates."""
    steps = projection.steps(inverse)

    def moved(p: Column, left: list) -> Column:
        x, y = left[0](p["x"], p["y"])
        q = F.struct(x.alias("x"), y.alias("y"))
        # a one-element array binds the step's result to a name
        return q if len(left) == 1 else F.transform(F.array(q), lambda r: moved(r, left[1:]))[0]

    return F.transform(rings, lambda ring: F.transform(ring, lambda p: moved(p, steps)))
