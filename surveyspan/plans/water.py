"""Drinking-water indicators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspan.functions import case_when, code_class
from surveyspan.operators.joins import quoted

# Water codes, labels and classes.
WATER_TYPES = {
    "piped water": 10,
    "    piped into dwelling": 11,
    "    piped to yard/plot": 12,
    "    piped from the neighbor": 13,
    "    public tap/standpipe": 14,
    "tube well water": 20,
    "   tube well or borehole": 21,
    "dug well (open/protected)": 30,
    "   protected well  to yard": 31,
    "   others protected well": 32,
    "   unprotected well to yard": 33,
    "   public and others unprotected well": 34,
    "surface water": 40,
    "   protected spring": 41,
    "   unprotected spring": 42,
    "   river/dam/lake/ponds/stream/canal/irrigation channel": 43,
    "   rainwater": 51,
    "   tanker truck": 61,
    "   cart with small tank": 62,
    "   bottled water": 71,
    "   sales company of water": 72,
    "   other": 96,
}
IMPROVED_WATER = (10, 11, 12, 13, 14, 20, 21, 31, 32, 41, 51)
UNIMPROVED_WATER = (30, 33, 34, 40, 42, 43, 61, 62, 71, 72, 96)
BOTTLED_WATER = (71, 72)
NEAR_MINUTES = 30


@dataclass(frozen=True)
class WaterClasses:
    improved: tuple = IMPROVED_WATER
    unimproved: tuple = UNIMPROVED_WATER
    bottled: tuple = BOTTLED_WATER

    @classmethod
    def from_classes(cls, classes: dict, bottled: tuple = BOTTLED_WATER) -> WaterClasses:
        """From ``read_code_classes`` over a classification table (1 improved, 0 not)."""
        return cls(classes[1], classes[0], bottled)

    @property
    def unimproved_piped(self) -> tuple:
        """Unimproved codes without the bottled ones."""
        return tuple(c for c in self.unimproved if c not in self.bottled)

    @property
    def improved_with_bottled(self) -> tuple:
        return self.improved + self.bottled

    def class_of(self, source: Column) -> Column:
        """1 improved, 2 unimproved, 3 bottled and unimproved, 4 bottled only."""
        listed = tuple(c for c in self.bottled if c in self.unimproved)
        return code_class(source, {1: self.improved, 2: self.unimproved_piped, 3: listed, 4: self.bottled})


def water_indicators(
    hh: DataFrame,
    classes: WaterClasses | None = None,
    rules: str = "primary",
    source: str = "water_source",
    minutes: str = "time2water",
) -> DataFrame:
    """Add ``improved_water``, ``impr_water_under30min``, ``impr_water_dhs``, ``impr_water_type``.

    ``impr_water_dhs`` counts bottled water as improved. Primary rules leave a code
    in no list missing; ``alternate`` counts any known code outside the list as 0.
    """
    classes = classes or WaterClasses()
    if rules not in ("primary", "alternate"):
        raise ValueError("rules must be 'primary' or 'alternate'")
    src, time = quoted(source), quoted(minutes)
    cls = classes.class_of(src)
    if rules == "primary":
        improved = case_when((cls == 1, 1), (cls < 4, 0))
        with_bottled = case_when((cls == 2, 0), (cls.isNotNull(), 1))
        known = cls < 4
    else:
        known = src.isNotNull()
        improved = F.when(known, F.when(cls == 1, 1).otherwise(0))
        with_bottled = F.when(known, F.when((cls == 1) | (cls > 2), 1).otherwise(0))
    near = (time <= NEAR_MINUTES) & (cls == 1)
    return hh.withColumns(
        {
            "improved_water": improved,
            "impr_water_under30min": F.when(known & time.isNotNull(), F.when(near, 1).otherwise(0)),
            "impr_water_dhs": with_bottled,
            "impr_water_type": case_when((cls == 1, "improved"), (cls == 2, "unimproved"), (cls > 2, "bottled")),
        }
    )
