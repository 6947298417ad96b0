"""Sanitation indicators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from surveyspan.functions import case_when, code_class
from surveyspan.operators.joins import quoted

# Toilet codes, labels and classes.
TOILET_TYPES = {
    "flush toilet": 10,
    "flush to piped sewer system": 11,
    "flush to septic tank": 12,
    "flush to pit latrine": 13,
    "flush to somewhere else": 14,
    "flush, don't know where": 15,
    "pit toilet latrine": 20,
    "ventilated improved pit latrine (vip)": 21,
    "pit latrine with slab": 22,
    "pit latrine without slab/open pit": 23,
    "no facility": 30,
    "no facility/bush/field": 31,
    "composting toilet": 41,
    "bucket toilet": 42,
    "hanging toilet/latrine": 43,
    "toilet hanging (on stilts)": 44,
    "mobile chemical toilet": 45,
    "other": 96,
}
IMPROVED_TOILETS = (10, 11, 12, 13, 14, 15, 20, 21, 22, 41)
OPEN_DEFECATION = (30, 31)
UNIMPROVED_TOILETS = (23, 42, 43, 44, 45, 96)


@dataclass(frozen=True)
class ToiletClasses:
    improved: tuple = IMPROVED_TOILETS
    unimproved: tuple = UNIMPROVED_TOILETS
    open_defecation: tuple = OPEN_DEFECATION

    @classmethod
    def from_classes(cls, classes: dict) -> ToiletClasses:
        """From ``read_code_classes`` over a classification table."""
        return cls(classes["Improved"], classes["Unimproved"], classes["open defecation"])

    def class_of(self, source: Column) -> Column:
        """1 improved, 2 unimproved, 3 open defecation."""
        return code_class(source, {1: self.improved, 2: self.unimproved, 3: self.open_defecation})


def sanitation_indicators(
    hh: DataFrame,
    classes: ToiletClasses | None = None,
    rules: str = "primary",
    source: str = "toilet_source",
    shared: str = "share_toilet",
) -> DataFrame:
    """Add ``toilet_type``, ``improved_toilet`` and ``impr_toilet_type``.

    Improved means an improved, unshared facility. Primary rules leave a missing
    type, or an improved toilet with unknown sharing, missing; ``alternate`` counts both as 0.
    """
    classes = classes or ToiletClasses()
    if rules not in ("primary", "alternate"):
        raise ValueError("rules must be 'primary' or 'alternate'")
    # All three columns test the class of the code. Building them on one another would
    # repeat the nested expression in every branch once the optimizer inlines it.
    cls, share = classes.class_of(quoted(source)), quoted(shared)
    private, communal = (cls == 1) & (share == 0), (cls == 1) & (share == 1)
    flag = (
        case_when((private, 1), (communal | (cls > 1), 0))
        if rules == "primary"
        else case_when((private, 1), default=0)
    )
    return hh.withColumns(
        {
            "toilet_type": case_when((cls == 1, "improved"), (cls == 2, "unimproved"), (cls == 3, "open defecation")),
            "improved_toilet": flag,
            "impr_toilet_type": case_when(
                (private, "improved-unshared"),
                (communal, "improved-shared"),
                (cls == 2, "unimproved"),
                (cls == 3, "open defecation"),
            ),
        }
    )
