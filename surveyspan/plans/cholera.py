"""Cholera: priority communes, case rates and monthly series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspan.functions import case_when, ratio, respell, signif, trim_text
from surveyspan.operators.joins import keyed_join, lookup_join, quoted, whole_join
from surveyspan.operators.order import descending

# Response classes, phases, base rate and name fixes.
PREVALENCE_2016 = {"C": 1, "B": 2, "A": 3}
PREVALENCE_2014 = {"Phase 1": 2, "Phase 2": 1}
BASE_RATE = 0.00059
POPULATION_SPELLINGS = {"Grande Anse": "Grande-Anse"}
RESPONSE_COLUMN = "Cholera Response (Mid-term Plan)"
DEPARTEMENT_COLUMN = "Departement "


def commune_priorities(raw: DataFrame) -> DataFrame:
    """Listed communes with a priority, both prevalence codes and trimmed names."""
    response, phase = quoted(RESPONSE_COLUMN), F.col("Priority")
    return raw.filter(phase.isNotNull()).select(
        trim_text(F.col("commune")).alias("commune"),
        trim_text(quoted(DEPARTEMENT_COLUMN)).alias("departement"),
        phase.alias("priority"),
        response.alias("response"),
        case_when(*[(response == k, v) for k, v in PREVALENCE_2016.items()]).alias("prevalence2016"),
        case_when(*[(phase == k, v) for k, v in PREVALENCE_2014.items()]).alias("prevalence2014"),
    )


def priority_communes(raw: DataFrame, layer: DataFrame, how: str = "full") -> DataFrame:
    """Commune priorities on the commune polygons (both name columns trimmed).

    ``how="left"`` keeps listed communes only; ``full`` also keeps polygons of
    communes that are not listed, and a commune listed twice raises. ``polygon_vertices(..., keep_empty=True)`` makes the vertex table of it.
    """
    listed, on = commune_priorities(raw), ["commune", "departement"]
    if how != "full":
        return keyed_join(listed, layer, on, how)
    both = whole_join(layer, listed, on, suffixes=("_y", "_x"))
    shared = set(listed.columns) & set(layer.columns) - set(on)
    first = [c + "_x" if c in shared else c for c in listed.columns if c not in on]
    rest = [c for c in both.columns if c not in (*on, *first)]
    return both.select(*[quoted(c) for c in (*on, *first, *rest)])


def rates(cases: DataFrame, population: DataFrame, spellings=POPULATION_SPELLINGS) -> DataFrame:
    """Monthly cases with population and ``rate = cases / population``."""
    people = population.withColumn("Departement", respell(F.col("Departement"), dict(spellings)))
    joined = lookup_join(cases, people, "Departement")
    return joined.withColumn("rate", ratio(F.col("Cases"), F.col("pop")))


def case_rates(cases: DataFrame, population: DataFrame, base_rate: float = BASE_RATE, ranked: bool = True) -> DataFrame:
    """Totals, peak monthly rate (two significant digits) and its multiple of the base rate."""
    summary = (
        rates(cases, population)
        .groupBy("Departement")
        .agg(
            F.coalesce(F.sum("Cases"), F.lit(0)).alias("cases"),
            F.coalesce(F.sum("Deaths"), F.lit(0)).alias("deaths"),
            F.max("rate").alias("peak"),
        )
        .select("Departement", "cases", "deaths", signif(F.col("peak"), 2).alias("rate"))
        .withColumn("fc", F.col("rate") / F.lit(base_rate))
    )
    return descending(summary, "rate") if ranked else summary


def monthly_series(cases: DataFrame, by: str | None = "Departement") -> DataFrame:
    """Cases and deaths per month, per area or in total, in time order. No gaps are filled."""
    keys = [by, "Month"] if by else ["Month"]
    return (
        cases.groupBy(*[quoted(k) for k in keys])
        .agg(F.sum("Cases").alias("cases"), F.sum("Deaths").alias("deaths"))
        .orderBy(*[quoted(k).asc_nulls_last() for k in keys])
    )
