"""Place names matched with tolerance: accents, case, outer blanks and a few slips of spelling.

Names within k edits of each other share an intact piece: when one is cut into k + 1 segments, at most k of them hold an
edit, and the untouched one stands in the other name at most k places away. So the distinct names of the gazetteer are filed
under their segments (with their length and the segment's place), the distinct names asked for under the
substrings that could be such a segment, and only names that meet in a key have their edit distance computed, in the JVM and
with an early stop. No match is lost. (Li, Deng, Wang, Feng, Pass-Join, VLDB 2012.)

All joins are equi-joins on short keys; a name asked for on many rows is matched once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspan.functions.text import accent_key
from surveyspan.operators.joins import keyed_join, lookup_join, quoted
from surveyspan.staging import stage


def _segment(length: Column, i: Column, k: int) -> tuple[Column, Column]:
    """(start from 0, size) of segment ``i`` of a text cut into k + 1 as evenly as possible, the longer ones last."""
    base, longer = F.floor(length / (k + 1)), length % (k + 1)
    late = F.greatest(F.lit(0), i - (F.lit(k + 1) - longer))
    return (i * base + late).cast("int"), (base + F.when(i >= F.lit(k + 1) - longer, 1).otherwise(0)).cast("int")


def _filed(names: DataFrame, key: str, k: int) -> DataFrame:
    """``size, i, piece, <key>`` for every segment of every name."""
    length = F.char_length(key)
    parts = F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: F.struct(i.alias("i"), *[
        c.alias(n) for c, n in zip(_segment(length, i, k), ("start", "width"), strict=True)
    ]))
    return names.select(quoted(key), length.alias("size"), F.explode(parts).alias("s")).select(
        "size", F.col("s.i").alias("i"), F.substr(quoted(key), F.col("s.start") + 1, F.col("s.width")).alias("piece"), quoted(key)
    )


def _asked(names: DataFrame, key: str, k: int) -> DataFrame:
    """``size, i, piece, <key>`` for every substring that may be a segment of a name within k edits."""
    length = F.char_length(key)
    sizes = F.sequence(F.greatest(F.lit(0), length - k), length + k)
    lengths = names.select(quoted(key), length.alias("l"), F.explode(sizes).alias("size"))
    placed = lengths.select("*", F.explode(F.sequence(F.lit(0), F.lit(k))).alias("i"))
    start, width = _segment(F.col("size"), F.col("i"), k)
    spans = placed.select("*", start.alias("start"), width.alias("width"))
    first, last = F.greatest(F.lit(0), F.col("start") - k), F.least(F.col("l") - F.col("width"), F.col("start") + k)
    spread = spans.filter(last >= first).select("*", F.explode(F.sequence(first, last)).alias("p"))
    return spread.select("size", "i", F.substr(quoted(key), F.col("p") + 1, F.col("width")).alias("piece"), quoted(key)).distinct()


def close_names(names: DataFrame, places: DataFrame, edits: int = 2, per_edit: int = 4) -> DataFrame:
    """``name, place, distance`` for all pairs of one-column tables within reach of each other.

    The distance is that of the names without accents, case and outer blanks; at most ``edits``, and one for each
    ``per_edit`` characters of the asked name. NULL names and places match nothing.
    """
    asked = names.toDF("name").filter("name is not null").distinct().withColumn("asked", accent_key(F.col("name")))
    known = places.toDF("place").filter("place is not null").distinct().withColumn("known", accent_key(F.col("place")))
    pairs = (
        _asked(asked.select("asked").distinct(), "asked", edits)
        .join(_filed(known.select("known").distinct(), "known", edits), ["size", "i", "piece"])
        .select("asked", "known")
        .distinct()
    )
    allowed = F.least(F.lit(edits), F.floor(F.char_length("asked") / per_edit).cast("int"))
    distance = F.levenshtein("asked", "known", edits)
    near = pairs.select("asked", "known", distance.alias("distance"), allowed.alias("allowed")).filter(
        (F.col("distance") >= 0) & (F.col("distance") <= F.col("allowed"))
    )
    return near.join(asked, "asked").join(known, "known").select("name", "place", "distance")


def best_places(names: DataFrame, places: DataFrame, edits: int = 2, per_edit: int = 4) -> DataFrame:
    """``name, place, distance, n_places`` for the names with a match.

    ``n_places`` counts the places at the smallest distance; a place spelled exactly like the name is alone.
    With several the name is ambiguous and ``place`` is NULL; :func:`close_names` lists them.
    """
    near = close_names(names, places, edits, per_edit).withColumn(
        "rank", F.when(F.col("name") == F.col("place"), -1).otherwise(F.col("distance"))
    )
    counted = near.groupBy("name", "rank").agg(F.min("place").alias("place"), F.count("*").alias("n"), F.min("distance").alias("d"))
    best = counted.groupBy("name").agg(F.min(F.struct("rank", "place", "n", "d")).alias("b"))
    return best.select(
        "name",
        F.when(F.col("b.n") == 1, F.col("b.place")).alias("place"),
        F.col("b.d").alias("distance"),
        F.col("b.n").alias("n_places"),
    )


def tolerant_lookup(
    df: DataFrame, name: str, gazetteer: DataFrame, place: str = "loc", edits: int = 2, per_edit: int = 4
) -> DataFrame:
    """Every row with the gazetteer's columns for its place, found by :func:`best_places`.

    Adds ``<place>`` (NULL without a match or with several), ``distance`` and ``n_places`` (0 without a match). A gazetteer
    with a second row for a place raises.
    """
    found = stage(best_places(df.select(quoted(name)), gazetteer.select(quoted(place)), edits, per_edit))
    matched = keyed_join(
        df, found.select(F.col("name").alias("_asked"), F.col("place").alias(place), "distance", "n_places"), {name: "_asked"}
    ).withColumn("n_places", F.coalesce("n_places", F.lit(0).cast("long")))
    known = gazetteer.filter(quoted(place).isNotNull())
    looked = lookup_join(matched, known, place)
    first = [*df.columns, place, "distance", "n_places"]
    return looked.select(*[quoted(c) for c in first], *[quoted(c) for c in looked.columns if c not in first])
