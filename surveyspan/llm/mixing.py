"""Mixing sources to target weights by whole copies and one hash-seeded extra copy.

Words are summed per source (partial aggregation, so a hot source is no hot task),
targets follow from the weights, and each document is emitted ``floor(rate)`` times plus
once more when its hash falls below the fraction of the rate. A document has eight hash
draws (the 32-bit words of one SHA-256); per source the draw whose outcome over the
whole table comes nearest to the target is used, which keeps small sources close to theirs.

Targets: sources in code-point order (a missing source last) take the weights in turn and share the
total number of words. A target stops at ``max_repeats`` times its source's size; the excess
goes to the others by weight until no target is above. Finding that level needs one small
aggregate over the source table per round; nothing of the size of the corpus moves.

Defined cases: a NULL text has size 0; a source without words has target 0; rows equal in
id and text draw alike; an empty table gives no rows; further columns are carried or ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspan.llm.tools import text_of, written
from surveyspan.operators.order import row_numbers

#: A word is a run of characters other than blank and the controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
DRAWS = 8


def _measured(docs: DataFrame, *columns: Column) -> DataFrame:
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text_of())
    return docs.select(
        *columns,
        F.col("source").alias("_source"),
        F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"),
        F.sha2(named, 256).alias("_draws"),
    )


def _draw(k: int) -> Column:
    """Draw number k of a document, in [0, 1)."""
    return F.conv(F.substring("_draws", 8 * k + 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS
) -> DataFrame:
    """``_source, source_size, weight, target`` from ``_source, source_size`` (one row per source)."""
    ranked = row_numbers(sizes, [F.col("_source").asc_nulls_last()], "_rank")
    turn = F.pmod(F.col("_rank") - 1, F.lit(len(weights))).cast("int") + 1
    sources = written(
        ranked.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), turn).cast("long")),
        "mix-sources",
    )
    cap = F.col("source_size") * F.lit(max_repeats)
    total, level, stopped = None, None, -1
    while True:
        full = F.lit(False) if level is None else cap.cast("double") <= F.lit(level) * F.col("weight")
        row = sources.agg(
            F.sum("source_size").alias("total"),
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0)).alias("taken"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("weight"),
            F.count(F.when(full, 1)).alias("stopped"),
        ).first()
        total = row["total"] or 0
        if row["stopped"] == stopped or not row["weight"]:
            break
        level, stopped = (total - row["taken"]) / row["weight"], row["stopped"]
    share = F.least(cap.cast("double"), F.lit(float(level or 0.0)) * F.col("weight"))
    return sources.select("_source", "source_size", "weight", share.alias("target"))


def _copies(k: Column | int) -> Column:
    extra = F.when(_draw(k) < F.col("_rate") - F.floor("_rate"), 1).otherwise(0)
    return (F.floor("_rate") + extra).cast("long")


def _plan(measured: DataFrame, weights: Sequence[int], max_repeats: int) -> DataFrame:
    """One row per source: target, rate and the draw that is used."""
    sizes = measured.groupBy("_source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, max_repeats).withColumnRenamed("_source", "_s")
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    rated = written(targets.withColumn("_rate", rate), "mix-rates")
    outcome = (
        measured.join(rated, F.col("_source").eqNullSafe(F.col("_s")))
        .groupBy("_s")
        .agg(
            F.first("target").alias("target"), F.first("source_size").alias("source_size"),
            F.first("_rate").alias("_rate"),
            *[F.sum(_copies(k) * F.col("size")).alias(f"_t{k}") for k in range(DRAWS)],
        )
    )
    errors = F.array(*[F.abs(F.col(f"_t{k}") - F.col("target")) for k in range(DRAWS)])
    best = (F.array_position(errors, F.array_min(errors)) - 1).cast("int")
    return written(outcome.select("_s", "source_size", "target", "_rate", best.alias("_k")), "mix-plan")


def _decided(measured: DataFrame, plan: DataFrame) -> DataFrame:
    copies = F.element_at(F.array(*[_copies(k) for k in range(DRAWS)]), F.col("_k") + 1)
    return measured.join(plan, F.col("_source").eqNullSafe(F.col("_s"))).withColumn("copies", copies)


def mix_plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Per document: ``doc_id, size, source_size, target, taken, copies``."""
    measured = written(_measured(docs, F.col("doc_id")), "mix-sizes")
    decided = _decided(measured, _plan(measured, weights, max_repeats))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return decided.select("doc_id", "size", "source_size", "target", taken, "copies")


def mix_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the mix takes it, columns unchanged."""
    plan = _plan(written(_measured(docs), "mix-sizes"), weights, max_repeats)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    decided = _decided(_measured(docs, row), plan).filter(F.col("copies") > 0)
    repeated = decided.select("_row", F.explode(F.expr("sequence(1, int(copies))")).alias("_copy"))
    return repeated.select("_row.*")
