"""Contiguous shards of nearly equal bytes from a global prefix sum of document sizes.

Documents lie in ascending ``doc_id`` order on one line of bytes; the line is cut at equal
targets and a document belongs to the shard that holds its middle byte. A shard
therefore differs from the target by less than the two documents at its ends. The
prefix sum needs one range shuffle and one total per partition; no hot key exists,
because nothing is grouped by text or source.

Defined cases: a NULL text weighs 16 bytes; an empty table gives no rows; rows that repeat an
id or lack one (NULL sorts first) lie side by side, in an order that no column but equal
rows could notice; further columns are carried, not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspan.llm.tools import prefix_sums, text_of

#: Bytes that a document weighs besides its text.
OVERHEAD = 16


def assign_shards(sized: DataFrame, n_shards: int, order: list[str], name: str = "shards") -> DataFrame:
    """``sized`` (with a long column ``size`` >= 1) plus ``shard`` and ``slot`` columns."""
    placed = prefix_sums(sized.withColumn("_one", F.lit(1).cast("long")), order, ["size", "_one"], name)
    total = placed.agg(F.coalesce(F.sum("size"), F.lit(1))).scalar()
    middle = F.lit(2) * F.col("before_size") + F.col("size")
    scaled = placed.withColumn("_middle", middle * F.lit(n_shards)).withColumn("_total", F.lit(2) * total)
    cut = scaled.withColumn("shard", F.least(F.lit(n_shards - 1), F.expr("_middle div _total")).cast("int"))
    # one row per shard
    first = cut.groupBy(F.col("shard").alias("_shard")).agg(F.min("before__one").alias("_first"))
    joined = cut.join(F.broadcast(first), F.col("shard") == F.col("_shard"))
    return joined.withColumn("slot", F.col("before__one") - F.col("_first")).drop(
        "_one", "before_size", "before__one", "_shard", "_first", "_middle", "_total"
    )


def shard_plan(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """Per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``."""
    text = text_of()
    sized = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_tie"),
    )
    placed = assign_shards(sized, n_shards, ["doc_id", "text_crc32", "_tie"], "byte-shards")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 40) -> None:
    """Whole rows as Parquet, one folder per shard, each in slot order."""
    text = text_of()
    row = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").alias("_id"),
        (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.xxhash64(text).alias("_tie"),
    )
    placed = assign_shards(row, n_shards, ["_id", "_tie"], "byte-shard-rows")
    placed.select(F.col("shard").alias("_shard"), "slot", "row").sortWithinPartitions("_shard", "slot").select(
        "_shard", "row.*"
    ).write.partitionBy("_shard").parquet(path)
