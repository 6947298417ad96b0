"""Exact deduplication by skew-safe combining; DataFrame functions only.

1. Each map task merges equal texts of its own rows (partial aggregation).
2. Groups are merged per digest, content and salt, so that a text with very many copies is
   spread over ``salts`` tasks.
3. The salt winners, at most ``salts`` rows per text, are merged globally.

The grouping key of both merges holds the whole content beside the digest: texts that
only share a digest are never merged. A document finds its group on narrow rows by the SHA-256 and an independent second
hash of its content, whatever digest the merges use: a weak digest costs time, never a wrong group.
A group of any size is the large side of a join that AQE may split.

Defined cases: a NULL text is the empty text; a NULL id is the smallest (and is kept only in a group
without ids); of rows that repeat both id and text exactly one is kept;
an empty table gives no rows; further columns are carried or ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspan.llm.tools import text_of

SALTS = 16


def sha256(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def _salt(salts: int) -> Column:
    return F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int")


def duplicate_groups(docs: DataFrame, salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per distinct text: ``digest, content, keep_id, group_size``."""
    content = text_of()
    rows = docs.select(F.col("doc_id").alias("_id"), content.alias("content"), digest(content).alias("digest"))
    salted = rows.groupBy("digest", _salt(salts).alias("_salt"), "content").agg(
        F.max("_id").alias("keep_id"), F.count("*").alias("group_size")
    )
    return salted.groupBy("digest", "content").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )


def mark_duplicates(docs: DataFrame, salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    content = text_of()
    winners = duplicate_groups(docs, salts, digest).select(
        sha256(F.col("content")).alias("_sha"), F.xxhash64("content").alias("_check"), "keep_id", "group_size"
    )
    members = (
        docs.select("doc_id", sha256(content).alias("sha"), F.xxhash64(content).alias("check"))
        .groupBy("doc_id", "sha", "check")
        .agg(F.count("*").cast("int").alias("copies"))
    )
    found = members.join(winners, (F.col("sha") == F.col("_sha")) & (F.col("check") == F.col("_check")))
    # repeated rows of one id and text come back one by one; the first of them counts as the one that stays
    return found.withColumn("copy", F.explode(F.expr("sequence(1, copies)"))).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The rows that stay, whole and unchanged: of equal texts the one with the largest id."""
    content = text_of()
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select(
        F.col("doc_id").alias("_id"),
        F.struct(*rest, F.col("text").isNull().alias("_null_text")).alias("row"),
        content.alias("content"),
        digest(content).alias("digest"),
    )
    order = F.struct(F.col("_id").isNotNull(), F.col("_id"))
    salted = rows.groupBy("digest", _salt(salts).alias("_salt"), "content").agg(
        F.max_by("row", order).alias("row"), F.max(F.col("_id")).alias("_id")
    )
    kept = salted.groupBy("digest", "content").agg(F.max_by("row", order).alias("row"))
    text = F.when(~F.col("row._null_text"), F.col("content")).alias("text")
    return kept.select(*[text if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
