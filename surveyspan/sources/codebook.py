"""Variable and value labels: column metadata on the frame, or a codebook table.

Labels of columns are metadata, which lives on the driver like the schema itself: of a codebook of any length only
the rows of a frame's own columns are brought there. Label tables of any length are joined (``decode_with_table``).
Where a code has several labels the first counts, in a table the smallest text.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyspan.operators.joins import quoted
from surveyspan.staging import broadcast_if_small

CODEBOOK_SCHEMA = T.StructType(
    [
        T.StructField("var", T.StringType()),
        T.StructField("varDescrip", T.StringType()),
        T.StructField("varValues", T.MapType(T.StringType(), T.LongType())),
    ]
)


@dataclass(frozen=True)
class Variable:
    """A survey variable: name, description and ``{label: code}``."""

    name: str
    description: str | None = None
    values: Mapping[str, int] = field(default_factory=dict)


def read_codebook(table: DataFrame, only: Sequence[str] | None = None) -> list[Variable]:
    """Variables from a codebook table; with ``only`` those of some columns, the first row of each.

    The rows reach the driver: give ``only`` unless the whole codebook belongs there.
    """
    rows = table.select("var", "varDescrip", "varValues")
    if only is not None:
        names = table.sparkSession.createDataFrame([(c,) for c in only], "_name string")
        rows = rows.join(names, F.col("var") == F.col("_name"), "left_semi").groupBy("var").agg(
            F.first("varDescrip").alias("varDescrip"), F.first("varValues").alias("varValues")
        )
    return [Variable(r["var"], r["varDescrip"], dict(r["varValues"] or {})) for r in rows.collect()]


def label_metadata(description: str | None, labels: Iterable[tuple[str, int]]) -> dict:
    """Metadata of a column from its (label, code) pairs in order.

    Metadata keeps no order, so where codes share a label or labels a code, ``codes`` tells which label
    each code has: its first.
    """
    meta: dict = {} if description is None else {"label": description}
    by_text: dict[str, int] = {}
    by_code: dict[str, str] = {}
    for text, code in labels:
        by_text.setdefault(text, int(code))
        by_code.setdefault(str(int(code)), text)
    if by_text:
        meta["labels"] = by_text
        if by_code != {str(code): text for text, code in by_text.items()} or len(by_code) != len(by_text):
            meta["codes"] = by_code
    return meta


def attach_codebook(df: DataFrame, variables: Iterable[Variable]) -> DataFrame:
    """Put labels on the columns they describe; other variables are ignored.

    Spark keeps the metadata through filters, plain selects and Parquet, and drops
    it from computed columns, so recodes attach their own.
    """
    found = {v.name: label_metadata(v.description, v.values.items()) for v in variables}
    return df.select(
        *[quoted(c).alias(c, metadata=found[c]) if c in found else quoted(c) for c in df.columns]
    )


def strip_metadata(df: DataFrame) -> DataFrame:
    """Plain columns without labels."""
    return df.select(
        *[quoted(f.name).alias(f.name, metadata={}) if f.metadata else quoted(f.name) for f in df.schema.fields]
    )


def codebook_table(df: DataFrame) -> DataFrame:
    """The codebook of a labelled frame: one row per column."""
    rows = [
        (f.name, f.metadata.get("label"), f.metadata.get("labels"))
        for f in df.schema.fields
    ]
    return df.sparkSession.createDataFrame(rows, CODEBOOK_SCHEMA)


def value_labels(codebook: DataFrame, variable: str) -> DataFrame:
    """``(label, code)`` of one variable."""
    return codebook.filter(F.col("var") == variable).select(
        F.explode("varValues").alias("label", "code")
    )


def decode(column: Column, values: Mapping[str, int], codes: Mapping[int, str] | None = None) -> Column:
    """Codes to labels; a value that equals no labelled code passes through as text.

    ``values`` is ``{label: code}``. Of several labels of one code the first counts. ``codes`` is
    ``{code: label}`` and takes its place, for lists in which codes share a label.
    """
    known: dict[int, str] = {}
    for code, label in codes.items() if codes else ((c, t) for t, c in values.items()):
        known.setdefault(int(code), label)
    if not known:
        return column.cast("string")
    entries = [e for code, label in known.items() for e in (F.lit(code).cast("bigint"), F.lit(label))]
    found = F.try_element_at(F.create_map(*entries), _whole(column))
    return F.coalesce(found, column.cast("string"))


def _whole(column: Column) -> Column:
    """The code that a value equals; fractions and text that is no number equal none."""
    whole = column.try_cast("bigint")
    return F.when(whole == column, whole)


def decode_labels(df: DataFrame, columns: Sequence[str], variables: Iterable[Variable] | None = None) -> DataFrame:
    """Decode several columns in one projection, without a join.

    Labels come from ``variables`` or, left out, from the columns' own metadata.
    """
    if variables is None:
        labels = {f.name: (f.metadata.get("labels", {}), f.metadata.get("codes")) for f in df.schema.fields}
    else:
        labels = {v.name: (v.values, None) for v in variables}
    return df.withColumns({c: decode(quoted(c), *labels.get(c, ({}, None))) for c in columns})


def label_table(variables: Iterable[Variable], spark: SparkSession) -> DataFrame:
    """The long form ``variable, code, label`` of some variables."""
    rows = [(v.name, int(code), label) for v in variables for label, code in v.values.items()]
    return spark.createDataFrame(rows, "variable string, code bigint, label string")


def decode_with_table(df: DataFrame, columns: Sequence[str], labels: DataFrame) -> DataFrame:
    """:func:`decode_labels` against a table ``variable, code, label`` of any length.

    The table is turned once into a row per code with a column per variable, so all columns look
    their codes up in the same table: one exchange serves them all. Of several labels of one code the smallest text
    counts. Small tables are broadcast after their size is known, others are shuffled.
    """
    chosen = list(dict.fromkeys(columns))
    by_code = broadcast_if_small(
        labels.filter(F.col("variable").isin(*chosen) & F.col("code").isNotNull())
        .groupBy(F.col("code").cast("bigint").alias("_code"))
        .agg(*[F.min(F.when(F.col("variable") == c, F.col("label"))).alias(f"_label{i}") for i, c in enumerate(chosen)])
    )
    # columns are addressed by place, so that no name of the frame can clash
    names = df.columns
    out = df.toDF(*[f"_c{i}" for i in range(len(names))])
    for i, name in enumerate(chosen):
        at = names.index(name)
        side = by_code.select(F.col("_code"), F.col(f"_label{i}").alias("_label"))
        kept = [F.coalesce("_label", F.col(c).cast("string")).alias(c) if j == at else F.col(c) for j, c in enumerate(out.columns)]
        out = out.join(side, _whole(F.col(f"_c{at}")) == F.col("_code"), "left").select(*kept)
    return out.toDF(*names)


def labelled_recode(df: DataFrame, into: str, value: Column, description: str, values: Mapping[str, int]) -> DataFrame:
    """Add a recoded column together with its own value labels."""
    return attach_codebook(df.withColumn(into, value), [Variable(into, description, values)])


def value_label_export(spark: SparkSession, labels: Mapping[str, int]) -> DataFrame:
    """Two-column form in which a code list is exported: text, ``x``."""
    return spark.createDataFrame(
        [(k, int(v)) for k, v in labels.items()], "label string, x bigint"
    )
