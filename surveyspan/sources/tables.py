"""Tabular inputs. File codecs of statistics packages and spreadsheets are not read
here: export them to Parquet or CSV first, and the codebook beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyspan.functions import nan_to_null
from surveyspan.operators.joins import attach, quoted
from surveyspan.sources.codebook import attach_codebook, read_codebook

TOILET_CLASS_SCHEMA = "toilet_type string, code int, improved string"
WATER_CLASS_SCHEMA = "water_type string, code int, improved int"
MONTHLY_CASES_SCHEMA = "Departement string, Month date, Cases double, Deaths double"
MONTHLY_TOTAL_SCHEMA = "Month date, `Monthly cases` double, `Cumulative cases` double"

# 13 secondary cities and their populations.
SECONDARY_CITIES = [
    ("Port-au-Prince", 897859),
    ("Carrefour", 465019),
    ("Gonaïves", 324043),
    ("Cap-Haïtien", 249541),
    ("Saint-Marc", 242485),
    ("Croix-des-Bouquets", 227012),
    ("Port-de-Paix", 185494),
    ("Jacmel", 170289),
    ("Les Cayes", 137952),
    ("Hinche", 109916),
    ("Mirebalais", 88899),
    ("Cabaret", 62063),
    ("Jérémie", 122149),
]


def read_microdata(
    spark: SparkSession,
    path: str,
    codebook: str | None = None,
    fmt: str = "parquet",
    schema: str | T.StructType | None = None,
    **options,
) -> DataFrame:
    """Coded survey rows, NaN read as NULL, labels attached from a codebook file.

    Give a ``schema`` for text formats: inferring one reads the whole input first.
    """
    reader = spark.read.format(fmt).options(**options)
    df = nan_to_null((reader if schema is None else reader.schema(schema)).load(path))
    if codebook is None:
        return df
    return attach_codebook(df, read_codebook(spark.read.parquet(codebook), df.columns))


def read_delimited(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """CSV with a header line and an explicit schema (headers may be blank, lines may
    end in a bare carriage return)."""
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=True)


def read_sheet_export(
    spark: SparkSession, path: str, schema: str | T.StructType, lead_rows: bool = False
) -> DataFrame:
    """A spreadsheet exported to CSV, typed by ``schema``.

    With ``lead_rows`` each file starts with title lines above the header: everything up to and
    including the first line that repeats the column names is dropped, and nothing after it, however empty a row is.
    The header is looked for in the first block of each file; large files are still split and read in parallel. A file
    without a header line keeps all its lines. Cells that do not fit the type become NULL.
    """
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not lead_rows:
        return spark.read.csv(path, schema=wanted, header=True, enforceSchema=True)
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in wanted.fields])
    raw = spark.read.csv(path, schema=text, header=False, mode="PERMISSIVE")
    placed = raw.select(
        *[quoted(c) for c in raw.columns],
        F.col("_metadata.file_path").alias("_file"),
        (F.col("_metadata.file_block_start") == 0).alias("_head"),
        F.monotonically_increasing_id().alias("_line"),
    )
    header = F.lit(True)
    for name in wanted.fieldNames():
        header = header & quoted(name).eqNullSafe(F.lit(name))
    # one row per file
    headers = placed.filter(F.col("_head") & header).groupBy(F.col("_file").alias("_f")).agg(F.min("_line").alias("_last"))
    found = placed.join(headers, F.col("_file") == F.col("_f"), "left")
    above = F.col("_head") & (F.col("_line") <= F.coalesce("_last", F.lit(-1)))
    return found.filter(~above).select(
        *[quoted(f.name).try_cast(f.dataType).alias(f.name) for f in wanted.fields]
    )


def read_code_classes(table: DataFrame, code: str = "code", cls: str = "improved", limit: int | None = None) -> dict:
    """``{class: (codes)}`` from a classification table, for use as literals.

    All its rows reach the driver; with a ``limit``, more of them raise. A long table is joined
    instead (:func:`classify`), with the same result.
    """
    classes: dict = {}
    listed = table.select(quoted(cls), quoted(code))
    rows = (listed if limit is None else listed.limit(limit + 1)).collect()
    if limit is not None and len(rows) > limit:
        raise ValueError(f"the classification has more than {limit} rows; join it instead")
    for row in rows:
        classes.setdefault(row[0], []).append(row[1])
    return {k: tuple(sorted(v)) for k, v in classes.items()}


def classify(
    df: DataFrame, column: str, table: DataFrame, into: str, code: str = "code", cls: str = "improved"
) -> DataFrame:
    """Add the class of each code from a classification table of any length; unlisted codes get NULL.

    A code listed twice with one class counts once; a code with two classes raises.
    """
    listed = table.select(quoted(code).alias("code"), quoted(cls).alias("class")).distinct()
    return attach(df, listed, {column: "code"}, {"class": into})


def secondary_cities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SECONDARY_CITIES, "city string, population bigint")
