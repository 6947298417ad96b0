"""What several operators share: table access, written intermediate tables, prefix sums."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from surveyspan.staging import ensure_checkpoint_dir


def share_package(spark: SparkSession) -> None:
    """Let Python workers find this package where it lies; a cluster gets it with ``--py-files``."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    share_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, a missing one as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it back.

    Unlike ``checkpoint()`` the stored table is compressed and later steps read only
    the columns they use. The folder is removed when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def prefix_sums(df: DataFrame, order: Sequence[str], values: Sequence[str], name: str) -> DataFrame:
    """``df`` with ``before_<value>`` columns: sums of each value over all earlier rows.

    The rows are range-partitioned and sorted once; each task adds running sums to
    its own rows as they stream by, and the per-partition totals (one row per
    shuffle partition) supply what lies before the partition. The values are
    non-negative, non-null integers; ``order`` should tell most rows apart, since rows that
    agree in all of it share a partition. Rows equal in ``order`` come in any order.
    """
    sums = [T.StructField(f"before_{v}", T.LongType()) for v in values]
    schema = T.StructType([*df.schema.fields, *sums, T.StructField("_part", T.IntegerType())])
    names = [f.name for f in schema.fields]

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), dict.fromkeys(values, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = list(batch.columns)
            for v in values:
                own = batch.column(v).to_numpy(zero_copy_only=False).astype(np.int64)
                upto = done[v] + np.cumsum(own)
                columns.append(pa.array(upto - own))
                done[v] = int(upto[-1])
            columns.append(pa.array(np.full(batch.num_rows, part, np.int32)))
            yield pa.RecordBatch.from_arrays(columns, names)

    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(running, schema)
    placed = written(placed, name)
    totals = placed.groupBy("_part").agg(*[F.sum(v).alias(v) for v in values])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        F.col("_part").alias("_p"), *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_s_{v}") for v in values]
    )
    # one row per shuffle partition
    joined = placed.join(F.broadcast(starts), F.col("_part") == F.col("_p"))
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[(F.col(f"before_{v}") + F.col(f"_s_{v}")).alias(f"before_{v}") for v in values],
    )
