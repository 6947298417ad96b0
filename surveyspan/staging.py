"""Shared-folder staging: compute a table once, survive lost executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the folder named by ``spark.checkpoint.dir``.

    A local session without that setting gets a folder of its own. A cluster
    session without it is refused, because a folder on one machine would be
    lost together with that machine.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if named:
            context.setCheckpointDir(named)
        elif context.master.startswith("local"):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="surveyspan-"))
        else:
            raise RuntimeError(
                "set spark.checkpoint.dir to a folder that every executor can reach"
            )
    return context.getCheckpointDir()


def stage(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the checkpoint folder and return the stored rows.

    Used where several later steps read the same reduced table: without it each
    step would plan its own scan of the fact table below.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Stage a dimension, measure it, and mark it for broadcast only if it is small.

    Catalyst multiplies sizes when it estimates a join result, so a small dimension
    that was itself joined looks huge, and the fact table would be shuffled to
    meet it. The bound is ``spark.sql.autoBroadcastJoinThreshold`` unless given;
    beyond it the table comes back unmarked and the join shuffles as usual.
    """
    if max_bytes is None:
        text = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
        max_bytes = _bytes(text)
    staged = stage(df)
    row_bytes = F.octet_length(F.to_csv(F.struct(*[F.expr(f"`{c}`") for c in df.columns]))) + 16
    size = staged.select(F.sum(row_bytes)).first()[0] or 0
    return F.broadcast(staged) if size <= max_bytes else staged


def _bytes(text: str) -> int:
    """Bytes of a Spark size setting such as ``10485760b``, ``10MB`` or ``-1``."""
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    number = text.lower().rstrip("b")
    return int(number[:-1]) * units[number[-1]] if number[-1] in units else int(number)
