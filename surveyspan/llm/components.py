"""Connected components of a link table by alternating large and small stars.

Each round is two aggregations and two joins on the links; no link, label or component
passes through the driver, only the count and checksum that tell whether a round
changed anything. Every round is written to the shared folder, so lost executors cost one round at most.
(Kiveris et al., Connected Components in MapReduce and Beyond, SoCC 2014.)
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspan.llm.tools import written


class Labels:
    """Inside a task: smallest reachable position for positions 0..n-1, under links that come in pieces."""

    def __init__(self, n: int) -> None:
        self.to = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.to[i], self.to[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            low = np.minimum(a, b)
            np.minimum.at(self.to, a, low)
            np.minimum.at(self.to, b, low)
            while not np.array_equal(up := self.to[self.to], self.to):
                self.to = up


def _minima(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("m"))


def _round(links: DataFrame) -> DataFrame:
    """``links`` holds (u, v) with u > v and no repeats."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both.join(_minima(both), F.col("u") == F.col("_u")).withColumn("m", F.least("u", "m"))
    large = near.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    down = large.join(_minima(large), F.col("u") == F.col("_u"))
    small = down.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
    return small.select("e.u", "e.v").filter(F.col("u") > F.col("v")).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` for every node of a link other than the smallest of its component.

    ``root`` is that smallest node. Links may repeat, point either way or join a node to itself.
    """
    links = written(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col("u") > F.col("v")).distinct(),
        "links",
    )
    seen = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
        links = written(_round(links), "links")
