"""Centroid clustering in exact integers, with Ptolemaic pivots.

Vectors become integers floor(scale * x). In every round each vector goes to its nearest
centroid and each centroid to the floored mean of its vectors. Most distances are never computed:

* a few fixed pivots are taken from the starting centroids, each as far as possible from those before it;
* a vector's distances to the pivots are computed once and kept beside it, a centroid's once a round;
* for pivots p, s Ptolemy's inequality gives
  ``d(x, c) >= |d(x, p) d(c, s) - d(x, s) d(c, p)| / d(p, s)``; the largest bound over all pivot pairs counts;
* the centroid with the smallest bound is measured exactly, and every other whose bound does not exceed that
  distance as well. The bounds are lowered by more than the rounding of their floating-point
  terms, so none is discarded wrongly, not even in a tie. Exact distances are integer sums.

A task adds up its vectors per cluster; sums (clusters x components) are merged by Spark and only the new
centroids pass through the driver, so neither a hot cluster nor the number of rows matters there.

Defined cases: a vector that is NULL, of another length, or holds NULL or non-finite components is left out; rows that
repeat an id or a vector each take part; rows of one id rank by their components and those without an id last
when centroids are chosen; with fewer vectors than ``k`` there are fewer centroids, and an empty table gives no rows;
further columns are ignored. A component beyond +-``LARGEST`` after scaling raises, because distances would leave a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspan.llm.tools import written

LARGEST = 1 << 26
PIVOTS = 6
#: Vectors whose bounds are held at once, and vector-centroid pairs measured at once.
ROWS = 4096
PAIRS = 1 << 15
#: Allowance for rounding, relative: far above the few 2**-53 that the terms can gather.
_EPS = 2.0**-48


def _usable(column: Column, width: int) -> Column:
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(column) == width) & finite, F.lit(False))


def scaled_vectors(vectors: DataFrame, width: int, scale: int) -> DataFrame:
    """``vec_id, v`` with integer components, for the vectors that take part."""
    wide = F.transform(F.col("embedding"), lambda x: x.cast("double"))

    def component(x: Column) -> Column:
        y = F.floor(F.lit(float(scale)) * x)
        fits = F.abs(F.lit(float(scale)) * x) < F.lit(float(LARGEST))
        return F.when(fits, y.cast("int")).otherwise(F.raise_error(F.lit(f"a component exceeds {LARGEST} / {scale}")))

    rows = vectors.select("vec_id", wide.alias("e")).filter(_usable(F.col("e"), width))
    return rows.select("vec_id", F.transform("e", component).alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest hash of their id, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = rows.select(key.alias("key"), "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in chosen], np.int64)


def choose_pivots(points: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` distinct points, each the farthest from those before it."""
    chosen = [0]
    gap = ((points - points[0]) ** 2).sum(1)
    while len(chosen) < n and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between all rows of two small integer matrices."""
    return np.sqrt(np.stack([((a - row) ** 2).sum(1) for row in b], axis=1).astype(np.float64))


class Nearest:
    """Nearest of some centroids, for vectors whose pivot distances are known."""

    def __init__(self, centroids: np.ndarray, pivots: np.ndarray) -> None:
        self.centroids = centroids
        self.to_pivots = distances(centroids, pivots)
        between = distances(pivots, pivots)
        self.pairs = [(p, s, between[p, s]) for p, s in combinations(range(len(pivots)), 2)]

    def bounds(self, known: np.ndarray) -> np.ndarray:
        """Lower bounds of the squared distances, vectors x centroids."""
        best = np.zeros((len(known), len(self.centroids)))
        for p, s, gap in self.pairs:
            one = known[:, p, None] * self.to_pivots[:, s]
            two = known[:, s, None] * self.to_pivots[:, p]
            low = np.abs(one - two)
            one += two
            one *= _EPS
            low -= one
            low *= (1 - _EPS) / gap
            np.maximum(best, low, out=best)
        best *= best
        best *= 1 - _EPS
        return best

    def _measure(self, v: np.ndarray, i: np.ndarray, c: np.ndarray) -> np.ndarray:
        out = np.empty(len(i), np.int64)
        for at in range(0, len(i), PAIRS):
            gap = v[i[at : at + PAIRS]] - self.centroids[c[at : at + PAIRS]]
            out[at : at + PAIRS] = np.einsum("nd,nd->n", gap, gap)
        return out

    def assign(self, v: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the nearest centroid, squared distance, and distances computed for it."""
        low = self.bounds(known)
        every = np.arange(len(v))
        first = low.argmin(1)
        reach = self._measure(v, every, first)
        left = low <= (reach * (1 + _EPS))[:, None]
        left[every, first] = True
        i, c = np.nonzero(left)
        squared = self._measure(v, i, c)
        starts = np.flatnonzero(np.diff(i, prepend=-1))
        least = np.minimum.reduceat(squared, starts)
        hits = np.flatnonzero(squared == least[i])
        # pairs stand in the order of vector, then centroid: the first hit has the smallest number
        own = hits[np.flatnonzero(np.diff(i[hits], prepend=-1))]
        return c[own].astype(np.int32), least, np.diff(np.append(starts, len(i)))


def _matrix(column: pa.Array, dtype: type) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(dtype).reshape(len(column), -1)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _with_pivots(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            known = distances(_matrix(part["v"], np.int64), pivots)
            offsets = pa.array(np.arange(0, known.size + 1, len(pivots), dtype=np.int32))
            cached = pa.ListArray.from_arrays(offsets, pa.array(known.ravel()))
            yield pa.RecordBatch.from_arrays([part["vec_id"], part["v"], cached], ["vec_id", "v", "known"])

    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, v array<int>, known array<double>"
    return written(rows.mapInArrow(measured, schema), "cluster-vectors")


def _moved(cached: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    k, width = centroids.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Nearest(centroids, pivots)
        sums, counts = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for part in _slices(batches):
            v = _matrix(part["v"], np.int64)
            c, _, _ = nearest.assign(v, _matrix(part["known"], np.float64))
            order = np.argsort(c, kind="stable")
            starts = np.flatnonzero(np.diff(c[order], prepend=-1))
            sums[c[order][starts]] += np.add.reduceat(v[order], starts, axis=0)
            counts += np.bincount(c, minlength=k)
        hit = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(hit, width), pa.int32()),
                pa.array(np.tile(np.arange(width), len(hit)), pa.int32()),
                pa.array(sums[hit].ravel()),
                pa.array(np.repeat(counts[hit], width)),
            ],
            ["c", "j", "s", "n"],
        )

    parts = cached.select("v", "known").mapInArrow(summed, "c int, j int, s long, n long")
    exact = [F.sum(F.col(x).cast("decimal(38,0)")).alias(x) for x in ("s", "n")]
    new = centroids.copy()
    for r in parts.groupBy("c", "j").agg(*exact).collect():  # clusters x components
        new[r["c"], r["j"]] = int(r["s"]) // int(r["n"])
    return new


def _digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster_vectors(
    vectors: DataFrame,
    k: int = 40,
    rounds: int = 5,
    width: int = 64,
    scale: int = 256,
    seed: int = 2,
    n_pivots: int = PIVOTS,
) -> DataFrame:
    """Per vector of ``vec_id, embedding``: ``vec_id, cluster, distance, cluster_inertia, inertia,
    centroid_sha256`` and ``measured``, the number of centroids whose distance was computed."""
    rows = scaled_vectors(vectors, width, scale)
    centroids = first_centroids(rows, k, seed)
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    if not len(centroids):
        return vectors.sparkSession.createDataFrame(
            [],
            f"vec_id {id_type}, cluster int, distance long, cluster_inertia long, inertia long, "
            "centroid_sha256 string, measured int",
        )
    pivots = choose_pivots(centroids, n_pivots)
    cached = _with_pivots(rows, pivots)
    for _ in range(rounds):
        centroids = _moved(cached, centroids, pivots)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Nearest(centroids, pivots)
        for part in _slices(batches):
            c, squared, n = nearest.assign(_matrix(part["v"], np.int64), _matrix(part["known"], np.float64))
            yield pa.RecordBatch.from_arrays(
                [part["vec_id"], pa.array(c), pa.array(squared), pa.array(n.astype(np.int32))],
                ["vec_id", "cluster", "distance", "measured"],
            )

    schema = f"vec_id {id_type}, cluster int, distance long, measured int"
    final = written(cached.mapInArrow(assigned, schema), "clusters")
    # at most one row per centroid
    own = final.groupBy(F.col("cluster").alias("_c")).agg(F.sum("distance").alias("cluster_inertia"))
    digests = vectors.sparkSession.createDataFrame(
        [(i, _digest(c)) for i, c in enumerate(centroids)], "_d int, centroid_sha256 string"
    )
    whole = own.agg(F.sum("cluster_inertia")).scalar()
    labels = own.join(F.broadcast(digests), F.col("_c") == F.col("_d")).withColumn("inertia", whole)
    return final.join(F.broadcast(labels), F.col("cluster") == F.col("_c")).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "measured"
    )
