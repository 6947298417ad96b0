"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine >= t lie within squared distance 2 - 2t. The vectors are rotated
(principal axes of a bounded sample, dealt in turn to the blocks) and cut into ``BLOCKS`` blocks;
in at least one block a close pair stays within that block's share of the squared distance. Each block is a range join:

* the block's leading coordinate is cut into cells as wide as the block's radius, so close vectors lie in the
  same or in neighbouring cells (at most 2/radius + 2 cells, whatever the data);
* a cell with many vectors is dealt by hash into chunks of about ``CHUNK`` vectors, and each pair of chunks of the same or
  neighbouring cells is one task group of bounded size;
* inside, matrix products find the pairs within the block's share; those are verified by their
  cosine in double precision over the whole vectors. A pair that several blocks find counts in the first one.

A group returns sums and a spanning forest, one row per linked vector, never its pairs. Equal vectors are merged beforehand and
counted with their multiplicity. Vectors of each length are rotated, cut and joined among themselves, all lengths in the same
steps. The result is exact: no pair is lost.

Vectors without structure (independent directions in d dimensions) are the hard case of every exact
method: a block's radius is then close to the spread of its coordinates, neighbouring cells hold most rows, and the
work is that of a blocked matrix product over most pairs. Clustered vectors are cut apart by the leading axes.

Defined cases: a vector that is NULL, zero, or holds NULL or non-finite components is linked
with nothing and is its own component; vectors of different lengths are not linked; rows that repeat a vector are linked with one another; a NULL id never
names a component with other ids; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspan.llm.components import Labels, components
from surveyspan.llm.tools import written

BLOCKS = 4
CHUNK = 8192
SAMPLE = 4096
#: Pairs that are verified in one go.
PIECE = 1 << 15
#: Rounding allowance on squared distances.
_SLACK = 1e-9


def _rotation(sample: np.ndarray) -> np.ndarray:
    """Columns: principal axes, block after block, each block led by its strongest axis."""
    _, axes = np.linalg.eigh(sample.T @ sample)
    axes = axes[:, ::-1]
    return np.concatenate([axes[:, b::BLOCKS] for b in range(BLOCKS)], axis=1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    wide = wide / np.abs(wide).max(1, keepdims=True)  # squares of tiny or huge components stay finite
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class PigeonholeJoin:
    """The fixed numbers of one join: rotation, block bounds and radii."""

    def __init__(self, rotation: np.ndarray, threshold: float) -> None:
        self.rotation, self.threshold = rotation, threshold
        d = len(rotation)
        self.width = d
        sizes = [len(range(b, d, BLOCKS)) for b in range(BLOCKS)]
        ends = np.cumsum(sizes)
        self.bounds = [(int(e - s), int(e)) for s, e in zip(sizes, ends, strict=True)]
        self.shares = [(2 - 2 * threshold) * s / d * (1 + _SLACK) + _SLACK for s in sizes]
        self.used = [b for b in range(BLOCKS) if sizes[b]]

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """Cell of every vector in every block."""
        turned = unit @ self.rotation
        lead = [np.floor(turned[:, self.bounds[b][0]] / np.sqrt(self.shares[b])).astype(np.int32) for b in self.used]
        return np.stack(lead, axis=1)

    def tile(self, block: int, left: np.ndarray, right: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pieces (i, j) of verified pairs; without ``right`` the pairs i < j inside ``left``."""
        a = _unit(left)
        b = a if right is None else _unit(right)
        ra = a @ self.rotation
        rb = ra if right is None else b @ self.rotation
        lo, hi = self.bounds[block]
        share = self.shares[block]
        # |x - y|^2 = |x|^2 + |y|^2 - 2xy: with two more columns one product gives -|x - y|^2 / 2
        x, y = ra[:, lo:hi], rb[:, lo:hi]
        one = np.ones((1, 1), np.float32)
        xs = np.concatenate([x, -(x**2).sum(1, keepdims=True) / 2, np.broadcast_to(one, (len(x), 1))], 1).astype(np.float32)
        ys = np.concatenate([y, np.broadcast_to(one, (len(y), 1)), -(y**2).sum(1, keepdims=True) / 2], 1).astype(np.float32)
        ys = np.ascontiguousarray(ys.T)
        rows = 256
        for at in range(0, len(xs), rows):
            near = np.flatnonzero((xs[at : at + rows] @ ys).ravel() >= np.float32(-share / 2 - 1e-5))
            i, j = near // ys.shape[1] + at, near % ys.shape[1]
            if right is None:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), PIECE):
                p, q = i[k : k + PIECE], j[k : k + PIECE]
                good = np.einsum("nd,nd->n", a[p], b[q]) >= self.threshold
                p, q = p[good], q[good]
                gap = (ra[p] - rb[q]) ** 2
                within = np.stack([gap[:, s:e].sum(1) <= self.shares[c] for c, (s, e) in enumerate(self.bounds)], 1)
                first = within.argmax(1) == block
                first &= within[:, block]
                if first.any():
                    yield p[first], q[first]


def _tiles(cell: int, chunk: int, chunks: dict[int, int]) -> list[tuple[int, int, int, int]]:
    """Groups (cell, chunk, cell, chunk) in which a vector of this cell and chunk takes part."""
    own = [(cell, min(chunk, k), cell, max(chunk, k)) for k in range(chunks[cell])]
    up = [(cell, chunk, cell + 1, k) for k in range(chunks.get(cell + 1, 0))]
    down = [(cell - 1, k, cell, chunk) for k in range(chunks.get(cell - 1, 0))]
    return own + up + down


def _joins(reps: DataFrame, threshold: float) -> dict[int, PigeonholeJoin]:
    """The join of each length that several vectors have."""
    totals = {r["width"]: r["count"] for r in reps.groupBy("width").count().filter("count > 1").collect()}
    if not totals:
        return {}
    draw = F.shiftrightunsigned(F.xxhash64("rid", F.lit("rotation")), 2)
    # the sample is shared out to the lengths; it decides on the speed only
    each = max(1, SAMPLE // len(totals))
    below = [(w, max(1, min(1 << 62, (each << 62) // n))) for w, n in totals.items()]
    shares = reps.sparkSession.createDataFrame(below, "_width int, _below long")
    sampled = reps.join(F.broadcast(shares), F.col("width") == F.col("_width")).filter(draw < F.col("_below"))
    sample = sampled.select("width", "embedding").toArrow()
    widths = sample["width"].to_numpy()
    joins = {}
    for w in totals:
        own = np.flatnonzero(widths == w)
        vectors = _matrix(sample["embedding"].take(pa.array(own)), w) if len(own) else np.eye(w)
        joins[w] = PigeonholeJoin(_rotation(_unit(vectors)), threshold)
    return joins


def _links(reps: DataFrame, threshold: float, chunk: int) -> DataFrame:
    """``rid, root, links`` rows: partial sums of links and a spanning forest."""
    joins = _joins(reps, threshold)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch["width"].to_numpy()
            for w in np.unique(widths).tolist():
                if w not in joins:  # the only vector of its length
                    continue
                part = batch.take(pa.array(np.flatnonzero(widths == w)))
                cells = joins[w].cells(_unit(_matrix(part["embedding"], w)))
                flat = pa.array(cells.ravel())
                offsets = pa.array(np.arange(0, cells.size + 1, cells.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part["rid"], part["copies"], part["width"], part["embedding"], pa.ListArray.from_arrays(offsets, flat)],
                    ["rid", "copies", "width", "embedding", "cells"],
                )

    schema = "rid long, copies long, width int, embedding array<double>, cells array<int>"
    cells = written(reps.select("rid", "copies", "width", "embedding").mapInArrow(placed, schema), "vector-cells")
    counted = cells.select("width", F.posexplode("cells").alias("b", "cell")).groupBy("width", "b", "cell").count().collect()
    chunks: dict[int, list[dict[int, int]]] = {w: [{} for _ in j.used] for w, j in joins.items()}
    for r in counted:  # at most 2/radius + 2 rows per block of a length
        chunks[r["width"]][r["b"]][r["cell"]] = -(-r["count"] // chunk)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["width", "b", "c1", "k1", "c2", "k2", "rid", "copies", "right", "embedding"]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                take, keys, rights = [], [], []
                columns = (part[c].to_pylist() for c in ("rid", "width", "cells"))
                for i, (rid, w, own) in enumerate(zip(*columns, strict=True)):
                    mixed = (rid * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 32
                    for b, cell in enumerate(own):
                        k = mixed % chunks[w][b][cell]
                        for t in _tiles(cell, k, chunks[w][b]):
                            take.append(i)
                            keys.append((w, b, *t))
                            rights.append((cell, k) != t[:2])
                columns = [pa.array(c, pa.int32()) for c in zip(*keys, strict=True)]
                rows = pa.array(take, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*columns, part["rid"].take(rows), part["copies"].take(rows), pa.array(rights), part["embedding"].take(rows)],
                    names,
                )

    def met(table: pa.Table) -> pa.Table:
        width, b, c1, k1, c2, k2 = (table[c][0].as_py() for c in ("width", "b", "c1", "k1", "c2", "k2"))
        join = joins[width]
        table = table.sort_by("right")
        right = table["right"].to_numpy()
        vectors = _matrix(table["embedding"], width)
        copies, rid = table["copies"].to_numpy(), table["rid"].to_numpy()
        cut = len(rid) if (c1, k1) == (c2, k2) else int((~right).sum())
        sums, labels = np.zeros(len(rid), np.int64), Labels(len(rid))
        other = None if cut == len(rid) and (c1, k1) == (c2, k2) else vectors[cut:]
        shift = 0 if other is None else cut
        if other is None or (cut and len(other)):
            for i, j in join.tile(join.used[b], vectors[:cut], other):
                j = j + shift
                sums += np.bincount(i, weights=copies[j], minlength=len(rid)).astype(np.int64)
                sums += np.bincount(j, weights=copies[i], minlength=len(rid)).astype(np.int64)
                labels.link(i, j)
        hit = np.flatnonzero(sums)
        return pa.table({"rid": rid[hit], "root": rid[labels.to[hit]], "links": sums[hit]})

    tiles = cells.mapInArrow(
        dealt,
        "width int, b int, c1 int, k1 int, c2 int, k2 int, rid long, copies long, right boolean, embedding array<double>",
    )
    return written(
        tiles.groupBy("width", "b", "c1", "k1", "c2", "k2").applyInArrow(met, "rid long, root long, links long"), "vector-links"
    )


def link_vectors(vectors: DataFrame, threshold: float = 0.9, chunk: int = CHUNK) -> DataFrame:
    """Per row of ``vec_id, embedding``: ``vec_id, n_links, component_id, kept``."""
    wide = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(finite & F.exists(wide, lambda x: x != 0.0), F.lit(False))
    rows = vectors.select("vec_id", F.when(usable, wide).alias("embedding"))
    grouped = rows.filter(F.col("embedding").isNotNull()).groupBy("embedding").agg(
        F.min("vec_id").alias("first"), F.count("*").alias("copies")
    )
    numbered = grouped.withColumn("rid", F.monotonically_increasing_id()).withColumn("width", F.size("embedding"))
    reps = written(numbered, "vectors")
    links = _links(reps, threshold, chunk)
    sums = links.groupBy(F.col("rid").alias("_r")).agg(F.sum("links").alias("links"))
    roots = components(links.select("rid", "root"), "rid", "root")
    rooted = reps.join(roots, F.col("rid") == F.col("node"), "left").select(
        "rid", "first", "copies", "embedding", F.coalesce("root", "rid").alias("root")
    )
    lowest = rooted.groupBy(F.col("root").alias("_root")).agg(F.min("first").alias("lowest"))
    known = (
        rooted.join(lowest, F.col("root") == F.col("_root"))
        .join(sums, F.col("rid") == F.col("_r"), "left")
        .select(
            F.col("embedding").alias("_e"),
            "lowest",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"),
        )
    )
    result = rows.join(written(known, "vector-groups"), F.col("embedding") == F.col("_e"), "left")
    component = F.when(F.col("_e").isNull(), F.col("vec_id")).otherwise(F.col("lowest"))
    return result.select(
        "vec_id",
        F.coalesce("n", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
