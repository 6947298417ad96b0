"""SimHash near-duplicates with pivot distance tables.

Pairs to be looked at lie in buckets: the 64 bits are cut into six blocks, and up to three differing bits leave at
least three blocks equal, so every close pair shares one of the 20 keys "these three blocks" (some 32 bits each).
Only buckets of several fingerprints go on. Inside a bucket

* every fingerprint gets a table of its Hamming distances to ``PIVOTS`` fixed reference fingerprints. By the triangle
  inequality two fingerprints within ``MOST`` bits differ by at most ``MOST`` in every entry;
* rows lie in the order of their first entry, and a pair is formed only inside a window of ``MOST`` of that entry;
* of the formed pairs those whose largest entry difference exceeds ``MOST`` are discarded, and the rest is verified
  bit by bit.

A bucket of more than ``CHUNK`` fingerprints is cut by the value of the first entry, and a value that is itself frequent is dealt into chunks
of about ``CHUNK``; chunks whose values lie within ``MOST`` of each other meet in tiles, which different tasks take. No bucket
is cut short and no close pair is lost.

Equal fingerprints are merged before all this, so copies in any number make no pairs. A task returns a spanning
forest of what it has found, at most one row per fingerprint and tile, never its pairs; a pair already joined by others is not verified again.
The forests go to distributed connected components.

Defined cases: a NULL text is the empty text, without words the fingerprint is zero and linked like any other; a
text of any length is read whole; repeated rows share a component; a NULL id joins its component but never names it
unless no other id is there; an empty table gives no rows; further columns are ignored or carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyspan.llm.components import Labels, components
from surveyspan.llm.tools import text_of, written

MOST = 3
SHINGLE = 3
SEED = 42
PIVOTS = 12
#: Fingerprints of one bucket or chunk that a task compares among themselves.
CHUNK = 4096
#: Rows of small buckets that are compared in one go.
BUFFER = 1 << 15
#: Shingles whose bits are counted in one go.
PIECE = 1 << 16
#: Side of rows that meet every other row of their tile.
_ALL = 2
_BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Majority of the shingle hashes' bits, as an unsigned number."""
    # bytes.lower folds A-Z only, bytes.split cuts at blank and tab to carriage return
    w = text.encode().lower().split()
    if not w:
        return 0
    n = max(1, len(w) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, PIECE):
        part = w[at : min(n, at + PIECE) + shingle - 1]
        joined = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False)) if len(w) >= shingle else [b" ".join(w)]
        h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in joined], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


@F.arrow_udf(T.LongType())
def _fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        values = np.array([fingerprint(item.as_py()) for item in batch], dtype=np.uint64)
        yield pa.array(values.view(np.int64))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def pivots(count: int = PIVOTS) -> list[int]:
    return [int(v) for v in np.random.default_rng(64).integers(0, 1 << 64, count, dtype=np.uint64)]


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _tiles(prints: DataFrame, most: int, chunk: int) -> DataFrame:
    """``tile, entry, side, fp``: rows that share a tile are compared, those of sides 0 and 1 across only."""
    if most > len(_BLOCKS) - 3:
        raise ValueError("six blocks in threes cover up to three differing bits")
    masks = [
        _signed(sum(((1 << width) - 1) << start for start, width in chosen)) for chosen in combinations(_BLOCKS, 3)
    ]
    keys = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)]
    keyed = prints.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = keyed.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("size")).filter("size > 1")
    entry = _distance(F.col("fp"), F.lit(_signed(pivots()[0]))).cast("tinyint").alias("entry")
    shared = written(keyed.join(sizes, F.col("key") == F.col("_key")).select("key", entry, "size", "fp"), "simhash-buckets")
    small = shared.filter(F.col("size") <= chunk).select(
        F.col("key").alias("tile"), "entry", F.lit(_ALL).cast("tinyint").alias("side"), "fp"
    )

    # at most 65 values of the entry in a bucket, with the number of chunks of each
    large = shared.filter(F.col("size") > chunk)
    values = large.groupBy("key", "entry").agg(F.ceil(F.count("*") / chunk).cast("int").alias("n"))
    chunks = values.groupBy(F.col("key").alias("_key")).agg(
        F.map_from_entries(F.collect_list(F.struct("entry", "n"))).alias("chunks")
    )
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")[F.col("entry")]).cast("int")
    placed = large.join(chunks, F.col("key") == F.col("_key")).withColumn("own", own)
    met = placed.select(
        "key", "entry", "own", "fp",
        F.explode(F.filter(F.map_entries("chunks"), lambda c: F.abs(c["key"] - F.col("entry")) <= most)).alias("c"),
    ).select("key", "entry", "own", "fp", F.col("c.key").alias("other"), F.explode(F.sequence(F.lit(0), F.col("c.value") - 1)).alias("k"))
    mine, theirs = F.struct("entry", "own"), F.struct(F.col("other").alias("entry"), F.col("k").alias("own"))
    side = F.when(mine == theirs, _ALL).when(mine < theirs, 0).otherwise(1).cast("tinyint")
    split = met.select(
        F.xxhash64("key", F.least(mine, theirs), F.greatest(mine, theirs)).alias("tile"), "entry", side.alias("side"), "fp"
    )
    return small.unionByName(split)


class _Found(NamedTuple):
    """Links of one buffer and how its pairs fared."""

    a: np.ndarray
    b: np.ndarray
    pairs: int
    formed: int
    discarded: int
    verified: int


def _compare(tile: np.ndarray, side: np.ndarray, fp: np.ndarray, most: int, forest: bool) -> _Found:
    """Close pairs of rows in the order of tile and first entry, all of them or a spanning forest."""
    table = np.stack([np.bitwise_count(fp ^ np.uint64(p)).astype(np.int8) for p in pivots()])
    different, index = np.unique(fp, return_inverse=True)
    labels, found = Labels(len(different)), []
    starts = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
    left, right, both = (np.add.reduceat((side == v).astype(np.int64), starts) for v in (0, 1, _ALL))
    pairs = int((both * (both - 1) // 2 + left * right + both * (left + right)).sum())
    formed = discarded = verified = 0
    at, step = np.arange(len(fp)), 0
    while True:
        step += 1
        at = at[at + step < len(fp)]
        at = at[(tile[at] == tile[at + step]) & (table[0, at + step] - table[0, at] <= most)]
        if not len(at):
            break
        i = at[(side[at] == _ALL) | (side[at] != side[at + step])]
        formed += len(i)
        if forest:
            i = i[labels.to[index[i]] != labels.to[index[i + step]]]
        looked = len(i)
        for entries in table[1:]:
            i = i[np.abs(entries[i] - entries[i + step]) <= most]
        discarded += looked - len(i)
        verified += len(i)
        i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= most]
        if forest:
            labels.link(index[i], index[i + step])
        else:
            found.append((fp[i], fp[i + step]))
    if forest:
        linked = np.flatnonzero(labels.to != np.arange(len(different)))
        found.append((different[labels.to[linked]], different[linked]))
    a, b = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (fp[:0], fp[:0])
    return _Found(a.view(np.int64), b.view(np.int64), pairs, formed, discarded, verified)


_COUNTS = ("pairs", "formed", "discarded", "verified")


def _compared(prints: DataFrame, most: int, chunk: int, forest: bool) -> DataFrame:
    """Links ``a, b``; rows without a link carry the counts of ``_Found``."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(tile: np.ndarray, side: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            got = _compare(tile, side, fp, most, forest)
            links = len(got.a)
            counts = [pa.array([None] * links + [c], pa.int64()) for c in got[2:]]
            ends = [pa.concat_arrays([pa.array(c), pa.nulls(1, pa.int64())]) for c in got[:2]]
            return pa.RecordBatch.from_arrays([*ends, *counts], ["a", "b", *_COUNTS])

        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for batch in batches:
            held.append(tuple(batch[c].to_numpy() for c in ("tile", "side", "fp")))
            rows += batch.num_rows
            if rows < BUFFER:
                continue
            tile, side, fp = (np.concatenate(c) for c in zip(*held, strict=True))
            # the last tile may go on in the next batch; a tile has some 2 * CHUNK rows at most
            cut = int(np.searchsorted(tile, tile[-1]))
            if cut:
                yield result(tile[:cut], side[:cut], fp[:cut].view(np.uint64))
            held, rows = [(tile[cut:], side[cut:], fp[cut:])], len(tile) - cut
        if rows:
            tile, side, fp = (np.concatenate(c) for c in zip(*held, strict=True))
            yield result(tile, side, fp.view(np.uint64))

    tiles = _tiles(prints, most, chunk)
    placed = tiles.repartition("tile").sortWithinPartitions("tile", "entry").select("tile", "side", "fp")
    return placed.mapInArrow(compare, ", ".join(f"{c} long" for c in ("a", "b", *_COUNTS)))


def close_pairs(prints: DataFrame, most: int = MOST, chunk: int = CHUNK) -> DataFrame:
    """``a, b``, in either order and possibly repeated, of distinct fingerprints ``fp`` within ``most`` <= 3 bits."""
    return _compared(prints, most, chunk, forest=False).filter("a is not null").select("a", "b")


def close_links(prints: DataFrame, most: int = MOST, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Links ``a, b`` with the components of ``close_pairs``, and one row that tells how the pairs fared.

    ``pairs`` share a tile, ``formed`` of them lie in the window of the first entry, ``discarded`` by the other
    entries and ``verified`` bit by bit; the rest of the formed were joined already.
    """
    found = written(_compared(prints, most, chunk, forest=True), "simhash-links")
    fared = found.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _COUNTS])
    return found.filter("a is not null").select("a", "b"), fared


def _grouped(printed: DataFrame, order: list[str], most: int) -> DataFrame:
    """``_fp, _first``: per fingerprint the smallest ``order`` struct of its component."""
    first = F.min(F.struct(*[F.struct(F.col(c).isNull(), F.col(c)) for c in order])).alias("first")
    prints = written(printed.groupBy("fp").agg(first), "simhash-prints")
    links, _ = close_links(prints.select("fp"), most)
    roots = components(links, "a", "b")
    rooted = prints.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    # only components of several fingerprints need the second look
    lowest = rooted.groupBy(F.col("root").alias("_root")).agg(F.min("first").alias("_first"))
    return written(
        rooted.join(lowest, F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "_first"), "simhash-groups"
    )


def near_duplicates(docs: DataFrame, most: int = MOST) -> DataFrame:
    """Per document: ``doc_id, fingerprint, component_id``."""
    printed = written(docs.select("doc_id", _fingerprints(text_of()).alias("fp")), "simhash-documents")
    groups = _grouped(printed, ["doc_id"], most)
    return printed.join(groups, F.col("fp") == F.col("_fp")).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("_first.col1.doc_id").alias("component_id"),
    )


def one_per_group(docs: DataFrame, most: int = MOST) -> DataFrame:
    """The rows that stay, whole: of each component the document with the smallest id.

    Among different texts under one id the smallest text hash decides; rows that repeat both
    id and text count as one document.
    """
    mark = F.xxhash64(text_of())
    printed = written(docs.select("doc_id", mark.alias("mark"), _fingerprints(text_of()).alias("fp")), "simhash-documents")
    groups = _grouped(printed, ["doc_id", "mark"], most)
    losers = printed.join(groups, F.col("fp") == F.col("_fp")).filter(
        ~(F.col("doc_id").eqNullSafe(F.col("_first.col1.doc_id")) & (F.col("mark") == F.col("_first.col2.mark")))
    )
    dropped = written(losers.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_m")).distinct(), "simhash-dropped")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", mark.alias("_mark"))
    kept = row.join(
        dropped, (F.col("_mark") == F.col("_m")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti"
    )
    return kept.select("_row.*")
