"""Hierarchical multi-length packing into power-of-two windows.

A document is its token ids and an end id. Its full windows of ``WINDOW`` ids stand alone; what is left is routed to
the smallest of ``TIERS`` that holds it.

1. Leftovers of the longest tier open a window each and stay whole as long as the shorter tiers have enough ids to
   fill the gaps behind them. The gaps, laid end to end, are filled from the shorter tiers, shortest
   documents first; a document is cut where a gap ends.
2. What remains of each tier is laid end to end and cut into windows of the tier's own length. What does not fill a window
   of its tier goes on to the next longer one, so only the very last sequence can hold padding.
3. Sequences of each tier are dealt in turn to step groups, so all groups get the same mix of lengths.

All positions come from one global prefix sum over narrow rows (five numbers per document); gaps meet their fillers by a
join on fixed-width position buckets. Only totals per tier reach the driver. Token ids are written once, next to a row id, and shuffled once, to be cut.

Defined cases: a NULL or empty text is the end id alone; a text of any length is cut into as many windows as it needs; repeated rows and
repeated or NULL ids are packed like any other row; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspan.llm.token_ids import default_tokenizer, encoded
from surveyspan.llm.tools import prefix_sums, text_of, written

WINDOW = 2048
TIERS = (256, 512, 1024, 2048)
END = 1
#: Tokens of a step group, at least.
STEP_TOKENS = 64 * WINDOW
#: Width of the position buckets in which gaps and fillers meet.
BUCKET = 4096


def tokenized(docs: DataFrame, tokenizer: str | None = None, end: int = END) -> DataFrame:
    """Written table ``rid, doc_id, n, ids``: a row id, the number of ids with the end id, and the ids as bytes."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, counts, size, first = batch["doc_id"], [], [], 0, 0
            for i, found in enumerate(encoded((t.as_py() for t in batch["text"]), path)):
                whole = np.append(found, np.array([end], found.dtype)).astype("<u4" if found.itemsize > 2 else "<u2")
                ids.append(whole.tobytes())
                counts.append(len(whole))
                size += whole.nbytes
                if size > 1 << 22 or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [keys.slice(first, len(ids)), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())],
                        ["doc_id", "n", "ids"],
                    )
                    ids, counts, size, first = [], [], 0, i + 1

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, n long, ids binary")
    return written(rows.withColumn("rid", F.monotonically_increasing_id()), "token-ids")


def _between(low: Column, high: Column, width: int) -> Column:
    """Numbers of the windows of this width that [low, high) touches."""
    return F.sequence(F.floor(low / F.lit(width)), F.floor((high - 1) / F.lit(width)))


def plan_pieces(tokens: DataFrame, step_tokens: int = STEP_TOKENS) -> tuple[DataFrame, DataFrame, int, int]:
    """Leftover pieces ``rid, start, length, sequence_id, offset, tier, place``; rows ``rid, before_full, full``; windows and steps."""
    size = F.col("n")
    left = F.pmod(size, F.lit(WINDOW))
    tier = F.lit(len(TIERS) - 1)
    for k in range(len(TIERS) - 2, -1, -1):
        tier = F.when(F.col("left") <= TIERS[k], k).otherwise(tier)
    longest = len(TIERS) - 1
    rows = (
        tokens.select("rid", "n", F.floor(size / F.lit(WINDOW)).alias("full"), left.alias("left"), F.xxhash64("rid").alias("mix"))
        .withColumn("tier", F.when(F.col("left") == 0, -1).otherwise(tier).cast("int"))
        .withColumn("long", (F.col("tier") == longest).cast("long"))
        .withColumn("gap", F.col("long") * (WINDOW - F.col("left")))
    )
    placed = prefix_sums(rows, ["tier", "mix", "rid"], ["full", "left", "long", "gap"], "pack-places")
    totals = {r["tier"]: r for r in placed.groupBy("tier").agg(F.sum("left").alias("left"), F.sum("full").alias("full"), F.sum("n").alias("n")).collect()}
    held = [totals[k]["left"] if k in totals else 0 for k in range(len(TIERS))]
    short = sum(held[:longest])
    full = sum(r["full"] for r in totals.values())
    kept = (F.col("tier") == longest) & (F.col("before_gap") + F.col("gap") <= F.lit(short))
    row = placed.filter(kept).agg(
        F.count("*").alias("windows"),
        F.coalesce(F.max(F.col("before_gap") + F.col("gap")), F.lit(0)).alias("gaps"),
        F.coalesce(F.sum("left"), F.lit(0)).alias("left"),
    ).first()
    whole, gaps = row["windows"], row["gaps"]

    # the stream of what remains: short tiers behind the filled gaps, then the longest tier
    remains, at = [], 0
    for k in range(longest):
        remains.append(max(0, at + held[k] - max(at, gaps)))
        at += held[k]
    remains.append(held[longest] - row["left"])
    regions, position, carried, number = [], 0, 0, full + whole
    for k, width in enumerate(TIERS):
        carried += remains[k]
        count = -(-carried // width) if k == longest else carried // width
        if count:
            regions.append((position, position + min(carried, count * width), width, number))
        number += count
        position += count * width
        carried -= min(carried, count * width)
    steps = max(1, -(-sum(r["n"] for r in totals.values()) // step_tokens))

    own = placed.filter(kept).select(
        "rid",
        (F.col("full") * WINDOW).alias("start"),
        F.col("left").alias("length"),
        (F.col("before_long") + full).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.lit(WINDOW).alias("tier"),
        (F.col("before_long") + full).alias("place"),
        "before_gap",
        "gap",
    )
    open_gaps = own.select(
        F.col("sequence_id").alias("g_sequence"), F.col("length").alias("g_used"), F.col("before_gap").alias("g_from"),
        (F.col("before_gap") + F.col("gap")).alias("g_to"),
    )
    open_gaps = open_gaps.withColumn("g_bucket", F.explode(_between(F.col("g_from"), F.col("g_to"), BUCKET)))
    shorter = placed.filter((F.col("tier") >= 0) & (F.col("tier") < longest)).withColumn("to", F.col("before_left") + F.col("left"))
    fillers = shorter.filter(F.col("before_left") < gaps).withColumn("to", F.least("to", F.lit(gaps)))
    fillers = fillers.withColumn("bucket", F.explode(_between(F.col("before_left"), F.col("to"), BUCKET)))
    low, high = F.greatest("before_left", "g_from"), F.least("to", "g_to")
    filled = (
        fillers.join(open_gaps, F.col("bucket") == F.col("g_bucket"))
        .filter((low < high) & (F.floor(low / F.lit(BUCKET)) == F.col("bucket")))
        .select(
            "rid",
            (F.col("full") * WINDOW + low - F.col("before_left")).alias("start"),
            (high - low).alias("length"),
            F.col("g_sequence").alias("sequence_id"),
            (F.col("g_used") + low - F.col("g_from")).alias("offset"),
            F.lit(WINDOW).alias("tier"),
            F.col("g_sequence").alias("place"),
        )
    )

    left_short = shorter.filter(F.col("to") > gaps).select(
        "rid", "full", F.greatest(F.lit(0), F.lit(gaps) - F.col("before_left")).alias("skip"), "left", "before_left"
    )
    left_short = left_short.withColumn("q", F.col("before_left") + F.col("skip") - gaps)
    left_long = placed.filter((F.col("tier") == longest) & ~kept).select(
        "rid", "full", F.lit(0).cast("long").alias("skip"), "left", "before_left",
        (F.col("before_left") - row["left"] - min(gaps, short)).alias("q"),
    )
    stream = left_short.unionByName(left_long).withColumn("q_to", F.col("q") + F.col("left") - F.col("skip"))
    known = F.array(
        *[
            F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"), F.lit(w).alias("w"), F.lit(s).cast("long").alias("s"))
            for a, b, w, s in regions or [(0, 0, WINDOW, 0)]
        ]
    )
    touched = stream.withColumn("r", F.explode(F.filter(known, lambda r: (r["a"] < F.col("q_to")) & (r["b"] > F.col("q")))))
    touched = touched.withColumn("lo", F.greatest("q", "r.a") - F.col("r.a")).withColumn("hi", F.least("q_to", "r.b") - F.col("r.a"))
    touched = touched.withColumn("w", F.explode(F.sequence(F.floor(F.col("lo") / F.col("r.w")), F.floor((F.col("hi") - 1) / F.col("r.w")))))
    low, high = F.greatest(F.col("lo"), F.col("w") * F.col("r.w")), F.least(F.col("hi"), (F.col("w") + 1) * F.col("r.w"))
    cut = touched.select(
        "rid",
        (F.col("full") * WINDOW + F.col("skip") + low + F.col("r.a") - F.col("q")).alias("start"),
        (high - low).alias("length"),
        (F.col("r.s") + F.col("w")).alias("sequence_id"),
        (low - F.col("w") * F.col("r.w")).alias("offset"),
        F.col("r.w").alias("tier"),
        # long windows go on counting where the whole ones end
        F.when(F.col("r.w") == WINDOW, F.col("w") + full + whole).otherwise(F.col("w")).alias("place"),
    )
    pieces = own.drop("before_gap", "gap").unionByName(filled).unionByName(cut)
    return pieces, placed.select("rid", "full", "before_full"), full + whole, steps


def pack(docs: DataFrame, tokenizer: str | None = None, with_ids: bool = False, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """Per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step`` and, on request, ``ids``."""
    tokens = tokenized(docs, tokenizer)
    pieces, places, _, steps = plan_pieces(tokens, step_tokens)
    fields = ["start", "length", "sequence_id", "offset", "tier", "place"]
    listed = pieces.groupBy(F.col("rid").alias("_p")).agg(F.collect_list(F.struct(*fields)).alias("pieces"))
    joined = (
        tokens.join(places.withColumnRenamed("rid", "_f"), F.col("rid") == F.col("_f"))
        .join(listed, F.col("rid") == F.col("_p"), "left")
        .select("doc_id", "n", "ids", "full", "before_full", "pieces")
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step"]
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                take, columns, cuts = [], [[] for _ in names[1:]], []
                rows = zip(*(part[c].to_pylist() for c in ("n", "full", "before_full", "pieces")), part["ids"], strict=True)
                for i, (n, full, before, own, raw) in enumerate(rows):
                    raw = raw.as_py()
                    ids = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4")
                    found = [(k * WINDOW, WINDOW, before + k, 0, WINDOW, before + k) for k in range(full)]
                    found += [tuple(p[f] for f in fields) for p in own or []]
                    for start, length, sequence, offset, tier, place in found:
                        cut = ids[start : start + length].tobytes()
                        take.append(i)
                        for c, v in zip(columns, (start, length, zlib.crc32(cut), n, sequence, offset, tier, place % steps), strict=True):
                            c.append(v)
                        if with_ids:
                            cuts.append(cut)
                arrays = [part["doc_id"].take(pa.array(take, pa.int32()))]
                arrays += [pa.array(c, pa.int32() if f == "tier" else pa.int64()) for c, f in zip(columns, names[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(cuts, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    return joined.mapInArrow(run, schema + ", ids binary" * with_ids)


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences themselves from ``pack(..., with_ids=True)``: ``sequence_id, tier, step, n, ids``.

    ``ids`` holds little-endian unsigned 32-bit ids in order; a sequence has at most ``WINDOW`` of them.
    """
    ordered = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return (
        pieces.groupBy("sequence_id", "tier", "step")
        .agg(ordered.alias("p"))
        .select(
            "sequence_id", "tier", "step",
            F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("n"),
            F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
        )
    )
