"""Token ids of whole documents in files of independently coded, checksummed blocks.

``write_ids`` sorts the documents by id (one range shuffle of the texts), and each task encodes its texts, adds the end id
and codes about ``FRAME`` ids at a time with :mod:`range_coder`. A file row is one frame: the coded blocks, the ids
and lengths of the documents in it, and its place in the order. Blocks hold 16-bit numbers: a frame with an id of 65,536 or more is
coded as two, the lower halves of its ids and the upper ones. The rows go through Spark's Parquet writer, so a lost or repeated task leaves
no broken file. ``read_ids`` decodes such files in whatever split they are read and needs nothing else.

Memory per task is a few frames; a document is never divided between frames, so a frame grows with the longest text.

Defined cases: a NULL or empty text is the end id alone; NULL ids come first; rows that repeat an id lie side by side, in the order of
their texts' hashes; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from surveyspan.llm.range_coder import BLOCK, pack_blocks, unpack_blocks
from surveyspan.llm.token_ids import default_tokenizer, encoded
from surveyspan.llm.tools import text_of
from surveyspan.staging import ensure_checkpoint_dir

END = 0
#: Ids of a frame, at least; many blocks in step make the coder fast.
FRAME = 2048 * BLOCK


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END) -> None:
    """Write the ids of every document to ``path``, in ascending order of ``doc_id``."""
    vocabulary = tokenizer or default_tokenizer()
    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField("ids_before", T.LongType()),
            T.StructField("n_ids", T.LongType()),
            T.StructField("doc_ids", T.ArrayType(docs.schema["doc_id"].dataType)),
            T.StructField("lengths", T.ArrayType(T.LongType())),
            T.StructField("frame", T.BinaryType()),
            T.StructField("upper", T.BinaryType()),
        ]
    )
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, keys, held, size = TaskContext.get().partitionId(), 0, [], [], 0

        def frame() -> pa.RecordBatch:
            whole, lengths = np.concatenate(held), [len(h) for h in held]
            held.clear()
            upper = pack_blocks(whole >> 16) if whole.itemsize > 2 and whole.max() >> 16 else None
            lower = pack_blocks(whole & 0xFFFF if whole.itemsize > 2 else whole)
            row = [part, before, size, keys, lengths, lower, upper]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(kind), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        kind = pa.int64()
        for batch in batches:
            kind = batch["doc_id"].type
            ids = encoded((t.as_py() for t in batch["text"]), vocabulary, roomy=2)
            for key, found in zip(batch["doc_id"].to_pylist(), ids, strict=True):
                keys.append(key)
                held.append(np.append(found, np.array([end], found.dtype)))
                size += len(held[-1])
                if size >= FRAME:
                    yield frame()
                    before, keys, held, size = before + size, [], [], 0
        if held:
            yield frame()

    rows = docs.select("doc_id", text_of().alias("text"), F.xxhash64(text_of()).alias("_tie"))
    ordered = rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    ordered.select("doc_id", "text").mapInArrow(run, schema).write.parquet(path, compression="none")


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document of the files: ``doc_id, start, n_tokens, ids_crc32`` and, on request, ``ids`` (little-endian, unsigned 32 bits)."""
    files = spark.read.parquet(path)
    kind = files.schema["doc_ids"].dataType.elementType
    fields = [
        T.StructField("part", T.IntegerType()), T.StructField("doc_id", kind), T.StructField("before", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ] + [T.StructField("ids", T.BinaryType())] * with_ids
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                (ids,) = unpack_blocks([row["frame"]])
                if row["upper"] is not None:
                    (upper,) = unpack_blocks([row["upper"]])
                    ids = ids.astype(np.uint32) | upper.astype(np.uint32) << np.uint32(16)
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                cuts = [ids[a:b].astype("<u4").tobytes() for a, b in zip(ends - lengths, ends, strict=True)]
                columns = [
                    pa.array([row["part"]] * len(lengths), pa.int32()),
                    batch["doc_ids"].slice(i, 1).flatten(),
                    pa.array(row["ids_before"] + ends - lengths),
                    pa.array(lengths),
                    pa.array([zlib.crc32(c) for c in cuts], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(cuts, pa.binary())] * with_ids, names)

    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition of the writer
    starts = totals.select(F.col("part").alias("_p"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_s"))
    found = files.mapInArrow(run, T.StructType(fields)).join(F.broadcast(starts), F.col("part") == F.col("_p"))
    return found.select(
        "doc_id", (F.col("before") + F.col("_s")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] * with_ids)
    )


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write to the shared folder, read back."""
    spark = docs.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    write_ids(docs, path, tokenizer)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return read_ids(spark, path)
