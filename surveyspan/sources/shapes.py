"""Polygon layers kept as record files (.shp, .shx, .dbf) as a Spark data source, split by the offset index.

The index file holds the offset of every shape record, so a task reads its range of records without touching the rest:
its part of the index, the bytes of its shapes and the attribute records of the same numbers. Ranges are cut at about equal
bytes, found by a binary search in the index. The layers of a folder form one table.

Columns: ``id`` (record number, from 0, over all files), the attributes, and ``rings array<array<struct<x,y>>>`` as
``polygons`` uses it. Polygons and lines give a ring per part, points a ring of one vertex, empty shapes NULL; heights and
measures are not read. Attribute texts lose their trailing blanks; a blank value is NULL. Records marked as deleted are left out.
An attribute called ``id`` or ``rings`` becomes ``id_attribute`` or ``rings_attribute``.

Options: ``path``; ``encoding`` (of attributes, where no .cpg file names it); ``recordBytes`` (size of a split).
Writing takes an optional ``id`` and other columns as attributes and a column ``rings``; ``projection`` is text for the .prj files.
"""

from __future__ import annotations

import datetime
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from surveyspan.functions.projection import TransverseMercator, convert_rings
from surveyspan.operators.joins import quoted
from surveyspan.sources.files import Input, Parts, listed, located, share_package

FORMAT = "polygon_layer"
SPLIT_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
FILE_BYTES = 64 << 20
# Fixed values of the file format.
FILE_CODE, HEADER, INDEX_ENTRY = 9994, 100, 8
POINTS, PARTED = (1, 11, 21), (3, 5, 13, 15, 23, 25)
MULTIPOINTS = (8, 18, 28)
POLYGON = 5
RINGS = T.ArrayType(
    T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
)
_RINGS_ARROW = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))


@dataclass(frozen=True)
class Attribute:
    name: str
    kind: str
    offset: int
    width: int
    decimals: int

    def spark_type(self) -> T.DataType:
        if self.kind in "NF":
            return T.LongType() if self.kind == "N" and not self.decimals and self.width <= 18 else T.DoubleType()
        return {"L": T.BooleanType(), "D": T.DateType()}.get(self.kind, T.StringType())


@dataclass(frozen=True)
class Layer:
    """One layer: its three files, the number of records, and the first record's number in the whole table."""

    shapes: str
    index: str
    table: str
    records: int
    first: int
    attributes: tuple[Attribute, ...]
    start: int
    width: int
    encoding: str


def _beside(path: str, suffix: str) -> str | None:
    """The file of the same layer with another suffix, in either case."""
    store, inner = located(path)
    prefix = path[: -len(inner)] if path.endswith(inner) else ""
    for s in (suffix, suffix.upper()):
        if store.get_file_info(inner[:-4] + s).is_file:
            return prefix + inner[:-4] + s
    return None


def read_text(path: str) -> str:
    with Input(path) as file:
        return file.at(0, file.size).decode("utf-8", "replace")


def read_layer_shape(path: str, encoding: str, first: int) -> Layer:
    """What describes the records of one layer."""
    index, table, page = (_beside(path, s) for s in (".shx", ".dbf", ".cpg"))
    if not index or not table:
        raise FileNotFoundError(f"{path} lacks its .shx or .dbf file")
    with Input(path) as file:
        if struct.unpack(">i", file.at(0, 4))[0] != FILE_CODE:
            raise ValueError(f"{path} is not a shape file")
    with Input(index) as file:
        records = (file.size - HEADER) // INDEX_ENTRY
    with Input(table) as file:
        count, start, width = struct.unpack("<IHH", file.at(4, 8))
        fields = file.at(32, start - 32)
    if count != records:
        raise ValueError(f"{table} holds {count} records and {index} {records}")
    attributes, offset = [], 1
    for at in range(0, len(fields) - 31, 32):
        if fields[at] == 0x0D:
            break
        name = fields[at : at + 11].split(b"\0", 1)[0].decode("latin-1")
        kind, size, decimals = chr(fields[at + 11]), fields[at + 16], fields[at + 17]
        attributes.append(Attribute(name, kind, offset, size, decimals))
        offset += size
    named = read_text(page).strip() if page else ""
    return Layer(path, index, table, records, first, tuple(attributes), start, width, named or encoding)


def layer_schema(layer: Layer) -> T.StructType:
    fields = [T.StructField("id", T.LongType())]
    fields += [T.StructField(_column(a.name), a.spark_type()) for a in layer.attributes]
    return T.StructType([*fields, T.StructField("rings", RINGS)])


def _column(name: str) -> str:
    return f"{name}_attribute" if name in ("id", "rings") else name


@dataclass
class _Range(InputPartition):
    layer: Layer
    first: int
    last: int

    def __post_init__(self) -> None:
        super().__init__(None)


def _entries(index: Input, first: int, last: int) -> np.ndarray:
    """Offset and length in bytes of the records first..last-1; the file counts 16-bit words."""
    raw = index.at(HEADER + first * INDEX_ENTRY, (last - first) * INDEX_ENTRY)
    return np.frombuffer(raw, ">i4").reshape(-1, 2).astype(np.int64) * 2


def cut_layer(layer: Layer, split: int) -> list[tuple[int, int]]:
    """Ranges of records of about ``split`` bytes of shapes, at least one record each."""
    if not layer.records:
        return []
    with Input(layer.index) as index:
        end = int(_entries(index, layer.records - 1, layer.records).sum())
        cuts = [0]
        for target in range(HEADER + split, end, split):
            low, high = cuts[-1] + 1, layer.records
            while low < high:
                middle = (low + high) // 2
                if _entries(index, middle, middle + 1)[0, 0] < target:
                    low = middle + 1
                else:
                    high = middle
            if low < layer.records and low > cuts[-1]:
                cuts.append(low)
    return list(zip(cuts, [*cuts[1:], layer.records], strict=True))


def _vertices(content: bytes) -> tuple[list[int], np.ndarray] | None:
    """Ring sizes and points of one record's content; None for an empty shape."""
    kind = struct.unpack_from("<i", content)[0]
    if kind == 0:
        return None
    if kind in POINTS:
        return [1], np.frombuffer(content, "<f8", 2, 4).reshape(1, 2)
    if kind in MULTIPOINTS:
        n = struct.unpack_from("<i", content, 36)[0]
        return [n], np.frombuffer(content, "<f8", 2 * n, 40).reshape(n, 2)
    if kind not in PARTED:
        raise ValueError(f"shape type {kind} is not known")
    parts, n = struct.unpack_from("<2i", content, 36)
    starts = np.frombuffer(content, "<i4", parts, 44)
    points = np.frombuffer(content, "<f8", 2 * n, 44 + 4 * parts).reshape(n, 2)
    return np.diff([*starts.tolist(), n]).tolist(), points


def _rings(contents: list[bytes]) -> pa.Array:
    sizes, counts, points, empty = [], [], [], []
    for content in contents:
        found = _vertices(content)
        empty.append(found is None)
        counts.append(0 if found is None else len(found[0]))
        if found is not None:
            sizes += found[0]
            points.append(found[1])
    flat = np.concatenate(points) if points else np.zeros((0, 2))
    xy = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in (0, 1)], ["x", "y"])
    rings = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), xy)
    ends = np.cumsum([0, *counts]).tolist()
    places = [None if e else a for e, a in zip(empty, ends[:-1], strict=True)]
    return pa.ListArray.from_arrays(pa.array([*places, ends[-1]], pa.int32()), rings)


def _number(raw: bytes) -> float | None:
    try:
        return float(raw)
    except ValueError:  # blanks, or the asterisks of an overflow
        return None


def _values(raw: list[bytes], attribute: Attribute, encoding: str) -> pa.Array:
    cells = [r[attribute.offset : attribute.offset + attribute.width] for r in raw]
    kind = attribute.spark_type()
    if isinstance(kind, T.LongType):
        stripped = [c.strip(b" \0") for c in cells]
        return pa.array([int(c) if c.lstrip(b"+-").isdigit() else None for c in stripped], pa.int64())
    if isinstance(kind, T.DoubleType):
        return pa.array([_number(c.strip(b" \0")) for c in cells], pa.float64())
    if isinstance(kind, T.BooleanType):
        known = {b"T": True, b"t": True, b"Y": True, b"y": True, b"F": False, b"f": False, b"N": False, b"n": False}
        return pa.array([known.get(c[:1]) for c in cells], pa.bool_())
    if isinstance(kind, T.DateType):
        days = [datetime.datetime.strptime(c.decode(), "%Y%m%d").date() if c.isdigit() else None for c in cells]
        return pa.array(days, pa.date32())
    texts = (c.split(b"\0", 1)[0].rstrip(b" ") for c in cells)
    return pa.array([t.decode(encoding, "replace") if t else None for t in texts], pa.string())


class _Reader(DataSourceReader):
    def __init__(self, layers: list[Layer], split: int) -> None:
        self.layers, self.split = layers, split

    def partitions(self) -> list[InputPartition]:
        ranges: list[InputPartition] = [_Range(layer, *r) for layer in self.layers for r in cut_layer(layer, self.split)]
        return ranges or [_Range(self.layers[0], 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        layer = partition.layer
        names = layer_schema(layer).fieldNames()
        with Input(layer.shapes) as shapes, Input(layer.index) as index, Input(layer.table) as table:
            at = partition.first
            while at < partition.last:
                # as many records as fit a batch, but at least one; the index is read a piece at a time
                entries = _entries(index, at, min(partition.last, at + 65_536))
                upto = np.cumsum(entries[:, 1] + 8 + layer.width)
                n = max(1, int(np.searchsorted(upto, BATCH_BYTES, "right")))
                yield self._batch(layer, names, at, entries[:n], shapes, table)
                at += n

    @staticmethod
    def _batch(layer: Layer, names: list[str], at: int, entries: np.ndarray, shapes: Input, table: Input) -> pa.RecordBatch:
        n = len(entries)
        raw = table.at(layer.start + at * layer.width, n * layer.width)
        rows = [raw[i * layer.width : (i + 1) * layer.width] for i in range(n)]
        kept = [i for i, r in enumerate(rows) if r[:1] != b"*"]
        ends = entries[:, 0] + entries[:, 1] + 8
        together = n > 0 and bool((entries[1:, 0] == ends[:-1]).all())
        block = shapes.at(int(entries[0, 0]), int(ends[-1] - entries[0, 0])) if together else b""
        contents = []
        for i in kept:
            offset, size = int(entries[i, 0]), int(entries[i, 1])
            start = offset - int(entries[0, 0])
            record = block[start : start + 8 + size] if together else shapes.at(offset, 8 + size)
            if struct.unpack_from(">i", record)[0] != at + i + 1:
                raise ValueError(f"{layer.shapes} holds another record than {at + i + 1} at {offset}")
            contents.append(record[8:])
        chosen = [rows[i] for i in kept]
        columns = [pa.array([layer.first + at + i for i in kept], pa.int64())]
        columns += [_values(chosen, a, layer.encoding) for a in layer.attributes]
        return pa.RecordBatch.from_arrays([*columns, _rings(contents)], names)


class PolygonLayer(DataSource):
    """``spark.read.format("polygon_layer").load(path)``, and ``df.write`` with the same format."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _layers(self) -> list[Layer]:
        path = self.options.get("path")
        if not path:
            raise ValueError("a path is needed")
        layers: list[Layer] = []
        for file in listed(path, ".shp"):
            first = layers[-1].first + layers[-1].records if layers else 0
            layers.append(read_layer_shape(file, self.options.get("encoding", "latin-1"), first))
            if layer_schema(layers[-1]) != layer_schema(layers[0]):
                raise ValueError(f"{file} and {layers[0].shapes} hold different attributes")
        return layers

    def schema(self) -> T.StructType:
        return layer_schema(self._layers()[0])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self._layers(), int(self.options.get("recordBytes", SPLIT_BYTES)))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], schema, overwrite, self.options.get("projection", ""))


# --- writing ------------------------------------------------------------------


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


def _storage(field: T.StructField) -> tuple[str, int, int]:
    """(kind, width, decimals) that hold every value; texts get the width of their longest later."""
    kinds: dict[type, tuple[str, int, int]] = {
        T.StringType: ("C", 1, 0),
        T.ByteType: ("N", 18, 0),
        T.ShortType: ("N", 18, 0),
        T.IntegerType: ("N", 18, 0),
        T.LongType: ("N", 18, 0),
        T.FloatType: ("F", 24, 15),
        T.DoubleType: ("F", 24, 15),
        T.BooleanType: ("L", 1, 0),
        T.DateType: ("D", 8, 0),
    }
    if type(field.dataType) not in kinds:
        raise ValueError(f"column {field.name} of type {field.dataType.simpleString()} has no counterpart in the file")
    if len(field.name.encode()) > 10:
        raise ValueError(f"column {field.name}: attribute names have at most 10 bytes")
    return kinds[type(field.dataType)]


def _cell(value, kind: str) -> bytes:
    if value is None:
        return b"?" if kind == "L" else b""
    if kind == "L":
        return b"T" if value else b"F"
    if kind == "D":
        return value.strftime("%Y%m%d").encode()
    return (repr(value) if kind == "F" else str(value)).encode()


def _header(words: int, box: np.ndarray) -> bytes:
    return struct.pack(">7i", FILE_CODE, 0, 0, 0, 0, 0, words) + struct.pack("<2i4d4d", 1000, POLYGON, *box, 0, 0, 0, 0)


def _content(rings: list[list[dict]] | None) -> tuple[bytes, np.ndarray | None]:
    if not rings:
        return struct.pack("<i", 0), None
    points = np.array([(p["x"], p["y"]) for ring in rings for p in ring], "<f8").reshape(-1, 2)
    starts = np.cumsum([0, *map(len, rings[:-1])]).astype("<i4")
    box = np.array([*points.min(0), *points.max(0)]) if len(points) else np.zeros(4)
    head = struct.pack("<i4d2i", POLYGON, *box, len(rings), len(points))
    return head + starts.tobytes() + points.tobytes(), box if len(points) else None


def encode_layer(rows: pa.Table, schema: T.StructType) -> dict[str, bytes]:
    """The files of one layer by suffix."""
    records, index, at, boxes = [], [], HEADER, []
    for number, rings in enumerate(rows["rings"].to_pylist(), 1):
        content, box = _content(rings)
        if box is not None:
            boxes.append(box)
        records.append(struct.pack(">2i", number, len(content) // 2) + content)
        index.append(struct.pack(">2i", at // 2, len(content) // 2))
        at += len(records[-1])
    all_boxes = np.array(boxes).reshape(-1, 4)
    box = np.array([*all_boxes[:, :2].min(0), *all_boxes[:, 2:].max(0)]) if len(boxes) else np.zeros(4)
    fields, columns = [], []
    for field in schema.fields:
        if field.name == "rings":
            continue
        kind, width, decimals = _storage(field)
        cells = [_cell(v, kind) for v in rows[field.name].to_pylist()]
        longest = max(map(len, cells), default=0)
        if kind == "C":
            width = max(1, longest)
            if width > 254:
                raise ValueError(f"column {field.name} holds a text of {width} bytes; the file keeps 254")
        elif longest > width:
            raise ValueError(f"column {field.name} holds a value too long for {width} characters")
        fields.append(struct.pack("<11sc4xBB14x", field.name.encode(), kind.encode(), width, decimals))
        columns.append([c.ljust(width) if kind == "C" else c.rjust(width) for c in cells])
    start, width = 32 + 32 * len(fields) + 1, 1 + sum(f[16] for f in fields)
    table = struct.pack("<4BIHH20x", 3, 100, 1, 1, rows.num_rows, start, width) + b"".join(fields) + b"\r"
    table += b"".join(b" " + b"".join(cells) for cells in zip(*columns, strict=True)) if columns else b" " * rows.num_rows
    return {
        ".shx": _header((HEADER + INDEX_ENTRY * len(index)) // 2, box) + b"".join(index),
        ".dbf": table + b"\x1a",
        ".cpg": b"UTF-8",
        ".shp": _header(at // 2, box) + b"".join(records),
    }


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: T.StructType, overwrite: bool, projection: str) -> None:
        self.path, self.schema, self.projection = path, schema, projection
        if "rings" not in schema.fieldNames():
            raise ValueError("a column rings is needed")
        for field in schema.fields:
            if field.name != "rings":
                _storage(field)
        parts = Parts(path)
        if overwrite:
            parts.clear()
        parts.create()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        parts, names = Parts(self.path), []
        held: list[pa.RecordBatch] = []
        task = TaskContext.get().partitionId()

        def flush() -> None:
            base = f"part-{task:05d}-{len(names):05d}-{uuid.uuid4().hex}"
            files = encode_layer(pa.Table.from_batches(held), self.schema)
            if self.projection:
                files = {".prj": self.projection.encode(), **files}
            # the shapes come last, so that a committed .shp always finds its companions
            names.extend(parts.write(base + suffix, content) for suffix, content in files.items())
            held.clear()

        for batch in iterator:
            if batch.num_rows:
                held.append(batch)
            if sum(b.nbytes for b in held) >= FILE_BYTES:
                flush()
        if held:
            flush()
        return _Written(names)

    def commit(self, messages: list[_Written | None]) -> None:
        Parts(self.path).commit([n for m in messages if m for n in m.names])

    def abort(self, messages: list[_Written | None]) -> None:
        Parts(self.path).abort([n for m in messages if m for n in m.names])


# --- the way in ---------------------------------------------------------------


def register(spark: SparkSession) -> None:
    share_package(spark)
    spark.dataSource.register(PolygonLayer)


def layer_projection(path: str) -> TransverseMercator | None:
    """The projection that the layers' .prj files name; None for geographic coordinates or without such a file."""
    texts = {read_text(p) for p in (_beside(f, ".prj") for f in listed(path, ".shp")) if p}
    if len(texts) > 1:
        raise ValueError(f"the layers in {path} have different projections")
    return TransverseMercator.from_wkt(texts.pop()) if texts else None


def read_layer(spark: SparkSession, path: str, reproject: bool = True, **options) -> DataFrame:
    """A layer as a table of rings; with ``reproject`` in longitude and latitude, whatever its .prj file says."""
    register(spark)
    layer = spark.read.format(FORMAT).options(**options).load(path)
    projection = layer_projection(path) if reproject else None
    if projection is None:
        return layer
    return layer.select(
        *[convert_rings(quoted(c), projection).alias(c) if c == "rings" else quoted(c) for c in layer.columns]
    )


def write_layer(df: DataFrame, path: str, projection: TransverseMercator | None = None, mode: str = "append") -> None:
    """Write a table of rings in longitude and latitude as a folder of layers, projected if asked."""
    register(df.sparkSession)
    out = df
    if projection is not None:
        out = df.select(
            *[convert_rings(quoted(c), projection, inverse=False).alias(c) if c == "rings" else quoted(c) for c in df.columns]
        )
    writer = out.write.format(FORMAT).mode(mode)
    (writer.option("projection", projection.wkt()) if projection else writer).save(path)
