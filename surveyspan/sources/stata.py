"""Labelled microdata files (.dta) as a Spark data source, split by record ranges.

The file is a header, fixed-width records, and value labels behind them. The driver reads only what describes the
records; each task seeks to its own range of records and decodes it column by column into Arrow batches.
Several files of one folder form one table, so a large survey is written and read in parallel.

What a reader gets: a column per variable with the type that its storage and display format imply, the variable's
description and value labels as column metadata (as ``codebook`` uses them), and NULL for missing values. The 27 missing codes
``.``, ``.a`` to ``.z`` can be kept in companion columns. Layouts 113 to 115 and 117 to 119 in either byte order are read; 118
is written. Long strings kept outside the records are not read: leave such variables out with ``columns``.

Options: ``path``; ``columns`` (comma-separated names to read, all if left out); ``missingCodes`` (``true`` adds
``<name>__missing`` for every number); ``recordBytes`` (size of a split); ``encoding`` (text of layouts before 118).
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from surveyspan.sources.codebook import label_metadata
from surveyspan.sources.files import Input, Parts, listed, share_package

FORMAT = "labelled_microdata"
SPLIT_BYTES = 64 << 20
#: Records decoded into one Arrow batch, and written into one file, hold about this many bytes.
BATCH_BYTES = 4 << 20
FILE_BYTES = 64 << 20

# Fixed values of the file format: type codes, the smallest missing code of each type, and the distance between codes.
NUMBERS = {"b": 65530, "h": 65529, "i": 65528, "f": 65527, "d": 65526}
OLD_NUMBERS = {"b": 251, "h": 252, "i": 253, "f": 254, "d": 255}
LONG_STRING = 32768
MISSING = {"b": 101, "h": 32741, "i": 2147483621, "f": 2.0**127, "d": 2.0**1023}
STEP = {"b": 1, "h": 1, "i": 1, "f": 2.0**115, "d": 2.0**1011}
CODES = [".", *(f".{c}" for c in "abcdefghijklmnopqrstuvwxyz")]
EPOCH_DAYS = 3653  # 1960-01-01 to 1970-01-01
_TYPES = {"b": T.ByteType(), "h": T.ShortType(), "i": T.IntegerType(), "f": T.FloatType(), "d": T.DoubleType()}
# Widths of names, formats, variable descriptions and label names by layout.
_WIDTHS = {113: (33, 12, 81, 33), 114: (33, 49, 81, 33), 115: (33, 49, 81, 33), 117: (33, 49, 81, 33), 118: (129, 57, 321, 129), 119: (129, 57, 321, 129)}


@dataclass(frozen=True)
class Variable:
    name: str
    kind: str  # b, h, i, f, d as in struct, s for text, L for a long string
    width: int
    display: str = ""
    description: str = ""
    label_set: str = ""

    @property
    def role(self) -> str:
        if self.kind not in "sL" and self.display.startswith(("%td", "%d", "%-td")):
            return "date"
        if self.kind == "d" and self.display.startswith(("%tc", "%tC", "%-tc")):
            return "time"
        return "text" if self.kind == "s" else "number"

    def spark_type(self) -> T.DataType:
        return {"date": T.DateType(), "time": T.TimestampNTZType(), "text": T.StringType()}.get(self.role) or _TYPES[self.kind]


@dataclass(frozen=True)
class Layout:
    """Where the records of a file stand and what they hold."""

    path: str
    order: str
    encoding: str
    rows: int
    start: int
    variables: tuple[Variable, ...]
    labels: dict[str, list[tuple[int, str]]]

    @property
    def record(self) -> np.dtype:
        kinds = {"b": "i1", "h": "i2", "i": "i4", "f": "f4", "d": "f8"}
        fields = []
        for i, v in enumerate(self.variables):
            fields.append((f"v{i}", f"{self.order}{kinds[v.kind]}" if v.kind in kinds else f"V{v.width}"))
        return np.dtype(fields)


class _Cursor:
    """Reads on through a file in pieces."""

    def __init__(self, file: Input, encoding: str) -> None:
        self.file, self.place, self.order, self.encoding = file, 0, "<", encoding

    def take(self, size: int) -> bytes:
        out = self.file.at(self.place, size)
        self.place += size
        return out

    def number(self, kind: str) -> int:
        return struct.unpack(self.order + kind, self.take(struct.calcsize(kind)))[0]

    def expect(self, tag: str) -> None:
        found = self.take(len(tag))
        if found != tag.encode():
            raise ValueError(f"{tag} expected at {self.place - len(tag)}, found {found!r}")

    def text(self, raw: bytes) -> str:
        return raw.split(b"\0", 1)[0].decode(self.encoding, "replace")

    def texts(self, count: int, width: int) -> list[str]:
        raw = self.take(count * width)
        return [self.text(raw[i * width : (i + 1) * width]) for i in range(count)]


def _label_table(cursor: _Cursor) -> list[tuple[int, str]]:
    n, size = cursor.number("i"), cursor.number("i")
    offsets = np.frombuffer(cursor.take(4 * n), cursor.order + "i4")
    codes = np.frombuffer(cursor.take(4 * n), cursor.order + "i4")
    texts = cursor.take(size)
    return [(int(c), cursor.text(texts[o:])) for o, c in zip(offsets, codes, strict=True)]


def _kind(code: int, numbers: dict[str, int], longest: int) -> tuple[str, int]:
    for kind, known in numbers.items():
        if code == known:
            return kind, struct.calcsize(kind)
    if code == LONG_STRING:
        return "L", 8
    if 0 < code <= longest:
        return "s", code
    raise ValueError(f"unknown variable type {code}")


def _variables(kinds, names, displays, sets, descriptions) -> tuple[Variable, ...]:
    rows = zip(kinds, names, displays, sets, descriptions, strict=True)
    return tuple(Variable(n, *k, d, t, s) for k, n, d, s, t in rows)


def _old_layout(cursor: _Cursor, path: str, release: int) -> Layout:
    cursor.order = {1: ">", 2: "<"}[cursor.take(1)[0]]
    cursor.take(2)
    count, rows = cursor.number("h"), cursor.number("i")
    cursor.take(81 + 18)
    name, display, description, label = _WIDTHS[release]
    kinds = [_kind(c, OLD_NUMBERS, 244) for c in cursor.take(count)]
    names = cursor.texts(count, name)
    cursor.take(2 * (count + 1))
    displays = cursor.texts(count, display)
    sets = cursor.texts(count, label)
    descriptions = cursor.texts(count, description)
    while True:  # expansion fields
        kind, size = cursor.take(1)[0], cursor.number("i")
        if kind == 0 and size == 0:
            break
        cursor.place += size
    variables = _variables(kinds, names, displays, sets, descriptions)
    start = cursor.place
    cursor.place += rows * sum(v.width for v in variables)
    labels = {}
    while cursor.place < cursor.file.size:
        cursor.number("i")
        known = cursor.text(cursor.take(label))
        cursor.take(3)
        labels[known] = _label_table(cursor)
    return Layout(path, cursor.order, cursor.encoding, rows, start, variables, labels)


def _new_layout(cursor: _Cursor, path: str) -> Layout:
    cursor.expect("<stata_dta><header><release>")
    release = int(cursor.take(3))
    if release not in (117, 118, 119):
        raise ValueError(f"layout {release} is not known")
    if release >= 118:
        cursor.encoding = "utf-8"
    cursor.expect("</release><byteorder>")
    cursor.order = {b"MSF": ">", b"LSF": "<"}[cursor.take(3)]
    cursor.expect("</byteorder><K>")
    count = cursor.number("I" if release == 119 else "H")
    cursor.expect("</K><N>")
    rows = cursor.number("I" if release == 117 else "Q")
    cursor.expect("</N><label>")
    cursor.take(cursor.number("B" if release == 117 else "H"))
    cursor.expect("</label><timestamp>")
    cursor.take(cursor.number("B"))
    cursor.expect("</timestamp></header><map>")
    places = struct.unpack(cursor.order + "14Q", cursor.take(14 * 8))
    name, display, description, label = _WIDTHS[release]

    def section(which: int, tag: str) -> None:
        cursor.place = places[which]
        cursor.expect(tag)

    section(2, "<variable_types>")
    codes = np.frombuffer(cursor.take(2 * count), cursor.order + "u2")
    kinds = [_kind(int(c), NUMBERS, 2045) for c in codes]
    section(3, "<varnames>")
    names = cursor.texts(count, name)
    section(5, "<formats>")
    displays = cursor.texts(count, display)
    section(6, "<value_label_names>")
    sets = cursor.texts(count, label)
    section(7, "<variable_labels>")
    descriptions = cursor.texts(count, description)
    section(9, "<data>")
    start = cursor.place
    section(11, "<value_labels>")
    labels = {}
    while True:
        tag = cursor.take(5)
        if tag != b"<lbl>":
            break
        cursor.number("i")
        known = cursor.text(cursor.take(label))
        cursor.take(3)
        labels[known] = _label_table(cursor)
        cursor.expect("</lbl>")
    return Layout(path, cursor.order, cursor.encoding, rows, start, _variables(kinds, names, displays, sets, descriptions), labels)


def read_layout(path: str, encoding: str = "windows-1252") -> Layout:
    """Everything but the records of one file."""
    with Input(path) as file:
        cursor = _Cursor(file, encoding)
        first = cursor.take(1)[0]
        if first in (113, 114, 115):
            return _old_layout(cursor, path, first)
        if first != ord("<"):
            raise ValueError(f"{path} is not a labelled microdata file of a known layout")
        cursor.place = 0
        return _new_layout(cursor, path)


@dataclass
class _Range(InputPartition):
    layout: Layout
    first: int
    last: int

    def __post_init__(self) -> None:
        super().__init__(None)


def _texts(raw: np.ndarray, encoding: str) -> pa.Array:
    width = raw.dtype.itemsize
    data = raw.tobytes()
    cells = (data[i : i + width].split(b"\0", 1)[0] for i in range(0, len(data), width))
    if encoding == "utf-8":
        return pa.array([c.decode("utf-8", "replace") for c in cells], pa.string())
    return pa.array([c.decode(encoding, "replace") for c in cells], pa.string())


def _numbers(raw: np.ndarray, variable: Variable) -> tuple[pa.Array, np.ndarray]:
    values = raw.astype(raw.dtype.newbyteorder("="))
    missing = values >= MISSING[variable.kind]
    if variable.kind in "fd":
        missing |= np.isnan(values)
    if variable.role == "date":
        days = np.where(missing, 0, np.floor(values.astype(np.float64))).astype(np.int64) - EPOCH_DAYS
        return pa.array(days.astype(np.int32), mask=missing).cast(pa.date32()), missing
    if variable.role == "time":
        millis = np.where(missing, 0.0, values).round().astype(np.int64) - EPOCH_DAYS * 86_400_000
        return pa.array(millis * 1000, mask=missing).cast(pa.timestamp("us")), missing
    return pa.array(values, mask=missing), missing


def _missing_codes(raw: np.ndarray, variable: Variable, missing: np.ndarray) -> pa.Array:
    above = np.where(missing, raw.astype(np.float64), MISSING[variable.kind]) - MISSING[variable.kind]
    with np.errstate(invalid="ignore"):
        steps = np.clip(np.nan_to_num(above / STEP[variable.kind]), 0, 26).astype(int)
    return pa.array(np.array(CODES, dtype=object)[steps], pa.string(), mask=~missing)


class _Reader(DataSourceReader):
    def __init__(self, layouts: list[Layout], schema: T.StructType, columns: list[str], split: int, codes: bool) -> None:
        # value labels went into the schema; tasks need only the shape of the records
        self.layouts = [replace(x, labels={}) for x in layouts]
        self.schema, self.columns = schema, columns
        self.split, self.codes = split, codes

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for layout in self.layouts:
            each = max(1, self.split // max(1, layout.record.itemsize))
            out += [_Range(layout, i, min(i + each, layout.rows)) for i in range(0, layout.rows, each)]
        return out or [_Range(self.layouts[0], 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        layout = partition.layout
        record = layout.record
        places = {v.name: i for i, v in enumerate(layout.variables)}
        each = max(1, BATCH_BYTES // max(1, record.itemsize))
        with Input(layout.path) as file:
            for first in range(partition.first, partition.last, each):
                n = min(each, partition.last - first)
                rows = np.frombuffer(file.at(layout.start + first * record.itemsize, n * record.itemsize), record)
                columns, names = [], []
                for name in self.columns:
                    variable = layout.variables[places[name]]
                    raw = np.ascontiguousarray(rows[f"v{places[name]}"])
                    names.append(name)
                    if variable.kind == "s":
                        columns.append(_texts(raw, layout.encoding))
                        continue
                    values, missing = _numbers(raw, variable)
                    columns.append(values)
                    if self.codes:
                        names.append(f"{name}__missing")
                        columns.append(_missing_codes(raw, variable, missing))
                yield pa.RecordBatch.from_arrays(columns, names)


def _same_shape(layouts: list[Layout]) -> None:
    first = [(v.name, v.kind, v.role) for v in layouts[0].variables]
    for other in layouts[1:]:
        if [(v.name, v.kind, v.role) for v in other.variables] != first:
            raise ValueError(f"{other.path} and {layouts[0].path} hold different variables")


def file_schema(layouts: list[Layout], columns: list[str], codes: bool) -> T.StructType:
    """Columns with types and labels; labels of all files together, the first file's text counting."""
    _same_shape(layouts)
    known = {v.name: v for v in layouts[0].variables}
    absent = [c for c in columns if c not in known]
    if absent:
        raise ValueError(f"variables not in {layouts[0].path}: {absent}")
    fields = []
    for name in columns:
        variable = known[name]
        if variable.kind == "L":
            raise ValueError(f"{name} is a long string kept outside the records; leave it out with the option columns")
        labels = [pair for x in layouts for pair in x.labels.get(variable.label_set, [])] if variable.label_set else []
        meta = label_metadata(variable.description or None, [(t, c) for c, t in labels])
        fields.append(T.StructField(name, variable.spark_type(), metadata=meta))
        if codes and variable.kind != "s":
            fields.append(T.StructField(f"{name}__missing", T.StringType()))
    return T.StructType(fields)


class LabelledMicrodata(DataSource):
    """``spark.read.format("labelled_microdata").load(path)``, and ``df.write`` with the same format."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _layouts(self) -> list[Layout]:
        path = self.options.get("path")
        if not path:
            raise ValueError("a path is needed")
        return [read_layout(p, self.options.get("encoding", "windows-1252")) for p in listed(path, ".dta")]

    def _columns(self, layouts: list[Layout]) -> list[str]:
        chosen = self.options.get("columns")
        return [c.strip() for c in chosen.split(",")] if chosen else [v.name for v in layouts[0].variables]

    def schema(self) -> T.StructType:
        layouts = self._layouts()
        return file_schema(layouts, self._columns(layouts), self._codes())

    def _codes(self) -> bool:
        return self.options.get("missingCodes", "false").lower() == "true"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        layouts = self._layouts()
        split = int(self.options.get("recordBytes", SPLIT_BYTES))
        return _Reader(layouts, schema, self._columns(layouts), split, self._codes())

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], schema, overwrite)


# --- writing ------------------------------------------------------------------


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


def _storage(field: T.StructField) -> tuple[str, str]:
    """(kind, display format) that holds every value of a Spark type."""
    kinds: dict[type, tuple[str, str]] = {
        T.BooleanType: ("b", "%8.0g"),
        T.ByteType: ("h", "%8.0g"),
        T.ShortType: ("i", "%12.0g"),
        T.IntegerType: ("i", "%12.0g"),
        T.LongType: ("d", "%20.0g"),
        T.FloatType: ("f", "%9.0g"),
        T.DoubleType: ("d", "%10.0g"),
        T.DateType: ("i", "%td"),
        T.TimestampNTZType: ("d", "%tc"),
        T.TimestampType: ("d", "%tc"),
        T.StringType: ("s", ""),
    }
    if type(field.dataType) not in kinds:
        raise ValueError(f"column {field.name} of type {field.dataType.simpleString()} has no counterpart in the file")
    return kinds[type(field.dataType)]


def _number_bytes(column: pa.Array, field: T.StructField, kind: str) -> np.ndarray:
    empty = column.is_null().to_numpy(zero_copy_only=False)
    if isinstance(field.dataType, T.DateType):
        column = column.cast(pa.int32())
    elif isinstance(field.dataType, (T.TimestampNTZType, T.TimestampType)):
        column = column.cast(pa.timestamp("us")).cast(pa.int64())
    elif isinstance(field.dataType, T.BooleanType):
        column = column.cast(pa.int8())
    values = column.fill_null(0).to_numpy(zero_copy_only=False)
    if isinstance(field.dataType, T.DateType):
        values = values.astype(np.int64) + EPOCH_DAYS
    elif isinstance(field.dataType, (T.TimestampNTZType, T.TimestampType)):
        values = values / 1000 + EPOCH_DAYS * 86_400_000
    elif isinstance(field.dataType, T.LongType) and (np.abs(values.astype(np.float64)) > 2.0**53).any():
        raise ValueError(f"column {field.name} holds integers beyond 2**53, which the file cannot keep exactly")
    if kind in "fd":
        empty = empty | np.isnan(values)
    with np.errstate(invalid="ignore"):
        large = ~empty & (np.abs(values.astype(np.float64)) >= MISSING[kind])
    if large.any():
        raise ValueError(f"column {field.name} holds {values[large][0]}, which the file would take for a missing code")
    return np.where(empty, MISSING[kind], values)


def _padded(texts: list[str], width: int) -> bytes:
    out = bytearray()
    for text in texts:
        raw = text.encode()
        if len(raw) >= width:
            raise ValueError(f"{text!r} is too long for {width - 1} bytes")
        out += raw.ljust(width, b"\0")
    return bytes(out)


def _label_bytes(name: str, pairs: list[tuple[int, str]]) -> bytes:
    texts = [t.encode() + b"\0" for _, t in pairs]
    ends = np.cumsum([0, *map(len, texts)])
    table = struct.pack("<2i", len(pairs), int(ends[-1])) + ends[:-1].astype("<i4").tobytes()
    table += np.array([c for c, _ in pairs], "<i4").tobytes() + b"".join(texts)
    return b"<lbl>" + struct.pack("<i", len(table)) + _padded([name], 129) + b"\0\0\0" + table + b"</lbl>"


def encode_file(batch: pa.Table, schema: T.StructType) -> bytes:
    """One whole file with the rows of ``batch``."""
    columns, fields, types, displays = [], [], [], []
    for field in schema.fields:
        kind, display = _storage(field)
        column = batch[field.name].combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
        if kind == "s":
            cells = [(x or "").encode() for x in column.to_pylist()]
            width = max(1, max(map(len, cells), default=1))
            if width > 2045:
                raise ValueError(f"column {field.name} holds a text of {width} bytes; the file keeps 2045")
            if any(b"\0" in c for c in cells):
                raise ValueError(f"column {field.name} holds a text with a NUL character, which would end it in the file")
            columns.append(np.array(cells, f"S{width}"))
            types.append(width)
            display = f"%{width}s"
        else:
            columns.append(_number_bytes(column, field, kind).astype("<" + {"b": "i1", "h": "i2", "i": "i4", "f": "f4", "d": "f8"}[kind]))
            types.append(NUMBERS[kind])
        fields.append((f"v{len(fields)}", columns[-1].dtype))
        displays.append(display)
    rows = np.zeros(batch.num_rows, np.dtype(fields))
    for (name, _), column in zip(fields, columns, strict=True):
        rows[name] = column
    names = [f.name for f in schema.fields]
    labelled = {}
    for f in schema.fields:
        by_code = f.metadata.get("codes") or {}
        pairs = [(int(c), t) for c, t in by_code.items()] or [(int(c), t) for t, c in (f.metadata.get("labels") or {}).items()]
        if pairs and not isinstance(f.dataType, T.StringType):
            labelled[f.name] = pairs
    count = len(names)
    descriptions = [(f.metadata.get("label") or "")[:80] for f in schema.fields]
    head = b"<stata_dta><header><release>118</release><byteorder>LSF</byteorder><K>" + struct.pack("<H", count)
    head += b"</K><N>" + struct.pack("<Q", batch.num_rows) + b"</N><label>\0\0</label><timestamp>\0</timestamp></header>"
    sections = [
        b"<variable_types>" + np.array(types, "<u2").tobytes() + b"</variable_types>",
        b"<varnames>" + _padded(names, 129) + b"</varnames>",
        b"<sortlist>" + bytes(2 * (count + 1)) + b"</sortlist>",
        b"<formats>" + _padded(displays, 57) + b"</formats>",
        b"<value_label_names>" + _padded([n if n in labelled else "" for n in names], 129) + b"</value_label_names>",
        b"<variable_labels>" + _padded(descriptions, 321) + b"</variable_labels>",
        b"<characteristics></characteristics>",
        b"<data>" + rows.tobytes() + b"</data>",
        b"<strls></strls>",
        b"<value_labels>" + b"".join(_label_bytes(n, p) for n, p in labelled.items()) + b"</value_labels>",
    ]
    map_size = len(b"<map></map>") + 14 * 8
    places = [0, len(head)]
    at = len(head) + map_size
    for s in sections:
        places.append(at)
        at += len(s)
    places += [at, at + len(b"</stata_dta>")]
    return b"".join([head, b"<map>", struct.pack("<14Q", *places), b"</map>", *sections, b"</stata_dta>"])


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: T.StructType, overwrite: bool) -> None:
        self.path, self.schema = path, schema
        for field in schema.fields:
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
            content = encode_file(pa.Table.from_batches(held), self.schema)
            names.append(parts.write(f"part-{task:05d}-{len(names):05d}-{uuid.uuid4().hex}.dta", content))
            held.clear()

        for batch in iterator:
            if batch.num_rows:
                held.append(batch)
            if sum(b.nbytes for b in held) >= FILE_BYTES:
                flush()
        if held or (task == 0 and not names):
            if not held:
                empty = [pa.array([], _arrow_type(f.dataType)) for f in self.schema.fields]
                held.append(pa.RecordBatch.from_arrays(empty, [f.name for f in self.schema.fields]))
            flush()
        return _Written(names)

    def commit(self, messages: list[_Written | None]) -> None:
        Parts(self.path).commit([n for m in messages if m for n in m.names])

    def abort(self, messages: list[_Written | None]) -> None:
        Parts(self.path).abort([n for m in messages if m for n in m.names])


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


# --- the way in ---------------------------------------------------------------


def register(spark: SparkSession) -> None:
    share_package(spark)
    spark.dataSource.register(LabelledMicrodata)


def read_labelled(
    spark: SparkSession, path: str, columns: list[str] | None = None, missing_codes: bool = False, **options
) -> DataFrame:
    """Coded rows with their labels from a file, or from all ``.dta`` files of a folder."""
    register(spark)
    reader = spark.read.format(FORMAT).option("missingCodes", str(missing_codes).lower()).options(**options)
    if columns:
        reader = reader.option("columns", ",".join(columns))
    return reader.load(path)


def write_labelled(df: DataFrame, path: str, mode: str = "append") -> None:
    """Write rows and their labels as a folder of files, one or more per partition."""
    register(df.sparkSession)
    df.write.format(FORMAT).mode(mode).save(path)


def label_rows(spark: SparkSession, path: str, encoding: str = "windows-1252") -> DataFrame:
    """``variable, code, label`` of every value label in the files, repeats of a code within a variable left out.

    The files are parsed by tasks, one each, so neither their number nor that of their labels meets the driver.
    """
    register(spark)
    files = spark.createDataFrame([(p,) for p in listed(path, ".dta")], "path string")

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where in batch["path"].to_pylist():
                layout = read_layout(where, encoding)
                rows = [
                    (where, v.name, code, text)
                    for v in layout.variables
                    for code, text in (layout.labels.get(v.label_set, []) if v.label_set else [])
                ]
                yield pa.RecordBatch.from_pylist(
                    [{"path": p, "variable": n, "code": c, "label": t} for p, n, c, t in rows],
                    pa.schema([("path", pa.string()), ("variable", pa.string()), ("code", pa.int64()), ("label", pa.string())]),
                )

    count = max(1, min(files.count(), 1000))
    rows = files.repartition(count).mapInArrow(parsed, "path string, variable string, code long, label string")
    first = F.min(F.struct("path", "label"))
    return rows.groupBy("variable", "code").agg(first.alias("f")).select("variable", "code", F.col("f.label").alias("label"))
