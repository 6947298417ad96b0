"""Keyed joins with survey-table rules: NULL keys match, look-ups stay unique.

No join here carries a broadcast hint. Catalyst broadcasts a side when its known
size is below ``spark.sql.autoBroadcastJoinThreshold``, the adaptive plan does so
once the real size is seen, and otherwise the join shuffles with skew splitting.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> Column:
    """Column by exact name, blanks and dots included."""
    return F.col(f"`{name}`")


def _pairs(on) -> list[tuple[str, str]]:
    if isinstance(on, str):
        return [(on, on)]
    if isinstance(on, Mapping):
        return list(on.items())
    return [(c, c) for c in on]


def _common_type(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The type in which two key columns are compared, None where Spark should decide."""
    if a == b:
        return a
    if isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType):
        return T.LongType()
    if isinstance(a, (T.StringType, T.CharType, T.VarcharType)) and isinstance(b, (T.StringType, T.CharType, T.VarcharType)):
        return T.StringType()
    return None


def _key_struct(df: DataFrame, places: Sequence[int], types: Sequence[T.DataType]) -> Column:
    """All key columns as one struct: never NULL itself, and equal where NULL fields meet NULL fields."""
    return F.struct(*[F.col(df.columns[i]).cast(t).alias(f"k{n}") for n, (i, t) in enumerate(zip(places, types, strict=True))])


class _Sides:
    """Both sides of a join, their columns renamed by place so that no name of the caller can clash."""

    def __init__(self, left: DataFrame, right: DataFrame, on, suffixes: tuple[str, str]) -> None:
        pairs = _pairs(on)
        self.left = left.toDF(*[f"l{i}" for i in range(len(left.columns))])
        self.right = right.toDF(*[f"r{i}" for i in range(len(right.columns))])
        self.left_keys = [left.columns.index(l) for l, _ in pairs]
        self.right_keys = [right.columns.index(r) for _, r in pairs]
        self.key_names = [l for l, _ in pairs]
        self.left_rest = [i for i in range(len(left.columns)) if i not in self.left_keys]
        self.right_rest = [i for i in range(len(right.columns)) if i not in self.right_keys]
        own = {left.columns[i] for i in self.left_rest}
        clash = own & {right.columns[i] for i in self.right_rest}
        self.names = [
            *self.key_names,
            *[c + suffixes[0] if c in clash else c for c in (left.columns[i] for i in self.left_rest)],
            *[c + suffixes[1] if c in clash else c for c in (right.columns[i] for i in self.right_rest)],
        ]
        kinds = [
            _common_type(left.schema[l].dataType, right.schema[r].dataType) for l, r in pairs
        ]
        self.types = kinds if all(k is not None for k in kinds) else None

    def columns(self, keys: Sequence[Column]) -> list[Column]:
        values = [*keys, *[F.col(f"l{i}") for i in self.left_rest], *[F.col(f"r{i}") for i in self.right_rest]]
        return [v.alias(n) for v, n in zip(values, self.names, strict=True)]

    def unique_right(self) -> DataFrame:
        """The right side once per key, under ``_key``; a repeated key raises as soon as one of its values is used."""
        shown = F.concat_ws(", ", *[F.coalesce(F.col(f"_key.k{n}").cast("string"), F.lit("NULL")) for n in range(len(self.right_keys))])
        text = F.concat(F.lit(f"look-up key {', '.join(self.key_names)} is not unique: "), shown)
        key = _key_struct(self.right, self.right_keys, self.types).alias("_key")
        rest = [f"r{i}" for i in self.right_rest]
        counted = self.right.groupBy(key).agg(F.count("*").alias("_rows"), *[F.any_value(c).alias(c) for c in rest])
        guarded = [F.when(F.col("_rows") > 1, F.raise_error(text)).otherwise(F.col(c)).alias(c) for c in rest]
        return counted.select("_key", *guarded)


def keyed_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str] | Mapping[str, str],
    how: str = "left",
    suffixes: tuple[str, str] = ("_x", "_y"),
) -> DataFrame:
    """Equi-join in which a NULL key matches a NULL key.

    ``on`` is a name, a list of names, or ``{left_name: right_name}``. The result
    holds one copy of every key under its left name (filled from whichever side
    has the row), then the other columns. Names present on both sides get
    ``suffixes``.
    """
    sides = _Sides(left, right, on, suffixes)
    pairs = [(f"l{l}", f"r{r}") for l, r in zip(sides.left_keys, sides.right_keys, strict=True)]
    joined = sides.left.join(sides.right, F.expr(" AND ".join(f"{l} <=> {r}" for l, r in pairs)), how)
    side = {"right": lambda l, r: F.col(r), "full": lambda l, r: F.coalesce(F.col(l), F.col(r))}
    return joined.select(*sides.columns([side.get(how, lambda l, r: F.col(l))(*p) for p in pairs]))


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str] | Mapping[str, str],
    suffixes: tuple[str, str] = ("_x", "_y"),
) -> DataFrame:
    """Left :func:`keyed_join` with a table that must hold one row per key; a second one raises.

    The look-up side is grouped and joined on the same column, so one exchange of it serves both the check and the
    join, and the check sits on the looked-up values, not on the key.
    """
    sides = _Sides(left, right, on, suffixes)
    if sides.types is None:
        keys = [right.columns[i] for i in sides.right_keys]
        return keyed_join(left, unique_lookup(right, keys), on, "left", suffixes)
    own = sides.left.withColumn("_own", _key_struct(sides.left, sides.left_keys, sides.types))
    joined = own.join(sides.unique_right(), F.col("_own") == F.col("_key"), "left")
    return joined.select(*sides.columns([F.col(f"l{i}") for i in sides.left_keys]))


def whole_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str] | Mapping[str, str],
    suffixes: tuple[str, str] = ("_x", "_y"),
) -> DataFrame:
    """Full outer :func:`keyed_join` with a look-up on the right, taken apart.

    The left rows with what they find (:func:`lookup_join`), then the right rows that no left row names. Each
    part may be broadcast or skew-split, which a full outer join may not. A repeated key on the right raises in either part.
    """
    sides = _Sides(left, right, on, suffixes)
    if sides.types is None:
        keys = [right.columns[i] for i in sides.right_keys]
        return keyed_join(left, unique_lookup(right, keys), on, "full", suffixes)
    named = sides.left.select(_key_struct(sides.left, sides.left_keys, sides.types).alias("_own")).distinct()
    alone = sides.unique_right().join(named, F.col("_key") == F.col("_own"), "left_anti")
    empty = [F.lit(None).cast(sides.left.schema[f"l{i}"].dataType).alias(f"l{i}") for i in sides.left_rest]
    rest = alone.select("*", *empty).select(*sides.columns([F.col(f"_key.k{n}") for n in range(len(sides.types))]))
    return lookup_join(left, right, on, suffixes).unionByName(rest)


def unique_lookup(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``table`` with a guard: a second row for one key raises instead of fanning out."""
    rest = [c for c in table.columns if c not in keys]
    names = [f"`{k}`" for k in keys]
    counted = table.groupBy(*[F.expr(n) for n in names]).agg(
        F.expr("count(*) AS _rows"), *[F.expr(f"any_value(`{c}`) AS `{c}`") for c in rest]
    )
    shown = ", ".join(f"coalesce(CAST({n} AS STRING), 'NULL')" for n in names)
    text = f"look-up key {', '.join(keys)} is not unique: ".replace("'", "")
    guard = f"CASE WHEN _rows > 1 THEN raise_error(concat('{text}', concat_ws(', ', {shown}))) ELSE {names[0]} END"
    return counted.selectExpr(f"{guard} AS {names[0]}", *names[1:], *[f"`{c}`" for c in rest])


def attach(df: DataFrame, table: DataFrame, on: Mapping[str, str], columns: Mapping[str, str]) -> DataFrame:
    """Add some columns of a look-up table, ``{its name: new name}``, to every row; columns of that name are replaced."""
    kept = [c for c in df.columns if c not in columns.values()]
    looked = lookup_join(df.select(*[quoted(c) for c in df.columns]), table.select(*[quoted(r) for r in on.values()], *[
        quoted(c).alias(f"_new_{i}") for i, c in enumerate(columns)
    ]), on)
    new = {f"_new_{i}": name for i, name in enumerate(columns.values())}
    return looked.select(*[quoted(c) for c in kept], *[F.col(c).alias(n) for c, n in new.items()])


def lookup(
    df: DataFrame,
    column: str,
    table: DataFrame,
    code: str = "code",
    label: str = "label",
    into: str | None = None,
) -> DataFrame:
    """Replace codes by labels from a table; a code without a label passes as text."""
    into = into or column
    # the code is looked up from a column of its own, so that the frame keeps its names
    placed = df.select(*[quoted(c) for c in df.columns], quoted(column).alias("_looked_up"))
    named = lookup_join(placed, table.select(quoted(code).alias("_looked_up"), quoted(label).alias("_label")), "_looked_up")
    decoded = F.coalesce(F.when(F.col("_looked_up").isNotNull(), F.col("_label")), quoted(column).cast("string"))
    kept = [decoded.alias(into) if c == into else quoted(c) for c in df.columns]
    return named.select(*kept, *([] if into in df.columns else [decoded.alias(into)]))


def place_lookup(df: DataFrame, city: str, gazetteer: DataFrame, country: str) -> DataFrame:
    """Add ``loc`` ("city, country") and the gazetteer's columns for that place."""
    located = df.withColumn("loc", F.concat(quoted(city), F.lit(f", {country}")))
    return lookup_join(located, gazetteer, "loc")


def with_scalar(df: DataFrame, one_row: DataFrame, value: str, into: str) -> DataFrame:
    """Attach one value of a one-row table to every row, as a scalar subquery."""
    return df.withColumn(into, one_row.select(quoted(value)).scalar())
