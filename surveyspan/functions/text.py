"""Name cleaning and text labels, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented Latin letters and their plain forms, position by position.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"


def title_case(column: Column) -> Column:
    """Capital at the start and after every blank or hyphen."""
    words = F.split(column, r"(?<=[- ])")
    return F.array_join(F.transform(words, F.initcap), "")


def trim_text(column: Column) -> Column:
    """Strip all kinds of white space from both ends."""
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def glue(*parts) -> Column:
    """Concatenate; any missing part makes the result missing."""
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def percent(column: Column, digits: int = 0) -> Column:
    """A share as text, ``0.123 -> '12%'``."""
    return F.concat(F.format_number(column * F.lit(100.0), digits), F.lit("%"))


def split_pair(column: Column, separator: str, first: str, second: str) -> list[Column]:
    """Two columns from one text; a text without the separator leaves the second NULL."""
    quoted = "".join("\\" + ch if not ch.isalnum() and ch != "_" else ch for ch in separator)
    parts = F.split(column, quoted, 2)
    return [F.get(parts, 0).alias(first), F.get(parts, 1).alias(second)]


def accent_key(column: Column) -> Column:
    """Join key that ignores accents (composed or combining), case and outer blanks.

    Collated columns would force a sort-merge join even against a small table;
    a plain normalised key keeps every join strategy open.
    """
    bare = F.translate(F.regexp_replace(column, r"\p{M}+", ""), ACCENTED, PLAIN)
    return F.lower(trim_text(bare))


def same_text(left: Column, right: Column, collation: str = "UNICODE_CI_AI") -> Column:
    """Collation-based comparison for filters, where no join key is needed."""
    return F.collate(left, collation) == F.collate(right, collation)


def respell(column: Column, spellings: dict[str, str]) -> Column:
    """Fix single names; every other value, NULL included, stays."""
    fixed = column
    for old, new in spellings.items():
        fixed = F.when(column == F.lit(old), F.lit(new)).otherwise(fixed)
    return fixed
