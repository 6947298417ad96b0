"""Conditionals and membership tests with explicit missing-value rules.

NULL is the only missing value. SQL ``CASE`` sends a NULL condition to ELSE, and
``x IN (...)`` is NULL for a NULL ``x``; survey recodes need other rules, so each
rule has its own name here.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def ifelse(condition: Column, yes, no) -> Column:
    """``yes`` or ``no``; NULL where the condition is NULL."""
    return F.when(condition, _column(yes)).when(condition.isNotNull(), _column(no))


def if_else(condition: Column, yes, no, missing=None) -> Column:
    """Like :func:`ifelse`, with a value of its own for a NULL condition."""
    return (
        F.when(condition.isNull(), _column(missing))
        .when(condition, _column(yes))
        .otherwise(_column(no))
    )


def case_when(*branches: tuple[Column, object], default=None) -> Column:
    """First true branch wins; a NULL condition counts as no match."""
    chain = None
    for condition, value in branches:
        chain = (
            F.when(condition, _column(value))
            if chain is None
            else chain.when(condition, _column(value))
        )
    if chain is None:
        raise ValueError("case_when needs at least one branch")
    return chain.otherwise(_column(default))


def na_if(column: Column, *sentinels) -> Column:
    """NULL where the column holds one of the sentinel codes."""
    return F.when(column.isin(*sentinels), None).otherwise(column)


def is_in(column: Column, codes: Iterable) -> Column:
    """Membership that is never NULL: a missing value is in no set."""
    return F.coalesce(column.isin(*codes), F.lit(False))


def replace_where(column: Column, value, condition: Column) -> Column:
    """Conditional in-place replacement; a NULL condition keeps the old value."""
    return F.when(condition, _column(value)).otherwise(column)


def recode_sets(column: Column, sets: Mapping[object, Iterable], other=None) -> Column:
    """Map sets of codes to new values: ``{new_value: [codes]}``.

    A missing value makes every ``IN`` NULL, which a CASE branch treats as no match.
    """
    return case_when(*[(column.isin(*codes), new) for new, codes in sets.items()], default=other)


def top_code(column: Column, code, value) -> Column:
    """Replace a top-coded entry such as 95 by the value it stands for."""
    return replace_where(column, value, column == F.lit(code))


def code_class(column: Column, sets: Mapping[int, Iterable[int]]) -> Column:
    """Class number of an integer code: ``{class: [codes]}``, NULL for any other value.

    Only a value that equals a listed code has a class: 10.5 is not 10, whatever the list. The
    codes and their classes are two array literals. Compared with a chain of ``IN`` lists this keeps the
    generated method short; above 8,000 bytes the JVM no longer compiles it and a scan slows
    down several times. A code in several lists belongs to the first.
    """
    classes: dict[int, int] = {}
    for number, codes in sets.items():
        for code in codes:
            classes.setdefault(int(code), number)
    if not classes:
        return F.lit(None).cast("int")
    codes = F.expr(f"array({', '.join(f'{c}L' for c in classes)})")
    numbers = F.expr(f"array({', '.join(str(n) for n in classes.values())})")
    whole = column.try_cast("bigint")
    return F.get(numbers, F.array_position(codes, F.when(whole == column, whole)).cast("int") - 1)
