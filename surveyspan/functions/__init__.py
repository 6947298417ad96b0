from surveyspan.functions.nulls import (
    case_when,
    code_class,
    if_else,
    ifelse,
    is_in,
    na_if,
    recode_sets,
    replace_where,
    top_code,
)
from surveyspan.functions.numbers import (
    implied_decimals,
    nan_to_null,
    ratio,
    signif,
    to_integer,
)
from surveyspan.functions.text import (
    accent_key,
    glue,
    percent,
    respell,
    same_text,
    split_pair,
    title_case,
    trim_text,
)

__all__ = [
    "accent_key",
    "case_when",
    "code_class",
    "glue",
    "if_else",
    "ifelse",
    "implied_decimals",
    "is_in",
    "na_if",
    "nan_to_null",
    "percent",
    "ratio",
    "recode_sets",
    "replace_where",
    "respell",
    "same_text",
    "signif",
    "split_pair",
    "title_case",
    "to_integer",
    "top_code",
    "trim_text",
]
