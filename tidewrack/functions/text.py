"""Label and quality-flag text expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import ColumnLike, any_of, col


def _blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def parse_flag(c: ColumnLike) -> Column:
    """First signed whole number in the text, NULL if there is none."""
    return F.regexp_extract(col(c), "(-?[0-9]+)", 1).try_cast("int")


def flag_code(c: ColumnLike) -> Column:
    """Number between the first ``<`` and the last ``>``."""
    return _blank_to_null(F.regexp_extract(col(c), "(?<=<).+(?=>)", 0)).try_cast("double")


def flag_code_lenient(c: ColumnLike) -> Column:
    """As :func:`flag_code`, but a bare ``0`` counts as well."""
    return _blank_to_null(F.regexp_extract(col(c), "0|(?<=<).+(?=>)", 0)).try_cast("double")


def flag_comment(c: ColumnLike) -> Column:
    """All text after the first ``"> "``."""
    return _blank_to_null(F.regexp_extract(col(c), "(?<=> ).+", 0))


def is_good(flag: ColumnLike) -> Column:
    """Passed, calculated, historical or corrected; drops 1, negatives, NULL."""
    return (col(flag) == 0) | (col(flag) > 1)


def is_zero_flag(c: ColumnLike) -> Column:
    return col(c).rlike("0")


def na_tokens(c: ColumnLike, tokens: Sequence[str] = ("", "NA", "NaN")) -> Column:
    return F.when(~col(c).isin(*tokens), col(c))


def split_at(c: ColumnLike, position: int) -> tuple[Column, Column]:
    """Text before and after a fixed character position."""
    return (
        F.substring(col(c), 1, position),
        F.substring(col(c), position + 1, 2147483647 - position),
    )


def split_part(c: ColumnLike, delimiter: str, index: int) -> Column:
    """Zero-based piece of a delimited text, NULL when there is no such piece."""
    import re

    return F.get(F.split(col(c), re.escape(delimiter)), F.lit(index))


def unite(columns: Sequence[ColumnLike], sep: str) -> Column:
    """Join columns into one label; a NULL becomes the text ``NA``."""
    parts = [F.coalesce(col(c).cast("string"), F.lit("NA")) for c in columns]
    return F.concat_ws(sep, *parts)


def recode(c: ColumnLike, mapping: Mapping, default: Column | None = None) -> Column:
    """Value to label; unmatched values give ``default`` (NULL if not given)."""
    out = None
    for key, value in mapping.items():
        test = col(c) == F.lit(key)
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    if out is None:
        raise ValueError("mapping is empty")
    return out if default is None else out.otherwise(default)


def replace_value(c: ColumnLike, values: Sequence, new: Column | str | None) -> Column:
    """``new`` where the value is one of ``values``, the value itself elsewhere.

    Membership never yields NULL, so NULL values pass through unchanged.
    """
    hit = any_of([col(c).eqNullSafe(F.lit(v)) for v in values])
    return F.when(hit, new if isinstance(new, Column) else F.lit(new)).otherwise(col(c))


def first_match(c: ColumnLike, rules: Sequence[tuple[str, str]]) -> Column:
    """Label of the first rule whose pattern is found in the text, else NULL."""
    out = None
    for pattern, label in rules:
        test = col(c).rlike(pattern)
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    if out is None:
        raise ValueError("no rules given")
    return out
