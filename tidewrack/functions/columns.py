"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = str | Column


def col(c: ColumnLike) -> Column:
    """A column from a name (dots and spaces taken literally) or a column."""
    return F.col("`" + c.replace("`", "``") + "`") if isinstance(c, str) else c


def cols(names: Iterable[str]) -> list[Column]:
    return [col(n) for n in names]


def number(c: ColumnLike) -> Column:
    """Double value with NaN turned into NULL, so that aggregates skip both."""
    return F.nanvl(col(c).cast("double"), F.lit(None).cast("double"))


def branch(cond: Column, yes: Column, no: Column) -> Column:
    """Two-way choice that stays NULL when the condition is NULL."""
    return F.when(cond, yes).when(~cond, no)


def all_of(conds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)


def any_of(conds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def keyed(right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Right side of a join: keys renamed, everything re-aliased, so that a
    table derived from the left side can be joined back without ambiguity."""
    return right.select(
        *[col(k).alias(f"_k_{k}") for k in keys],
        *[col(c).alias(c) for c in right.columns if c not in keys],
    )


def matches(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality with a :func:`keyed` side; planned as a hash join."""
    return all_of([left[k].eqNullSafe(right[f"_k_{k}"]) for k in keys])


def require(df: DataFrame, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}; have {df.columns}")
