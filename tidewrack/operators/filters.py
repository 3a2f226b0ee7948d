"""Projections, filters and predicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..functions.columns import all_of, any_of, col, number, require


def station_alias(
    df: DataFrame, code: str, rules: Sequence[tuple[str, str]], name: str = "sitename"
) -> DataFrame:
    """Site name of a station code: first rule whose pattern is found wins."""
    return df.withColumn(name, text.first_match(code, rules))


def station_alias_table(
    df: DataFrame, code: str, aliases: DataFrame, alias_code: str = "station_code", alias_name: str = "sitename", name: str = "sitename"
) -> DataFrame:
    """Site name of a station code from a table of whole codes; NULL for codes it lacks.

    A code listed several times takes its smallest name, so rows never multiply.
    """
    right = aliases.groupBy(col(alias_code).alias("_code")).agg(F.min(col(alias_name)).alias("_name"))
    kept = [c for c in df.columns if c != name]
    joined = df.join(right, df[code] == right["_code"], "left")
    return joined.select(*[col(c) for c in kept], F.col("_name").alias(name))


def station_set(df: DataFrame, code: str, codes: Sequence[str]) -> DataFrame:
    """Rows of a literal set of codes that stand for one site over time."""
    return df.where(col(code).isin(*codes))


def station_filter_by_program(
    df: DataFrame, code: str, program: str, within: str | None = None
) -> DataFrame:
    """Distinct station codes of a program, optionally narrowed by a pattern."""
    keep = col(code).rlike(program)
    if within is not None:
        keep = keep & col(code).rlike(within)
    return df.where(keep).select(col(code)).distinct()


def date_range_filter(
    df: DataFrame,
    ts: str,
    start: str | None = None,
    end: str | None = None,
    after: str | None = None,
    year: int | None = None,
    year_above: int | None = None,
) -> DataFrame:
    """Rows in a closed interval, after a moment, or in / after a year.

    Bounds are compared in the column's own type, so an end given as a date
    means that day's midnight for timestamps. A year is turned into a range
    of stamps, which reaches the file scan as a pushed filter.
    """
    kind = df.schema[ts].dataType.simpleString()
    at = lambda v: F.lit(v).cast("timestamp_ntz").cast(kind)
    c = col(ts)
    if start is not None:
        df = df.where(c >= at(start))
    if end is not None:
        df = df.where(c <= at(end))
    if after is not None:
        df = df.where(c > at(after))
    if year is not None:
        df = df.where((c >= at(f"{year}-01-01")) & (c < at(f"{year + 1}-01-01")))
    if year_above is not None:
        df = df.where(c >= at(f"{year_above + 1}-01-01"))
    return df


def drop_any_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without a NULL (or NaN) in the listed columns, or in any."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    wanted = list(columns) if columns is not None else df.columns
    require(df, wanted)
    known = [
        number(c).isNotNull() if isinstance(kinds[c], T.DoubleType | T.FloatType) else col(c).isNotNull()
        for c in wanted
    ]
    return df.where(all_of(known))


def recode_values(
    df: DataFrame, column: str, mapping: Mapping, default: Column | None = None
) -> DataFrame:
    """Values to labels in place; unmatched values become ``default`` or NULL."""
    return df.withColumn(column, text.recode(column, mapping, default))


def not_in(c: str, values: Sequence) -> Column:
    """``NOT IN`` that keeps NULLs, as membership is never unknown."""
    return ~any_of([col(c).eqNullSafe(F.lit(v)) for v in values])


def range_in_list(c: str, ranges: Sequence[tuple[int, int]]) -> Column:
    """Whether a number lies in one of the closed ranges; NULL does not."""
    return F.coalesce(any_of([col(c).between(lo, hi) for lo, hi in ranges]), F.lit(False))


def explode_params(registry: DataFrame, column: str = "params_reported") -> DataFrame:
    """Distinct words of the comma-separated parameter lists."""
    words = F.explode(F.regexp_extract_all(col(column), F.lit(r"([A-Za-z0-9_]+)"), 1))
    return registry.select(words.alias("param")).distinct()


def plausible_range(
    df: DataFrame,
    limits: Mapping[str, tuple[float, float]],
    breaks: Mapping[str, Sequence[float]] | None = None,
) -> DataFrame:
    """Values outside their variable's limits to NULL.

    With ``breaks`` a column ``<name>_bin`` counts the break points at or
    below each plausible value.
    """
    require(df, limits)
    inside = {c: F.when(number(c).between(lo, hi), number(c)) for c, (lo, hi) in limits.items()}
    out = [inside[c].alias(c) if c in inside else col(c) for c in df.columns]
    for c, points in (breaks or {}).items():
        steps = [(inside.get(c, number(c)) >= F.lit(float(p))).cast("int") for p in points]
        out.append(sum(steps[1:], steps[0]).alias(f"{c}_bin"))
    return df.select(*out)


# Plausible limits and contour break points of cast variables.
CAST_LIMITS = {
    "Temperature_ITS90_DegC": (0.0, 14.0),
    "Salinity_PSU": (25.0, 33.0),
    "Density_sigma.theta.kg.m.3": (20.0, 26.0),
    "Fluorescence_mg_m3": (0.0, 10.0),
}
CAST_BREAKS = {
    "Temperature_ITS90_DegC": (0.0, 2.5, 5.0, 7.5, 10.0, 12.5),
    "Salinity_PSU": (26.0, 28.0, 30.0, 32.0),
    "Density_sigma.theta.kg.m.3": (20.0, 21.0, 22.0, 23.0, 24.0, 25.0, 26.0),
    "Fluorescence_mg_m3": (0.0, 2.0, 4.0, 6.0, 8.0, 10.0),
}
