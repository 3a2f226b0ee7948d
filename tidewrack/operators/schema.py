"""Schema normalisation and typing: one ``select`` built from the column names."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clock, text
from ..functions.columns import col, cols, require


def _is_time(t: T.DataType) -> bool:
    return isinstance(t, T.TimestampNTZType | T.TimestampType)


def _to_timestamp(name: str, t: T.DataType, formats: Sequence[str]) -> Column:
    if _is_time(t) or isinstance(t, T.DateType):
        return col(name).cast("timestamp_ntz")
    return clock.parse_datetime(name, formats)


ISO = ("yyyy-M-d H:mm:ss", "yyyy-M-d H:mm", "yyyy-M-d")


def normalise_wq(df: DataFrame) -> DataFrame:
    """Provisional water-quality sheet to the archive's layout and types."""
    kept = [f for f in df.schema.fields if f.name != "RowID"]
    lower = [f.name.lower() for f in kept]
    if "datetimestamp" not in lower:
        raise ValueError("no datetimestamp column")
    out: list[Column] = []
    for f, name in zip(kept, lower):
        if name in ("historical", "provisionalplus"):
            continue
        if "datetimestamp" in name:
            c = _to_timestamp(f.name, f.dataType, ISO)
        elif re.search(r"(^f_)|station|site", name):
            c = col(f.name).cast("string")
        else:
            c = col(f.name).try_cast("double")
        out.append(c.alias(name))
        if name == "datetimestamp":
            out += [F.lit(0.0).alias("historical"), F.lit(1.0).alias("provisionalplus")]
    return df.select(*out)


MET_TIMES = ("DateTimeStamp", "MinTempT", "MaxTempT", "MaxWSpdT")


def normalise_met(df: DataFrame) -> DataFrame:
    """Reviewed weather sheet: the first rule a name fits decides its type."""
    types = {f.name: f.dataType for f in df.schema.fields}
    bad = [c for c in MET_TIMES if c not in types or not _is_time(types[c])]
    if bad:
        raise ValueError(f"date/time check: {bad} must be timestamps")
    out = []
    for name, t in types.items():
        if "Station" in name:
            c = col(name).cast("string")
        elif "Date" in name:
            c = _to_timestamp(name, t, ISO)
        elif name.endswith("T"):
            c = F.date_format(_to_timestamp(name, t, ISO), "HH:mm")
        elif name.startswith("F_"):
            c = col(name).cast("string")
        else:
            c = col(name).try_cast("double")
        out.append(c.alias(name))
    return df.select(*out)


def normalise_met_raw(df: DataFrame) -> DataFrame:
    """Raw weather file read as text, with either stamp format."""
    out = []
    for name in df.columns:
        if re.search("TIMESTAMP|DateTimeStamp", name):
            c = clock.parse_datetime(name, clock.LOGGER_FORMATS)
        elif "RECORD" in name:
            c = col(name).try_cast("double")
        elif name.endswith("T"):
            c = clock.pad_hm(name)
        elif name.startswith("F_"):
            c = col(name).cast("string")
        else:
            c = col(name).try_cast("double")
        out.append(c.alias(name))
    return df.select(*out)


def type_logger(
    df: DataFrame,
    formats: Sequence[str] = ("yyyy-M-d H:mm:ss",),
    stamp: str = "TIMESTAMP",
    rename_stamp: str | None = None,
    drop: Sequence[str] = (),
) -> DataFrame:
    """Logger text columns to types; names ending in capital T stay text."""
    require(df, [stamp, "RECORD"])
    out = []
    for f in df.schema.fields:
        if f.name in drop:
            continue
        if f.name == stamp:
            c = _to_timestamp(f.name, f.dataType, formats).alias(rename_stamp or stamp)
        elif f.name == "RECORD":
            c = col("RECORD").try_cast("int").alias("RECORD")
        elif f.name.endswith("T") or not isinstance(f.dataType, T.StringType):
            c = col(f.name)
        else:
            c = col(f.name).try_cast("double").alias(f.name)
        out.append(c)
    return df.select(*out)


def select_rename_relocate(
    df: DataFrame,
    drop: Sequence[str | int] = (),
    rename: Mapping[str, str] | None = None,
    front: Sequence[str] = (),
    keep_matching: str | None = None,
) -> DataFrame:
    """Drop (by name or position), keep by pattern, rename, move to the front."""
    dropped = {df.columns[d] if isinstance(d, int) else d for d in drop}
    names = [c for c in df.columns if c not in dropped]
    if keep_matching is not None:
        names = [c for c in names if re.search(keep_matching, c)]
    new = {c: (rename or {}).get(c, c) for c in names}
    ordered = [c for f in front for c in names if new[c] == f]
    require(df, ordered)
    ordered += [c for c in names if c not in ordered]
    return df.select(*[col(c).alias(new[c]) for c in ordered])


def stack_evolving(
    sources: Sequence[tuple[str, DataFrame]],
    label: str = "station_code",
    add_null: Mapping[str, str] | None = None,
) -> DataFrame:
    """Stack tables by name, each under its own label.

    ``add_null`` maps column names to types for columns every result has to
    carry even if no source does. Sorting is left to the reader of the
    result: rows have no order until one is asked for.
    """
    if not sources:
        raise ValueError("nothing to stack")
    out = None
    for name, df in sources:
        part = df.select(F.lit(name).alias(label), *cols(c for c in df.columns if c != label))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    for name, kind in (add_null or {}).items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    return out


def split_label(
    df: DataFrame,
    column: str,
    names: Sequence[str],
    delimiter: str | None = None,
    position: int | None = None,
    keep: bool = False,
) -> DataFrame:
    """Split a text column at a delimiter, or once after a fixed position."""
    if (delimiter is None) == (position is None):
        raise ValueError("give either a delimiter or a position")
    if position is not None:
        if len(names) != 2:
            raise ValueError("a position gives two parts")
        parts = text.split_at(column, position)
    else:
        parts = [text.split_part(column, delimiter, i) for i in range(len(names))]
    new = [p.alias(n) for p, n in zip(parts, names)]
    out: list[Column] = []
    for c in df.columns:
        if c == column:
            out += ([col(c)] if keep else []) + new
        else:
            out.append(col(c))
    return df.select(*out)


def unite_label(
    df: DataFrame, name: str, columns: Sequence[str], sep: str = "_", remove: bool = True
) -> DataFrame:
    """Join columns into ``name``, placed where the first of them was."""
    require(df, columns)
    out: list[Column] = []
    for c in df.columns:
        if c == columns[0]:
            out.append(text.unite(columns, sep).alias(name))
        if c not in columns or not remove:
            if c != name or c in columns:
                out.append(col(c))
    return df.select(*out)


def pivot_longer(
    df: DataFrame,
    ids: Sequence[str],
    columns: Sequence[str],
    name: str = "param",
    value: str = "value",
    drop_null: bool = False,
) -> DataFrame:
    """Wide to long; NULL values are kept unless told otherwise."""
    long = df.unpivot(cols(ids), cols(columns), name, value)
    return long.where(col(value).isNotNull()) if drop_null else long
