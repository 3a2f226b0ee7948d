"""Quality-flag operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.codes import CODES, FLAG_LABELS
from ..functions.columns import col, cols, require


def parse_flags(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Flag text to number in the named columns (default: all with ``f_``)."""
    wanted = list(columns) if columns is not None else [c for c in df.columns if "f_" in c]
    require(df, wanted)
    return df.select(*[text.parse_flag(c).alias(c) if c in wanted else col(c) for c in df.columns])


def split_flag(
    df: DataFrame, flag: str, lenient: bool = False, code: str = "f_code", comment: str = "f_comments"
) -> DataFrame:
    """Flag text to a numeric code and the comment after it."""
    number = text.flag_code_lenient(flag) if lenient else text.flag_code(flag)
    return df.withColumns({code: number, comment: text.flag_comment(flag)})


def keep_good(df: DataFrame, flag: str) -> DataFrame:
    """Rows whose numeric flag is 0 or above 1."""
    return df.where(text.is_good(flag))


def rm_flags(
    df: DataFrame, known: Sequence[str], params: Sequence[str] | str = "all"
) -> DataFrame:
    """Blank rejected values and drop the flag columns.

    ``known`` is the registry's list of parameters. A value becomes NULL where
    its flag is -3 or is missing; other flags leave it alone.
    """
    asked = [params] if isinstance(params, str) else list(params)
    valid = {*known, "clevel", "cdepth"}
    unknown = [p for p in asked if p not in valid | {"all", "record"}]
    if unknown:
        raise ValueError(f"one or more parameters are not valid: {unknown}")
    lower = list(dict.fromkeys(c.lower() for c in df.columns))
    if "all" in asked:
        used = sorted(c.replace("f_", "") for c in lower if c in valid | {"f_record"})
        flags = sorted(c for c in lower if "f_" in c)
        if used != [f.replace("f_", "") for f in flags]:
            raise ValueError(f"params and f_params do not match: {used} / {flags}")
    else:
        used = sorted(p.lower() for p in asked)
        flags = [f"f_{p}" for p in used]
    flag_of = dict(zip(used, flags))
    require(df, flags)
    kept: list[str] = []
    for piece in ("site", "station", "date", *used):
        kept += [c for c in df.columns if piece in c.lower() and c not in kept]
    out = []
    for c in kept:
        if c in flags:
            continue
        if c in flag_of:
            f = text.parse_flag(flag_of[c])
            out.append(F.when(f.isNotNull() & (f != -3), col(c)).alias(c))
        else:
            out.append(col(c))
    return df.select(*out)


def qaqc_keep(df: DataFrame, flag_of: Mapping[str, str], codes: Sequence[int]) -> DataFrame:
    """Keep values whose flag is in ``codes``, blank the rest, drop the flags."""
    require(df, [*flag_of, *flag_of.values()])
    drop = set(flag_of.values())
    out = []
    for c in df.columns:
        if c in drop:
            continue
        if c in flag_of:
            out.append(F.when(text.parse_flag(flag_of[c]).isin(*codes), col(c)).alias(c))
        else:
            out.append(col(c))
    return df.select(*out)


def split_suspect(
    df: DataFrame, value: str, flag: str, ok: str = "ok", suspect: str = "suspect"
) -> DataFrame:
    """Rows with flag >= 0; the value goes to ``suspect`` where the flag is 1."""
    return df.where(col(flag) >= 0).withColumns(
        {ok: F.when(col(flag) != 1, col(value)), suspect: F.when(col(flag) == 1, col(value))}
    )


def is_zero_flag(df: DataFrame, flag: str, name: str = "is_zero") -> DataFrame:
    """Whether the flag text contains a 0 (``<10>`` does as well)."""
    return df.withColumn(name, text.is_zero_flag(flag))


def code_dimension(df: DataFrame, program: str) -> DataFrame:
    """The code table of one program as a DataFrame; its size is fixed."""
    if program not in CODES:
        raise ValueError(f"program must be one of {sorted(CODES)}")
    return df.sparkSession.createDataFrame(list(CODES[program].items()), "code string, meaning string")


def flag_label(flag: Column) -> Column:
    return text.recode(flag, FLAG_LABELS)


def decode_flag(df: DataFrame, flag: str, program: str, bare: bool = False) -> DataFrame:
    """One row per code in the flag text, with its meaning in ``program``.

    Adds ``flag``, ``label``, ``code`` and ``meaning``; a text without codes
    keeps one row with NULL code. ``bare`` reads columns that hold codes
    alone, without brackets (``_C`` and ``EC_`` columns): every word of
    capital letters, with a digit or without, is a code. The code table has a
    few dozen fixed rows, hence the broadcast.
    """
    pattern = r"(?<![A-Za-z0-9])([A-Z]{1,3}[0-9]?)(?![A-Za-z0-9])" if bare else r"[\[(]([A-Z]{1,3}[0-9]?)[\])]"
    found = F.regexp_extract_all(col(flag), F.lit(pattern), 1)
    number = text.parse_flag(flag)
    long = df.select(
        *cols(df.columns),
        number.alias("flag"),
        flag_label(number).alias("label"),
        F.explode_outer(found).alias("code"),
    )
    return long.join(F.broadcast(code_dimension(df, program)), "code", "left").select(
        *cols(df.columns), "flag", "label", "code", "meaning"
    )


def qaqc_stage(
    df: DataFrame,
    historical: str = "historical",
    provisionalplus: str = "provisionalplus",
    name: str = "stage",
) -> DataFrame:
    """Review stage a record has reached."""
    return df.withColumn(
        name,
        F.when(col(historical) == 1, "authenticated")
        .when(col(provisionalplus) == 1, "provisional plus")
        .otherwise("provisional"),
    )


def sentinel_to_null(
    df: DataFrame, columns: Sequence[str], sentinels: Sequence[float] = (-99, -99999)
) -> DataFrame:
    """Missing-value sentinels to NULL (-99 today, -99999 in old files)."""
    require(df, columns)
    return df.select(
        *[F.when(~col(c).isin(*sentinels), col(c)).alias(c) if c in columns else col(c) for c in df.columns]
    )


def flag_summary(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column and how often each occurs."""
    return df.groupBy(col(column)).agg(F.count("*").alias("n"))
