"""Logger-clock repair, deployments, filling, bands and daylight checks.

Operators that look at neighbouring rows go through :mod:`.blocks`, so a
single very long series is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock
from ..functions.columns import all_of, any_of, branch, col, cols, number, require
from .blocks import BLOCK_ROWS, Getter, fill_forward, neighbours, row_index, step_and_fill
from .filters import range_in_list
from .joins import daylight, days_with_rows
from .quantiles import quantiles
from .staging import attach

TOD = ("MaxTempT", "MinTempT", "MaxWSpdT")


def record_gaps(
    df: DataFrame,
    by: Sequence[str] = (),
    record: str = "RECORD",
    tie: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``step``: difference to the previous record number, 1 when all is well."""
    near = neighbours(df, by, [record, *tie], [record], lags=[1], block_rows=block_rows)
    return near.select(
        *cols(df.columns), (col(record) - F.col("_lag1").getField(record)).alias("step")
    )


def low_voltage(df: DataFrame, volt: str = "AvgVolt", limit: float = 7.0) -> DataFrame:
    """Records measured below the supply voltage that data can be trusted at."""
    return df.where(col(volt) < limit)


def rebuild_timestamps(
    df: DataFrame,
    anchor_record: int,
    by: Sequence[str] = (),
    record: str = "RECORD",
    ts: str = "TIMESTAMP",
    step_minutes: int = 15,
    tie: Sequence[str] = (),
    gap_free: bool = False,
    name: str = "ts_fix",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """From the anchor record on, stamps at a fixed step from its own stamp.

    The i-th row gets ``first stamp + (i - 1) * step``. When records are known
    to have no gaps the row number follows from the record itself
    (``gap_free``) and no ordering is needed.
    """
    kept = df.where(col(record) >= anchor_record)
    head = kept.groupBy(*cols(by)).agg(
        F.min_by(col(ts), F.struct(*cols([record, *tie]))).alias("_ts0"),
        F.min(col(record)).alias("_r0"),
    )
    if gap_free:
        rows = attach(kept, head, by)
        steps = col(record) - F.col("_r0")
    else:
        numbered = row_index(kept, by, [record, *tie], "_i", block_rows)
        rows = attach(numbered, head, by)
        steps = F.col("_i") - 1
    return rows.select(
        *cols(df.columns), clock.plus("_ts0", steps * step_minutes, "MINUTE").alias(name)
    )


def match_old_new(
    df: DataFrame,
    n: int = 4,
    by: Sequence[str] = (),
    order: Sequence[str] = ("RECORD",),
    ts: str = "TIMESTAMP",
    fixed: str = "ts_fix",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Rows whose old stamp lies between the new stamps n rows away."""
    near = neighbours(df, by, order, [fixed], lags=[n], leads=[n], block_rows=block_rows)
    lo, hi = F.col(f"_lag{n}").getField(fixed), F.col(f"_lead{n}").getField(fixed)
    return near.where(col(ts).between(lo, hi)).select(*cols(df.columns))


def shift_from_records(
    df: DataFrame,
    records: Sequence[int],
    by: Sequence[str] = (),
    record: str = "RECORD",
    ts: str = "ts_fix",
    tie: Sequence[str] = (),
    name: str = "ts_shift",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """From each listed record on, take the previous row's stamp.

    The shifts apply one after the other: the second moves what the first
    produced. Looking back one row per shift covers them all in one pass.
    """
    if not records:
        raise ValueError("no records given")
    depth = len(records)
    near = neighbours(
        df, by, [record, *tie], [record, ts], lags=list(range(1, depth + 1)), block_rows=block_rows
    )

    def at(back: int, field: str) -> Column:
        return col(field) if back == 0 else F.col(f"_lag{back}").getField(field)

    def stamp(level: int, back: int) -> Column:
        """Stamp ``back`` rows earlier after the first ``level`` shifts."""
        if level == 0:
            return at(back, ts)
        r = records[level - 1]
        return F.when(at(back, record) < r, stamp(level - 1, back)).when(
            at(back, record) >= r, stamp(level - 1, back + 1)
        )

    return near.select(*cols(df.columns), stamp(depth, 0).alias(name))


def drop_repeat_records(
    df: DataFrame,
    records: Sequence[int],
    record: str = "RECORD",
    ts: str = "TIMESTAMP",
    shifted: str = "ts_shift",
    helpers: Sequence[str] = ("ts_fix", "ts_shift"),
) -> DataFrame:
    """Adopt the shifted stamps and drop the repeated records and helpers."""
    kept = df.where(~F.coalesce(col(record).isin(*records), F.lit(False)))
    return kept.select(
        *[
            col(shifted).alias(ts) if c == ts else col(c)
            for c in df.columns
            if c == ts or c not in helpers
        ]
    )


def time_of_day_check(
    df: DataFrame,
    by: Sequence[str] = (),
    order: Sequence[str] = ("RECORD",),
    ts: str = "TIMESTAMP",
    tods: Sequence[str] = TOD,
    width_minutes: int = 15,
    shift_minutes: int = 0,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Check time-of-day columns against the interval before each stamp.

    A time of day is dated by the previous row's day; past 23:45, when the
    stamp's day is later than the day two rows back, that earlier day is used.
    Rows before the first count as the first. ``<tod>_bad`` is whether the
    dated time lies outside the closed interval [ts - width, ts], moved by
    ``shift_minutes``; ``n_bad`` adds them up.
    """
    near = neighbours(df, by, order, [ts], lags=[1, 2], first=True, block_rows=block_rows)
    first = F.col("_first").getField(ts)
    back1 = F.when(F.col("_lag1").isNull(), first).otherwise(F.col("_lag1").getField(ts))
    back2 = F.when(F.col("_lag2").isNull(), first).otherwise(F.col("_lag2").getField(ts))
    hi = clock.plus(ts, shift_minutes, "MINUTE")
    lo = clock.plus(ts, shift_minutes - width_minutes, "MINUTE")
    checks, bad = {}, {}
    for t in tods:
        minutes = clock.hm_minutes(t)
        late = (minutes > 23 * 60 + 45) & (F.to_date(col(ts)) > F.to_date(back2))
        day = branch(late, clock.midnight(back2), clock.midnight(back1))
        checks[f"{t}_check"] = clock.plus(day, minutes, "MINUTE")
        bad[f"{t}_bad"] = ~F.col(f"{t}_check").between(lo, hi)
    out = near.withColumns(checks).withColumns(bad)
    return out.select(*cols(df.columns), *cols(checks), *cols(bad), bad_count(list(bad)).alias("n_bad"))


def bad_count(columns: Sequence[str]) -> Column:
    """How many of the checks failed; NULL if any is unknown."""
    flags = [col(c).cast("int") for c in columns]
    return sum(flags[1:], flags[0])


def all_bad(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.where(all_of(cols(columns)))


def any_bad(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.where(any_of(cols(columns)))


def interval_tolerance(
    df: DataFrame,
    ts: str,
    checks: Sequence[str],
    width_minutes: int = 15,
    shift_minutes: int = 0,
) -> DataFrame:
    """Judge already dated ``<tod>_check`` columns by another interval."""
    hi = clock.plus(ts, shift_minutes, "MINUTE")
    lo = clock.plus(ts, shift_minutes - width_minutes, "MINUTE")
    bad = {f"{c.removesuffix('_check')}_bad": ~col(c).between(lo, hi) for c in checks}
    out = df.withColumns(bad)
    return out.withColumn("n_bad", bad_count(list(bad)))


def shift_time_of_day(
    df: DataFrame,
    ranges: Mapping[str, Sequence[tuple[int, int]]],
    minutes: int = 60,
    record: str = "RECORD",
    suffix: str = "",
) -> DataFrame:
    """Move ``HH:MM`` columns inside their record ranges, wrapping at midnight."""
    require(df, ranges)
    new = {}
    for c, rs in ranges.items():
        m = clock.hm_minutes(c)
        new[c + suffix] = clock.minutes_hm(F.when(range_in_list(record, rs), m + minutes).otherwise(m))
    return df.withColumns(new)


def deployment_start_number(
    df: DataFrame,
    deployments: DataFrame,
    ts: str,
    by: Sequence[str] = (),
    start: str = "start_ts",
    number_col: str = "seq",
    step_minutes: int = 15,
    name: str = "deploy",
) -> DataFrame:
    """Number on the row stamped at a deployment's start, rounded up to the step."""
    firsts = (
        deployments.withColumn("_at", clock.ceil_to_step(start, step_minutes * 60))
        .groupBy(*cols(by), "_at")
        .agg(F.min(col(number_col)).alias("_no"))
        .select(*[col(k).alias(f"_k_{k}") for k in by], "_at", "_no")
    )
    on = [df[ts] == firsts["_at"]] + [df[k].eqNullSafe(firsts[f"_k_{k}"]) for k in by]
    return df.join(firsts, all_of(on), "left").select(*cols(df.columns), F.col("_no").alias(name))


def deployment_offset_correction(
    df: DataFrame,
    sonde: str,
    columns: Mapping[str, int],
    by: Sequence[str] = (),
    order: Sequence[str] = ("ts",),
    label: str = "sonde",
    deploy: str = "deploy",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Take the jump at each deployment of one sonde out of its readings.

    At the first row of a deployment the offset is the step from the previous
    reading; it holds until the next offset. Rows of other sondes, and rows
    between deployments, have offset 0. ``columns`` maps a column to +1
    (step measured upward, subtracted) or -1 (downward, added). If a step is
    unknown at a start the earlier offset is carried on. Adds
    ``<column>_diff``.
    """

    def jumps(at: Getter, before: Getter) -> dict[str, Column]:
        here, found = at(label) == sonde, {}
        for c, sign in columns.items():
            jump = F.when(here & at(deploy).isNotNull(), (at(c) - before(c)) * sign)
            found[f"{c}_diff"] = jump.when(here, F.lit(None).cast("double")).otherwise(F.lit(0.0))
        return found

    filled = step_and_fill(df, by, order, list(columns), jumps, block_rows)
    diffs = [f"{c}_diff" for c in columns]
    fixed = {c: (col(c) - sign * F.col(f"{c}_diff")).alias(c) for c, sign in columns.items()}
    return filled.select(*[fixed.get(c, col(c)) for c in df.columns], *cols(diffs))


def fill_down(
    df: DataFrame,
    columns: Sequence[str],
    by: Sequence[str],
    order: Sequence[str],
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Last observation carried forward."""
    return fill_forward(df, by, order, columns, block_rows)


def align_year_window(
    df: DataFrame, ts: str, start_mmdd: str | Column, span_seconds: float | Column
) -> DataFrame:
    """Keep, in every year, the rows within a span from the same calendar start.

    The year is the row's own, so a span across New Year loses its tail, and
    02-29 drops the years that do not have it.
    """
    text = F.lit(start_mmdd) if isinstance(start_mmdd, str) else start_mmdd
    span = F.lit(float(span_seconds)) if isinstance(span_seconds, int | float) else span_seconds
    year = F.lpad(F.year(col(ts)).cast("string"), 4, "0")
    start = F.try_to_timestamp(
        F.concat(year, F.lit("-"), text), F.lit("yyyy-MM-dd HH:mm:ss")
    ).cast("timestamp_ntz")
    end = clock.plus_micros(start, F.round(span * 1_000_000).cast("bigint"))
    return df.where(col(ts).between(start, end))


def quantile_band(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    lo: float = 0.1,
    hi: float = 0.9,
    names: tuple[str, str, str] = ("q10", "qmean", "q90"),
    accuracy: int = 10_000,
) -> DataFrame:
    """Low and high quantile per group, and the mean strictly between, on each row."""
    q_lo, q_mean, q_hi = names
    band = quantiles(df, by, value, {q_lo: lo, q_hi: hi}, accuracy).drop("_n")
    x = number(value)
    inside = F.when((x > F.col(q_lo)) & (x < F.col(q_hi)), x)
    middle = attach(df, band, by).groupBy(*cols(by)).agg(
        F.first(q_lo).alias(q_lo), F.avg(inside).alias(q_mean), F.first(q_hi).alias(q_hi)
    )
    return attach(df, middle, by)


def night_radiation_flag(
    obs: DataFrame,
    sun: DataFrame,
    ts: str,
    radiation: str,
    date: str = "date",
    pad_hours: int = 1,
    flag: str = "f_totsorad",
) -> DataFrame:
    """Flag radiation measured at night; every earlier flag is replaced.

    Days of the sun table without observations keep one row. NULL radiation
    gives a NULL flag outside daylight and ``0`` inside it.
    """
    rounded = obs.withColumn(radiation, F.bround(col(radiation), 0))
    keep = [c for c in obs.columns if c != date]
    o = rounded.select(F.to_date(col(ts)).alias("_on"), *[col(c).alias(c) for c in keep])
    days = daylight(sun, "rise", "set", pad_hours).select(
        col(date).alias(date), "light_from", "light_to"
    )
    night = ~col(ts).between(F.col("light_from"), F.col("light_to")) & (col(radiation) != 0)
    mark = F.when(night, "<1> (CSM)").when(~night, "0").alias(flag)
    return days_with_rows(days, o, date, "_on").select(
        col(date), *[mark if c == flag else col(c) for c in keep], *([] if flag in keep else [mark])
    )


def sun_table_tidy(
    sun: DataFrame, year: int, months: Sequence[str], day: str = "day", pad_hours: int = 1
) -> DataFrame:
    """Rise/set table (days x months of ``"HHMM HHMM"``) to one row per date.

    ``months`` are the month columns, their names ending in the two-digit
    month. Missing days and dates that do not exist are left out.
    """
    long = sun.unpivot([col(day)], cols(months), "_month", "_rise_set").where(
        F.col("_rise_set").isNotNull()
    )
    date = F.concat_ws("-", F.lit(str(year)), F.substring("_month", -2, 2), F.lpad(col(day), 2, "0"))
    stamp = lambda i: F.try_to_timestamp(
        F.concat(date, F.lit(" "), F.get(F.split("_rise_set", " "), F.lit(i))),
        F.lit("yyyy-MM-dd HHmm"),
    ).cast("timestamp_ntz")
    out = long.select(stamp(0).alias("rise"), stamp(1).alias("set")).where(
        F.col("rise").isNotNull() & F.col("set").isNotNull()
    )
    return out.select(
        F.to_date("rise").alias("date"),
        "rise",
        "set",
        clock.plus("rise", -pad_hours, "HOUR").alias("light_from"),
        clock.plus("set", pad_hours, "HOUR").alias("light_to"),
    )
