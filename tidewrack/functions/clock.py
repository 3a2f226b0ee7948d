"""Date and time expressions on zone-less timestamps (TIMESTAMP_NTZ).

The data carry local standard time without daylight saving, so all
arithmetic is done on TIMESTAMP_NTZ and never passes through the session
time zone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import ColumnLike, col

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"

# Text formats the input files use.
LOGGER_FORMATS = ("MM/dd/yyyy HH:mm", "MM/dd/yy HH:mm")
MDY_HM = ("M/d/yyyy H:mm", "M/d/yy H:mm")
DMY_HM = ("d/M/yyyy H:mm", "d/M/yy H:mm")
MDY = ("M/d/yyyy", "M/d/yy")
YMD = ("yyyy-M-d",)
YMD_HM = ("yyyy-M-d H:mm",)
YMD_HMS = ("yyyy-M-d H:mm:ss",)
MDY_HMS_TRUNCATED = ("M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy H", "M/d/yyyy")


def parse_datetime(c: ColumnLike, formats: Sequence[str]) -> Column:
    """Text to timestamp, first format that fits; NULL when none does."""
    tries = [F.try_to_timestamp(col(c), F.lit(f)) for f in formats]
    return F.coalesce(*tries).cast("timestamp_ntz")


def parse_date(c: ColumnLike, formats: Sequence[str]) -> Column:
    return parse_datetime(c, formats).cast("date")


def format_timestamp(c: ColumnLike, fmt: str = "MM/dd/yyyy HH:mm") -> Column:
    return F.date_format(col(c), fmt)


def fix_century(c: ColumnLike) -> Column:
    """``MM/dd/yy HH:mm`` text to the same with a four-digit 20yy year."""
    return F.date_format(parse_datetime(c, ("MM/dd/yy HH:mm",)), "MM/dd/yyyy HH:mm")


def micros(ts: ColumnLike) -> Column:
    """Microseconds since 1970-01-01, without any time-zone shift."""
    ts = col(ts)
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
    whole = days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    part = (F.extract(F.lit("SECOND"), ts) * 1000000).cast("bigint")
    return whole * F.lit(1000000).cast("bigint") + part


def plus(ts: ColumnLike, amount: Column | int, unit: str = "MINUTE") -> Column:
    """``ts`` moved by a number of units (DAY, HOUR, MINUTE, SECOND)."""
    amount = F.lit(amount) if isinstance(amount, int) else amount
    return col(ts) + F.expr(f"INTERVAL '1' {unit}") * amount


def plus_micros(ts: ColumnLike, amount: Column) -> Column:
    return col(ts) + F.expr("INTERVAL '0.000001' SECOND") * amount


def ceil_to_step(ts: ColumnLike, seconds: int) -> Column:
    """Round up to a multiple of ``seconds``; aligned stamps stay put."""
    rest = F.pmod(micros(ts), F.lit(seconds * 1_000_000).cast("bigint"))
    up = F.pmod(F.lit(seconds * 1_000_000).cast("bigint") - rest, F.lit(seconds * 1_000_000).cast("bigint"))
    return plus_micros(ts, up)


def floor_to_step(ts: ColumnLike, seconds: int) -> Column:
    rest = F.pmod(micros(ts), F.lit(seconds * 1_000_000).cast("bigint"))
    return plus_micros(ts, -rest)


def midnight(ts: ColumnLike) -> Column:
    """Start of the day of ``ts`` as a zone-less timestamp."""
    return F.to_date(col(ts)).cast("timestamp_ntz")


def year(ts: ColumnLike) -> Column:
    return F.year(col(ts)).cast("bigint")


def month(ts: ColumnLike) -> Column:
    return F.month(col(ts)).cast("bigint")


def hm_minutes(c: ColumnLike) -> Column:
    """``H:M`` text to minutes of the day; NULL when it is not a time."""
    part = F.split(col(c), ":")
    return F.get(part, F.lit(0)).try_cast("int") * 60 + F.get(part, F.lit(1)).try_cast("int")


def minutes_hm(minutes: Column) -> Column:
    """Minutes to ``HH:MM`` text, wrapping at midnight."""
    m = F.pmod(minutes, F.lit(1440))
    hour = F.lpad(F.floor(m / 60).cast("string"), 2, "0")
    minute = F.lpad(F.pmod(m, F.lit(60)).cast("string"), 2, "0")
    return F.concat(hour, F.lit(":"), minute)


def pad_hm(c: ColumnLike) -> Column:
    """``"3:2"`` to ``"03:02"`` (seconds, if any, are dropped)."""
    part = F.split(col(c), ":")
    piece = [F.get(part, F.lit(i)).try_cast("int").cast("string") for i in (0, 1)]
    return F.concat(F.lpad(piece[0], 2, "0"), F.lit(":"), F.lpad(piece[1], 2, "0"))


def unpad_hm(c: ColumnLike) -> Column:
    """``"03:02"`` to ``"3:2"``; a missing part becomes the text ``NA``."""
    part = F.split(col(c), ":")
    piece = [
        F.coalesce(F.get(part, F.lit(i)).try_cast("int").cast("string"), F.lit("NA"))
        for i in (0, 1)
    ]
    return F.concat(piece[0], F.lit(":"), piece[1])
