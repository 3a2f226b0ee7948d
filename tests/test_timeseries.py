"""Logger repair, deployments, filling, daylight."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewrack.operators import joins, timeseries as tsr

from .helpers import frame, rows, ts

MIN = dt.timedelta(minutes=1)


def stamped(spark, start, n, first_record=100, step=15):
    t0 = ts(start)
    data = [(first_record + i, str(t0 + i * step * MIN)) for i in range(n)]
    return frame(spark, "RECORD int,TIMESTAMP ts", data)


def expected_checks(stamps, tods, width=15, shift=0):
    """The rule, row by row."""
    out = []
    for i, t in enumerate(stamps):
        b1 = stamps[i - 1] if i >= 1 else stamps[0]
        b2 = stamps[i - 2] if i >= 2 else stamps[0]
        if tods[i] is None:
            out.append(None)
            continue
        h, m = map(int, tods[i].split(":"))
        late = h * 60 + m > 1425 and t.date() > b2.date()
        day = (b2 if late else b1).date()
        at = dt.datetime.combine(day, dt.time(h, m))
        hi = t + shift * MIN
        out.append(not (hi - width * MIN <= at <= hi))
    return out


@pytest.mark.parametrize("block_rows", [2, 5, 10_000])
@pytest.mark.parametrize("width,shift", [(15, 0), (17, 0), (15, -2)])
def test_time_of_day_check_around_midnight(spark, block_rows, width, shift):
    rnd = random.Random(3)
    stamps = [ts("2021-09-21 23:00:00") + i * 15 * MIN for i in range(30)]
    fixed = {4: "00:00", 5: "23:59", 3: "23:45", 6: "00:15", 2: None, 0: "23:00"}
    tods = [fixed.get(i, (t - rnd.randint(0, 20) * MIN).strftime("%H:%M")) for i, t in enumerate(stamps)]
    df = frame(spark, "RECORD int,TIMESTAMP ts,MaxTempT string", [(i, str(t), tods[i]) for i, t in enumerate(stamps)])
    out = tsr.time_of_day_check(
        df, tods=["MaxTempT"], width_minutes=width, shift_minutes=shift, block_rows=block_rows
    )
    got = [r.MaxTempT_bad for r in out.orderBy("RECORD").collect()]
    assert got == expected_checks(stamps, tods, width, shift)
    again = tsr.interval_tolerance(
        tsr.time_of_day_check(df, tods=["MaxTempT"]), "TIMESTAMP", ["MaxTempT_check"], width, shift
    )
    assert [r.MaxTempT_bad for r in again.orderBy("RECORD").collect()] == got


def test_bad_count_is_null_when_any_is_unknown(spark):
    df = spark.createDataFrame([(True, True), (True, None), (False, True)], "a boolean, b boolean")
    assert [r[0] for r in df.select(tsr.bad_count(["a", "b"])).collect()] == [2, None, 1]
    assert tsr.all_bad(df, ["a", "b"]).count() == 1 and tsr.any_bad(df, ["a", "b"]).count() == 3


@pytest.mark.parametrize("block_rows", [3, 10_000])
def test_rebuild_shift_and_drop(spark, block_rows):
    df = stamped(spark, "2021-08-29 12:00:00", 20).withColumn(
        "TIMESTAMP", F.when(F.col("RECORD") > 103, F.lit("1944-01-01").cast("timestamp_ntz")).otherwise(F.col("TIMESTAMP"))
    )
    fixed = tsr.rebuild_timestamps(df, 103, block_rows=block_rows)
    same = tsr.rebuild_timestamps(df, 103, gap_free=True)
    assert rows(fixed) == rows(same)
    t0 = ts("2021-08-29 12:45:00")
    got = [r.ts_fix for r in fixed.orderBy("RECORD").collect()]
    assert got == [t0 + i * 15 * MIN for i in range(17)]
    near = tsr.match_old_new(fixed, 4, block_rows=block_rows)
    assert near.count() == 0  # edges are left out, everything else is in 1944
    shifted = tsr.shift_from_records(fixed, [107, 112], block_rows=block_rows)
    s = {r.RECORD: r.ts_shift for r in shifted.collect()}
    fix = {103 + i: t for i, t in enumerate(got)}
    one = {r: fix[r] if r < 107 else fix[r - 1] for r in fix}
    two = {r: one[r] if r < 112 else one[r - 1] for r in fix}
    assert s == two
    final = tsr.drop_repeat_records(shifted, [107, 112])
    assert final.columns == ["RECORD", "TIMESTAMP"]
    stamps = [r.TIMESTAMP for r in final.orderBy("RECORD").collect()]
    assert all(b - a == 15 * MIN for a, b in zip(stamps, stamps[1:]))


def test_match_old_new_excludes_edges(spark):
    df = stamped(spark, "2021-08-29 12:00:00", 12).withColumn("ts_fix", F.col("TIMESTAMP"))
    got = tsr.match_old_new(df, 4, block_rows=3).select("RECORD")
    assert rows(got) == [(104,), (105,), (106,), (107,)]


def test_gaps_voltage_and_hour_shift(spark):
    df = spark.createDataFrame([(1,), (2,), (5,)], "RECORD int")
    assert [r.step for r in tsr.record_gaps(df, block_rows=1).orderBy("RECORD").collect()] == [None, 1, 3]
    v = spark.createDataFrame([(6.9,), (7.0,), (None,)], "AvgVolt double")
    assert rows(tsr.low_voltage(v)) == [(6.9,)]
    t = spark.createDataFrame([(10, "23:30"), (11, "23:30"), (None, "01:05"), (10, None)], "RECORD int, MaxTempT string")
    out = tsr.shift_time_of_day(t, {"MaxTempT": [(10, 10)]})
    assert [r.MaxTempT for r in out.collect()] == ["00:30", "23:30", "01:05", None]


DEPLOY = [
    (0, "2023-01-01 00:00:00", "2023-01-01 01:00:00", "one"),
    (1, "2023-01-01 01:05:00", "2023-01-01 02:00:00", "two"),
    (2, "2023-01-01 02:20:00", "2023-01-01 03:30:00", "one"),
    (3, "2023-01-01 03:31:00", "2023-01-01 05:00:00", "two"),
]


@pytest.mark.parametrize("block_rows", [2, 10_000])
def test_offset_correction(spark, block_rows):
    sal = [30, 30, 30, 30, 30, 33, 33, 34, 33, 29, 28, 28, 28, 28, 28, None, 31, 31, 31, 31, 31]
    t0 = ts("2023-01-01")
    df = frame(spark, "ts ts,sal double", [(str(t0 + i * 15 * MIN), float(s) if s is not None else None) for i, s in enumerate(sal)])
    dep = frame(spark, "seq int,start_ts ts,end_ts ts,label string", DEPLOY)
    x = tsr.deployment_start_number(joins.interval_join_first(df, "ts", dep, name="sonde"), dep, "ts")
    starts = {r.ts.strftime("%H:%M"): r.deploy for r in x.collect() if r.deploy is not None}
    assert starts == {"00:00": 0, "01:15": 1, "02:30": 2, "03:45": 3}
    out = tsr.deployment_offset_correction(x, "two", {"sal": 1}, block_rows=block_rows).orderBy("ts").collect()
    diff = [r.sal_diff for r in out]
    # deployment 1 starts at row 5 with a jump of 3, held to its end at row 8; row 9 is between deployments;
    # deployment 3 starts at row 15 with an unknown jump, so the earlier offset (0) is carried
    assert diff == [0.0] * 5 + [3.0] * 4 + [0.0] * 12
    assert [r.sal for r in out][5:9] == [30.0, 30.0, 31.0, 30.0]
    mirrored = tsr.deployment_offset_correction(x, "two", {"sal": -1}, block_rows=block_rows).orderBy("ts").collect()
    assert [r.sal for r in mirrored] == [r.sal for r in out]
    assert mirrored[5].sal_diff == -3.0


def test_year_windows(spark):
    df = frame(spark, "t ts", [(f"{y}-{d} 00:00:00",) for y in (2019, 2020) for d in ("02-28", "02-28", "03-01", "12-31")]
               + [("2020-02-29 00:00:00",), ("2020-01-01 00:00:00",)])
    keep = tsr.align_year_window(df, "t", "02-29 00:00:00", 86400.0)
    assert rows(keep) == [(ts("2020-02-29"),), (ts("2020-03-01"),)]
    tail = tsr.align_year_window(df, "t", "12-31 00:00:00", 3 * 86400)
    assert rows(tail) == [(ts("2019-12-31"),), (ts("2020-12-31"),)]


def test_quantile_band(spark):
    df = spark.createDataFrame([("d", float(i)) for i in range(11)] + [("e", 5.0)], "s string, x double")
    out = {(r.s, r.x): (r.q10, r.qmean, r.q90) for r in tsr.quantile_band(df, ["s"], "x").collect()}
    assert out[("d", 0.0)] == (1.0, 5.0, 9.0)
    assert out[("e", 5.0)] == (5.0, None, 5.0)


def test_night_flag_three_valued(spark):
    sun = frame(spark, "date ts,rise ts,set ts", [("2022-01-01 00:00:00", "2022-01-01 10:07:00", "2022-01-01 16:15:00"),
                                                   ("2022-01-02 00:00:00", "2022-01-02 10:07:00", "2022-01-02 16:17:00")])
    sun = sun.withColumn("date", F.to_date("date"))
    obs = frame(spark, "t ts,rad double,f string", [
        ("2022-01-01 09:06:00", 2.0, "<0>"), ("2022-01-01 09:07:00", 2.0, "<0>"), ("2022-01-01 09:00:00", 0.5, "<1>"),
        ("2022-01-01 09:01:00", None, "<0>"), ("2022-01-01 12:00:00", None, "<-3>"),
    ])
    out = tsr.night_radiation_flag(obs, sun, "t", "rad", flag="f")
    got = {r.t: r.f for r in out.collect()}
    assert got == {
        ts("2022-01-01 09:06"): "<1> (CSM)", ts("2022-01-01 09:07"): "0", ts("2022-01-01 09:00"): "0",
        ts("2022-01-01 09:01"): None, ts("2022-01-01 12:00"): "0", None: None,
    }


def test_sun_table(spark):
    wide = spark.createDataFrame(
        [("01", "1007 1615", "0919 1724", "0804 1836"), ("29", "0926 1716", None, "0641 1945"), ("31", "0921 1721", "0500 0600", "0635 1949")],
        "day string, m01 string, m02 string, m03 string",
    )
    out = rows(tsr.sun_table_tidy(wide, 2022, ["m01", "m02", "m03"]), "date")
    assert [str(r[0]) for r in out] == ["2022-01-01", "2022-01-29", "2022-01-31", "2022-02-01", "2022-03-01", "2022-03-29", "2022-03-31"]
    assert out[0][1:] == (ts("2022-01-01 10:07"), ts("2022-01-01 16:15"), ts("2022-01-01 09:07"), ts("2022-01-01 17:15"))
