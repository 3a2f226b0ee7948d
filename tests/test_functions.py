"""Column expressions: flags, clock, labels."""

import datetime as dt


from tidewrack.functions import chemistry, clock, text

from .helpers import frame, rows, ts


def one(spark, value, f, kind="string"):
    return frame(spark, f"x {kind}", [(value,)]).select(f("x").alias("y")).first()[0]


def test_parse_flag(spark):
    cases = {
        "<-3> [GQR] (CSM)": -3, "<0>": 0, "0": 0, "": None, None: None, "abc": None,
        "<10>": 10, "<0> [SSM] <x> (CDF)": 0, "-3": -3,
    }
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    got = {r[0]: r[1] for r in df.select("x", text.parse_flag("x")).collect()}
    assert got == cases


def test_strict_and_lenient_code(spark):
    strict = {"<0>": 0.0, "0": None, "<-3> [GQR] (CSM)": -3.0, "<0> [SSM] <x> (CDF)": None, "": None}
    lenient = {"<0>": 0.0, "0": 0.0, "<-3> [GQR] (CSM)": -3.0, "<10>": 10.0, "<0> [SSM] <x> (CDF)": 0.0}
    for cases, f in ((strict, text.flag_code), (lenient, text.flag_code_lenient)):
        for value, want in cases.items():
            assert one(spark, value, f) == want, value
    assert one(spark, "<-3> [GQR] (CSM)", text.flag_comment) == "[GQR] (CSM)"
    assert one(spark, "<-3>", text.flag_comment) is None


def test_good_flags(spark):
    df = spark.createDataFrame([(f,) for f in (-5, -3, -1, 0, 1, 2, 3, 4, 5, None)], "f int")
    assert [r[0] for r in df.where(text.is_good("f")).collect()] == [0, 2, 3, 4, 5]


def test_times_of_day(spark):
    assert one(spark, "3:2", clock.pad_hm) == "03:02"
    assert one(spark, "12:59:33", clock.pad_hm) == "12:59"
    assert one(spark, "x", clock.pad_hm) is None
    assert one(spark, "03:20", clock.unpad_hm) == "3:20"
    assert one(spark, "03:02", clock.unpad_hm) == "3:2"
    assert one(spark, None, clock.unpad_hm) == "NA:NA"
    assert one(spark, "23:30", lambda c: clock.minutes_hm(clock.hm_minutes(c) + 60)) == "00:30"


def test_datetime_formats_do_not_overlap(spark):
    f = lambda c: clock.parse_datetime(c, clock.MDY_HM)
    assert one(spark, "8/9/2021 5:07", f) == ts("2021-08-09 05:07")
    assert one(spark, "08/09/21 05:07", f) == ts("2021-08-09 05:07")
    assert one(spark, "header", f) is None
    assert one(spark, "9/8/2021 5:07", lambda c: clock.parse_datetime(c, clock.DMY_HM)) == ts("2021-08-09 05:07")
    assert one(spark, "08/09/21 05:07", clock.fix_century) == "08/09/2021 05:07"
    assert one(spark, "3/15/2022", lambda c: clock.parse_datetime(c, clock.MDY_HMS_TRUNCATED)) == ts("2022-03-15")


def test_ceiling_keeps_aligned_stamps(spark):
    up = lambda c: clock.ceil_to_step(c, 900)
    assert one(spark, "2023-01-12 10:52:00", up, "ts") == ts("2023-01-12 11:00")
    assert one(spark, "2023-01-01 00:00:00", up, "ts") == ts("2023-01-01")
    assert one(spark, "2023-01-01 23:59:59.999999", up, "ts") == ts("2023-01-02")
    assert one(spark, "1969-12-31 23:50:00", up, "ts") == ts("1970-01-01")


def test_arithmetic_ignores_the_session_time_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Anchorage")
        # inside the hour that summer time skips
        got = one(spark, "2021-03-14 02:30:00", lambda c: clock.micros(c), "ts")
        want = (ts("2021-03-14 02:30:00") - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
        assert got == want
        assert one(spark, "2021-03-14 01:50:00", lambda c: clock.plus(c, 30), "ts") == ts("2021-03-14 02:20")
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_labels(spark):
    df = spark.createDataFrame([("a", None)], "x string, y string")
    assert df.select(text.unite(["x", "y"], "_")).first()[0] == "a_NA"
    a, b = text.split_at("x", 1)
    assert spark.createDataFrame([("B03",)], "x string").select(a, b).first() == ("B", "03")
    got = rows(
        spark.createDataFrame([("p",), ("q",), (None,)], "x string").select(
            text.recode("x", {"p": "P"}).alias("a"), text.replace_value("x", ["p"], "Z").alias("b")
        )
    )
    assert got == sorted([("P", "Z"), (None, "q"), (None, None)], key=repr)


def test_fluor_to_chla(spark):
    df = spark.createDataFrame([(100.0, 40.0, 10.0, 50.0), (1.0, 1.0, 1.0, 0.0)], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(chemistry.fluor_to_chla("a", "b", "c", "d")).collect()]
    assert abs(got[0] - (1 / 2.8376) * (1.9 / 0.9) * 60 * 0.2) < 1e-12
    assert got[1] is None
