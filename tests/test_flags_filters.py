"""Flag operators, filters and their NULL rules."""

import pytest
from pyspark.sql import functions as F

from tidewrack.operators import filters, flags

from .helpers import frame, rows, ts

FLAGS = ["<-5>", "<-4>", "<-3> [GQR]", "<-2>", "<-1>", "<0>", "<1> (CSM)", "<2>", "<3>", "<4>", "<5>", "0", "", None]


def wide(spark):
    data = [("s", float(i), f, 2.0 * i, "<0>") for i, f in enumerate(FLAGS)]
    return spark.createDataFrame(data, "station_code string, temp double, f_temp string, sal double, f_sal string")


def test_rm_flags_blanks_only_rejected_and_unflagged(spark):
    out = flags.rm_flags(wide(spark), known=["temp", "sal"])
    assert out.columns == ["station_code", "sal", "temp"]
    assert sorted(int(r.sal / 2) for r in out.collect() if r.temp is None) == [2, 12, 13]


def test_rm_flags_arguments(spark):
    with pytest.raises(ValueError, match="not valid"):
        flags.rm_flags(wide(spark), ["temp", "sal"], ["chlorine"])
    with pytest.raises(ValueError, match="do not match"):
        flags.rm_flags(wide(spark).drop("f_sal"), ["temp", "sal"])
    some = flags.rm_flags(wide(spark).withColumn("x_temp", F.lit(1)), ["temp", "sal"], ["temp"])
    assert some.columns == ["station_code", "temp", "x_temp"]


def test_qaqc_keep(spark):
    out = flags.qaqc_keep(wide(spark), {"temp": "f_temp"}, range(6))
    assert [r.temp for r in out.orderBy("sal").collect()] == [
        None, None, None, None, None, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0, 11.0, None, None,
    ]
    assert "f_temp" not in out.columns and "f_sal" in out.columns


def test_split_suspect(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 1), (3.0, -3), (4.0, None)], "x double, f int")
    assert rows(flags.split_suspect(df, "x", "f"), "x") == [(1.0, 0, 1.0, None), (2.0, 1, None, 2.0)]


def test_decode_flag(spark):
    df = spark.createDataFrame([("<-3> [GQR] (CSM)",), ("<0>",), ("<1> (WH0)(N)",)], "f string")
    got = rows(flags.decode_flag(df, "f", "water").select("f", "flag", "code", "meaning"))
    assert ("<-3> [GQR] (CSM)", -3, "GQR", "data rejected due to QA/QC checks") in got
    assert ("<0>", 0, None, None) in got and len(got) == 5
    record = rows(flags.decode_flag(df, "f", "record").select("code", "meaning"))
    assert ("WH0", "0 to <0.1 meters") in record and ("N", "from the north") in record
    with pytest.raises(ValueError):
        flags.decode_flag(df, "f", "lunar")


def test_stage_and_sentinel(spark):
    df = spark.createDataFrame([(1, 1, -99.0), (0, 1, 5.0), (0, 0, None)], "historical int, provisionalplus int, x double")
    out = flags.sentinel_to_null(flags.qaqc_stage(df), ["x"])
    assert [(r.stage, r.x) for r in out.collect()] == [
        ("authenticated", None), ("provisional plus", 5.0), ("provisional", None),
    ]


def test_null_rules_of_predicates(spark):
    df = spark.createDataFrame([("lab",), ("A",), (None,)], "s string")
    assert rows(df.where(filters.not_in("s", ["lab"]))) == sorted([("A",), (None,)], key=repr)
    assert rows(df.where(F.col("s") != "lab")) == [("A",)]
    n = spark.createDataFrame([(5,), (50,), (None,)], "r int")
    got = {r[0]: r[1] for r in n.select("r", filters.range_in_list("r", [(1, 5), (7, 9)])).collect()}
    assert got == {5: True, 50: False, None: False}


def test_station_alias_order_decides(spark):
    df = spark.createDataFrame([("kbhs",), ("kbho",), ("zz",)], "c string")
    out = filters.station_alias(df, "c", [("hs|h3", "surface"), ("h", "deep")])
    assert dict(rows(out)) == {"kbhs": "surface", "kbho": "deep", "zz": None}


def test_date_range_end_is_midnight(spark):
    df = frame(spark, "t ts", [("2022-12-31 00:00:00",), ("2022-12-31 00:15:00",), ("1944-01-01 00:00:00",)])
    pick = lambda **k: [r[0] for r in filters.date_range_filter(df, "t", **k).collect()]
    assert pick(start="2008-01-01", end="2022-12-31") == [ts("2022-12-31")]
    assert len(pick(year=2022)) == 2 and len(pick(year_above=2000)) == 2
    assert pick(after="2022-12-31") == [ts("2022-12-31 00:15")]


def test_year_filter_is_pushed_to_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    frame(spark, "t ts", [("2022-12-31 00:00:00",)]).write.parquet(path)
    plan = filters.date_range_filter(spark.read.parquet(path), "t", year=2022)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(t" in plan and "LessThan(t" in plan


def test_drop_any_null_counts_nan(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "b"), (2.0, None)], "x double, s string")
    assert rows(filters.drop_any_null(df)) == [(1.0, "a")]
    assert len(rows(filters.drop_any_null(df, ["s"]))) == 2


def test_params_and_limits(spark):
    reg = spark.createDataFrame([("ATemp,RH,BP",), ("RH",), (None,)], "params_reported string")
    assert rows(filters.explode_params(reg)) == [("ATemp",), ("BP",), ("RH",)]
    df = spark.createDataFrame([(-1.0,), (0.0,), (7.5,), (14.1,), (None,)], "t double")
    out = filters.plausible_range(df, {"t": (0.0, 14.0)}, {"t": (0.0, 5.0, 10.0)})
    assert [tuple(r) for r in out.collect()] == [(None, None), (0.0, 1), (7.5, 2), (None, None), (None, None)]
