"""Climatology and summaries."""

import math

from tidewrack.operators import climate

from .helpers import frame, rows


def temps(spark):
    data = [
        ("2001-01-05 00:00:00", 1.0), ("2001-01-06 00:00:00", 3.0), ("2001-01-07 00:00:00", None), ("2001-01-08 00:00:00", float("nan")),
        ("2002-01-05 00:00:00", 8.0), ("2001-02-01 00:00:00", 4.0), ("2001-03-01 00:00:00", None),
    ]
    return frame(spark, "t ts,x double", data)


def test_reference_weighs_years_equally(spark):
    out = {(r.year, r.month): r for r in climate.monthly_anomaly(temps(spark), "t", "x").collect()}
    jan = out[(2001, 1)]
    assert (jan["var"], jan.ref, jan.anom, jan.sign) == (2.0, 5.0, -3.0, "neg")
    assert out[(2002, 1)].sign == "pos"
    assert (out[(2001, 2)].anom, out[(2001, 2)].sign) == (0.0, "neg")  # zero counts as negative
    assert (out[(2001, 3)].anom, out[(2001, 3)].sign) == (None, None)
    assert str(jan.date) == "2001-01-01"


def test_anomalies_sum_to_zero_per_month(spark):
    df = spark.range(5000).selectExpr(
        "timestamp_ntz'1999-01-01' + interval '1' day * cast(id as int) t", "pmod(hash(id), 1000) / 7.0 x", "id % 3 site"
    )
    out = climate.monthly_anomaly(df, "t", "x", ["site"]).groupBy("site", "month").sum("anom").collect()
    assert len(out) == 36 and all(abs(r[2]) < 1e-9 for r in out)


def test_sd_needs_two_years(spark):
    monthly = climate.monthly_means(temps(spark), "t", "x")
    out = {r.month: (r.mean, r.sd) for r in climate.climatology_sd(monthly).collect()}
    assert out[1][0] == 5.0 and abs(out[1][1] - math.sqrt(18)) < 1e-12
    assert out[2] == (4.0, None) and out[3] == (None, None)


def test_seasonal_pair_keeps_left_months(spark):
    out = climate.seasonal_pair(temps(spark), temps(spark).where("month(t) = 1"), ("t", "t"), ("x", "x"), names=("temp", "chla"))
    assert rows(out.select("month", "temp", "chla"), "month") == [(1, 5.0, 5.0), (2, 4.0, None), (3, None, None)]


def test_standardise_and_range(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), (None, None)], "g string, x double")
    z = {(r.g, r.x): r.z for r in climate.standardise(df, "x", ["g"]).collect()}
    assert abs(z[("a", 3.0)] - 1 / math.sqrt(2)) < 1e-12 and z[("b", 5.0)] is None
    assert tuple(climate.range_of(df, "x").first()) == (1.0, 5.0)
    assert tuple(climate.range_of(df, "x", na_rm=False).first()) == (None, None)


def test_counts_drop_unknown_status(spark):
    df = spark.createDataFrame([("a", "Active"), ("a", None), ("b", "Active"), ("b", "Active"), ("c", "Inactive")], "s string, st string")
    assert climate.count_by_then_mean(df, df.st != "Inactive", ["s"]).first()[0] == 1.5


def test_group_values_on_rows_with_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", 2.0), ("b", None)], "g string, x double")
    out = climate.mean_min_max_grouped(df, ["g"], "x")
    assert rows(out) == sorted(
        [("a", 1.0, 2.5, 1.0, 4.0), ("a", 4.0, 2.5, 1.0, 4.0), ("b", 2.0, None, None, None), ("b", None, None, None, None)], key=repr
    )


def test_summary_and_labels(spark):
    df = spark.createDataFrame([(1.0, "x"), (2.0, ""), (None, None), (4.0, "  ")], "v double, s string")
    out = {r.variable: r for r in climate.column_summary(df, ["v"], ["s"]).collect()}
    v, s = out["v"], out["s"]
    assert (v.n_missing, v.complete_rate, v.p0, v.p25, v.p50, v.p75, v.p100) == (1, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0)
    assert (s.n_missing, s.min_length, s.max_length, s.empty, s.n_unique, s.whitespace) == (1, 0, 2, 1, 3, 1)
    assert tuple(climate.group_extent_label(df, [], "v", "median").first()) == (2.0, 4)


def test_span(spark):
    r = climate.min_max_span(temps(spark), [], "t").first()
    assert r.span_seconds == (r.end - r.start).total_seconds()
    assert r.start_text == "01-05 00:00:00"
