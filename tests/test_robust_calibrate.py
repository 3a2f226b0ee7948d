"""Robust statistics and calibration against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewrack.operators import calibrate, robust

from .helpers import frame, rows


def sample():
    rng = np.random.default_rng(5)
    a = np.round(rng.normal(10, 3, 700), 0)  # many ties
    b = np.round(rng.exponential(5, 300), 3)
    return {"a": a, "b": b, "c": np.array([1.0, 2.0])}


@pytest.fixture(scope="module")
def data(spark):
    rows_ = [(g, float(v)) for g, x in sample().items() for v in x] + [("a", None), ("a", float("nan"))]
    return spark.createDataFrame(rows_, "g string, x double")


def near(got, want):
    assert set(got) == set(want)
    for k, w in want.items():
        if w is None or (isinstance(w, float) and math.isnan(w)):
            assert got[k] is None, k
        else:
            assert abs(got[k] - w) < 1e-9 * max(1.0, abs(w)), (k, got[k], w)


def skew(x):
    return np.mean((x - x.mean()) ** 3) / x.std(ddof=1) ** 3


FUN = {"mean": np.mean, "var": lambda x: x.var(ddof=1) if len(x) > 1 else None, "sd": lambda x: x.std(ddof=1) if len(x) > 1 else None}


@pytest.mark.parametrize("accuracy", [100, 10_000])
@pytest.mark.parametrize("trim", [0.1, 0.25])
def test_trimmed(data, trim, accuracy):
    def want(x, f):
        k = math.floor(len(x) * trim)
        return FUN[f](np.sort(x)[k : len(x) - k])

    out = robust.trimmed(data, ["g"], "x", trim, list(FUN), accuracy=accuracy).collect()
    for f in FUN:
        near({r.g: r[f"trimmed_{f}"] for r in out}, {g: want(x, f) for g, x in sample().items()})
    one = robust.trimmed(data.where("g <> 'c'"), ["g"], "x", trim, "skew", accuracy=accuracy).collect()
    cut = {g: np.sort(x)[math.floor(len(x) * trim) : len(x) - math.floor(len(x) * trim)] for g, x in sample().items() if g != "c"}
    near({r.g: r.trimmed for r in one}, {g: skew(x) for g, x in cut.items()})


def test_outliers(data):
    kept = robust.trim_outliers(data, ["g"], "x", 1.0).groupBy("g").agg(F.count("*"), F.sum("x")).collect()
    swapped = robust.winsorize_outliers(data, ["g"], "x", 1.0).groupBy("g").agg(F.sum("winsorized")).collect()
    want, want2 = {}, {}
    for g, x in sample().items():
        q1, q3 = np.quantile(x, [0.25, 0.75])
        lo, hi = q1 - (q3 - q1), q3 + (q3 - q1)
        want[g] = float(x[(x > lo) & (x < hi)].sum())
        want2[g] = float(np.where((x < lo) | (x > hi), np.median(x), x).sum())
    near({r.g: r[2] for r in kept}, want)
    near({r.g: r[1] for r in swapped}, want2)


def test_all_statistics(data):
    out = {r.g: r for r in robust.robust_stats_by_group(data, ["g"], "x", accuracy=100).collect()}
    for g, x in sample().items():
        q10, q1, m, q3, q90 = np.quantile(x, [0.1, 0.25, 0.5, 0.75, 0.9])
        s = x.std(ddof=1)
        inside = x[(x > q1) & (x < q3)]
        want = {
            "n": len(x), "q10": q10, "q25": q1, "median": m, "q75": q3, "q90": q90, "mean": x.mean(), "sd": s,
            "midrange": (x.min() + x.max()) / 2, "mean_iqr": inside.mean() if len(inside) else None,
            "winsorized_mean": np.clip(x, q10, q90).mean(), "mad": np.median(abs(x - m)), "midhinge": (q1 + q3) / 2,
            "trimean": ((q1 + q3) / 2 + m) / 2, "iqr": q3 - q1, "skew_quantile": ((q3 - m) - (m - q1)) / (q3 - q1),
            "skew_np": (x.mean() - m) / s, "skew_pearson2": 3 * (x.mean() - m) / s, "skew": skew(x),
            "kurtosis": np.mean(((x - x.mean()) / s) ** 4), "kurtosis_excess": np.mean(((x - x.mean()) / s) ** 4) - 3,
        }
        got = out[g].asDict()
        got.pop("g")
        near(got, {k: float(v) if v is not None else None for k, v in want.items()})


def test_single_statistics_agree_with_the_table(data):
    table = {r.g: r for r in robust.robust_stats_by_group(data, ["g"], "x").collect()}
    for f in (robust.mean_iqr, robust.midhinge, robust.midrange, robust.trimean, robust.mad, robust.skew,
              robust.skew_quantile, robust.skew_np, robust.skew_pearson2, robust.kurtosis, robust.kurtosis_excess):
        near({r[0]: r[1] for r in f(data, ["g"], "x").collect()}, {g: r[f.__name__] for g, r in table.items()})
    wins = robust.winsorized(data, ["g"], "x", 0.1).collect()
    near({r.g: r.winsorized for r in wins}, {g: r.winsorized_mean for g, r in table.items()})
    whole = robust.mad(data.where("g = 'b'"), [], "x").first()[0]
    assert abs(whole - table["b"].mad) < 1e-12
    with pytest.raises(ValueError):
        robust.winsorized(data, ["g"], "x", 0.1, "mode")


CURVE = [(8.0, 1.0, 10.0), (12.0, 2.0, 9.0), (20.0, 4.0, 5.0), (20.0, 6.0, 5.0), (30.0, 10.0, 1.0)]


@pytest.fixture(scope="module")
def curve(spark):
    return spark.createDataFrame(CURVE, "temp double, chla_rfu double, fdom_qsu double")


def test_interpolation(curve):
    out = {(r.param, r.std_temp): r.std_value for r in calibrate.calibration_interpolate(curve, [20, 10, 7.999, 30.0, 30.1]).collect()}
    assert out[("chla_rfu", 20.0)] == 5.0  # repeated knots are averaged
    assert out[("chla_rfu", 10.0)] == 1.5 and out[("chla_rfu", 30.0)] == 10.0
    assert out[("chla_rfu", 7.999)] is None and out[("fdom_qsu", 30.1)] is None
    only = calibrate.calibration_interpolate(curve, param="RFU").collect()
    assert [r.param for r in only] == ["chla_rfu"]


def test_regression(curve):
    t = np.array([r[0] for r in CURVE])
    want = {}
    for i, p in ((1, "chla_rfu"), (2, "fdom_qsu")):
        b, a = np.polyfit(t, np.array([r[i] for r in CURVE]), 1)
        want[p] = float(a + b * 20)
    near({r.param: r.std_value for r in calibrate.calibration_regression(curve).collect()}, want)


@pytest.mark.parametrize("args", [{"std_temp": True}, {"std_temp": "20"}, {"param": ""}, {"param": "salinity"}])
def test_calibration_arguments(curve, args):
    for f in (calibrate.calibration_regression, calibrate.calibration_interpolate):
        with pytest.raises(ValueError):
            f(curve, **args)


def test_t_distribution():
    # closed forms: one degree of freedom is Cauchy, two have an algebraic tail
    for t in (0.0, 0.3, 1.0, 4.7, 60.0):
        assert abs(calibrate.t_two_sided(t, 1) - (1 - 2 / math.pi * math.atan(t))) < 1e-12
        assert abs(calibrate.t_two_sided(t, 2) - (1 - t / math.sqrt(2 + t * t))) < 1e-12
        assert abs(calibrate.t_two_sided(t, 1e7) - math.erfc(t / math.sqrt(2))) < 1e-6


def test_correlation(spark, curve):
    out = {r.param: r for r in calibrate.correlation_test(curve, "temp", ["chla_rfu", "fdom_qsu"]).collect()}
    r = np.corrcoef([c[0] for c in CURVE], [c[1] for c in CURVE])[0, 1]
    got = out["chla_rfu"]
    assert abs(got.estimate - r) < 1e-12 and got.parameter == 3
    assert abs(got.statistic - r * math.sqrt(3 / (1 - r * r))) < 1e-9
    assert abs(got.conf_low - math.tanh(math.atanh(r) - 1.959963984540054 / math.sqrt(2))) < 1e-12
    assert 0 < got.p_value < 0.05 and out["fdom_qsu"].estimate < 0


FLUOR = "Station string, Date_col string, Sample string, Replicate string, F_0 double, F_a double, Vol_ext double, Vol_fil double, Notes string"


def test_chla_pipeline(spark):
    fluor = spark.createDataFrame(
        [
            ("TB03", "5/7/2021", "surface", "1", 10.0, 4.0, 10.0, 100.0, None),
            ("T613", "5/7/2021", "deep", "2", 10.0, 4.0, 10.0, 100.0, "lab replicate"),
            ("lab", "5/7/2021", "deep", "1", 1.0, 1.0, 1.0, 1.0, None),
            (None, "5/7/2021", "middle", "S", 1.0, 0.5, 1.0, 1.0, "cloudy"),
        ],
        FLUOR,
    )
    pairs = spark.createDataFrame([("AlongBay_3", "2021-05-07")] * 2, "Station string, Date string")
    out = rows(calibrate.chla_pipeline(fluor, pairs).select("Station", "Sample", "Replicate", "CHLA_N_MDL_ug/L"))
    assert out == sorted([("AlongBay_3", "S", "1", 0.001), ("NA_NA", None, "S", 0.001)], key=repr)
    plot = rows(calibrate.chla_extremes(fluor, pairs).select("Station", "Sample"))
    assert plot == [("6_13", "D lab-rep"), ("AlongBay_3", "S"), ("NA_NA", "NAS")]


def test_section_grid_meets_the_casts(spark):
    data = [(f"2020-01-{d:02d} 00:00:00", float(y), 10.0 * d + y) for d in (1, 5, 9) for y in (0, 2, 4)]
    data += [("2020-01-01 00:00:00", 0.0, 12.0), ("2020-01-05 00:00:00", 3.0, None)]
    df = frame(spark, "t ts,depth double,v double", data)
    grid = {(r.x, r.y): r.z for r in calibrate.section_grid(df, "v", "t", "depth", nx=9, ny=5).collect()}
    assert len(grid) == 45
    d0 = 18262.0
    assert grid[(d0, 0.0)] == 11.0  # repeated cell averaged
    assert grid[(d0 + 4, 3.0)] == 53.0 and grid[(d0 + 6, 4.0)] == 74.0 and grid[(d0 + 8, 4.0)] == 94.0


def test_profile_bin(spark):
    df = frame(spark, "Station string,Date ts,pressure_db double,v double",
               [("A", "2017-01-01 00:00:00", 3.9, 1.0), ("A", "2016-12-31 00:00:00", 3.9, 1.0), ("A", "2018-01-01 00:00:00", 2.0, None), ("B", "2018-01-01 00:00:00", 2.0, 1.0)])
    out = calibrate.profile_bin(df, "A", "2017-01-01", "2021-12-31")
    assert [(r["Depth.m"], r.v) for r in out.collect()] == [(3.0, 1.0)]


def test_pre_post(spark):
    pre = spark.createDataFrame([(20.5, "H3 2023"), (19.6, "H3 2024")], "temp double, x string")
    post = spark.createDataFrame([(18.4, "SS 2023")], "temp double, x string")
    table = calibrate.pre_post_table(pre, post)
    assert table.columns == ["temp", "site", "year", "when"]
    out = {(r.year, r.variable): r for r in calibrate.pre_post_compare(pre, post, by=["year"]).collect()}
    assert out[("2023", "temp")].p100 == 20.5 and out[("2023", "site")].n_unique == 2
