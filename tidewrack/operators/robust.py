"""Robust statistics of one numeric column per group.

Quantiles are linear-interpolated at ``(n - 1) * p`` and exact. NULL and NaN
are ignored. No group is gathered in one task: quantiles come from
:mod:`.quantiles`, everything else is a map-side combined aggregate over the
rows with their group's quantiles attached.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, cols, number
from .quantiles import ACCURACY, order_stats, quantiles
from .staging import attach

FUNS = ("mean", "var", "sd", "skew")


def _sd(x: Column) -> Column:
    return F.when(F.count(x) > 1, F.stddev_samp(x))


def _skew(x: Column) -> Column:
    n = F.count(x)
    return F.when(n > 1, F.nanvl(F.skewness(x), F.lit(None)) * F.pow((n - 1) / n, F.lit(1.5)))


def _kurtosis(x: Column) -> Column:
    n = F.count(x)
    return F.when(n > 1, (F.nanvl(F.kurtosis(x), F.lit(None)) + 3) * F.pow((n - 1) / n, F.lit(2.0)))


def _fun(name: str, x: Column) -> Column:
    if name == "mean":
        return F.avg(x)
    if name == "var":
        return F.when(F.count(x) > 1, F.var_samp(x))
    if name == "sd":
        return _sd(x)
    return _skew(x)


def _named(fun: str | Sequence[str], name: str) -> dict[str, str]:
    """Output column -> statistic."""
    funs = [fun] if isinstance(fun, str) else list(fun)
    if not funs or any(f not in FUNS for f in funs):
        raise ValueError(f"fun must be one of {FUNS}")
    return {name: fun} if isinstance(fun, str) else {f"{name}_{f}": f for f in funs}


def _fences(df: DataFrame, by: Sequence[str], value: str, k: float, accuracy: int, extra=None):
    q = quantiles(df, by, value, {"_q1": 0.25, "_q3": 0.75, **(extra or {})}, accuracy).drop("_n")
    iqr = F.col("_q3") - F.col("_q1")
    return q.withColumns({"_lo": F.col("_q1") - k * iqr, "_hi": F.col("_q3") + k * iqr})


def trimmed(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    trim: float,
    fun: str | Sequence[str] = "mean",
    name: str = "trimmed",
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Statistic of the sorted values at places floor(n*trim)+1 .. n-floor(n*trim).

    Several statistics are named ``<name>_<fun>`` and share one pass.

    Only the two border values are looked up; rows strictly between them are
    aggregated as they are, and the copies of a border value that fall inside
    are added to the moments by their count.
    """
    named = _named(fun, name)
    cut = F.floor(F.col("_n") * F.lit(float(trim)))
    border = order_stats(
        df,
        by,
        value,
        {"_lo": (float(trim), cut), "_hi": (1.0 - float(trim), F.col("_n") - 1 - cut)},
        accuracy,
    )
    x = number(value)
    rows = attach(df.select(*cols(by), x.alias("_x")), border, by).where(F.col("_x").isNotNull())
    x, lo, hi = F.col("_x"), F.col("_lo"), F.col("_hi")
    mid = F.when((x > lo) & (x < hi), x)
    agg = rows.groupBy(*cols(by), "_n", "_lo", "_hi").agg(
        F.count(mid).alias("_m"),
        F.coalesce(F.avg(mid), F.lit(0.0)).alias("_mu"),
        F.coalesce(F.var_pop(mid), F.lit(0.0)).alias("_v"),
        F.coalesce(F.nanvl(F.skewness(mid), F.lit(0.0)), F.lit(0.0)).alias("_g"),
        F.count_if(x <= lo).alias("_upto_lo"),
        F.count_if(x < hi).alias("_below_hi"),
    )
    same = lo == hi
    a = F.when(same, F.col("_n") - 2 * cut).otherwise(F.col("_upto_lo") - cut)
    b = F.when(same, F.lit(0)).otherwise(F.col("_n") - cut - F.col("_below_hi"))
    agg = agg.withColumns({"_a": a, "_b": b})
    a, b, m = F.col("_a"), F.col("_b"), F.col("_m")
    size = m + a + b
    mean = (m * F.col("_mu") + a * lo + b * hi) / size
    agg = agg.withColumns({"_size": size, "_mean": mean})
    size, mean = F.col("_size"), F.col("_mean")
    d = F.col("_mu") - mean
    sum2 = m * F.col("_v") + m * d * d + a * (lo - mean) ** 2 + b * (hi - mean) ** 2
    sum3 = (
        F.col("_g") * m * F.pow("_v", F.lit(1.5))
        + 3 * d * m * F.col("_v")
        + m * d * d * d
        + a * (lo - mean) ** 3
        + b * (hi - mean) ** 3
    )
    var = F.when(size > 1, sum2 / (size - 1))
    out = {
        "mean": mean,
        "var": var,
        "sd": F.sqrt(var),
        "skew": F.try_divide(sum3 / size, F.pow(F.sqrt(var), F.lit(3.0))),
    }
    return agg.select(*cols(by), *[out[f].alias(n) for n, f in named.items()])


def trim_outliers(
    df: DataFrame, by: Sequence[str], value: str, k: float = 1.5, accuracy: int = ACCURACY
) -> DataFrame:
    """Rows strictly inside the fences Q1 - k*IQR and Q3 + k*IQR."""
    rows = attach(df, _fences(df, by, value, k, accuracy), by)
    x = number(value)
    return rows.where((x > F.col("_lo")) & (x < F.col("_hi"))).select(*cols(df.columns))


def winsorized(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    at: float,
    fun: str | Sequence[str] = "mean",
    name: str = "winsorized",
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Statistic after pulling the tails in to the ``at`` and ``1 - at`` quantiles.

    Several statistics are named ``<name>_<fun>`` and share one pass.
    """
    named = _named(fun, name)
    q = quantiles(df, by, value, {"_lo": at, "_hi": 1.0 - at}, accuracy).drop("_n")
    x = number(value)
    low = F.when(x < F.col("_lo"), F.col("_lo")).otherwise(x)
    clamped = F.when(low > F.col("_hi"), F.col("_hi")).otherwise(low)
    rows = attach(df.select(*cols(by), col(value)), q, by)
    return rows.select(*cols(by), clamped.alias("_x")).groupBy(*cols(by)).agg(
        *[_fun(f, F.col("_x")).alias(n) for n, f in named.items()]
    )


def winsorize_outliers(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    k: float = 1.5,
    name: str = "winsorized",
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Add the value with outliers beyond the fences replaced by the median."""
    rows = attach(df, _fences(df, by, value, k, accuracy, {"_med": 0.5}), by)
    x = number(value)
    out = F.when((x < F.col("_lo")) | (x > F.col("_hi")), F.col("_med")).otherwise(x)
    return rows.select(*cols(df.columns), out.alias(name))


def mean_iqr(
    df: DataFrame, by: Sequence[str], value: str, name: str = "mean_iqr", accuracy: int = ACCURACY
) -> DataFrame:
    """Mean of the values strictly between the quartiles."""
    q = quantiles(df, by, value, {"_q1": 0.25, "_q3": 0.75}, accuracy).drop("_n")
    x = number(value)
    rows = attach(df.select(*cols(by), col(value)), q, by)
    inside = F.when((x > F.col("_q1")) & (x < F.col("_q3")), x)
    return rows.groupBy(*cols(by)).agg(F.avg(inside).alias(name))


def midhinge(df, by, value, name="midhinge", accuracy=ACCURACY) -> DataFrame:
    """(Q1 + Q3) / 2."""
    q = quantiles(df, by, value, {"_q1": 0.25, "_q3": 0.75}, accuracy)
    return q.select(*cols(by), ((F.col("_q1") + F.col("_q3")) / 2).alias(name))


def midrange(df, by, value, name="midrange") -> DataFrame:
    """(min + max) / 2."""
    x = number(value)
    return df.groupBy(*cols(by)).agg(((F.min(x) + F.max(x)) / 2).alias(name))


def trimean(df, by, value, name="trimean", accuracy=ACCURACY) -> DataFrame:
    """Mean of the midhinge and the median."""
    q = quantiles(df, by, value, {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75}, accuracy)
    hinge = (F.col("_q1") + F.col("_q3")) / 2
    return q.select(*cols(by), ((hinge + F.col("_q2")) / 2).alias(name))


def mad(df, by, value, name="mad", accuracy=ACCURACY) -> DataFrame:
    """Median absolute deviation from the median, unscaled."""
    med = quantiles(df, by, value, {"_med": 0.5}, accuracy).drop("_n")
    rows = attach(df.select(*cols(by), number(value).alias("_x")), med, by)
    spread = rows.select(*cols(by), F.abs(F.col("_x") - F.col("_med")).alias("_d"))
    return quantiles(spread, by, "_d", {name: 0.5}, accuracy).drop("_n")


def quantile_range(df, by, value, lower, upper, name="quantile_range", accuracy=ACCURACY) -> DataFrame:
    """Distance between two quantiles."""
    q = quantiles(df, by, value, {"_l": lower, "_u": upper}, accuracy)
    return q.select(*cols(by), (F.col("_u") - F.col("_l")).alias(name))


def _aggregate(f: Callable[[Column], Column], df, by, value, name) -> DataFrame:
    return df.groupBy(*cols(by)).agg(f(number(value)).alias(name))


def skew(df, by, value, name="skew") -> DataFrame:
    """Mean cubed deviation over the cubed sample sd."""
    return _aggregate(_skew, df, by, value, name)


def skew_quantile(df, by, value, p=0.25, name="skew_quantile", accuracy=ACCURACY) -> DataFrame:
    """How far the median sits from the middle of a quantile range."""
    q = quantiles(df, by, value, {"_l": p, "_m": 0.5, "_u": 1.0 - p}, accuracy)
    up, down = F.col("_u") - F.col("_m"), F.col("_m") - F.col("_l")
    return q.select(*cols(by), F.try_divide(up - down, F.col("_u") - F.col("_l")).alias(name))


def skew_np(df, by, value, name="skew_np", accuracy=ACCURACY, times: float = 1.0) -> DataFrame:
    """(mean - median) / sample sd."""
    x = number(value)
    moments = df.groupBy(*cols(by)).agg(F.avg(x).alias("_mean"), _sd(x).alias("_sd"))
    med = quantiles(df, by, value, {"_med": 0.5}, accuracy).drop("_n")
    ratio = F.try_divide(F.col("_mean") - F.col("_med"), F.col("_sd"))
    return attach(moments, med, by).select(*cols(by), (ratio * times).alias(name))


def skew_pearson2(df, by, value, name="skew_pearson2", accuracy=ACCURACY) -> DataFrame:
    """Three times the nonparametric skewness."""
    return skew_np(df, by, value, name, accuracy, times=3.0)


def kurtosis(df, by, value, name="kurtosis") -> DataFrame:
    """Mean fourth power of the sample-sd scores."""
    return _aggregate(_kurtosis, df, by, value, name)


def kurtosis_excess(df, by, value, name="kurtosis_excess") -> DataFrame:
    return _aggregate(lambda x: _kurtosis(x) - 3, df, by, value, name)


def robust_stats_by_group(
    df: DataFrame, by: Sequence[str], value: str, accuracy: int = ACCURACY
) -> DataFrame:
    """All the quantile and moment statistics of each group in one table.

    The quantiles are found once and shared; the median absolute deviation
    needs a second search.
    """
    q = quantiles(
        df, by, value,
        {"q10": 0.1, "q25": 0.25, "median": 0.5, "q75": 0.75, "q90": 0.9},
        accuracy,
    )
    x = number(value)
    rows = attach(df.select(*cols(by), x.alias("_x")), q, by)
    x = F.col("_x")
    keys = [*by, "_n", "q10", "q25", "median", "q75", "q90"]
    inside = F.when((x > F.col("q25")) & (x < F.col("q75")), x)
    low = F.when(x < F.col("q10"), F.col("q10")).otherwise(x)
    wins = F.when(low > F.col("q90"), F.col("q90")).otherwise(low)
    agg = rows.groupBy(*cols(keys)).agg(
        F.avg(x).alias("mean"),
        _sd(x).alias("sd"),
        ((F.min(x) + F.max(x)) / 2).alias("midrange"),
        F.avg(inside).alias("mean_iqr"),
        F.avg(wins).alias("winsorized_mean"),
        _skew(x).alias("skew"),
        _kurtosis(x).alias("kurtosis"),
    )
    hinge = (F.col("q25") + F.col("q75")) / 2
    lop = (F.col("q75") - F.col("median")) - (F.col("median") - F.col("q25"))
    skew_np_ = F.try_divide(F.col("mean") - F.col("median"), F.col("sd"))
    spread = rows.select(*cols(by), F.abs(x - F.col("median")).alias("_d"))
    deviation = quantiles(spread, by, "_d", {"mad": 0.5}, accuracy).drop("_n")
    return attach(agg, deviation, by).select(
        *cols(by), F.col("_n").alias("n"), *cols(keys[len(by) + 1 :]), "mean", "sd", "midrange", "mean_iqr", "winsorized_mean", "mad",
        hinge.alias("midhinge"),
        ((hinge + F.col("median")) / 2).alias("trimean"),
        (F.col("q75") - F.col("q25")).alias("iqr"),
        F.try_divide(lop, F.col("q75") - F.col("q25")).alias("skew_quantile"),
        skew_np_.alias("skew_np"),
        (3 * skew_np_).alias("skew_pearson2"),
        "skew", "kurtosis",
        (F.col("kurtosis") - 3).alias("kurtosis_excess"),
    )
