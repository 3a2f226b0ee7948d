"""Robust statistics per group."""

from __future__ import annotations

from ..operators import robust
from . import views
from .registry import query, rounded
from .views import SAMPLE

QUART = """q AS (
  SELECT grp, count(*) AS n, quantile_cont(x, 0.1) AS q10, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS med,
         quantile_cont(x, 0.75) AS q75, quantile_cont(x, 0.9) AS q90, avg(x) AS m, stddev_samp(x) AS s FROM sample GROUP BY 1)"""
ROWS = f"WITH {SAMPLE}, {QUART}"
FROM_ROWS = "FROM sample JOIN q USING (grp)"


def data(spark, sf):
    return views.sample(spark, sf)


def _moment(k: int) -> str:
    return f"avg(power(x - m, {k})) / power(any_value(s), {k})"


TRIM = f"""
{ROWS}, ranked AS (
  SELECT grp, x, row_number() OVER (PARTITION BY grp ORDER BY x) AS i, count(*) OVER (PARTITION BY grp) AS n FROM sample),
kept AS (SELECT grp, x FROM ranked WHERE i BETWEEN floor(n * 0.1::DOUBLE) + 1 AND n - floor(n * 0.1::DOUBLE)),
ks AS (SELECT grp, avg(x) AS m, stddev_samp(x) AS s, var_samp(x) AS v FROM kept GROUP BY 1)
SELECT grp, round(any_value(m), 4) AS trim_mean, round(any_value(v), 0) AS trim_var, round(any_value(s), 4) AS trim_sd,
       round({_moment(3)}, 6) + 0.0 AS trim_skew
FROM kept JOIN ks USING (grp) GROUP BY 1
"""


@query("trimmed", TRIM)
def trimmed(spark, sf):
    out = robust.trimmed(data(spark, sf), ["grp"], "x", 0.1, ["mean", "var", "sd", "skew"], "trim")
    digits = {"trim_mean": 4, "trim_var": 0, "trim_sd": 4, "trim_skew": 6}
    return out.withColumns({c: rounded(c, d) for c, d in digits.items()})


@query(
    "trim_outliers",
    f"""
{ROWS}
SELECT grp, x {FROM_ROWS} WHERE x > q25 - 0.4 * (q75 - q25) AND x < q75 + 0.4 * (q75 - q25)
""",
)
def trim_outliers(spark, sf):
    return robust.trim_outliers(data(spark, sf), ["grp"], "x", k=0.4)


@query(
    "winsorized",
    f"""
{ROWS}, c AS (SELECT grp, least(greatest(x, q10), q90) AS x {FROM_ROWS}),
cs AS (SELECT grp, avg(x) AS m, stddev_samp(x) AS s FROM c GROUP BY 1)
SELECT grp, round(any_value(m), 4) AS wins_mean, round(any_value(s), 4) AS wins_sd, round({_moment(3)}, 6) + 0.0 AS wins_skew
FROM c JOIN cs USING (grp) GROUP BY 1
""",
)
def winsorized(spark, sf):
    out = robust.winsorized(data(spark, sf), ["grp"], "x", 0.1, ["mean", "sd", "skew"], "wins")
    digits = {"wins_mean": 4, "wins_sd": 4, "wins_skew": 6}
    return out.withColumns({c: rounded(c, d) for c, d in digits.items()})


@query(
    "winsorize_outliers",
    f"""
{ROWS}
SELECT grp, x, CASE WHEN x < q25 - 0.4 * (q75 - q25) OR x > q75 + 0.4 * (q75 - q25) THEN round(med, 6) ELSE x END AS winsorized
{FROM_ROWS}
""",
)
def winsorize_outliers(spark, sf):
    out = robust.winsorize_outliers(data(spark, sf), ["grp"], "x", k=0.4)
    return out.withColumn("winsorized", rounded("winsorized"))


@query(
    "mean_iqr",
    f"{ROWS} SELECT grp, round(avg(x) FILTER (x > q25 AND x < q75), 4) AS mean_iqr {FROM_ROWS} GROUP BY 1",
)
def mean_iqr(spark, sf):
    return robust.mean_iqr(data(spark, sf), ["grp"], "x").withColumn("mean_iqr", rounded("mean_iqr", 4))


def _simple(name: str, expr: str, digits: int = 6):
    """Register a statistic whose oracle is one expression over the quartiles."""

    def register(f):
        sql = f"{ROWS} SELECT grp, round({expr}, {digits}) + 0.0 AS {name} FROM q"
        return query(name, sql)(lambda spark, sf: f(data(spark, sf)).withColumn(name, rounded(name, digits)))

    return register


_simple("midhinge", "(q25 + q75) / 2")(lambda d: robust.midhinge(d, ["grp"], "x"))
_simple("trimean", "((q25 + q75) / 2 + med) / 2")(lambda d: robust.trimean(d, ["grp"], "x"))
_simple("quantile_range", "q90 - q10")(lambda d: robust.quantile_range(d, ["grp"], "x", 0.1, 0.9))
_simple("skew_quantile", "((q75 - med) - (med - q25)) / (q75 - q25)", 8)(
    lambda d: robust.skew_quantile(d, ["grp"], "x")
)
_simple("skew_np", "(m - med) / s", 8)(lambda d: robust.skew_np(d, ["grp"], "x"))
_simple("skew_pearson2", "3 * (m - med) / s", 8)(lambda d: robust.skew_pearson2(d, ["grp"], "x"))


@query("midrange", f"WITH {SAMPLE} SELECT grp, round((min(x) + max(x)) / 2, 6) AS midrange FROM sample GROUP BY 1")
def midrange(spark, sf):
    return robust.midrange(data(spark, sf), ["grp"], "x").withColumn("midrange", rounded("midrange"))


@query("mad", f"{ROWS} SELECT grp, round(quantile_cont(abs(x - med), 0.5), 6) AS mad {FROM_ROWS} GROUP BY 1")
def mad(spark, sf):
    return robust.mad(data(spark, sf), ["grp"], "x").withColumn("mad", rounded("mad"))


@query("skew", f"{ROWS} SELECT grp, round({_moment(3)}, 8) + 0.0 AS skew {FROM_ROWS} GROUP BY 1")
def skew(spark, sf):
    return robust.skew(data(spark, sf), ["grp"], "x").withColumn("skew", rounded("skew", 8))


@query("kurtosis", f"{ROWS} SELECT grp, round({_moment(4)}, 8) AS kurtosis {FROM_ROWS} GROUP BY 1")
def kurtosis(spark, sf):
    return robust.kurtosis(data(spark, sf), ["grp"], "x").withColumn("kurtosis", rounded("kurtosis", 8))


@query(
    "kurtosis_excess",
    f"{ROWS} SELECT grp, round({_moment(4)} - 3, 8) + 0.0 AS kurtosis_excess {FROM_ROWS} GROUP BY 1",
)
def kurtosis_excess(spark, sf):
    out = robust.kurtosis_excess(data(spark, sf), ["grp"], "x")
    return out.withColumn("kurtosis_excess", rounded("kurtosis_excess", 8))


@query(
    "robust_stats_by_group",
    f"""
{ROWS},
a AS (
  SELECT grp, any_value(n) AS n, any_value(q10) AS q10, any_value(q25) AS q25, any_value(med) AS median,
         any_value(q75) AS q75, any_value(q90) AS q90, any_value(m) AS mean, any_value(s) AS sd,
         (min(x) + max(x)) / 2 AS midrange, avg(x) FILTER (x > q25 AND x < q75) AS mean_iqr,
         avg(least(greatest(x, q10), q90)) AS winsorized_mean, quantile_cont(abs(x - med), 0.5) AS mad,
         {_moment(3)} AS skew, {_moment(4)} AS kurtosis
  {FROM_ROWS} GROUP BY 1)
SELECT grp, n, round(q10, 6) AS q10, round(q25, 6) AS q25, round(median, 6) AS median, round(q75, 6) AS q75,
       round(q90, 6) AS q90, round(mean, 6) AS mean, round(sd, 6) AS sd, round(midrange, 6) AS midrange,
       round(mean_iqr, 6) AS mean_iqr, round(winsorized_mean, 6) AS winsorized_mean, round(mad, 6) AS mad,
       round((q25 + q75) / 2, 6) AS midhinge, round(((q25 + q75) / 2 + median) / 2, 6) AS trimean,
       round(q75 - q25, 6) AS iqr, round(((q75 - median) - (median - q25)) / (q75 - q25), 6) + 0.0 AS skew_quantile,
       round((mean - median) / sd, 6) + 0.0 AS skew_np, round(3 * (mean - median) / sd, 6) + 0.0 AS skew_pearson2,
       round(skew, 6) + 0.0 AS skew, round(kurtosis, 6) AS kurtosis, round(kurtosis - 3, 6) + 0.0 AS kurtosis_excess
FROM a
""",
)
def robust_stats_by_group(spark, sf):
    out = robust.robust_stats_by_group(data(spark, sf), ["grp"], "x")
    return out.select(
        "grp",
        "n",
        *[rounded(c).alias(c) for c in out.columns if c not in ("grp", "n")],
    )
