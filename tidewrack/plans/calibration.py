"""Calibration, chlorophyll and section queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chemistry
from ..operators import calibrate
from . import views
from .registry import query, rounded
from .views import CAST, CURVE, table

TARGETS = [20.0, 8.005, 20.68, 0.999]
TARGET_SQL = ", ".join(f"({t}::DOUBLE)" for t in TARGETS)
LONG = f"""{CURVE}, long AS (
  SELECT temp, 'chla_rfu' AS param, chla_rfu AS y FROM curve UNION ALL SELECT temp, 'fdom_qsu', fdom_qsu FROM curve),
targets(std_temp) AS (VALUES {TARGET_SQL})"""


@query(
    "calibration_regression",
    f"""
WITH {LONG}, fit AS (SELECT param, regr_slope(y, temp) AS b, regr_intercept(y, temp) AS a FROM long GROUP BY 1)
SELECT param, std_temp, round(a + b * std_temp, 5) AS std_value FROM fit, targets
""",
)
def calibration_regression(spark, sf):
    out = calibrate.calibration_regression(views.curve(spark, sf), TARGETS)
    return out.withColumn("std_value", rounded("std_value", 5))


@query(
    "calibration_interpolate",
    f"""
WITH {LONG}, knots AS (SELECT param, temp, avg(y) AS y FROM long GROUP BY 1, 2),
p AS (SELECT DISTINCT param, std_temp FROM knots, targets),
s AS (
  SELECT p.param, p.std_temp, max(k.temp) FILTER (k.temp <= p.std_temp) AS x0, min(k.temp) FILTER (k.temp >= p.std_temp) AS x1,
         arg_max(k.y, k.temp) FILTER (k.temp <= p.std_temp) AS y0, arg_min(k.y, k.temp) FILTER (k.temp >= p.std_temp) AS y1
  FROM p JOIN knots k ON p.param = k.param GROUP BY 1, 2)
SELECT param, std_temp, round(CASE WHEN x0 = x1 THEN y0 WHEN x0 < x1 THEN y0 + (y1 - y0) * (std_temp - x0) / (x1 - x0) END, 5) AS std_value
FROM s
""",
)
def calibration_interpolate(spark, sf):
    out = calibrate.calibration_interpolate(views.curve(spark, sf), TARGETS)
    return out.withColumn("std_value", rounded("std_value", 5))


@query(
    "correlation_test",
    f"""
WITH {LONG},
r AS (SELECT param, corr(temp, y) AS r, count(*) AS n FROM long WHERE temp IS NOT NULL AND y IS NOT NULL GROUP BY 1),
t AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t, n - 2 AS nu FROM r),
k AS (SELECT *, exp(lgamma((nu + 1) / 2.0) - lgamma(nu / 2.0)) / sqrt(nu * pi()) AS c FROM t),
area AS (
  SELECT param, sum((CASE WHEN i = 0 OR i = 20000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
                    * c * power(1 + (abs(t) * i / 20000) * (abs(t) * i / 20000) / nu, -(nu + 1) / 2.0)) * abs(any_value(t)) / 20000 / 3 AS half
  FROM k, generate_series(0, 20000) g(i) GROUP BY 1)
SELECT param, round(r, 8) + 0.0 AS estimate, round(t, 6) + 0.0 AS statistic, round(1 - 2 * half, 6) + 0.0 AS p_value, nu AS parameter,
       round(tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)), 6) + 0.0 AS conf_low,
       round(tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)), 6) + 0.0 AS conf_high
FROM k JOIN area USING (param)
""",
)
def correlation_test(spark, sf):
    out = calibrate.correlation_test(views.curve(spark, sf), "temp", ["chla_rfu", "fdom_qsu"])
    return out.select(
        "param",
        rounded("estimate", 8).alias("estimate"),
        rounded("statistic").alias("statistic"),
        rounded("p_value").alias("p_value"),
        "parameter",
        rounded("conf_low").alias("conf_low"),
        rounded("conf_high").alias("conf_high"),
    )


CHLA = f"(1 / {chemistry.SLOPE}::DOUBLE) * ({chemistry.TAU}::DOUBLE / ({chemistry.TAU}::DOUBLE - 1)) * (\"F_0\" - \"F_a\") * (\"Vol_ext\" / \"Vol_fil\")"


@query(
    "fluor_to_chla",
    f"""
WITH {views.FLUOR} SELECT "F_0", "F_a", "Vol_ext", "Vol_fil", round({CHLA}, 3) AS chla
FROM (SELECT "F_0", round("F_a", 6) AS "F_a", "Vol_ext", "Vol_fil" FROM fluor)
""",
)
def fluor_to_chla(spark, sf):
    x = views.fluor(spark, sf).select("F_0", rounded("F_a").alias("F_a"), "Vol_ext", "Vol_fil")
    return calibrate.with_chla(x).withColumn("chla", rounded("chla", 3))


LABELLED = f"""{views.FLUOR}, clean AS (
  SELECT CASE WHEN "Station" IS NULL THEN 'NA_NA'
              ELSE CASE WHEN "Station"[2:2] = 'B' THEN 'AlongBay' ELSE "Station"[2:2] END || '_' || CAST(CAST("Station"[3:] AS INTEGER) AS VARCHAR) END AS "Station",
         d AS "Date", CASE "Sample" WHEN 'surface' THEN 'S' WHEN 'deep' THEN 'D' END AS "Sample", "Replicate", "Notes", {CHLA} AS chla
  FROM fluor WHERE "Station" IS DISTINCT FROM 'lab')"""


@query(
    "chla_pipeline",
    f"""
WITH {LABELLED}
SELECT "Station", "Date", "Sample", "Replicate", round(chla, 3) AS "CHLA_N_ug/L", 0.001::DOUBLE AS "CHLA_N_MDL_ug/L"
FROM clean WHERE "Notes" IS DISTINCT FROM 'lab replicate'
""",
)
def chla_pipeline(spark, sf):
    out = calibrate.chla_pipeline(views.fluor(spark, sf), views.ctd_pairs(spark, sf))
    return out.withColumn("CHLA_N_ug/L", rounded("CHLA_N_ug/L", 3))


@query(
    "chla_extremes",
    f"""
WITH {LABELLED}, t AS (
  SELECT "Station", "Date", coalesce("Sample", 'NA') || CASE WHEN "Notes" = 'lab replicate' THEN ' lab-rep'
           WHEN "Replicate" IN ('1', '2') THEN '' ELSE "Replicate" END AS "Sample", chla FROM clean)
SELECT t."Station", t."Date", t."Sample", round(a, 3) AS mean_chla, round(b, 3) AS min_chla, round(c, 3) AS max_chla
FROM t JOIN (SELECT "Station", "Date", "Sample", avg(chla) AS a, min(chla) AS b, max(chla) AS c FROM t GROUP BY 1, 2, 3) s
  ON t."Station" = s."Station" AND t."Date" = s."Date" AND t."Sample" = s."Sample"
""",
)
def chla_extremes(spark, sf):
    out = calibrate.chla_extremes(views.fluor(spark, sf), views.ctd_pairs(spark, sf))
    return out.withColumns({c: rounded(c, 3) for c in ("mean_chla", "min_chla", "max_chla")})


@query(
    "profile_bin",
    f"""
WITH {CAST} SELECT "Station", "Date", floor(pressure_db) AS "Depth.m", temp FROM casts
WHERE "Station" = 'A' AND "Date" BETWEEN DATE '1997-01-01' AND DATE '2000-12-31' AND temp IS NOT NULL
""",
)
def profile_bin(spark, sf):
    return calibrate.profile_bin(views.cast(spark, sf), "A", "1997-01-01", "2000-12-31")


@query(
    "section_grid",
    f"""
WITH {CAST},
cells AS (
  SELECT "Station" AS st, CAST("Date" - DATE '1970-01-01' AS DOUBLE) AS x, floor(pressure_db) AS y, avg(temp) AS z
  FROM casts WHERE temp IS NOT NULL GROUP BY 1, 2, 3),
ext AS (SELECT st, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM cells GROUP BY 1),
placed AS (SELECT st, round((x - x0) * 59 / (x1 - x0), 9) AS u, round((y - y0) * 19 / (y1 - y0), 9) AS v, z FROM cells JOIN ext USING (st)),
s1 AS (SELECT *, lead(v) OVER w AS v2, lead(z) OVER w AS z2 FROM placed WINDOW w AS (PARTITION BY st, u ORDER BY v)),
g1 AS (
  SELECT st, u, unnest(generate_series(CAST(ceil(v) AS BIGINT), CAST(CASE WHEN v2 IS NULL THEN floor(v) ELSE ceil(v2) - 1 END AS BIGINT))) AS j, v, v2, z, z2 FROM s1),
d1 AS (SELECT st, u, j, CASE WHEN v2 IS NULL THEN z ELSE z + (z2 - z) * ((j - v) / (v2 - v)) END AS z FROM g1),
s2 AS (SELECT *, lead(u) OVER w AS u2, lead(z) OVER w AS z2 FROM d1 WINDOW w AS (PARTITION BY st, j ORDER BY u)),
g2 AS (
  SELECT st, j, unnest(generate_series(CAST(ceil(u) AS BIGINT), CAST(CASE WHEN u2 IS NULL THEN floor(u) ELSE ceil(u2) - 1 END AS BIGINT))) AS i, u, u2, z, z2 FROM s2),
d2 AS (SELECT st, i, j, CASE WHEN u2 IS NULL THEN z ELSE z + (z2 - z) * ((i - u) / (u2 - u)) END AS z FROM g2)
SELECT st AS "Station", i, j, round(x0 + i * (x1 - x0) / 59, 6) AS x, round(y0 + j * (y1 - y0) / 19, 6) AS y, round(z, 5) AS z
FROM d2 JOIN ext USING (st)
""",
)
def section_grid(spark, sf):
    binned = calibrate.profile_bin(views.cast(spark, sf))
    out = calibrate.section_grid(binned, "temp", by=["Station"], nx=60, ny=20)
    return out.withColumns({"x": rounded("x"), "y": rounded("y"), "z": rounded("z", 5)})


PREPOST = """prepost AS (
  SELECT l_quantity + l_discount AS temp, CASE WHEN l_linestatus = 'O' THEN 'pre' ELSE 'post' END AS "when",
         'H' || l_returnflag AS site, CAST(year(l_shipdate) AS VARCHAR) AS year FROM lineitem)"""


def _summary_sql(by: str, texts: list[str]) -> str:
    parts = " UNION ALL ".join(f"SELECT \"{by}\", '{t}' AS variable, \"{t}\" AS v FROM prepost" for t in texts)
    return f"""
WITH {PREPOST}, texts AS ({parts})
SELECT "{by}", 'temp' AS variable, count(*) - count(temp) AS n_missing, round(count(temp) / count(*), 6) AS complete_rate,
       round(avg(temp), 6) AS mean, round(stddev_samp(temp), 6) AS sd, min(temp) AS p0, round(quantile_cont(temp, 0.25), 6) AS p25,
       round(quantile_cont(temp, 0.5), 6) AS p50, round(quantile_cont(temp, 0.75), 6) AS p75, max(temp) AS p100,
       NULL::BIGINT AS min_length, NULL::BIGINT AS max_length, NULL::BIGINT AS empty, NULL::BIGINT AS n_unique, NULL::BIGINT AS whitespace
FROM prepost GROUP BY 1
UNION ALL
SELECT "{by}", variable, count(*) - count(v), round(count(v) / count(*), 6), NULL, NULL, NULL, NULL, NULL, NULL, NULL,
       min(length(v)), max(length(v)), count(*) FILTER (v = ''), count(DISTINCT v), count(*) FILTER (regexp_full_match(v, '\\s+'))
FROM texts GROUP BY 1, 2
"""


def _pre_post(spark, sf, by):
    li = table(spark, sf, "lineitem")
    x = li.select(
        (F.col("l_quantity") + F.col("l_discount")).alias("temp"),
        F.concat(F.lit("H"), "l_returnflag", F.lit(" "), F.year("l_shipdate").cast("string")).alias("x"),
        "l_linestatus",
    )
    out = calibrate.pre_post_compare(
        x.where("l_linestatus = 'O'").drop("l_linestatus"),
        x.where("l_linestatus <> 'O'").drop("l_linestatus"),
        by=[by],
    )
    return out.withColumns({c: rounded(c) for c in ("complete_rate", "mean", "sd", "p25", "p50", "p75")})


@query("pre_post_compare", _summary_sql("when", ["site", "year"]))
def pre_post_compare(spark, sf):
    return _pre_post(spark, sf, "when")


@query("pre_post_compare_by_year", _summary_sql("year", ["when", "site"]))
def pre_post_compare_by_year(spark, sf):
    return _pre_post(spark, sf, "year")
