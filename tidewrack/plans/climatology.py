"""Climatology, anomalies and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import climate, joins
from . import views
from .registry import query, rounded
from .views import table

MONTHLY = """m AS (
  SELECT o_orderpriority AS site, CAST(year(o_orderdate) AS BIGINT) AS year,
         CAST(month(o_orderdate) AS BIGINT) AS month, avg(o_totalprice) AS var
  FROM orders GROUP BY 1, 2, 3)"""
REF = "r AS (SELECT site, month, avg(var) AS ref, stddev_samp(var) AS sd FROM m GROUP BY 1, 2)"


def orders(spark, sf):
    return table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "site")


def monthly(spark, sf):
    return climate.monthly_means(orders(spark, sf), "o_orderdate", "o_totalprice", ["site"])


@query("monthly_means", f"WITH {MONTHLY} SELECT site, year, month, round(var, 4) AS var FROM m")
def monthly_means(spark, sf):
    return monthly(spark, sf).withColumn("var", rounded("var", 4))


@query("climatology_ref", f"WITH {MONTHLY}, {REF} SELECT site, month, round(ref, 4) AS ref FROM r")
def climatology_ref(spark, sf):
    return climate.climatology_ref(monthly(spark, sf), ["site"]).withColumn("ref", rounded("ref", 4))


@query(
    "climatology_sd",
    f"WITH {MONTHLY}, {REF} SELECT site, month, round(ref, 4) AS mean, round(sd, 4) AS sd FROM r",
)
def climatology_sd(spark, sf):
    out = climate.climatology_sd(monthly(spark, sf), ["site"])
    return out.withColumns({c: rounded(c, 4) for c in ("mean", "sd")})


@query(
    "monthly_anomaly",
    f"""
WITH {MONTHLY}, {REF}
SELECT m.site, m.year, m.month, CAST(make_date(m.year, m.month, 1) AS DATE) AS date,
       round(var, 4) AS var, round(ref, 4) AS ref, round(var - ref, 4) + 0.0 AS anom,
       CASE WHEN var - ref > 0 THEN 'pos' WHEN var - ref <= 0 THEN 'neg' END AS sign
FROM m LEFT JOIN r ON m.site = r.site AND m.month = r.month
""",
)
def monthly_anomaly(spark, sf):
    out = climate.monthly_anomaly(orders(spark, sf), "o_orderdate", "o_totalprice", ["site"])
    return out.withColumns({c: rounded(c, 4) for c in ("var", "ref", "anom")})


@query(
    "monthly_anomaly_flagged",
    f"""
WITH {views.OBS},
good AS (
  SELECT *, {views.sql_flag('f_value')} AS flag FROM obs),
m AS (
  SELECT station_code, CAST(year(datetimestamp) AS BIGINT) AS year, CAST(month(datetimestamp) AS BIGINT) AS month,
         avg(value) AS var FROM good WHERE flag = 0 OR flag > 1 GROUP BY 1, 2, 3),
r AS (SELECT station_code, month, avg(var) AS ref FROM m GROUP BY 1, 2)
SELECT m.station_code, m.year, m.month, CAST(make_date(m.year, m.month, 1) AS DATE) AS date,
       round(var, 6) AS var, round(ref, 6) AS ref, round(var - ref, 6) + 0.0 AS anom,
       CASE WHEN var - ref > 0 THEN 'pos' WHEN var - ref <= 0 THEN 'neg' END AS sign
FROM m JOIN r USING (station_code, month)
""",
)
def monthly_anomaly_flagged(spark, sf):
    from ..functions.text import parse_flag
    from ..operators.flags import keep_good

    good = keep_good(views.obs(spark, sf).withColumn("flag", parse_flag("f_value")), "flag")
    out = climate.monthly_anomaly(good, "datetimestamp", "value", ["station_code"])
    return out.withColumns({c: rounded(c) for c in ("var", "ref", "anom")})


@query(
    "standardise",
    f"""
WITH {MONTHLY}, s AS (SELECT site, avg(var) AS a, stddev_samp(var) AS b FROM m GROUP BY 1)
SELECT m.site, m.year, m.month, round((var - a) / b, 6) + 0.0 AS z FROM m JOIN s USING (site)
""",
)
def standardise(spark, sf):
    out = climate.standardise(monthly(spark, sf), "var", ["site"])
    return out.select("site", "year", "month", rounded("z").alias("z"))


@query(
    "seasonal_pair",
    """
WITH a AS (
  SELECT month, avg(v) AS price, stddev_samp(v) AS price_sd FROM (
    SELECT CAST(month(o_orderdate) AS BIGINT) AS month, year(o_orderdate) AS y, avg(o_totalprice) AS v
    FROM orders GROUP BY 1, 2) GROUP BY 1),
b AS (
  SELECT month, avg(v) AS qty, stddev_samp(v) AS qty_sd FROM (
    SELECT CAST(month(l_shipdate) AS BIGINT) AS month, year(l_shipdate) AS y, avg(l_quantity) AS v
    FROM lineitem GROUP BY 1, 2) GROUP BY 1)
SELECT a.month, round(price, 4) AS price, round(price_sd, 4) AS price_sd, round(qty, 6) AS qty, round(qty_sd, 6) AS qty_sd
FROM a LEFT JOIN b ON a.month = b.month
""",
)
def seasonal_pair(spark, sf):
    out = climate.seasonal_pair(
        table(spark, sf, "orders"),
        table(spark, sf, "lineitem"),
        ("o_orderdate", "l_shipdate"),
        ("o_totalprice", "l_quantity"),
        names=("price", "qty"),
    )
    return out.select(
        "month",
        *[rounded(c, 4).alias(c) for c in ("price", "price_sd")],
        *[rounded(c, 6).alias(c) for c in ("qty", "qty_sd")],
    )


@query(
    "count_by_then_mean",
    f"""
WITH {views.REGISTRY}
SELECT round(avg(n), 6) AS mean_count FROM (
  SELECT site, count(*) AS n FROM registry WHERE status <> 'Inactive' GROUP BY 1)
""",
)
def count_by_then_mean(spark, sf):
    out = climate.count_by_then_mean(views.registry(spark, sf), F.col("status") != "Inactive", ["site"])
    return out.select(rounded("mean_count").alias("mean_count"))


@query(
    "range_of",
    f"""
WITH {views.CAST}
SELECT "Station", min(temp) AS lo, max(temp) AS hi,
       CASE WHEN count(*) = count(temp) THEN min(temp) END AS strict_lo,
       CASE WHEN count(*) = count(temp) THEN max(temp) END AS strict_hi
FROM casts GROUP BY 1
""",
)
def range_of(spark, sf):
    c = views.cast(spark, sf)
    strict = climate.range_of(c, "temp", ["Station"], na_rm=False).toDF("Station", "strict_lo", "strict_hi")
    return joins.left_join_key(climate.range_of(c, "temp", ["Station"]), strict, ["Station"])


@query(
    "column_summary",
    f"""
WITH {views.CAST},
long AS (
  SELECT "Station", 'pressure_db' AS variable, pressure_db AS value FROM casts
  UNION ALL SELECT "Station", 'temp', temp FROM casts)
SELECT "Station", variable, count(*) - count(value) AS n_missing, round(count(value) / count(*), 6) AS complete_rate,
       round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, min(value) AS p0,
       round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50,
       round(quantile_cont(value, 0.75), 6) AS p75, max(value) AS p100
FROM long GROUP BY 1, 2
""",
)
def column_summary(spark, sf):
    out = climate.numeric_summary(views.cast(spark, sf), ["pressure_db", "temp"], ["Station"])
    return out.withColumns(
        {c: rounded(c) for c in ("complete_rate", "mean", "sd", "p25", "p50", "p75")}
    )


@query(
    "column_summary_text",
    f"""
WITH {views.OBS},
long AS (
  SELECT historical, 'f_value' AS variable, f_value AS value FROM obs
  UNION ALL SELECT historical, 'station_code', station_code FROM obs)
SELECT historical, variable, count(*) - count(value) AS n_missing, round(count(value) / count(*), 6) AS complete_rate,
       min(length(value)) AS min_length, max(length(value)) AS max_length, count(*) FILTER (value = '') AS empty,
       count(DISTINCT value) AS n_unique, count(*) FILTER (regexp_full_match(value, '\\s+')) AS whitespace
FROM long GROUP BY 1, 2
""",
)
def column_summary_text(spark, sf):
    out = climate.text_summary(views.obs(spark, sf), ["f_value", "station_code"], ["historical"])
    return out.withColumn("complete_rate", rounded("complete_rate"))


@query(
    "group_extent_label",
    f"""
WITH {views.SAMPLE}
SELECT grp, 'max' AS fun, max(x) AS y, count(*) AS label FROM sample GROUP BY 1
UNION ALL SELECT grp, 'min', min(x), count(*) FROM sample GROUP BY 1
UNION ALL SELECT grp, 'median', round(quantile_cont(x, 0.5), 6), count(*) FROM sample GROUP BY 1
""",
)
def group_extent_label(spark, sf):
    s = views.sample(spark, sf)
    parts = [
        climate.group_extent_label(s, ["grp"], "x", f).select("grp", F.lit(f).alias("fun"), rounded("y").alias("y"), "label")
        for f in ("max", "min", "median")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "mean_min_max_grouped",
    f"""
WITH {views.CAST}
SELECT c."Station", c."Date", c.pressure_db, c.temp, round(s.a, 10) AS mean_temp, s.b AS min_temp, s.c AS max_temp
FROM casts c JOIN (
  SELECT "Station", "Date", CASE WHEN count(*) = count(temp) THEN avg(temp) END AS a,
         CASE WHEN count(*) = count(temp) THEN min(temp) END AS b,
         CASE WHEN count(*) = count(temp) THEN max(temp) END AS c FROM casts GROUP BY 1, 2) s
ON c."Station" = s."Station" AND c."Date" = s."Date"
""",
)
def mean_min_max_grouped(spark, sf):
    out = climate.mean_min_max_grouped(views.cast(spark, sf), ["Station", "Date"], "temp")
    return out.withColumn("mean_temp", rounded("mean_temp", 10))


@query(
    "min_max_span",
    """
SELECT event_type AS station, min(ts) AS start, max(ts) AS "end",
       round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS span_seconds,
       strftime(min(ts), '%m-%d %H:%M:%S') AS start_text
FROM events GROUP BY 1
""",
)
def min_max_span(spark, sf):
    e = table(spark, sf, "events").withColumnRenamed("event_type", "station")
    return climate.min_max_span(e, ["station"], "ts").withColumn("span_seconds", rounded("span_seconds"))
