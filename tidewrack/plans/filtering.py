"""Filter and join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock
from ..operators import filters, joins
from . import views
from .registry import query, rounded
from .views import OBS, table

# The order decides, as a code may fit several rules.
SITE_RULES = [("view|cl", "Outer Bay"), ("ckwq|error", "Inner Bay"), ("sign", "Harbor")]


@query(
    "station_alias",
    f"""
WITH {OBS}
SELECT event_id, station_code,
       CASE WHEN regexp_matches(station_code, 'view|cl') THEN 'Outer Bay'
            WHEN regexp_matches(station_code, 'ckwq|error') THEN 'Inner Bay'
            WHEN regexp_matches(station_code, 'sign') THEN 'Harbor' END AS sitename
FROM obs
""",
)
def station_alias(spark, sf):
    return filters.station_alias(
        views.obs(spark, sf).select("event_id", "station_code"), "station_code", SITE_RULES
    )


@query(
    "station_filter_by_program",
    f"""
WITH {OBS}
SELECT 'wq' AS program, station_code FROM (SELECT DISTINCT station_code FROM obs WHERE station_code LIKE '%wq%')
UNION ALL SELECT 'met', station_code FROM (SELECT DISTINCT station_code FROM obs WHERE station_code LIKE '%met%')
UNION ALL SELECT 'nut', station_code FROM (
  SELECT DISTINCT station_code FROM obs WHERE station_code LIKE '%nut%' AND regexp_matches(station_code, 'cl|vi|er'))
""",
)
def station_filter_by_program(spark, sf):
    o = views.obs(spark, sf)
    parts = [
        filters.station_filter_by_program(o, "station_code", p, within).select(
            F.lit(p).alias("program"), "station_code"
        )
        for p, within in (("wq", None), ("met", None), ("nut", "cl|vi|er"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "date_range_filter",
    """
SELECT o_orderkey, o_orderdate FROM orders
WHERE (o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate <= TIMESTAMP '1998-12-31')
UNION ALL SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '2001-03-01'
UNION ALL SELECT o_orderkey, o_orderdate FROM orders WHERE year(o_orderdate) = 1996
UNION ALL SELECT o_orderkey, o_orderdate FROM orders WHERE year(o_orderdate) > 2000
""",
)
def date_range_filter(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    pick = lambda **k: filters.date_range_filter(o, "o_orderdate", **k)
    out = pick(start="1997-01-01", end="1998-12-31")
    for part in (pick(after="2001-03-01"), pick(year=1996), pick(year_above=2000)):
        out = out.unionByName(part)
    return out


@query(
    "drop_any_null",
    f'WITH {views.CAST} SELECT * FROM casts WHERE "Station" IS NOT NULL AND "Date" IS NOT NULL AND pressure_db IS NOT NULL AND temp IS NOT NULL',
)
def drop_any_null(spark, sf):
    return filters.drop_any_null(views.cast(spark, sf))


@query(
    "recode_values",
    """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' END AS o_orderstatus FROM orders
""",
)
def recode_values(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return filters.recode_values(o, "o_orderstatus", {"F": "done", "O": "open"})


RANGES = [(120, 230), (1400, 1486), (5000, 5099)]


@query(
    "range_in_list",
    """
SELECT event_id, (event_id BETWEEN 120 AND 230 OR event_id BETWEEN 1400 AND 1486 OR event_id BETWEEN 5000 AND 5099) AS inside
FROM events
""",
)
def range_in_list(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", filters.range_in_list("event_id", RANGES).alias("inside"))


@query(
    "explode_params",
    """
SELECT DISTINCT unnest(string_split(replace(p_name, ' ', ',') || ',' || lower(p_type), ',')) AS param FROM part
""",
)
def explode_params(spark, sf):
    p = table(spark, sf, "part").select(
        F.concat_ws(",", F.translate("p_name", " ", ","), F.lower("p_type")).alias("params_reported")
    )
    return filters.explode_params(p)


@query(
    "plausible_range",
    f"""
WITH {views.CAST}, t AS (
  SELECT "Station", "Date", CASE WHEN pressure_db BETWEEN 5 AND 45 THEN pressure_db END AS pressure_db,
         CASE WHEN temp BETWEEN 10 AND 60 THEN temp END AS temp FROM casts)
SELECT *, CAST(temp >= 10 AS INTEGER) + CAST(temp >= 20 AS INTEGER) + CAST(temp >= 40 AS INTEGER) AS temp_bin FROM t
""",
)
def plausible_range(spark, sf):
    return filters.plausible_range(
        views.cast(spark, sf),
        {"pressure_db": (5.0, 45.0), "temp": (10.0, 60.0)},
        {"temp": (10.0, 20.0, 40.0)},
    )


@query(
    "left_join_key",
    """
WITH m AS (
  SELECT o_orderpriority AS site, CAST(year(o_orderdate) AS BIGINT) AS year, CAST(month(o_orderdate) AS BIGINT) AS month,
         avg(o_totalprice) AS var FROM orders GROUP BY 1, 2, 3),
r AS (SELECT month, avg(var) AS ref FROM m GROUP BY 1)
SELECT site, year, m.month, round(var, 4) AS var, round(ref, 4) AS ref FROM m LEFT JOIN r ON m.month = r.month
""",
)
def left_join_key(spark, sf):
    from ..operators import climate
    from .climatology import monthly

    m = monthly(spark, sf)
    out = joins.left_join_key(m, climate.climatology_ref(m), ["month"])
    return out.withColumns({c: rounded(c, 4) for c in ("var", "ref")})


@query(
    "right_join_2key",
    """
WITH p AS (SELECT DISTINCT o_custkey AS k, CAST(o_orderdate AS DATE) AS d, 1 AS seen FROM orders)
SELECT CAST(l_suppkey AS BIGINT) AS k, CAST(l_shipdate AS DATE) AS d, seen, l_orderkey, l_extendedprice
FROM p RIGHT JOIN lineitem ON k = l_suppkey AND d = CAST(l_shipdate AS DATE)
""",
)
def right_join_2key(spark, sf):
    p = (
        table(spark, sf, "orders")
        .select(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("d"), F.lit(1).alias("seen"))
        .distinct()
    )
    li = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("k"), F.to_date("l_shipdate").alias("d"), "l_orderkey", "l_extendedprice"
    )
    return joins.right_join_2key(p, li, ["k", "d"])


@query(
    "left_join_suffix",
    f"""
WITH {views.CORRECTIONS}
SELECT l."RECORD", l."TIMESTAMP", c."TIMESTAMP" AS "TIMESTAMP_ok", coalesce(c."TIMESTAMP", l."TIMESTAMP") AS "TIMESTAMP_fix"
FROM logger l LEFT JOIN corrections c ON l."RECORD" = c."RECORD"
""",
)
def left_join_suffix(spark, sf):
    x = views.logger(spark, sf).select("RECORD", "TIMESTAMP")
    return joins.left_join_suffix(x, views.corrections(spark, sf), "RECORD", "TIMESTAMP")


@query(
    "left_join_date",
    f"""
WITH {views.SUN}, days AS (
  SELECT date, rise, "set" FROM sun UNION ALL SELECT date + 40, rise + INTERVAL 40 DAY, "set" + INTERVAL 40 DAY FROM sun)
SELECT CAST(d.date AS DATE) AS date, rise, "set", event_id, ts, value FROM days d LEFT JOIN events e ON CAST(e.ts AS DATE) = d.date
""",
)
def left_join_date(spark, sf):
    from ..functions.clock import plus

    s = views.sun(spark, sf)
    later = s.select(
        F.date_add("date", 40).alias("date"), plus("rise", 40, "DAY").alias("rise"), plus("set", 40, "DAY").alias("set")
    )
    e = table(spark, sf, "events").select("event_id", "ts", "value")
    return joins.left_join_date(s.unionByName(later), e, "date", "ts")


@query(
    "anti_join_all",
    f"""
WITH {views.LOGGER_DUP}, b AS (SELECT * FROM logger WHERE "RECORD" % 4 <> 0)
SELECT * FROM logger_dup a WHERE NOT EXISTS (
  SELECT 1 FROM b WHERE a.station = b.station AND a."TIMESTAMP" = b."TIMESTAMP" AND a."RECORD" = b."RECORD"
    AND a."AvgVolt" = b."AvgVolt" AND a."MaxTempT" IS NOT DISTINCT FROM b."MaxTempT"
    AND a."MinTempT" = b."MinTempT" AND a."MaxWSpdT" = b."MaxWSpdT")
""",
)
def anti_join_all(spark, sf):
    b = views.logger(spark, sf).where(F.col("RECORD") % 4 != 0)
    return joins.anti_join_all(views.logger_dup(spark, sf), b)


INTERVAL_SQL = f"""
WITH {views.DEPLOYMENTS}
SELECT event_id, ts, (SELECT arg_min(label, seq) FROM deployments d WHERE e.ts BETWEEN d.start_ts AND d.end_ts) AS sonde
FROM events e
"""


@query("interval_join_first", INTERVAL_SQL)
def interval_join_first(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts")
    return joins.interval_join_first(e, "ts", views.deployments(spark), name="sonde")


@query(
    "semi_join_list",
    """
SELECT l_orderkey, l_suppkey, l_extendedprice FROM lineitem
WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
""",
)
def semi_join_list(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    s = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return joins.semi_join_list(li, s, "l_suppkey")


@query(
    "interval_join_daylight",
    f"""
WITH {views.SUN}
SELECT event_id, ts, ts BETWEEN rise - INTERVAL 1 HOUR AND "set" + INTERVAL 1 HOUR AS in_daylight
FROM events LEFT JOIN sun ON CAST(ts AS DATE) = date
""",
)
def interval_join_daylight(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts")
    return joins.interval_join_daylight(e, views.sun(spark, sf), "ts")


ALIASES = [("clickwq", "North Pier"), ("clickmet", "North Pier"), ("viewnut", "South Pier"), ("viewnut", "Zone 9")]


@query(
    "station_alias_table",
    f"""
WITH {OBS}, aliases(station_code, sitename) AS (VALUES
  ('clickwq', 'North Pier'), ('clickmet', 'North Pier'), ('viewnut', 'South Pier'), ('viewnut', 'Zone 9'))
SELECT event_id, station_code, (SELECT min(sitename) FROM aliases a WHERE a.station_code = obs.station_code) AS sitename FROM obs
""",
)
def station_alias_table(spark, sf):
    aliases = spark.createDataFrame(ALIASES, "station_code string, sitename string")
    return filters.station_alias_table(views.obs(spark, sf).select("event_id", "station_code"), "station_code", aliases)


@query("station_set", f"WITH {OBS} SELECT event_id, station_code FROM obs WHERE station_code IN ('clickwq', 'clickmet', 'none')")
def station_set(spark, sf):
    o = views.obs(spark, sf).select("event_id", "station_code")
    return filters.station_set(o, "station_code", ["clickwq", "clickmet", "none"])


@query(
    "interval_join_overlapping",
    """
WITH i AS (
  SELECT event_id AS seq, event_type AS label, ts AS s, ts + to_minutes(CAST((event_id * 37) % 3000 AS INTEGER)) AS e FROM events)
SELECT event_id, (SELECT arg_min(label, seq) FROM i WHERE ts + INTERVAL 7 MINUTE BETWEEN s AND e) AS label FROM events
""",
)
def interval_join_overlapping(spark, sf):
    """Each event opens an interval of minutes to two days: thousands are open at any time."""
    e = table(spark, sf, "events")
    n = F.col("event_id")
    spans = e.select(
        n.alias("seq"),
        F.col("event_type").alias("label"),
        F.col("ts").alias("start_ts"),
        clock.plus("ts", (n * 37 % 3000).cast("int"), "MINUTE").alias("end_ts"),
    )
    rows = e.select("event_id", clock.plus("ts", 7, "MINUTE").alias("at"))
    return joins.interval_join_first(rows, "at", spans).drop("at")
