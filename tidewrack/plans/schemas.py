"""Normalisation and typing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock
from ..operators import schema
from . import views
from .registry import query, rounded
from .views import LOGGER, OBS, table


@query(
    "normalise_wq",
    f"""
WITH {OBS}
SELECT station_code, date_trunc('second', datetimestamp) AS datetimestamp, 0.0::DOUBLE AS historical, 1.0::DOUBLE AS provisionalplus,
       CAST(value AS DOUBLE) AS temp, f_value AS f_temp, TRY_CAST(NULLIF(f_k, '') AS DOUBLE) AS level FROM obs
""",
)
def normalise_wq(spark, sf):
    x = views.obs(spark, sf).select(
        F.col("event_id").alias("RowID"),
        F.col("station_code").alias("Station_Code"),
        F.date_format("datetimestamp", "yyyy-MM-dd HH:mm:ss").alias("DateTimeStamp"),
        F.col("value").cast("string").alias("Temp"),
        F.col("f_value").alias("F_Temp"),
        F.col("f_k").alias("Level"),
    )
    return schema.normalise_wq(x)


@query(
    "normalise_met",
    f"""
WITH {LOGGER}
SELECT station AS "Station Code", "TIMESTAMP" AS "DateTimeStamp",
       strftime("TIMESTAMP" - INTERVAL 3 MINUTE, '%H:%M') AS "MinTempT", strftime("TIMESTAMP" - INTERVAL 5 MINUTE, '%H:%M') AS "MaxTempT",
       strftime("TIMESTAMP" - INTERVAL 7 MINUTE, '%H:%M') AS "MaxWSpdT", CAST("RECORD" AS VARCHAR) AS "F_ATemp", "AvgVolt" AS "ATemp"
FROM logger
""",
)
def normalise_met(spark, sf):
    back = lambda m: clock.plus("TIMESTAMP", -m)
    x = views.logger(spark, sf).select(
        F.col("station").alias("Station Code"),
        F.col("TIMESTAMP").alias("DateTimeStamp"),
        back(3).alias("MinTempT"),
        back(5).alias("MaxTempT"),
        back(7).alias("MaxWSpdT"),
        F.col("RECORD").alias("F_ATemp"),
        F.col("AvgVolt").cast("string").alias("ATemp"),
    )
    return schema.normalise_met(x)


@query(
    "normalise_met_raw",
    f"""
WITH {LOGGER}
SELECT date_trunc('minute', "TIMESTAMP") AS "TIMESTAMP", CAST("RECORD" AS DOUBLE) AS "RECORD", "AvgVolt",
       "MaxTempT", CASE "RECORD" % 3 WHEN 0 THEN '<0>' ELSE '<1>' END AS "F_BP" FROM logger
""",
)
def normalise_met_raw(spark, sf):
    x = views.logger(spark, sf)
    short = F.date_format("TIMESTAMP", "MM/dd/yy HH:mm")
    long = F.date_format("TIMESTAMP", "MM/dd/yyyy HH:mm")
    raw = x.select(
        F.when(F.col("RECORD") % 2 == 0, long).otherwise(short).alias("TIMESTAMP"),
        F.col("RECORD").cast("string").alias("RECORD"),
        F.col("AvgVolt").cast("string").alias("AvgVolt"),
        clock.unpad_hm("MaxTempT").alias("MaxTempT"),
        F.when(F.col("RECORD") % 3 == 0, "<0>").otherwise("<1>").alias("F_BP"),
    )
    return schema.normalise_met_raw(raw)


@query(
    "type_logger",
    f"""
WITH {LOGGER}
SELECT date_trunc('second', "TIMESTAMP") AS "TIMESTAMP", CASE WHEN "RECORD" % 11 <> 0 THEN "RECORD" END AS "RECORD", "AvgVolt", "MaxTempT",
       CASE WHEN "RECORD" % 5 <> 0 THEN CAST("RECORD" AS DOUBLE) END AS "RH" FROM logger
""",
)
def type_logger(spark, sf):
    n = F.col("RECORD")
    raw = views.logger(spark, sf).select(
        F.date_format("TIMESTAMP", "yyyy-MM-dd HH:mm:ss").alias("TIMESTAMP"),
        F.when(n % 11 != 0, n.cast("string")).otherwise("x").alias("RECORD"),
        F.col("AvgVolt").cast("string").alias("AvgVolt"),
        "MaxTempT",
        F.when(n % 5 != 0, n.cast("string")).otherwise("NAN!").alias("RH"),
    )
    return schema.type_logger(raw)


@query(
    "type_logger_yearly",
    f"""
WITH {LOGGER}
SELECT CASE "RECORD" % 3 WHEN 0 THEN date_trunc('second', "TIMESTAMP") WHEN 1 THEN date_trunc('minute', "TIMESTAMP")
       ELSE date_trunc('day', "TIMESTAMP") END AS "DateTimeStamp", "RECORD", "MinTempT" FROM logger
""",
)
def type_logger_yearly(spark, sf):
    n = F.col("RECORD")
    text = (
        F.when(n % 3 == 0, F.date_format("TIMESTAMP", "M/d/yyyy H:mm:ss"))
        .when(n % 3 == 1, F.date_format("TIMESTAMP", "M/d/yyyy H:mm"))
        .otherwise(F.date_format("TIMESTAMP", "M/d/yyyy"))
    )
    raw = views.logger(spark, sf).select(
        n.alias("RowID"), F.col("station").alias("Station Code"), text.alias("TIMESTAMP"), n, "MinTempT"
    )
    return schema.type_logger(
        raw, clock.MDY_HMS_TRUNCATED, rename_stamp="DateTimeStamp", drop=["RowID", "Station Code"]
    )


PAD = """
SELECT event_id, CAST(hour(ts) AS VARCHAR) || ':' || CAST(minute(ts) AS VARCHAR) AS raw, strftime(ts, '%H:%M') AS padded FROM events
"""


@query("pad_hm", PAD)
def pad_hm(spark, sf):
    raw = F.concat_ws(":", F.hour("ts").cast("string"), F.minute("ts").cast("string"))
    x = table(spark, sf, "events").select("event_id", raw.alias("raw"))
    return x.withColumn("padded", clock.pad_hm("raw"))


@query(
    "unpad_hm",
    """
SELECT event_id, CASE WHEN event_id % 31 = 0 THEN 'NA:NA' ELSE CAST(hour(ts) AS VARCHAR) || ':' || CAST(minute(ts) AS VARCHAR) END AS plain
FROM events
""",
)
def unpad_hm(spark, sf):
    n = F.col("event_id")
    x = table(spark, sf, "events").select(n, F.when(n % 31 != 0, F.date_format("ts", "HH:mm")).alias("t"))
    return x.select("event_id", clock.unpad_hm("t").alias("plain"))


@query(
    "parse_datetime",
    """
SELECT event_id, date_trunc('minute', ts) AS mdy_hm, date_trunc('minute', ts) AS dmy_hm, CAST(ts AS DATE) AS mdy,
       CASE WHEN event_id % 4 <> 0 THEN date_trunc('minute', ts) END AS ymd_hm, CAST(ts AS DATE) AS ymd FROM events
""",
)
def parse_datetime(spark, sf):
    n = F.col("event_id")
    fmt = lambda f: F.date_format("ts", f)
    x = table(spark, sf, "events").select(
        n,
        F.when(n % 2 == 0, fmt("M/d/yyyy H:mm")).otherwise(fmt("M/d/yy H:mm")).alias("a"),
        fmt("d/M/yyyy H:mm").alias("b"),
        fmt("MM/dd/yy").alias("c"),
        F.when(n % 4 != 0, fmt("yyyy-MM-dd HH:mm")).otherwise("not a date").alias("d"),
        fmt("yyyy-M-d").alias("e"),
    )
    return x.select(
        "event_id",
        clock.parse_datetime("a", clock.MDY_HM).alias("mdy_hm"),
        clock.parse_datetime("b", clock.DMY_HM).alias("dmy_hm"),
        clock.parse_date("c", clock.MDY).alias("mdy"),
        clock.parse_datetime("d", clock.YMD_HM).alias("ymd_hm"),
        clock.parse_date("e", clock.YMD).alias("ymd"),
    )


@query("fix_century", "SELECT event_id, strftime(ts, '%m/%d/%Y %H:%M') AS stamp FROM events")
def fix_century(spark, sf):
    x = table(spark, sf, "events").select("event_id", F.date_format("ts", "MM/dd/yy HH:mm").alias("t"))
    return x.select("event_id", clock.fix_century("t").alias("stamp"))


@query(
    "format_timestamp",
    "SELECT event_id, strftime(ts, '%m/%d/%Y %H:%M') AS stamp, strftime(ts, '%Y-%m-%d %H:%M:%S') AS iso FROM events",
)
def format_timestamp(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        clock.format_timestamp("ts").alias("stamp"),
        clock.format_timestamp("ts", "yyyy-MM-dd HH:mm:ss").alias("iso"),
    )


@query(
    "select_rename_relocate",
    'SELECT c_nationkey, c_custkey AS "Customer", c_name, c_acctbal AS balance FROM customer',
)
def select_rename_relocate(spark, sf):
    return schema.select_rename_relocate(
        table(spark, sf, "customer"),
        drop=[4],
        rename={"c_custkey": "Customer", "c_acctbal": "balance"},
        front=["c_nationkey"],
        keep_matching="^c_",
    )


@query(
    "stack_evolving",
    f"""
WITH {LOGGER}
SELECT 'homet' AS station_code, "RECORD", "AvgVolt", CAST("RECORD" % 500 AS DOUBLE) AS totsorad, NULL::VARCHAR AS f_totsorad FROM logger WHERE station = 'view'
UNION ALL SELECT 'apmet', "RECORD", "AvgVolt", NULL, NULL FROM logger WHERE station <> 'view'
""",
)
def stack_evolving(spark, sf):
    x = views.logger(spark, sf)
    ho = x.where("station = 'view'").select("RECORD", "AvgVolt", (F.col("RECORD") % 500).cast("double").alias("totsorad"))
    ap = x.where("station <> 'view'").select("AvgVolt", "RECORD")
    return schema.stack_evolving(
        [("homet", ho), ("apmet", ap)], add_null={"totsorad": "double", "f_totsorad": "string"}
    )


@query(
    "split_label",
    """
SELECT p_partkey, split_part(p_name, ' ', 1) AS site, split_part(p_name, ' ', 2) AS year, p_brand[1:5] AS kind, p_brand[6:] AS code FROM part
""",
)
def split_label(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    two = schema.split_label(p, "p_name", ["site", "year"], delimiter=" ")
    return schema.split_label(two, "p_brand", ["kind", "code"], position=5)


@query(
    "unite_label",
    f"""
WITH {OBS} SELECT event_id, station_code || '_' || coalesce(f_value, 'NA') || '_' || CAST(historical AS VARCHAR) AS label FROM obs
""",
)
def unite_label(spark, sf):
    x = views.obs(spark, sf).select("event_id", "station_code", "f_value", "historical")
    return schema.unite_label(x, "label", ["station_code", "f_value", "historical"], "_")


@query(
    "pivot_longer",
    f"""
WITH {views.CAST}
SELECT "Station", "Date", 'pressure_db' AS param, round(pressure_db, 6) AS value FROM casts
UNION ALL SELECT "Station", "Date", 'temp', round(temp, 6) FROM casts
""",
)
def pivot_longer(spark, sf):
    out = schema.pivot_longer(views.cast(spark, sf), ["Station", "Date"], ["pressure_db", "temp"])
    return out.withColumn("value", rounded("value"))
