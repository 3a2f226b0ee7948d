"""Duplicates, set comparison, sorting and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality
from . import views
from .registry import query, rounded
from .views import LOGGER, LOGGER_DUP, table

COLS = 'station, "TIMESTAMP", "RECORD", "AvgVolt", "MaxTempT", "MinTempT", "MaxWSpdT"'


@query(
    "duplicate_rows",
    f"""
WITH {LOGGER_DUP}
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {COLS}) AS copy_no FROM logger_dup) WHERE copy_no > 1
""",
)
def duplicate_rows(spark, sf):
    return quality.duplicate_rows(views.logger_dup(spark, sf))


@query(
    "duplicate_count",
    f"WITH {LOGGER_DUP} SELECT (SELECT count(*) FROM logger_dup) - (SELECT count(*) FROM (SELECT DISTINCT * FROM logger_dup)) AS n_duplicates",
)
def duplicate_count(spark, sf):
    return quality.duplicate_count(views.logger_dup(spark, sf))


@query("distinct_rows", f"WITH {LOGGER_DUP} SELECT DISTINCT * FROM logger_dup")
def distinct_rows(spark, sf):
    return quality.distinct_rows(views.logger_dup(spark, sf))


@query(
    "key_repeats",
    """
SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice FROM lineitem
WHERE (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
""",
)
def key_repeats(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    return quality.key_repeats(li, ["l_orderkey", "l_linenumber"])


@query(
    "set_equal",
    f"""
WITH {LOGGER_DUP},
a AS (SELECT DISTINCT "RECORD", round_even("AvgVolt", 1) AS v FROM logger_dup),
b AS (SELECT DISTINCT "RECORD", round_even("AvgVolt", 1) AS v FROM logger),
c AS (SELECT DISTINCT "RECORD", round_even(CASE WHEN "RECORD" % 50 = 0 THEN "AvgVolt" + 3 ELSE "AvgVolt" END, 1) AS v FROM logger)
SELECT 'copies' AS pair, oa = 0 AND ob = 0 AS set_equal, oa AS only_a, ob AS only_b FROM (
  SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS oa, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS ob)
UNION ALL
SELECT 'changed', oa = 0 AND ob = 0, oa, ob FROM (
  SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM c)) AS oa, (SELECT count(*) FROM (SELECT * FROM c EXCEPT SELECT * FROM a)) AS ob)
""",
)
def set_equal(spark, sf):
    a = views.logger_dup(spark, sf).select("RECORD", "AvgVolt")
    b = views.logger(spark, sf).select("RECORD", "AvgVolt")
    moved = F.when(F.col("RECORD") % 50 == 0, F.col("AvgVolt") + 3).otherwise(F.col("AvgVolt"))
    c = b.withColumn("AvgVolt", moved)
    same = quality.set_equal(a, b, 1).select(F.lit("copies").alias("pair"), "*")
    return same.unionByName(quality.set_equal(a, c, 1).select(F.lit("changed").alias("pair"), "*"))


FILES = f"""{LOGGER}, files AS (
  SELECT 'oct' AS file, "RECORD", "TIMESTAMP", "AvgVolt" FROM logger
  UNION ALL SELECT 'nov', "RECORD", "TIMESTAMP", "AvgVolt" FROM logger, (SELECT max("RECORD") AS top FROM logger)
  WHERE "RECORD" * 2 < top)"""


@query(
    "file_overlap",
    f"""
WITH {FILES},
nov AS (SELECT "RECORD", "TIMESTAMP", "AvgVolt" FROM files WHERE file = 'nov'),
head AS (
  SELECT "RECORD", "TIMESTAMP", "AvgVolt" FROM (
    SELECT *, row_number() OVER (ORDER BY "RECORD") AS i FROM files WHERE file = 'oct') WHERE i <= (SELECT count(*) FROM nov))
SELECT file, count(*) AS n, min("RECORD") AS min_record, max("RECORD") AS max_record, min("TIMESTAMP") AS min_ts,
       max("TIMESTAMP") AS max_ts, (SELECT count(*) FROM (SELECT * FROM head EXCEPT ALL SELECT * FROM nov)) AS prefix_missing
FROM files GROUP BY 1
""",
)
def file_overlap(spark, sf):
    x = views.logger(spark, sf).select("RECORD", "TIMESTAMP", "AvgVolt")
    top = x.agg(F.max("RECORD")).scalar()
    both = x.select(F.lit("oct").alias("file"), "*").unionByName(
        x.where(F.col("RECORD") * 2 < top).select(F.lit("nov").alias("file"), "*")
    )
    return quality.file_overlap(both, "file", "RECORD", "TIMESTAMP", "oct", "nov")


@query(
    "records_after",
    f"""
WITH {views.CORRECTIONS}
SELECT "RECORD", "TIMESTAMP", "AvgVolt" FROM logger WHERE "RECORD" > (SELECT max("RECORD") FROM corrections WHERE "TIMESTAMP" < TIMESTAMP '2024-01-15')
""",
)
def records_after(spark, sf):
    fixes = views.corrections(spark, sf).where(F.col("TIMESTAMP") < F.lit("2024-01-15").cast("timestamp_ntz"))
    x = views.logger(spark, sf).select("RECORD", "TIMESTAMP", "AvgVolt")
    return quality.records_after(x, fixes, "RECORD")


@query(
    "time_cutoff",
    f"""
WITH {LOGGER}
SELECT "RECORD", "TIMESTAMP", "AvgVolt" FROM (
  SELECT *, row_number() OVER (ORDER BY "RECORD") AS i FROM logger WHERE "TIMESTAMP" < TIMESTAMP '2024-01-16 00:00:00') WHERE i > 2
""",
)
def time_cutoff(spark, sf):
    x = views.logger(spark, sf).select("RECORD", "TIMESTAMP", "AvgVolt")
    return quality.time_cutoff(x, "TIMESTAMP", "2024-01-16 00:00:00", 2, ["RECORD"])


@query(
    "union_all",
    f"""
WITH {LOGGER}
SELECT "RECORD", "AvgVolt", NULL::VARCHAR AS "MinTempT" FROM logger
UNION ALL SELECT "RECORD", NULL, "MinTempT" FROM logger
""",
)
def union_all(spark, sf):
    x = views.logger(spark, sf)
    return quality.union_all([x.select("RECORD", "AvgVolt"), x.select("MinTempT", "RECORD")], lenient=True)


@query(
    "repair_embedded_headers",
    """
WITH t AS (
  SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'Date (MM/DD/YYYY)' ELSE strftime(ts, '%m/%d/%Y') END AS d,
         CASE WHEN event_id % 50 = 0 THEN 'Time (HH:mm:ss)' WHEN event_id % 77 = 0 THEN NULL ELSE strftime(ts, '%H:%M:%S') END AS t,
         CASE WHEN event_id % 50 = 0 THEN 'Value' ELSE CAST(user_id AS VARCHAR) END AS v FROM events)
SELECT 'date' AS variant, event_id, d AS "Date (MM/DD/YYYY)", t AS "Time (HH:mm:ss)", v FROM t WHERE event_id % 50 <> 0
UNION ALL SELECT 'date and time', event_id, d, t, v FROM t WHERE event_id % 50 <> 0 AND t IS NOT NULL
""",
)
def repair_embedded_headers(spark, sf):
    e, n = table(spark, sf, "events"), F.col("event_id")
    x = e.select(
        n,
        F.when(n % 50 == 0, "Date (MM/DD/YYYY)").otherwise(F.date_format("ts", "MM/dd/yyyy")).alias("Date (MM/DD/YYYY)"),
        F.when(n % 50 == 0, "Time (HH:mm:ss)")
        .when(n % 77 != 0, F.date_format("ts", "HH:mm:ss"))
        .alias("Time (HH:mm:ss)"),
        F.when(n % 50 == 0, "Value").otherwise(F.col("user_id").cast("string")).alias("v"),
    )
    one = quality.repair_embedded_headers(x, need_time=False, sort=False)
    two = quality.repair_embedded_headers(x, need_time=True, sort=False)
    return one.select(F.lit("date").alias("variant"), "*").unionByName(
        two.select(F.lit("date and time").alias("variant"), "*")
    )


@query(
    "sort_rows",
    f"""
WITH {views.CAST}
SELECT "Station", "Date", temp, round(pressure_db, 6) AS pressure_db FROM casts ORDER BY "Date" NULLS LAST, temp NULLS LAST
""",
)
def sort_rows(spark, sf):
    c = views.cast(spark, sf).select("Station", "Date", "temp", rounded("pressure_db").alias("pressure_db"))
    return quality.sort_rows(c, ["Date", "temp"])


@query(
    "head_rows",
    f"""
WITH {LOGGER}
SELECT station, "RECORD", "AvgVolt" FROM (
  SELECT *, row_number() OVER (PARTITION BY station ORDER BY "RECORD") AS i FROM logger) WHERE i <= 5
""",
)
def head_rows(spark, sf):
    x = views.logger(spark, sf).select("station", "RECORD", "AvgVolt")
    return quality.head_rows(x, 5, ["RECORD"], ["station"])


@query(
    "drop_first",
    f"""
WITH {LOGGER}
SELECT station, "RECORD", "AvgVolt" FROM (
  SELECT *, row_number() OVER (PARTITION BY station ORDER BY "RECORD") AS i FROM logger) WHERE i > 2
""",
)
def drop_first(spark, sf):
    x = views.logger(spark, sf).select("station", "RECORD", "AvgVolt")
    return quality.drop_first(x, 2, ["RECORD"], ["station"])


@query(
    "drop_first_ties",
    """
WITH t AS (SELECT event_type AS station, CAST(floor(event_id / 8) AS BIGINT) AS slot FROM events)
SELECT station, slot FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY slot) AS i FROM t) WHERE i > 3
""",
)
def drop_first_ties(spark, sf):
    """Exactly three rows of each station go, although several share a place."""
    x = table(spark, sf, "events").select(
        F.col("event_type").alias("station"), F.floor(F.col("event_id") / 8).cast("bigint").alias("slot")
    )
    return quality.drop_first(x, 3, ["slot"], ["station"])


@query(
    "repair_embedded_headers_sorted",
    """
WITH t AS (
  SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'Date (MM/DD/YYYY)' ELSE strftime(ts, '%m/%d/%Y') END AS d,
         CASE WHEN event_id % 77 = 0 THEN NULL ELSE strftime(ts, '%H:%M:%S') END AS t FROM events)
SELECT event_id, d AS "Date (MM/DD/YYYY)", t AS "Time (HH:mm:ss)",
       row_number() OVER (ORDER BY strptime(d, '%m/%d/%Y'), t NULLS LAST, event_id) - 1 AS place
FROM t WHERE event_id % 50 <> 0
""",
)
def repair_embedded_headers_sorted(spark, sf):
    """The sorted rows with the place each came out at, counted over the partitions in order."""
    e, n = table(spark, sf, "events"), F.col("event_id")
    x = e.select(
        n,
        F.when(n % 50 == 0, "Date (MM/DD/YYYY)").otherwise(F.date_format("ts", "MM/dd/yyyy")).alias("Date (MM/DD/YYYY)"),
        F.when(n % 77 != 0, F.date_format("ts", "HH:mm:ss")).alias("Time (HH:mm:ss)"),
    ).orderBy("event_id")
    out = quality.repair_embedded_headers(x, need_time=False, tie=["event_id"])
    return quality.place_of_rows(out, "place")
