"""Monitoring-shaped views over the test tables, in Spark and in SQL.

Each view reads a whole table. The SQL text of a view is a common table
expression for the oracle queries.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock

# Flag texts covering every flag number and odd spelling.
FLAG_TEXTS = [
    "<-5>",
    "<-4> [SBO]",
    "<-3> [GQR] (CSM)",
    "<-2> [GPF]",
    "<-1>",
    "<0>",
    "<1> (CSM)",
    "<2>",
    "<3> [GCM]",
    "<4>",
    "<5> (CDF)",
    "0",
    "",
    None,
    "<0> [SSM] <x> (CDF)",
    "<10>",
    "<1> [SIC] (CAF)",
    "<0> (CSM)",
    "-3",
    "abc",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _flag(n: Column) -> Column:
    return F.get(F.array(*[F.lit(t) for t in FLAG_TEXTS]), (n % 20).cast("int"))


_FLAG_LIST = "[" + ", ".join("NULL" if t is None else f"'{t}'" for t in FLAG_TEXTS) + "]"


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of fifteen stations with two flagged parameters."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    suffix = F.when(n % 3 == 0, "wq").when(n % 3 == 1, "met").otherwise("nut")
    return e.select(
        n,
        F.concat("event_type", suffix).alias("station_code"),
        F.col("ts").alias("datetimestamp"),
        (n % 2).cast("int").alias("historical"),
        F.when(n % 3 == 0, 1).otherwise(0).alias("provisionalplus"),
        "value",
        _flag(n).alias("f_value"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("k"),
        _flag(n * 7).alias("f_k"),
    )


OBS = f"""obs AS (
  SELECT event_id,
         event_type || CASE event_id % 3 WHEN 0 THEN 'wq' WHEN 1 THEN 'met' ELSE 'nut' END AS station_code,
         ts AS datetimestamp,
         CAST(event_id % 2 AS INTEGER) AS historical,
         CAST(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS provisionalplus,
         value,
         {_FLAG_LIST}[CAST(event_id % 20 AS INTEGER) + 1] AS f_value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k,
         {_FLAG_LIST}[CAST((event_id * 7) % 20 AS INTEGER) + 1] AS f_k
  FROM events)"""

# first signed whole number in a flag text
SQL_FLAG = "TRY_CAST(NULLIF(regexp_extract({c}, '(-?[0-9]+)', 1), '') AS INTEGER)"


def sql_flag(c: str) -> str:
    return SQL_FLAG.format(c=c)


def logger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logger records in order of RECORD, times of day somewhat before the stamp."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    tod = lambda back: F.date_format(clock.plus("ts", -back, "MINUTE"), "HH:mm")
    return e.select(
        F.col("event_type").alias("station"),
        F.col("ts").alias("TIMESTAMP"),
        n.cast("int").alias("RECORD"),
        F.col("value").alias("AvgVolt"),
        F.when(n % 97 != 0, tod((n % 40).cast("int"))).alias("MaxTempT"),
        tod((n * 3 % 25).cast("int")).alias("MinTempT"),
        tod((n * 7 % 31).cast("int")).alias("MaxWSpdT"),
    )


LOGGER = """logger AS (
  SELECT event_type AS station, ts AS "TIMESTAMP", CAST(event_id AS INTEGER) AS "RECORD", value AS "AvgVolt",
         CASE WHEN event_id % 97 <> 0 THEN strftime(ts - to_minutes(CAST(event_id % 40 AS INTEGER)), '%H:%M') END AS "MaxTempT",
         strftime(ts - to_minutes(CAST(event_id * 3 % 25 AS INTEGER)), '%H:%M') AS "MinTempT",
         strftime(ts - to_minutes(CAST(event_id * 7 % 31 AS INTEGER)), '%H:%M') AS "MaxWSpdT"
  FROM events)"""


def logger_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logger records with a repeated slice, as after overlapping downloads."""
    x = logger(spark, sf_dir)
    again = x.where(F.col("RECORD") % 100 < 3)
    thrice = x.where(F.col("RECORD") % 300 == 0)
    return x.unionByName(again).unionByName(thrice)


LOGGER_DUP = (
    LOGGER
    + """,
logger_dup AS (
  SELECT * FROM logger
  UNION ALL SELECT * FROM logger WHERE "RECORD" % 100 < 3
  UNION ALL SELECT * FROM logger WHERE "RECORD" % 300 = 0)"""
)


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrected stamps for some records."""
    x = logger(spark, sf_dir).where(F.col("RECORD") % 7 == 0)
    return x.select("RECORD", clock.plus("TIMESTAMP", -15, "MINUTE").alias("TIMESTAMP"))


CORRECTIONS = (
    LOGGER
    + """,
corrections AS (
  SELECT "RECORD", "TIMESTAMP" - INTERVAL 15 MINUTE AS "TIMESTAMP" FROM logger WHERE "RECORD" % 7 = 0)"""
)



def _deployment_rows(n: int = 7) -> list[tuple[int, str, str, str]]:
    """Deployments of 100 hours, one after another over the events' month, the sondes in turn.

    Each starts seven minutes after the last one's planned end; the one with
    number 3 stays three hours too long, and number 5 starts on a quarter hour.
    """
    first = dt.datetime(2024, 1, 1)
    rows = []
    for k in range(n):
        start = first + k * dt.timedelta(hours=100) + dt.timedelta(minutes=0 if k == 5 else 7)
        end = first + (k + 1) * dt.timedelta(hours=100) + dt.timedelta(hours=3 if k == 3 else 0)
        rows.append((k, str(start), str(end), ("north", "south", "east")[k % 3]))
    return rows


DEPLOYMENT_ROWS = _deployment_rows()


def deployments(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"({n}, TIMESTAMP_NTZ '{s}', TIMESTAMP_NTZ '{e}', '{l}')" for n, s, e, l in DEPLOYMENT_ROWS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS deployments(seq, start_ts, end_ts, label)")


DEPLOYMENTS = (
    "deployments(seq, start_ts, end_ts, label) AS (VALUES "
    + ", ".join(f"({n}, TIMESTAMP '{s}', TIMESTAMP '{e}', '{l}')" for n, s, e, l in DEPLOYMENT_ROWS)
    + ")"
)


def quarter_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reading per station and quarter hour, with a conductivity twin."""
    e = table(spark, sf_dir, "events")
    return (
        e.groupBy(
            F.col("event_type").alias("station"), clock.ceil_to_step("ts", 900).alias("ts")
        )
        .agg(
            F.max("value").alias("sal"),
            F.min("value").alias("spcond"),
            F.max("event_id").alias("event_id"),
        )
        .select("station", "ts", F.when(F.col("event_id") % 11 != 0, F.col("sal")).alias("sal"), "spcond")
    )


QUARTER_HOUR = """quarter_hour AS (
  SELECT station, ts, CASE WHEN event_id % 11 <> 0 THEN sal END AS sal, spcond FROM (
    SELECT event_type AS station,
           make_timestamp((((epoch_us(ts) + 899999999) // 900000000) * 900000000)) AS ts,
           max(value) AS sal, min(value) AS spcond, max(event_id) AS event_id
    FROM events GROUP BY 1, 2))"""


def sun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rise and set per day, from each day's first and last event."""
    e = table(spark, sf_dir, "events")
    hour = lambda c: clock.floor_to_step(c, 60)
    return e.groupBy(F.to_date("ts").alias("date")).agg(
        hour(clock.plus(F.min("ts"), 6, "HOUR")).alias("rise"),
        hour(clock.plus(F.max("ts"), -6, "HOUR")).alias("set"),
    )


SUN = """sun AS (
  SELECT CAST(ts AS DATE) AS date,
         date_trunc('minute', min(ts) + INTERVAL 6 HOUR) AS rise,
         date_trunc('minute', max(ts) - INTERVAL 6 HOUR) AS "set"
  FROM events GROUP BY 1)"""


def day_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root of the daily mean price per priority over seven years.

    A root, so that rounding a statistic of few values does not meet a tie.
    """
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("site"), F.col("o_orderdate").alias("ts")).agg(
        F.sqrt(F.avg("o_totalprice")).alias("var")
    )


DAY_SERIES = """day_series AS (
  SELECT o_orderpriority AS site, o_orderdate AS ts, sqrt(avg(o_totalprice)) AS var FROM orders GROUP BY 1, 2)"""


def cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Casts: station, date, pressure and a measured variable with gaps."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("Station"),
        F.to_date("l_shipdate").alias("Date"),
        (F.col("l_quantity") + F.col("l_discount")).alias("pressure_db"),
        F.when(F.col("l_tax") > 0.005, F.col("l_extendedprice") / 1000).alias("temp"),
    )


CAST = """casts AS (
  SELECT l_returnflag AS "Station", CAST(l_shipdate AS DATE) AS "Date", l_quantity + l_discount AS pressure_db,
         CASE WHEN l_tax > 0.005 THEN l_extendedprice / 1000 END AS temp
  FROM lineitem)"""


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_returnflag").alias("grp"), F.col("l_extendedprice").alias("x"))


SAMPLE = """sample AS (SELECT l_returnflag AS grp, l_extendedprice AS x FROM lineitem)"""


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_size").cast("double").alias("temp"),
        F.col("p_retailprice").alias("chla_rfu"),
        (F.col("p_partkey") * 1.0 + F.col("p_size") * 3.0).alias("fdom_qsu"),
    )


CURVE = """curve AS (
  SELECT CAST(p_size AS DOUBLE) AS temp, p_retailprice AS chla_rfu,
         CAST(p_partkey AS DOUBLE) + CAST(p_size AS DOUBLE) * 3 AS fdom_qsu FROM part)"""


def fluor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fluorescence sheet: padded station labels, grabs, replicates, notes."""
    li = table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey")
    transect = F.when(k % 4 == 0, "B").when(k % 4 == 1, "3").when(k % 4 == 2, "6").otherwise("9")
    return li.select(
        F.when(k % 23 == 0, F.lit("lab"))
        .when(k % 29 == 0, F.lit(None).cast("string"))
        .otherwise(
            F.concat(F.lit("T"), transect, F.lpad((F.col("l_suppkey") % 13).cast("string"), 2, "0"))
        )
        .alias("Station"),
        F.date_format("l_shipdate", "M/d/yyyy").alias("Date_col"),
        F.when(F.col("l_linenumber") % 3 == 0, "surface")
        .when(F.col("l_linenumber") % 3 == 1, "deep")
        .otherwise("other")
        .alias("Sample"),
        F.when(k % 5 == 0, "1").when(k % 5 == 1, "2").otherwise("3").alias("Replicate"),
        F.col("l_extendedprice").alias("F_0"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("F_a"),
        F.col("l_quantity").alias("Vol_ext"),
        (F.col("l_tax") + 1.0).alias("Vol_fil"),
        F.when(k % 7 == 0, "lab replicate").when(k % 7 == 1, "cloudy").alias("Notes"),
    )


FLUOR = """fluor AS (
  SELECT CASE WHEN l_orderkey % 23 = 0 THEN 'lab' WHEN l_orderkey % 29 = 0 THEN NULL
              ELSE 'T' || CASE l_orderkey % 4 WHEN 0 THEN 'B' WHEN 1 THEN '3' WHEN 2 THEN '6' ELSE '9' END
                   || lpad(CAST(l_suppkey % 13 AS VARCHAR), 2, '0') END AS "Station",
         CAST(l_shipdate AS DATE) AS d,
         CASE l_linenumber % 3 WHEN 0 THEN 'surface' WHEN 1 THEN 'deep' ELSE 'other' END AS "Sample",
         CASE l_orderkey % 5 WHEN 0 THEN '1' WHEN 1 THEN '2' ELSE '3' END AS "Replicate",
         l_extendedprice AS "F_0", l_extendedprice * l_discount AS "F_a", l_quantity AS "Vol_ext",
         l_tax + 1.0 AS "Vol_fil",
         CASE l_orderkey % 7 WHEN 0 THEN 'lab replicate' WHEN 1 THEN 'cloudy' END AS "Notes"
  FROM lineitem)"""


def ctd_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("AlongBay_"), (F.col("l_suppkey") % 13).cast("string")).alias("Station"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("Date"),
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations per site with a status (sometimes unknown) and parameter list."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(
        F.col("n_name").alias("site"),
        F.col("s_name").alias("station_code"),
        F.when(F.col("s_suppkey") % 17 != 0, F.when(F.col("s_acctbal") > 0, "Active").otherwise("Inactive"))
        .alias("status"),
    )


REGISTRY = """registry AS (
  SELECT n_name AS site, s_name AS station_code,
         CASE WHEN s_suppkey % 17 <> 0 THEN CASE WHEN s_acctbal > 0 THEN 'Active' ELSE 'Inactive' END END AS status
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
