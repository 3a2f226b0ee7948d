"""Reader and writer queries: whole tables are written out as the files the
readers expect, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock
from ..operators.staging import fresh_folder
from ..sources import readers, writers
from . import views
from .registry import query
from .views import LOGGER, table


def folder(spark, sf, name: str) -> str:
    """A folder of its own for each call, so that no lazy table loses its files to a later one."""
    return fresh_folder(spark, f"{sf.rstrip('/').rsplit('/', 1)[-1]}-{name}")


EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, value double"
EVENT_SQL = "SELECT event_id, ts, value FROM events"


@query("scan_csv_dir", EVENT_SQL)
def scan_csv_dir(spark, sf):
    path = folder(spark, sf, "csv")
    writers.write_csv_table(table(spark, sf, "events").select("event_id", "ts", "value"), path)
    return readers.scan_csv_dir(spark, path, EVENT_SCHEMA)


@query(
    "scan_csv_lenient",
    "SELECT event_id, value, NULL::BIGINT AS user_id FROM events UNION ALL SELECT event_id, NULL, user_id FROM events",
)
def scan_csv_lenient(spark, sf):
    a, b = folder(spark, sf, "csv_2021"), folder(spark, sf, "csv_2022")
    e = table(spark, sf, "events")
    writers.write_csv_table(e.select("event_id", "value"), a)
    writers.write_csv_table(e.select("user_id", "event_id"), b)
    return readers.scan_csv_variants(
        spark, [(a, "event_id bigint, value double"), (b, "user_id bigint, event_id bigint")]
    )


@query(
    "select_files",
    "SELECT event_type AS src, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE event_type IN ('click', 'view') GROUP BY 1",
)
def select_files(spark, sf):
    path = folder(spark, sf, "named_files")
    e = table(spark, sf, "events")
    name = F.concat("event_type", F.when(F.col("event_type").isin("error", "signup"), "_RAW.dat").otherwise("_QC.dat"))
    writers.write_csv_table(
        e.select(name.alias("src"), "event_id", "value"), path, partition_by=["src"]
    )
    df = spark.read.schema("event_id bigint, value double, src string").csv(path, header=True)
    picked = readers.select_files(df, ["(?<=QC).dat"], exclude=["purch"])
    return picked.groupBy(F.regexp_replace("src", "_QC.dat$", "").alias("src")).agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")
    )


@query(
    "scan_logger",
    f"""
WITH {LOGGER}
SELECT strftime("TIMESTAMP", '%Y-%m-%d %H:%M:%S') AS "TIMESTAMP", CAST("RECORD" AS VARCHAR) AS "RECORD", "MaxTempT", "MinTempT", "MaxWSpdT" FROM logger
""",
)
def scan_logger(spark, sf):
    path = folder(spark, sf, "logger")
    raw = views.logger(spark, sf).select(
        F.concat(
            F.lit('"'),
            F.concat_ws(
                '","',
                F.date_format("TIMESTAMP", "yyyy-MM-dd HH:mm:ss"),
                F.col("RECORD").cast("string"),
                *[F.when(F.col(t).isNotNull(), clock.unpad_hm(t)).otherwise("") for t in ("MaxTempT", "MinTempT", "MaxWSpdT")],
            ),
            F.lit('"'),
        ).alias("value")
    )
    head = spark.createDataFrame(
        [
            ('"TOA5","station"',),
            ('"TIMESTAMP","RECORD","MaxTempT","MinTempT","MaxWSpdT"',),
            ('"TS","RN","Deg C","Deg C","m/s"',),
            ('"","","TMx","TMn","TMx"',),
        ],
        "value string",
    )
    head.unionByName(raw).write.mode("overwrite").text(path)
    return readers.scan_logger(
        spark, path, ["TIMESTAMP", "RECORD", "MaxTempT", "MinTempT", "MaxWSpdT"], file=None
    )


SONDE = ["Date (MM/DD/YYYY)", "Time (HH:mm:ss)", "Temp °C", "Site"]


@query(
    "scan_sonde_csv",
    """
SELECT strftime(ts, '%m/%d/%Y') AS "Date (MM/DD/YYYY)", strftime(ts, '%H:%M:%S') AS "Time (HH:mm:ss)",
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS temp, 'Año ' || event_type AS site FROM events
""",
)
def scan_sonde_csv(spark, sf):
    path = folder(spark, sf, "sonde")
    n = F.col("event_id")
    rows = table(spark, sf, "events").select(
        F.concat_ws(
            ",",
            F.date_format("ts", "MM/dd/yyyy"),
            F.date_format("ts", "HH:mm:ss"),
            F.when(n % 9 == 0, "NA").when(n % 9 == 3, "NaN").when(n % 9 == 6, "").otherwise(F.col("user_id").cast("string")),
            F.concat(F.lit("Año "), "event_type"),
        ).alias("value")
    )
    head = spark.createDataFrame(
        [("Sonde export",), ("Serial,17",), ("",), (",".join(SONDE),), (",".join(SONDE),)], "value string"
    )
    head.unionByName(rows).write.mode("overwrite").option("encoding", "ISO-8859-1").csv(path, quote="\u0000", sep="\u0001")
    out = readers.scan_sonde_csv(spark, path, SONDE)
    return out.toDF(*SONDE[:2], "temp", "site")


@query("scan_tsv", EVENT_SQL)
def scan_tsv(spark, sf):
    path = folder(spark, sf, "tsv")
    writers.write_csv_table(table(spark, sf, "events").select("event_id", "ts", "value"), path, sep="\t")
    return readers.scan_tsv(spark, path, EVENT_SCHEMA, glob="*.csv")


@query(
    "scan_two_space_table",
    """
SELECT lpad(CAST(event_id % 100 AS VARCHAR), 2, '0') AS day, strftime(ts, '%H%M %M%S') AS m01,
       CASE WHEN event_id % 10 <> 0 THEN strftime(ts, '%M%S %H%M') END AS m02 FROM events
""",
)
def scan_two_space_table(spark, sf):
    path = folder(spark, sf, "sun_text")
    n = F.col("event_id")
    line = F.concat(
        F.concat_ws(
            "  ",
            F.lpad((n % 100).cast("string"), 2, "0"),
            F.date_format("ts", "HHmm mmss"),
            F.when(n % 10 != 0, F.date_format("ts", "mmss HHmm")).otherwise("9999 9999"),
        ),
        F.lit("\\"),
    )
    head = spark.createDataFrame(
        [("{\\rtf1 text",), ("       Jan.       Feb.  \\",), ("Day Rise  Set  Rise  Set\\",)], "value string"
    )
    head.unionByName(table(spark, sf, "events").select(line.alias("value"))).write.mode("overwrite").text(path)
    return readers.scan_two_space_table(spark, path, ["day", "m01", "m02"])


@query(
    "import_stations",
    "SELECT event_type || 'wq' AS station_code, event_id, ts, value FROM events WHERE event_type IN ('click', 'signup', 'error')",
)
def import_stations(spark, sf):
    path = folder(spark, sf, "archive")
    e = table(spark, sf, "events").select(
        F.concat("event_type", F.lit("wq")).alias("archive"), "event_id", "ts", "value"
    )
    writers.write_csv_table(e, path, partition_by=["archive"])
    out = readers.import_stations(spark, path, ["clickwq", "signupwq", "errorwq"], EVENT_SCHEMA)
    return out.drop("archive")


@query(
    "skip_select_bindcols",
    """
WITH a AS (SELECT CAST(ts AS DATE) AS date, max(value) AS v FROM events GROUP BY 1),
b AS (SELECT CAST(ts + INTERVAL 9 DAY AS DATE) AS date, min(value) AS v FROM events GROUP BY 1)
SELECT coalesce(a.date, b.date) AS date, a.v AS v_depth, b.v AS v_swe FROM a FULL JOIN b ON a.date = b.date
""",
)
def skip_select_bindcols(spark, sf):
    e = table(spark, sf, "events")
    parts = {}
    for name, days, agg in (("depth", 0, F.max("value")), ("swe", 9, F.min("value"))):
        path = folder(spark, sf, f"bind_{name}")
        x = e.groupBy(F.to_date(clock.plus("ts", days, "DAY")).alias("date")).agg(
            F.max("user_id").alias("Site Id"), agg.alias("v"), F.max("user_id").alias("last")
        )
        writers.write_csv_table(x, path)
        parts[name] = readers.scan_csv_dir(
            spark, path, "date date, `Site Id` bigint, v double, last bigint"
        )
    return readers.bind_files_by_key(parts, "date", drop=["Site Id", "last"])


@query(
    "write_csv_table",
    'SELECT row_number() OVER (ORDER BY event_id) AS "row", event_id, CASE WHEN event_id % 6 <> 0 THEN value END AS value FROM events',
)
def write_csv_table(spark, sf):
    path = folder(spark, sf, "numbered")
    x = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 6 != 0, F.col("value")).alias("value")
    )
    writers.write_csv_table(x, path, row_numbers=["event_id"])
    return readers.scan_csv_dir(spark, path, "row bigint, event_id bigint, value double")


@query(
    "write_logger",
    f"""
WITH {LOGGER}
SELECT strftime("TIMESTAMP", '%Y-%m-%d %H:%M:%S') AS "TIMESTAMP", CAST("RECORD" AS VARCHAR) AS "RECORD",
       CASE WHEN "MaxTempT" IS NULL THEN 'NA:NA' ELSE regexp_replace(regexp_replace("MaxTempT", '^0', ''), ':0', ':') END AS "MaxTempT",
       regexp_replace(regexp_replace("MinTempT", '^0', ''), ':0', ':') AS "MinTempT",
       regexp_replace(regexp_replace("MaxWSpdT", '^0', ''), ':0', ':') AS "MaxWSpdT",
       CASE WHEN "AvgVolt" < 5 THEN NULL ELSE 'v' || CAST("RECORD" AS VARCHAR) END AS note FROM logger
""",
)
def write_logger(spark, sf):
    path = folder(spark, sf, "logger_out")
    names = ["TIMESTAMP", "RECORD", "MaxTempT", "MinTempT", "MaxWSpdT", "note"]
    x = views.logger(spark, sf)
    note = F.when(F.col("AvgVolt") >= 5, F.concat(F.lit("v"), F.col("RECORD").cast("string")))
    writers.write_logger(x.withColumn("note", note).select(*names), path)
    back = spark.read.schema(readers.text_schema(names)).csv(path)
    return back.select(*names[:-1], F.nullif("note", F.lit("")).alias("note"))


@query(
    "bind_files_repeats",
    """
WITH a AS (
  SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY v) AS n
  FROM (SELECT CASE WHEN user_id % 10 > 2 THEN user_id END AS k, event_id AS v FROM events)),
b AS (
  SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY v) AS n
  FROM (SELECT CASE WHEN user_id % 10 <> 1 THEN (user_id * 7) % 900 END AS k, event_id AS v FROM events))
SELECT coalesce(a.k, b.k) AS k, a.v AS v_first, b.v AS v_second
FROM a FULL JOIN b ON a.k IS NOT DISTINCT FROM b.k AND a.n = b.n
""",
)
def bind_files_repeats(spark, sf):
    """Keys that repeat differently in both tables; a third of the first one's rows has none."""
    e, user = table(spark, sf, "events"), F.col("user_id")
    part = lambda keep, key: e.select(F.when(keep, key).alias("k"), F.col("event_id").alias("v"))
    sources = {"first": part(user % 10 > 2, user), "second": part(user % 10 != 1, user * 7 % 900)}
    return readers.bind_files_by_key(sources, "k", order=["v"])


@query(
    "scan_logger_odd_records",
    """
SELECT CASE WHEN event_id % 5 <> 3 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE 'no stamp' END AS "TIMESTAMP",
       CASE event_id % 5 WHEN 0 THEN event_id || '.0' WHEN 1 THEN 'NAN' WHEN 2 THEN 'lost' ELSE CAST(event_id AS VARCHAR) END AS "RECORD",
       strftime(ts, '%H:%M') AS "MaxTempT"
FROM events
""",
)
def scan_logger_odd_records(spark, sf):
    path = folder(spark, sf, "logger_odd")
    n = F.col("event_id")
    record = F.when(n % 5 == 0, F.concat(n.cast("string"), F.lit(".0"))).when(n % 5 == 1, "NAN").when(n % 5 == 2, "lost")
    raw = table(spark, sf, "events").select(
        F.concat_ws(
            ",",
            F.when(n % 5 == 3, "no stamp").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")),
            record.otherwise(n.cast("string")),
            F.date_format("ts", "H:m"),
        ).alias("value")
    )
    head = spark.createDataFrame(
        [("TOA5,CR1000,17",), ("TIMESTAMP,RECORD,MaxTempT",), ("TS,RN,Deg C",), (",,TMx",)], "value string"
    )
    head.unionByName(raw).write.text(path)
    return readers.scan_logger(spark, path, ["TIMESTAMP", "RECORD", "MaxTempT"], file=None)


@query(
    "import_stations_exact",
    """
SELECT CASE event_type WHEN 'click' THEN 'dlwq' WHEN 'view' THEN 'dlwq2' END AS station_code, event_id, value
FROM events WHERE event_type IN ('click', 'view')
""",
)
def import_stations_exact(spark, sf):
    """Codes that contain each other, and files of stations whose code merely contains one asked for."""
    path = folder(spark, sf, "dlwq_archive")
    kind = F.col("event_type")
    code = F.when(kind == "click", "dlwq").when(kind == "view", "dlwq2").when(kind == "error", "xdlwq").otherwise("dlwqs")
    e = table(spark, sf, "events").select(code.alias("archive"), "event_id", "value")
    writers.write_csv_table(e, path, partition_by=["archive"])
    out = readers.import_stations(spark, path, ["dlwq", "dlwq2"], "event_id bigint, value double")
    return out.drop("archive")


@query(
    "import_stations_one_code",
    "SELECT 'dlwq' AS station_code, event_id, value FROM events WHERE event_type IN ('click', 'purchase')",
)
def import_stations_one_code(spark, sf):
    """One code asked for; files of its years count, those of longer codes do not."""
    path = folder(spark, sf, "dlwq_only")
    kind = F.col("event_type")
    code = F.when(kind == "click", "dlwq").when(kind == "purchase", "dlwq2021").when(kind == "view", "dlwq2").otherwise("dlwq20219")
    e = table(spark, sf, "events").select(code.alias("archive"), "event_id", "value")
    writers.write_csv_table(e, path, partition_by=["archive"])
    return readers.import_stations(spark, path, ["dlwq"], "event_id bigint, value double").drop("archive")


def headed_files(path: str, rows, heads, encoding: str = "UTF-8") -> None:
    """One file for each layout: its leading lines, then its rows (``layout``, ``value``)."""
    spark = rows.sparkSession
    lines = [(layout, i, line) for layout, own in heads.items() for i, line in enumerate(own)]
    top = spark.createDataFrame(lines, "layout string, place int, value string")
    every = top.unionByName(rows.withColumn("place", F.lit(1 << 30)))
    ordered = every.repartition("layout").sortWithinPartitions("layout", "place").select("layout", "value")
    if encoding == "UTF-8":
        ordered.write.partitionBy("layout").text(path)
    else:
        ordered.write.options(encoding=encoding, quote="\u0000", sep="\u0001").partitionBy("layout").csv(path)


@query(
    "scan_logger_by_header",
    """
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS "TIMESTAMP", CAST(event_id AS VARCHAR) AS "RECORD",
       CASE WHEN event_id % 3 <> 1 THEN strftime(ts, '%H:%M') END AS "MaxTempT",
       CASE WHEN event_id % 3 <> 2 THEN event_type || ', ' || user_id END AS note
FROM events
""",
)
def scan_logger_by_header(spark, sf):
    """Three programs with columns in other places or missing, and unit rows that could be data."""
    path, n = folder(spark, sf, "logger_programs"), F.col("event_id")
    stamp, record = F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), n.cast("string")
    hour = F.date_format("ts", "H:m")
    note = F.concat(F.lit('"'), "event_type", F.lit(", "), F.col("user_id").cast("string"), F.lit('"'))
    line = (
        F.when(n % 3 == 0, F.concat_ws(",", stamp, record, hour, note))
        .when(n % 3 == 1, F.concat_ws(",", note, record, stamp))
        .otherwise(F.concat_ws(",", hour, record, stamp, F.lit("beyond the header")))
    )
    unit = "2024-01-01 00:00:00,7,12:10"
    heads = {
        "p0": ["TOA5,one", "TIMESTAMP,RECORD,MaxTempT,note", unit, unit],
        "p1": ["TOA5,two,and,more,fields", '"note","RECORD","TIMESTAMP"', "x,8,2024-01-01 00:00:00", ""],
        "p2": ["", "MaxTempT,RECORD,TIMESTAMP", "9:9,9,2024-01-01 00:00:00", unit],
    }
    layout = F.concat(F.lit("p"), (n % 3).cast("string"))
    headed_files(path, table(spark, sf, "events").select(layout.alias("layout"), line.alias("value")), heads)
    out = readers.scan_logger(spark, path, tods=["MaxTempT"], file=None)
    return out.select("TIMESTAMP", "RECORD", "MaxTempT", "note")


@query(
    "scan_sonde_by_header",
    """
SELECT strftime(ts, '%m/%d/%Y') AS "Date (MM/DD/YYYY)", CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%H:%M:%S') END AS "Time (HH:mm:ss)",
       CASE WHEN event_id % 3 <> 0 THEN CAST(user_id AS VARCHAR) END AS "Temp °C"
FROM events
""",
)
def scan_sonde_by_header(spark, sf):
    """Exports of two sondes: other columns in other places after eight lines, which hold a date as well."""
    path, n = folder(spark, sf, "sondes"), F.col("event_id")
    day, temp = F.date_format("ts", "MM/dd/yyyy"), F.when(n % 3 == 0, "NaN").otherwise(F.col("user_id").cast("string"))
    line = F.when(n % 2 == 0, F.concat_ws(",", day, F.date_format("ts", "HH:mm:ss"), temp)).otherwise(F.concat_ws(",", temp, day))
    top = ["KOR export", "Serial,1", "-", "01/02/2024,00:00:00,1", "x", "-", "Mean,2", "Sites"]
    heads = {"s0": [*top, "Date (MM/DD/YYYY),Time (HH:mm:ss),Temp °C"], "s1": [*top, "Temp °C,Date (MM/DD/YYYY)"]}
    layout = F.concat(F.lit("s"), (n % 2).cast("string"))
    rows = table(spark, sf, "events").select(layout.alias("layout"), line.alias("value"))
    headed_files(path, rows, heads, "ISO-8859-1")
    return readers.scan_sonde_csv(spark, path)
