"""Quality-flag queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.codes import CODES, FLAG_LABELS
from ..functions.text import parse_flag as parse_flag_text
from ..operators import flags
from . import views
from .registry import query
from .views import OBS, sql_flag, table

# code = greedy text between the first '<' and the last '>'
STRICT = "TRY_CAST(NULLIF(regexp_extract(f_value, '<(.+)>', 1), '') AS DOUBLE)"
COMMENT = "NULLIF(regexp_extract(f_value, '> (.+)', 1), '')"
LENIENT = """TRY_CAST(CASE
  WHEN strpos(f_value, '0') > 0 AND (NOT regexp_matches(f_value, '<.+>') OR strpos(f_value, '0') <= strpos(f_value, '<') + 1) THEN '0'
  ELSE NULLIF(regexp_extract(f_value, '<(.+)>', 1), '') END AS DOUBLE)"""


@query(
    "parse_flag",
    f"WITH {OBS} SELECT event_id, station_code, {sql_flag('f_value')} AS f_value, {sql_flag('f_k')} AS f_k FROM obs",
)
def parse_flag(spark, sf):
    return flags.parse_flags(views.obs(spark, sf)).select("event_id", "station_code", "f_value", "f_k")


@query(
    "split_flag",
    f"WITH {OBS} SELECT event_id, f_value, {STRICT} AS f_code, {COMMENT} AS f_comments FROM obs",
)
def split_flag(spark, sf):
    return flags.split_flag(views.obs(spark, sf).select("event_id", "f_value"), "f_value")


@query(
    "split_flag_lenient",
    f"WITH {OBS} SELECT event_id, f_value, {LENIENT} AS f_code, {COMMENT} AS f_comments FROM obs",
)
def split_flag_lenient(spark, sf):
    return flags.split_flag(views.obs(spark, sf).select("event_id", "f_value"), "f_value", lenient=True)


@query(
    "keep_good",
    f"""
WITH {OBS}, t AS (SELECT event_id, datetimestamp, value, {sql_flag('f_value')} AS flag FROM obs)
SELECT * FROM t WHERE flag = 0 OR flag > 1
""",
)
def keep_good(spark, sf):
    x = views.obs(spark, sf).select(
        "event_id", "datetimestamp", "value", parse_flag_text("f_value").alias("flag")
    )
    return flags.keep_good(x, "flag")


def _removed(p: str) -> str:
    f = sql_flag(f"f_{p}")
    return f"CASE WHEN {f} IS NOT NULL AND {f} <> -3 THEN {p} END AS {p}"


@query(
    "rm_flags",
    f"WITH {OBS} SELECT station_code, datetimestamp, {_removed('value')}, {_removed('k')} FROM obs",
)
def rm_flags(spark, sf):
    x = views.obs(spark, sf).select("station_code", "datetimestamp", "value", "f_value", "k", "f_k")
    return flags.rm_flags(x, known=["value", "k"], params="all")


@query(
    "rm_flags_some",
    f"WITH {OBS} SELECT station_code, datetimestamp, {_removed('value')} FROM obs",
)
def rm_flags_some(spark, sf):
    return flags.rm_flags(views.obs(spark, sf), known=["value", "k"], params=["value"])


def _kept(p: str) -> str:
    return f"CASE WHEN {sql_flag(f'f_{p}')} IN (0, 1, 2, 3, 4, 5) THEN {p} END AS {p}"


@query(
    "qaqc_keep",
    f"WITH {OBS} SELECT event_id, station_code, datetimestamp, {_kept('value')}, {_kept('k')} FROM obs",
)
def qaqc_keep(spark, sf):
    x = views.obs(spark, sf).drop("historical", "provisionalplus")
    return flags.qaqc_keep(x, {"value": "f_value", "k": "f_k"}, range(6))


@query(
    "split_suspect",
    f"""
WITH {OBS}, t AS (SELECT event_id, value, {sql_flag('f_value')} AS flag FROM obs)
SELECT *, CASE WHEN flag <> 1 THEN value END AS ok, CASE WHEN flag = 1 THEN value END AS suspect FROM t WHERE flag >= 0
""",
)
def split_suspect(spark, sf):
    x = views.obs(spark, sf).select("event_id", "value", parse_flag_text("f_value").alias("flag"))
    return flags.split_suspect(x, "value", "flag")


@query(
    "is_zero_flag",
    f"WITH {OBS} SELECT event_id, f_value, contains(f_value, '0') AS is_zero FROM obs",
)
def is_zero_flag(spark, sf):
    return flags.is_zero_flag(views.obs(spark, sf).select("event_id", "f_value"), "f_value")


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(_literal(v) for v in r) + ")" for r in rows)


def _literal(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


@query(
    "decode_flag",
    f"""
WITH {OBS},
dim(code, meaning) AS (VALUES {_values(CODES['water'].items())}),
lab(flag, label) AS (VALUES {_values(FLAG_LABELS.items())}),
t AS (
  SELECT event_id, f_value, {sql_flag('f_value')} AS flag,
         regexp_extract_all(f_value, '[\\[(]([A-Z]{{1,3}}[0-9]?)[\\])]', 1) AS found FROM obs),
u AS (
  SELECT event_id, f_value, flag, unnest(CASE WHEN found IS NULL OR len(found) = 0 THEN [NULL] ELSE found END) AS code FROM t)
SELECT event_id, f_value, u.flag, label, u.code, meaning
FROM u LEFT JOIN lab ON u.flag = lab.flag LEFT JOIN dim ON u.code = dim.code
""",
)
def decode_flag(spark, sf):
    return flags.decode_flag(views.obs(spark, sf).select("event_id", "f_value"), "f_value", "water")


@query(
    "qaqc_stage",
    f"""
WITH {OBS}
SELECT event_id, historical, provisionalplus,
       CASE WHEN historical = 1 THEN 'authenticated' WHEN provisionalplus = 1 THEN 'provisional plus' ELSE 'provisional' END AS stage
FROM obs
""",
)
def qaqc_stage(spark, sf):
    return flags.qaqc_stage(views.obs(spark, sf).select("event_id", "historical", "provisionalplus"))


@query(
    "sentinel_to_null",
    """
WITH t AS (
  SELECT event_id, CASE event_id % 10 WHEN 3 THEN -99 WHEN 7 THEN -99999 ELSE value END AS value,
         CAST(CASE event_id % 9 WHEN 5 THEN -99 ELSE event_id % 360 END AS INTEGER) AS wdir FROM events)
SELECT event_id, CASE WHEN value NOT IN (-99, -99999) THEN value END AS value,
       CASE WHEN wdir NOT IN (-99, -99999) THEN wdir END AS wdir FROM t
""",
)
def sentinel_to_null(spark, sf):
    n = F.col("event_id")
    x = table(spark, sf, "events").select(
        n,
        F.when(n % 10 == 3, -99.0).when(n % 10 == 7, -99999.0).otherwise(F.col("value")).alias("value"),
        F.when(n % 9 == 5, -99).otherwise(n % 360).cast("int").alias("wdir"),
    )
    return flags.sentinel_to_null(x, ["value", "wdir"])


@query("flag_summary", f"WITH {OBS} SELECT f_value, count(*) AS n FROM obs GROUP BY 1")
def flag_summary(spark, sf):
    return flags.flag_summary(views.obs(spark, sf), "f_value")


# Flag texts of each program with the meaning of every code in them, written out by hand.
_PROGRAMS = {
    "weather": (False, {"<-3> [GPR] (CML)": [("GPR", "program reload"), ("CML", "snow melt from previous snowfall event")],
                        "<1> [SIW]": [("SIW", "incorrect wiring")], "<0>": [(None, None)], "<1> [ZZZ]": [("ZZZ", None)]}),
    "nutrient": (False, {"<-4> [SBL]": [("SBL", "value below minimum limit of method detection")],
                         "<1> [GQS] (CDR)": [("GQS", "data suspect due to QA/QC checks"), ("CDR", "sample diluted and rerun")]}),
    "record": (False, {"{CSM} (WH2)": [("WH2", "0.3 to 0.6 meters")], "(NNE) (WS5) (CFY)": [
        ("NNE", "from the north northeast"), ("WS5", "> 40 knots"), ("CFY", "foggy")]}),
    "legacy nutrient": (True, {"A": [("A", "Value above upper limit of method detection")],
                               "A H": [("A", "Value above upper limit of method detection"), ("H", "Sample held beyond specified holding time")],
                               "U,N": [("U", "Lab analysis from unpreserved sample"), ("N", "Calculated value is negative")], "": [(None, None)]}),
    "water": (True, {"GIC": [("GIC", "no instrument deployed due to ice")], "SWM CTS": [
        ("SWM", "wiper malfunction / loss"), ("CTS", "turbidity spike")], "ok": [(None, None)]}),
}


def _program_query(program: str, key: str) -> None:
    bare, texts = _PROGRAMS[program]
    quoted = ", ".join(f"'{t}'" for t in texts)
    wanted = _values([(t, *m) for t, found in texts.items() for m in found])

    @query(
        key,
        f"""
WITH t AS (SELECT event_id, [{quoted}][CAST(event_id % {len(texts)} AS INTEGER) + 1] AS f FROM events),
w(f, code, meaning) AS (VALUES {wanted})
SELECT event_id, t.f, code, meaning FROM t JOIN w ON t.f = w.f
""",
    )
    def decoded(spark, sf):
        pick = F.get(F.array(*[F.lit(t) for t in texts]), (F.col("event_id") % len(texts)).cast("int"))
        x = table(spark, sf, "events").select("event_id", pick.alias("f"))
        return flags.decode_flag(x, "f", program, bare=bare).select("event_id", "f", "code", "meaning")


for _program, _key in (
    ("weather", "decode_flag_weather"),
    ("nutrient", "decode_flag_nutrient"),
    ("record", "decode_flag_record"),
    ("legacy nutrient", "decode_code_column"),
    ("water", "decode_error_column"),
):
    _program_query(_program, _key)
