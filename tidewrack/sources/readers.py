"""Readers. Every one is a single scan with a stated schema.

Header, unit and preamble lines are told from data by content where the
columns are stated. Where they are not, `scan_headed` finds them by their place
in the file and takes the columns from each file's own header, whatever splits
Spark reads the file in. File and station names come from the scan's own
metadata, and a filter on them prunes files before they are opened.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clock, text
from ..functions.columns import all_of, col, cols, require
from ..operators.blocks import BLOCK_ROWS, row_index
from ..operators.staging import settled

Paths = str | Sequence[str]

# header line, NA or nothing for missing, stamps with or without decimals
CSV = {
    "header": True,
    "nullValue": "NA",
    "timestampNTZFormat": "yyyy-MM-dd['T'][ ]HH:mm:ss[.SSSSSS]",
}


STAMPS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.S", "yyyy-MM-dd HH:mm")


def text_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _paths(path: Paths) -> Paths:
    return path if isinstance(path, str) else list(path)


def scan_csv_dir(
    spark: SparkSession,
    path: Paths,
    schema: T.StructType | str,
    glob: str = "*.csv",
    sep: str = ",",
    file: str | None = None,
) -> DataFrame:
    """All CSV files of a directory, stacked strictly.

    Headers are checked against the schema; a file with other columns stops
    the query. ``file`` names a column for the source file's name.
    """
    df = (
        spark.read.schema(schema)
        .options(**CSV, enforceSchema=False, sep=sep, pathGlobFilter=glob, mode="FAILFAST")
        .csv(_paths(path))
    )
    return df if file is None else df.withColumn(file, F.col("_metadata.file_name"))


def scan_csv_variants(
    spark: SparkSession, variants: Sequence[tuple[Paths, T.StructType | str]], glob: str = "*.csv"
) -> DataFrame:
    """Files whose columns changed over time, stacked by name.

    One scan per layout; a column a layout lacks is NULL there.
    """
    if not variants:
        raise ValueError("no files given")
    out = None
    for path, schema in variants:
        part = scan_csv_dir(spark, path, schema, glob)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def select_files(
    df: DataFrame, patterns: Sequence[str], exclude: Sequence[str] = (), path: Column | None = None
) -> DataFrame:
    """Rows of the files whose path matches every pattern and no excluded one.

    Works on a scan directly: the predicate only reads file metadata, so
    files that do not match are never opened.
    """
    p = F.col("_metadata.file_path") if path is None else path
    conds = [p.rlike(x) for x in patterns] + [~p.rlike(x) for x in exclude]
    return df.where(all_of(conds)) if conds else df


def _lines(spark: SparkSession, path: Paths, glob: str, encoding: str) -> DataFrame:
    """All lines as ``_path``, ``_name``, ``_block`` (first byte of the split), ``_at`` (order inside it) and ``value``."""
    df = spark.read.options(pathGlobFilter=glob).text(_paths(path))
    # lines come as the bytes they are
    line = F.col("value") if encoding == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    return df.select(
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_name").alias("_name"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
        line.alias("value"),
    )


def scan_headed(
    spark: SparkSession,
    path: Paths,
    names_line: int = 0,
    skip: int = 1,
    names: Sequence[str] | None = None,
    sep: str = ",",
    glob: str = "*",
    encoding: str = "UTF-8",
    file: str | None = "file",
) -> DataFrame:
    """Delimited files as text columns, each read by its own header.

    Line ``names_line`` (from 0) of every file names its columns, in whatever
    order; data begins at line ``skip``, and what stands before it is no data
    however much it looks like it. A column a file does not have is NULL in its
    rows, fields beyond its header are dropped, and of a repeated name the
    first column counts. ``names`` picks columns; without it there is one for
    each name found, in the order of the files' paths. Empty lines are dropped;
    files that end before their data have no rows.

    The source is read once: its lines are written to a step table with their
    split and their order in it, which tells the first lines of a file in any
    number of splits. What a file's rows need to know of its header is one
    small row, joined by path.
    """
    if not 0 <= names_line < skip:
        raise ValueError("the line of names has to stand before the data")
    lines = settled(_lines(spark, path, glob, encoding))
    splits = lines.groupBy("_path", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    heads = splits.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).where(F.col("_base") < skip)
    place = F.col("_base") + F.col("_at") - F.col("_first")
    titled = lines.join(heads, ["_path", "_block"]).where(place == names_line).select("_path", "value")
    ends = heads.groupBy("_path").agg(
        # the first line of data in each of the splits that the lines before it reach into
        F.map_from_entries(F.collect_list(F.struct("_block", (F.col("_first") + skip - F.col("_base")).alias("at")))).alias("_data")
    )
    titled = settled(titled.join(ends, "_path"))
    options = {"sep": sep, "mode": "PERMISSIVE"}
    widest = titled.agg(F.max(F.size(F.split("value", re.escape(sep), -1)))).first()[0] or 1
    fields = [f"c{i}" for i in range(widest)]

    def parsed(line: str) -> Column:
        struct = F.from_csv(F.col(line), ", ".join(f"{c} string" for c in fields), options)
        return F.array(*[struct.getField(c) for c in fields])

    headers = titled.select("_path", "_data", F.transform(parsed("value"), F.trim).alias("_titles"))
    if names is None:
        found = headers.select("_path", F.posexplode("_titles").alias("at", "name")).where("name <> ''")
        first = found.groupBy("name").agg(F.min(F.struct("_path", "at")).alias("first"))
        names = [r["name"] for r in first.orderBy("first").collect()]  # as many as there are names of columns
    start = F.try_element_at("_data", F.col("_block"))
    rows = lines.join(headers, "_path").where((start.isNull() | (F.col("_at") >= start)) & (F.col("value") != ""))
    rows = rows.withColumn("_fields", parsed("value"))

    def picked(name: str) -> Column:
        place = F.coalesce(F.array_position("_titles", F.lit(name)), F.lit(0))
        return F.get("_fields", (place - 1).cast("int")).alias(name)

    out = [picked(n) for n in names]
    if file is not None:
        out.append(F.col("_name").alias(file))
    return rows.select(*out)


def scan_logger(
    spark: SparkSession,
    path: Paths,
    names: Sequence[str] | None = None,
    tods: Sequence[str] = ("MaxTempT", "MinTempT", "MaxWSpdT"),
    record: str = "RECORD",
    glob: str = "*",
    file: str | None = "file",
    ts: str = "TIMESTAMP",
    missing: Sequence[str] = ("NA", "NAN", "NaN"),
) -> DataFrame:
    """Raw logger files as text columns, times of day padded.

    Without ``names`` every file is read by its own second line, and its first
    four lines (file info, names, units, kind) are no data. With ``names``,
    which then hold for all files, lines may come in any place: those four
    fall out as they have neither a readable stamp nor a record that is a
    number or a word for a missing one, and every other line stays.
    """
    if names is None:
        df = scan_headed(spark, path, names_line=1, skip=4, glob=glob, file=file)
        if record not in df.columns:
            raise ValueError(f"no {record} column")
        return df.select(*[clock.pad_hm(c).alias(c) if c in tods else col(c) for c in df.columns])
    if record not in names:
        raise ValueError(f"no {record} column")
    df = spark.read.schema(text_schema(names)).options(pathGlobFilter=glob).csv(_paths(path))
    is_data = col(record).try_cast("double").isNotNull() | col(record).isin(*missing)
    if ts in names:
        is_data = is_data | clock.parse_datetime(ts, STAMPS).isNotNull()
    kept = df.where(F.coalesce(is_data, F.lit(False)))
    out = [clock.pad_hm(c).alias(c) if c in tods else col(c) for c in names]
    if file is not None:
        out.append(F.col("_metadata.file_name").alias(file))
    return kept.select(*out)


#: Lines before the names in a sonde export.
PREAMBLE = 8


def scan_sonde_csv(
    spark: SparkSession,
    path: Paths,
    names: Sequence[str] | None = None,
    date: str = "Date (MM/DD/YYYY)",
    na: Sequence[str] = ("", "NA", "NaN"),
    keep_headers: bool = False,
    glob: str = "*",
    preamble: int = PREAMBLE,
) -> DataFrame:
    """Sonde exports (latin-1, preamble, missing-value words) as text columns.

    Without ``names`` every file is read by its own header, the line after
    ``preamble`` lines. Rows are told by a readable date. With ``keep_headers``
    repeated header lines stay in, for the repair operator to drop.
    """
    if names is None:
        df = scan_headed(spark, path, preamble, preamble + 1, glob=glob, encoding="ISO-8859-1", file=None)
    else:
        options = {"encoding": "ISO-8859-1", "pathGlobFilter": glob}
        df = spark.read.schema(text_schema(names)).options(**options).csv(_paths(path))
    if date not in df.columns:
        raise ValueError(f"no {date} column")
    wanted = clock.parse_date(date, clock.MDY).isNotNull()
    if keep_headers:
        wanted = wanted | (col(date) == date)
    return df.where(wanted).select(*[text.na_tokens(c, na).alias(c) for c in df.columns])


def scan_tsv(
    spark: SparkSession, path: Paths, schema: T.StructType | str, glob: str = "*"
) -> DataFrame:
    """Tab-separated variant of :func:`scan_csv_dir`."""
    return scan_csv_dir(spark, path, schema, glob, sep="\t")


def scan_two_space_table(
    spark: SparkSession,
    path: Paths,
    names: Sequence[str],
    na: str = "9999 9999",
    row: str = "^[0-9]{2}$",
) -> DataFrame:
    """Table with two spaces between columns; lines are told by the first one."""
    line = F.regexp_replace("value", r"[\\}]+$", "")
    part = F.split(line, " {2}")
    lines = spark.read.text(_paths(path)).select(part.alias("_p"))
    kept = lines.where(F.get("_p", F.lit(0)).rlike(row))
    return kept.select(
        *[
            F.nullif(F.get("_p", F.lit(i)), F.lit(na)).alias(n)
            for i, n in enumerate(names)
        ]
    )


def import_stations(
    spark: SparkSession,
    path: Paths,
    codes: Sequence[str],
    schema: T.StructType | str,
    glob: str = "*.csv",
    station: str = "station_code",
) -> DataFrame:
    """Several stations from one archive, the station code as first column.

    The code is found in the file's name, or in the names of ``key=value``
    folders right above it, as a word of its own: neither a letter nor a digit
    before it, and after it nothing, a separator or the four digits of a year.
    The longest code wins; files of other stations are pruned, also those whose
    code merely begins with one asked for.
    """
    if not codes:
        raise ValueError("no station codes given")
    df = spark.read.schema(schema).options(**CSV, pathGlobFilter=glob).csv(_paths(path))
    listed = "|".join(re.escape(c) for c in sorted(codes, key=len, reverse=True))
    name = F.regexp_extract(F.col("_metadata.file_path"), r"((?:[^/=]+=[^/]*/)*[^/]*)$", 1)
    code = F.regexp_extract(name, f"(?<![A-Za-z0-9])({listed})(?=(?:[0-9]{{4}})?(?:[^A-Za-z0-9]|$))", 1)
    names = [f.name for f in df.schema.fields if f.name != station]
    return df.where(code != "").select(code.alias(station), *cols(names))


def bind_files_by_key(
    sources: Mapping[str, DataFrame],
    key: str,
    drop: Sequence[str] = (),
    order: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Tables side by side on a key, columns suffixed by their source's name.

    The k-th row of a key in one source stands beside the k-th of the others,
    so a key that stands n and m times gives max(n, m) rows, and keys only
    some sources have stay, with NULLs for the others. NULL is a key like any
    other. ``order`` names the columns that put a key's rows in order, the
    first a number, day or stamp; without it they are in the order of a hash
    of the row. Rows are numbered block by block and then meet in one
    aggregate on (key, number), whatever the number of sources, so that a key
    or NULL that holds a third of the rows is spread over all tasks.
    """
    if not sources:
        raise ValueError("no tables given")
    parts, kinds = [], {}
    for i, (name, df) in enumerate(sources.items()):
        require(df, [key, *order])
        values = [c for c in df.columns if c != key and c not in drop]
        own = df.select(
            col(key).alias("_key"),
            *([col(c).alias(f"_o{j}") for j, c in enumerate(order)] or [F.xxhash64(*cols(df.columns)).alias("_o0")]),
            F.struct(*[col(c).alias(f"{c}_{name}") for c in values], F.lit(i).alias("_")).alias(f"_s{i}"),
        )
        own = row_index(own, ["_key"], [c for c in own.columns if c.startswith("_o")], "_k", block_rows)
        kinds[f"_s{i}"] = [f"{c}_{name}" for c in values]
        parts.append(own.select("_key", "_k", f"_s{i}"))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    met = rows.groupBy("_key", "_k").agg(*[F.first(s, ignorenulls=True).alias(s) for s in kinds])
    return met.select(
        F.col("_key").alias(key), *[F.col(s).getField(c).alias(c) for s, names in kinds.items() for c in names]
    )
