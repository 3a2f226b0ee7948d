"""Compare a query with its oracle SQL, run by DuckDB on the same files.

Usage: python -m tests.oracle [sf] [key ...]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time
from collections import Counter

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
DATA = os.environ.get("TEST_DATA", "/root/testdata")


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def text(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "NULL" if math.isnan(v) else repr(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    return f"{type(v).__name__}:{v}"


def table_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(text(r[i]) for i in order) for r in rows)


def compare(spark, con, run, sql: str, sf_dir: str):
    df = run(spark, sf_dir)
    mine = table_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = table_of(names, cur.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} != {theirs[0]}"
    if mine[1] != theirs[1]:
        a, b = mine[1] - theirs[1], theirs[1] - mine[1]
        return (
            f"rows {sum(mine[1].values())} / {sum(theirs[1].values())}, differ {sum(a.values())} / {sum(b.values())}"
            f"\n   cols   {mine[0]}\n   spark  {list(a)[:3]}\n   oracle {list(b)[:3]}"
        )
    if not mine[1]:
        return "both are empty"
    return None


def main() -> int:
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", os.environ.get("TEST_TZ", "UTC"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"{DATA}/{sf}"
    con = duck(sf_dir)
    wanted = sys.argv[2:] or list(oracle_sql())
    bad = 0
    for key in wanted:
        t = time.time()
        try:
            error = compare(spark, con, queries()[key], oracle_sql()[key], sf_dir)
        except Exception as e:  # report and go on with the next query
            error = f"{type(e).__name__}: {str(e)[:700]}"
        bad += error is not None
        print(f"{'ok ' if error is None else 'BAD'} {key} {time.time() - t:.1f}s {error or ''}", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} agree")
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
