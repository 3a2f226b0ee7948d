"""Helpers for the tests."""

import datetime as dt


def ts(text):
    return dt.datetime.fromisoformat(text)


def rows(df, *order):
    out = [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
    return out if order else sorted(out, key=repr)


def frame(spark, schema, data):
    """A frame whose timestamp columns are zone-less and given as text."""
    from pyspark.sql import functions as F

    names = [p.strip().split(" ") for p in schema.split(",")]
    plain = ", ".join(f"`{n}` {'string' if k == 'ts' else k}" for n, k in names)
    df = spark.createDataFrame(data, plain)
    return df.select(
        *[F.col(f"`{n}`").cast("timestamp_ntz").alias(n) if k == "ts" else F.col(f"`{n}`") for n, k in names]
    )
