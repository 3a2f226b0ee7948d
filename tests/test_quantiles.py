"""Exact order statistics against Spark's own percentile."""

import pytest
from pyspark.sql import functions as F

from tidewrack.operators.quantiles import order_stats, quantiles


def data(spark):
    return spark.range(6000).select(
        F.when(F.col("id") % 7 < 5, F.lit("hot")).when(F.col("id") % 7 == 5, "b").alias("g"),
        F.when(F.col("id") % 50 == 0, None)
        .when(F.col("id") % 51 == 0, float("nan"))
        .otherwise(F.floor(F.pmod(F.hash("id"), F.lit(3000)) / 3).cast("double"))
        .alias("x"),
    )


@pytest.mark.parametrize("accuracy", [60, 10_000])
@pytest.mark.parametrize("by", [["g"], []])
def test_quantiles_are_exact(spark, accuracy, by):
    df = data(spark)
    probs = {"q0": 0.0, "q10": 0.1, "q25": 0.25, "q50": 0.5, "q90": 0.9, "q100": 1.0}
    got = quantiles(df, by, "x", probs, accuracy)
    clean = df.where(F.col("x").isNotNull() & ~F.isnan("x"))
    want = clean.groupBy(*by).agg(
        F.count("*").alias("n"),
        *[F.percentile("x", F.lit(p)).alias(name) for name, p in probs.items()],
    )
    fix = lambda d: sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in d.collect())
    assert fix(got.withColumnRenamed("_n", "n").select(*want.columns)) == fix(want)


def test_a_rank_outside_its_bracket_is_found(spark):
    df = spark.range(5000).select(F.col("id").cast("double").alias("x"), (F.col("id") % 3).alias("g"))
    got = order_stats(df, [], "x", {"r": (0.2, F.col("_n") - 1), "s": (0.9, F.lit(7))}, accuracy=100).first()
    assert (got["r"], got["s"]) == (4999.0, 7.0)
    by = order_stats(df, ["g"], "x", {"r": (0.5, F.lit(0))}, accuracy=100).collect()
    assert {r["g"]: r["r"] for r in by} == {0: 0.0, 1: 1.0, 2: 2.0}


def test_no_task_sorts_a_large_bracket(spark):
    df = spark.range(20000).select(F.pow(F.pmod(F.hash("id"), F.lit(100000)).cast("double"), F.lit(3)).alias("x"), (F.col("id") % 2).alias("g"))
    for most in (5, 400):
        ranks = {"a": (0.1, F.floor(F.col("_n") * 0.1)), "b": (0.1, F.ceil(F.col("_n") * 0.1)), "c": (0.7, F.floor(F.col("_n") * 0.7))}
        got = {r["g"]: r for r in order_stats(df, ["g"], "x", ranks, accuracy=50, most=most).collect()}
        for g in (0, 1):
            x = sorted(r["x"] for r in df.where(F.col("g") == g).collect())
            n = len(x)
            assert (got[g]["a"], got[g]["b"], got[g]["c"]) == (x[int(n * 0.1)], x[-int(-n * 0.1 // 1)], x[int(n * 0.7)])
