"""Blocked series operators against plain windows, with tiny blocks."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewrack.operators.blocks import dense_index, fill_forward, neighbours, row_index, step_and_fill, with_blocks


def series(spark, seed=1, n=240):
    rnd = random.Random(seed)
    rows, record = [], 0
    for _ in range(n):
        record += rnd.choice([1, 1, 1, 1, 2, 30])
        site = rnd.choice(["a", "a", "a", "b", None])
        rows.append((site, record, rnd.choice([None, None, float(rnd.randint(0, 99))])))
    return spark.createDataFrame(rows, "site string, record bigint, x double")


def rows_of(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("by", [["site"], []])
@pytest.mark.parametrize("block_rows", [5, 1000])
def test_neighbours(spark, by, block_rows):
    df = series(spark)
    w = Window.partitionBy(*by).orderBy("record")
    want = df.select(
        "*",
        *[F.lag("x", k).over(w).alias(f"l{k}") for k in (1, 2, 4)],
        *[F.lead("record", k).over(w).alias(f"r{k}") for k in (1, 4)],
        F.first("record").over(w).alias("f"),
    )
    got = neighbours(
        df, by, ["record"], ["record", "x"], lags=[1, 2, 4], leads=[1, 4], first=True,
        block_rows=block_rows,
    ).select(
        "site", "record", "x",
        F.col("_lag1.x").alias("l1"), F.col("_lag2.x").alias("l2"), F.col("_lag4.x").alias("l4"),
        F.col("_lead1.record").alias("r1"), F.col("_lead4.record").alias("r4"),
        F.col("_first.record").alias("f"),
    )
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("by", [["site"], []])
@pytest.mark.parametrize("block_rows", [5, 1000])
def test_fill_forward_and_row_index(spark, by, block_rows):
    df = series(spark, seed=2)
    w = Window.partitionBy(*by).orderBy("record")
    want = df.select(
        "site", "record",
        F.last("x", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("x"),
        F.row_number().over(w).cast("bigint").alias("i"),
    )
    filled = fill_forward(df, by, ["record"], ["x"], block_rows=block_rows)
    got = row_index(filled, by, ["record"], "i", block_rows=block_rows)
    assert rows_of(got) == rows_of(want)


def test_timestamp_order_with_ties_broken(spark):
    df = spark.sql(
        "select timestamp_ntz'2024-01-01' + interval '1' minute * cast(id / 3 as int) ts, id from range(200)"
    )
    w = Window.orderBy("ts", "id")
    want = df.select("ts", "id", F.lag("id").over(w).alias("p"))
    got = neighbours(df, [], ["ts", "id"], ["id"], lags=[1], block_rows=10).select(
        "ts", "id", F.col("_lag1.id").alias("p")
    )
    assert rows_of(got) == rows_of(want)


def test_unorderable_key_is_refused(spark):
    with pytest.raises(ValueError):
        row_index(series(spark), [], ["site"])


def test_crowded_blocks_are_split(spark):
    # 2000 dense keys, a burst inside them, and one far outlier stretching the range
    df = spark.sql(
        "select id k from range(2000) union all select 1000000 + id * 40 from range(2000) "
        "union all select 4000000000 union all select null"
    ).selectExpr("k", "coalesce(k, -1) x")
    blocked = with_blocks(df, ["k"], block_rows=20)
    sizes = blocked.groupBy("_blk").count()
    assert sizes.agg(F.max("count")).first()[0] <= 80 and sizes.count() > 50  # needs three cuts
    border = blocked.groupBy("_blk").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("_blk").collect()
    assert all(a.hi < b.lo for a, b in zip(border, border[1:]))
    w = Window.orderBy("k")
    want = df.select("k", F.lag("x", 2).over(w).alias("p"), F.row_number().over(w).cast("bigint").alias("i"))
    got = neighbours(df, [], ["k"], ["x"], lags=[2], block_rows=20).select("k", F.col("_lag2.x").alias("p"), "x")
    numbered = row_index(got, [], ["k"], "i", block_rows=20).select("k", "p", "i")
    assert rows_of(numbered) == rows_of(want)


def test_a_hot_stamp_is_cut_by_the_next_column(spark):
    # half the rows carry the same wrong stamp; ids tell them apart
    df = spark.sql(
        "select timestamp_ntz'2024-01-01' + interval '1' minute * (case when id % 2 = 0 then 7 else id end) ts, "
        "id * 3 id, case when id % 5 = 0 then id end x from range(1000)"
    )
    blocked = with_blocks(df, ["ts", "id"], block_rows=20)
    assert blocked.groupBy("_blk").count().agg(F.max("count")).first()[0] <= 80
    w = Window.orderBy("ts", "id")
    want = df.select(
        "ts", "id", F.last("x", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("x"),
        F.lead("id", 3).over(w).alias("n"),
    )
    filled = fill_forward(df, [], ["ts", "id"], ["x"], block_rows=20)
    got = neighbours(filled, [], ["ts", "id"], ["id"], leads=[3], block_rows=20)
    assert rows_of(got.select("ts", "id", "x", F.col("_lead3.id").alias("n"))) == rows_of(want)


def ordered(df, order, block_rows, by=()):
    """Rows must come in order of (series, block, order), and blocks must not interleave."""
    blocked = with_blocks(df, order, block_rows, by)
    w = Window.partitionBy("_grp").orderBy(*order)
    placed = blocked.withColumn("i", F.row_number().over(w))
    spans = placed.groupBy("_grp", "_blk").agg(F.min("i").alias("lo"), F.max("i").alias("hi"), F.count("*").alias("n"))
    assert spans.where("hi - lo + 1 <> n").count() == 0
    follow = Window.partitionBy("_grp").orderBy("_blk")
    assert spans.withColumn("after", F.lead("lo").over(follow)).where("after < hi").count() == 0
    return spans


@pytest.mark.parametrize("kind", ["double", "float", "decimal(9,4)"])
def test_fractional_order_keys(spark, kind):
    df = spark.sql(
        f"select cast(case when id % 50 = 0 then null else rand(3) * pow(10, id % 5) - 1 end as {kind}) x, id k from range(2000)"
    )
    if kind != "decimal(9,4)":
        odd = [float("nan"), float("inf"), float("-inf"), 1e308, -1e308]
        df = df.union(spark.createDataFrame([(x, 9000 + i) for i, x in enumerate(odd * 30)], "x double, k bigint").selectExpr(f"cast(x as {kind})", "k"))
    spans = ordered(df, ["x", "k"], 20)
    assert spans.agg(F.max("n")).first()[0] <= 80
    got = row_index(df, [], ["x", "k"], "i", block_rows=20)
    want = df.withColumn("i", F.row_number().over(Window.orderBy("x", "k")).cast("bigint"))
    assert rows_of(got) == rows_of(want)


def test_wide_bigints(spark):
    df = spark.sql("select cast((id - 500) * 18000000000000000 as bigint) x from range(1000)")
    assert ordered(df, ["x"], 10).agg(F.max("n")).first()[0] <= 40


def test_long_decimals_are_refused(spark):
    with pytest.raises(ValueError):
        row_index(spark.sql("select cast(1 as decimal(30,2)) x"), [], ["x"])


@pytest.mark.parametrize("tie", ["repeat('same long start ', 3) || lpad(cast(id as string), 5, '0')", "cast(id as string)"])
def test_null_and_equal_keys_are_cut_by_text(spark, tie):
    df = spark.sql(f"select cast(case when id % 2 = 0 then null else 7 end as bigint) x, {tie} t from range(1000)")
    assert ordered(df, ["x", "t"], 20).agg(F.max("n")).first()[0] <= 80


def test_many_series_have_few_blocks(spark):
    df = spark.sql("select id % 300 s, id k from range(15000)").union(spark.sql("select -1L, id from range(8000)"))
    spans = ordered(df, ["k"], 100, ["s"])
    assert spans.count() <= 2 * (301 + 23000 // 100)
    assert spans.agg(F.max("n")).first()[0] <= 400


@pytest.mark.parametrize("block_rows", [1, 7, 64, 1 << 16])
def test_all_neighbours_at_once(spark, block_rows):
    df = spark.sql("select id % 3 s, cast(id * 7 % 501 as int) k, case when id % 4 = 0 then id end x from range(500)")
    w = Window.partitionBy("s").orderBy("k")
    want = df.select("s", "k", F.lag("x", 2).over(w), F.lag("k", 3).over(w), F.lead("k", 1).over(w), F.lead("x", 4).over(w), F.first("k").over(w))
    got = neighbours(df, ["s"], ["k"], ["k", "x"], lags=[2, 3], leads=[1, 4], first=True, block_rows=block_rows)
    got = got.select("s", "k", "_lag2.x", "_lag3.k", "_lead1.k", "_lead4.x", "_first.k")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


@pytest.mark.parametrize("block_rows", [1, 5, 1 << 16])
def test_steps_filled_across_borders(spark, block_rows):
    df = spark.sql("select id % 2 s, cast(id * 11 % 400 as int) k, pmod(hash(id), 90) x, pmod(hash(id, 1), 6) = 0 mark from range(400)")
    w = Window.partitionBy("s").orderBy("k")
    jump = F.when(F.col("mark"), F.col("x") - F.lag("x").over(w)).when(F.col("x") > 80, 0)
    want = df.withColumn("j", jump).withColumn("d", F.last("j", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("j")
    steps = lambda at, before: {"d": F.when(at("mark"), at("x") - before("x")).when(at("x") > 80, 0)}
    assert rows_of(step_and_fill(df, ["s"], ["k"], ["x"], steps, block_rows)) == rows_of(want)


@pytest.mark.parametrize("block_rows", [10, 1 << 16])
def test_distinct_values_are_numbered(spark, block_rows):
    df = spark.sql("select id % 2 s, cast(id / 3 as int) k, id from range(600)")
    want = df.withColumn("i", F.dense_rank().over(Window.partitionBy("s").orderBy("k")).cast("bigint"))
    assert rows_of(dense_index(df, ["s"], ["k"], "i", block_rows)) == rows_of(want)


def source_reads(df, path):
    """How often the finished plan scans a folder and shuffles its rows."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    return final.count("FileScan parquet"), len(re.findall(r"\bExchange ", final))


def test_uncut_series_are_read_and_shuffled_once(spark, tmp_path):
    from tidewrack.operators import timeseries as tsr

    path = str(tmp_path / "t")
    spark.sql(
        "select timestamp_ntz'2024-01-01' + interval '15' minute * cast(id as int) TIMESTAMP, id RECORD, '10:00' MaxTempT, '11:00' MinTempT, "
        "'12:00' MaxWSpdT, 'n' sonde, case when id % 50 = 0 then id end deploy, rand(1) temp from range(900)"
    ).write.parquet(path)
    df = spark.read.parquet(path)
    fixed = df.withColumn("ts_fix", F.col("TIMESTAMP"))
    for out in (
        tsr.match_old_new(fixed),
        tsr.time_of_day_check(df),
        tsr.deployment_offset_correction(df, "n", {"temp": 1}, order=["TIMESTAMP"]),
    ):
        assert source_reads(out, path) == (1, 1)


def test_cut_series_are_written_once_and_joined_with_their_borders(spark, tmp_path):
    from tidewrack.operators import timeseries as tsr

    path = str(tmp_path / "t")
    spark.sql("select id k, 'n' sonde, case when id % 50 = 0 then id end deploy, rand(1) temp from range(900)").write.parquet(path)
    df = spark.read.parquet(path)
    out = tsr.deployment_offset_correction(df, "n", {"temp": 1}, order=["k"], block_rows=20)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2 and path not in plan  # the written rows and their borders
