"""Joins, duplicates and set comparison."""

import datetime as dt
import random

import pytest

from tidewrack.operators import joins, quality

from .helpers import frame, rows, ts


def test_overlapping_intervals_take_the_first_listed(spark):
    dep = frame(
        spark, "seq int,start_ts ts,end_ts ts,label string",
        [(7, "2023-03-01 06:00:00", "2023-03-20 18:00:00", "first"), (8, "2023-03-20 12:00:00", "2023-04-10 06:30:00", "second")],
    )
    at = ["2023-03-01 05:59:59", "2023-03-01 06:00:00", "2023-03-20 15:00:00", "2023-03-20 18:00:00",
          "2023-03-20 18:00:01", "2023-04-10 06:30:00", "2023-04-10 06:30:01"]
    out = joins.interval_join_first(frame(spark, "t ts", [(a,) for a in at]), "t", dep, name="sonde")
    assert [r[1] for r in rows(out, "t")] == [None, "first", "first", "first", "second", "second", None]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_intervals_by_station_with_null_key(spark):
    dep = frame(spark, "s string,seq int,start_ts ts,end_ts ts,label string",
                [(None, 1, "2023-01-01 00:00:00", "2023-01-03 00:00:00", "X"), ("a", 2, "2023-01-01 00:00:00", "2023-01-03 00:00:00", "Y")])
    df = frame(spark, "s string,t ts", [(None, "2023-01-02 00:00:00"), ("a", "2023-01-02 00:00:00"), ("b", "2023-01-02 00:00:00")])
    got = {r.s: r.label for r in joins.interval_join_first(df, "t", dep, ["s"]).collect()}
    assert got == {None: "X", "a": "Y", "b": None}


def plain_first(intervals, key, t):
    open_ = [(seq, s, e, label) for k, seq, s, e, label in intervals if k == key and s is not None and e is not None and s <= t <= e]
    return min(open_)[3] if open_ else None


@pytest.mark.parametrize("crowd", [joins.CROWD, 2])
def test_intervals_against_looking_at_all(spark, crowd):
    """Long and short intervals, copies, touching ends, single stamps, a crowded hour in an empty year, NULLs."""
    rng, zero = random.Random(11), ts("2023-01-01")
    some = []
    for i in range(400):
        begin = zero + dt.timedelta(seconds=rng.choice([rng.randrange(3600), rng.randrange(3600), rng.randrange(31_000_000)]))
        length = dt.timedelta(microseconds=rng.choice([0, 1, 7_000_000, 10**9, rng.randrange(10**13)]))
        some.append((rng.choice(["a", "a", "b", None]), rng.randrange(60), begin, begin + length, f"l{i % 50}"))
    some += some[:5] + [("a", -1, zero, zero - dt.timedelta(1), "never"), ("a", -2, None, zero, "no start"), ("b", -2, zero, None, "no end")]
    kind = "s string, seq int, start_ts timestamp_ntz, end_ts timestamp_ntz, label string"
    borders = [x[i] + dt.timedelta(microseconds=d) for x in some[:200] for i in (2, 3) for d in (-1, 0, 1) if x[0]]
    at = [(k, t) for t in rng.sample(borders, 300) for k in ("a", "b", None, "c")] + [("a", None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in at], "s string, t timestamp_ntz, _first string, _low int")
    out = joins.interval_join_first(df, "t", spark.createDataFrame(some, kind), ["s"], crowd=crowd)
    assert out.columns == ["s", "t", "_first", "_low", "label"]
    got = sorted(((r.s, r.t, r.label) for r in out.collect()), key=repr)
    assert got == sorted(((k, t, plain_first(some, k, t) if t else None) for k, t in at), key=repr)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "collect_list" not in plan


def test_segments_are_disjoint_across_blocks(spark):
    rng, zero = random.Random(12), ts("2023-01-01")
    some = [(i, zero + dt.timedelta(hours=rng.randrange(500)), rng.randrange(90)) for i in range(300)]
    some = [(i, s, s + dt.timedelta(hours=h), "x") for i, s, h in some]
    df = spark.createDataFrame(some, "seq int, start_ts timestamp_ntz, end_ts timestamp_ntz, label string")
    whole = [rows(joins.segments(df, "start_ts", "end_ts", ["seq"], block_rows=n), "_from") for n in (1 << 16, 8)]
    assert whole[0] == whole[1]
    assert all(a[1] <= b[0] for a, b in zip(whole[0], whole[0][1:]))


def test_many_intervals_are_not_broadcast(spark, monkeypatch):
    """Listed under nodes and cells they are many times as large as Spark reckons."""

    def moved(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan

    at = [ts("2023-01-01") + dt.timedelta(minutes=i) for i in range(60)]
    some = [(i, a, a + dt.timedelta(minutes=i % 7), f"l{i}") for i, a in enumerate(at)]
    spans = spark.createDataFrame(some, "seq long, start_ts timestamp_ntz, end_ts timestamp_ntz, label string")
    parts = joins.segments(spans, "start_ts", "end_ts", ["seq", "label"], block_rows=32)
    assert len(parts.collect()) > 60 and moved(parts)
    monkeypatch.setattr(joins, "BLOCK_ROWS", 32)
    out = joins.interval_join_first(frame(spark, "t ts", [(a,) for a in at]), "t", spans, crowd=1000)
    got = {r.t: r.label for r in out.collect()}
    assert got == {t: plain_first([(None, *x) for x in some], None, t) for t in at} and moved(out)


def test_no_intervals(spark):
    df = frame(spark, "t ts", [("2023-01-01 00:00:00",)])
    none = frame(spark, "seq int,start_ts ts,end_ts ts,label string", [])
    assert rows(joins.interval_join_first(df, "t", none)) == [(ts("2023-01-01"), None)]


def test_anti_join_treats_nulls_as_equal_and_keeps_copies(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x"), (2, "x"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(1, None), (3, "y")], "k int, v string")
    assert rows(joins.anti_join_all(a, b)) == sorted([(2, "x"), (2, "x"), (3, None)], key=repr)
    assert rows(joins.anti_join_all(a, a.where("k = 2"))) == sorted([(1, None), (1, None), (3, None)], key=repr)


def test_right_join_keeps_every_reading(spark):
    pairs = spark.createDataFrame([("A", 1, "seen"), ("C", 1, "seen")], "s string, d int, flag string")
    read = spark.createDataFrame([("A", 1, 0.5), ("A", 1, 0.6), ("B", 1, 0.7)], "s string, d int, x double")
    assert rows(joins.right_join_2key(pairs, read, ["s", "d"])) == [
        ("A", 1, "seen", 0.5), ("A", 1, "seen", 0.6), ("B", 1, None, 0.7),
    ]


def test_corrections_and_days(spark):
    x = frame(spark, "RECORD int,T ts", [(1, "2022-01-01 00:00:00"), (2, "2022-01-01 00:15:00")])
    ok = frame(spark, "RECORD int,T ts", [(2, "2022-01-01 00:10:00")])
    got = rows(joins.left_join_suffix(x, ok, "RECORD", "T"), "RECORD")
    assert got[0][2] is None and got[0][3] == ts("2022-01-01") and got[1][3] == ts("2022-01-01 00:10")
    days = spark.sql("select date'2022-01-01' d union all select date'2022-01-02'")
    assert [r.RECORD for r in joins.left_join_date(days, x, "d", "T").orderBy("d", "RECORD").collect()] == [1, 2, None]


def test_duplicates(spark, monkeypatch):
    monkeypatch.setattr(quality, "COPIES_PER_SLICE", 3)
    data = [("a", None)] * 11 + [("b", 1)] * 2 + [("c", 2)]
    df = spark.createDataFrame(data, "k string, v int")
    got = rows(quality.duplicate_rows(df))
    assert got == sorted([("a", None, i) for i in range(2, 12)] + [("b", 1, 2)], key=repr)
    assert quality.duplicate_count(df).first()[0] == 11
    assert quality.duplicate_count(df.where("k = 'z'")).first()[0] == 0
    assert df.count() - quality.distinct_rows(df).count() == 11


def test_key_repeats(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, "d"), (2, "e")], "k int, v string")
    assert sorted(r.v for r in quality.key_repeats(df, ["k"]).collect()) == ["a", "b", "c", "d"]


def test_set_equal_rounds_half_even_and_ignores_copies(spark):
    a = spark.createDataFrame([(0.25, 1), (0.25, 1), (0.35, None)], "x double, r int")
    b = spark.createDataFrame([(0.2, 1), (0.4, None)], "x double, r int")
    assert tuple(quality.set_equal(a, b, 1).first()) == (True, 0, 0)
    assert tuple(quality.set_equal(a, b).first()) == (False, 2, 2)
    with pytest.raises(ValueError):
        quality.set_equal(a, b.drop("r"))


def test_prefix_and_cutoffs(spark):
    a = frame(spark, "RECORD int,T ts", [(i, f"2022-03-{i:02d} 00:00:00") for i in range(1, 10)])
    b = a.where("RECORD <= 4")
    assert quality.prefix_difference(a, b, ["RECORD"]).count() == 0
    assert rows(quality.prefix_difference(a, a.where("RECORD between 2 and 5"), ["RECORD"]).select("RECORD")) == [(1,)]
    assert [r[0] for r in rows(quality.time_cutoff(a, "T", "2022-03-07", 2, ["RECORD"]), "RECORD")] == [3, 4, 5, 6]
    assert rows(quality.records_after(a, b, "RECORD").select("RECORD")) == [(i,) for i in range(5, 10)]
    assert [r[0] for r in quality.head_rows(a, 2, ["RECORD"]).collect()] == [1, 2]


def test_drop_first_per_group(spark):
    df = spark.createDataFrame([(g, i) for g in ("a", None) for i in range(4)] + [("c", 0)], "g string, i int")
    assert rows(quality.drop_first(df, 2, ["i"], ["g"])) == sorted([("a", 2), ("a", 3), (None, 2), (None, 3)], key=repr)


def test_union_is_strict_unless_told(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2, 3)], "y int, x int")
    with pytest.raises(ValueError):
        quality.union_all([a, b])
    assert rows(quality.union_all([a, b], lenient=True)) == sorted([(1, None), (3, 2)], key=repr)


def test_embedded_headers(spark):
    data = [("12/02/2022", "00:15:00", "3"), ("Date (MM/DD/YYYY)", "Time (HH:mm:ss)", "Temp"), ("12/01/2022", None, "2"),
            ("12/01/2022", "23:45:00", "1")]
    df = spark.createDataFrame(data, "`Date (MM/DD/YYYY)` string, `Time (HH:mm:ss)` string, v string")
    assert [r.v for r in quality.repair_embedded_headers(df, need_time=False).collect()] == ["1", "2", "3"]
    assert [r.v for r in quality.repair_embedded_headers(df, need_time=True).collect()] == ["1", "3"]
    once = quality.repair_embedded_headers(df, need_time=True)
    assert once.collect() == quality.repair_embedded_headers(once, need_time=True).collect()


def test_sort_puts_nulls_last(spark):
    df = spark.createDataFrame([(None,), (2,), (1,)], "x int")
    assert [r[0] for r in quality.sort_rows(df, ["x"]).collect()] == [1, 2, None]
