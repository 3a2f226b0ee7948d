"""Joins. None is forced to broadcast: Spark decides from measured sizes.

Spark's measure of an exploded table is that of the table before, so joins
with one that may be large are forced not to be broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import micros, plus
from ..functions.columns import all_of, col, cols, keyed, matches, require
from .blocks import BLOCK_ROWS, dense_index
from .staging import settled


def left_join_key(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left equi join; NULL keys match each other."""
    extra = [c for c in b.columns if c not in keys]
    right = keyed(b, keys)
    return a.join(right, matches(a, right, keys), "left").select(*cols(a.columns), *cols(extra))


def right_join_2key(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keep every row of ``b``; keys first, then ``a``'s columns, then ``b``'s."""
    of_a = [c for c in a.columns if c not in keys]
    of_b = [c for c in b.columns if c not in keys]
    side = keyed(a, keys)
    return b.join(side, matches(b, side, keys), "left").select(
        *cols(keys), *cols(of_a), *cols(of_b)
    )


def left_join_suffix(
    a: DataFrame, fixes: DataFrame, key: str, column: str, suffix: str = "_ok", fixed: str | None = None
) -> DataFrame:
    """Join corrections by key; ``<column>_fix`` takes the correction if any."""
    right = fixes.select(col(key).alias("_key"), col(column).alias(column + suffix))
    joined = a.join(right, a[key].eqNullSafe(right["_key"]), "left").drop("_key")
    return joined.withColumn(
        fixed or f"{column}_fix", F.coalesce(col(column + suffix), col(column))
    )


def left_join_date(days: DataFrame, obs: DataFrame, date: str, ts: str) -> DataFrame:
    """Every day with its observations; days without any keep one row."""
    keep = [c for c in obs.columns if c not in days.columns]
    o = obs.select(F.to_date(col(ts)).alias("_on"), *[col(c).alias(c) for c in keep])
    return days_with_rows(days, o, date, "_on").select(*cols(days.columns), *cols(keep))


def days_with_rows(days: DataFrame, rows: DataFrame, date: str, on: str) -> DataFrame:
    """Left join of a small day table with rows of many sources by day.

    Written as an inner join, which can move the small side to the rows or
    split a crowded day among tasks (a left outer join can do neither), and
    the days without rows, whose columns are NULL.
    """
    met = days.join(rows, days[date] == rows[on])
    seen = rows.select(col(on).alias("_seen")).distinct()
    alone = days.join(seen, days[date] == seen["_seen"], "left_anti")
    return met.unionByName(alone, allowMissingColumns=True)


def anti_join_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` absent from ``b`` on all shared columns; copies stay."""
    shared = [c for c in a.columns if c in b.columns]
    if not shared:
        raise ValueError("no shared columns")
    right = keyed(b.select(*cols(shared)), shared).distinct()
    return a.join(right, matches(a, right, shared), "left_anti")


def semi_join_list(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of ``a`` whose key occurs in ``b``."""
    right = b.select(col(key).alias("_key")).distinct()
    return a.join(right, a[key] == right["_key"], "left_semi")


def _own(intervals: DataFrame, start: str, end: str, first: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Keys ``_k0..``, the struct ``_first`` and the half-open range ``_from``, ``_to`` of usable intervals."""
    return intervals.where(col(start) <= col(end)).select(
        *[col(k).alias(f"_k{i}") for i, k in enumerate(by)],
        F.struct(*cols(first)).alias("_first"),
        micros(start).alias("_from"),
        (micros(end) + 1).alias("_to"),
    )


def _exploded(df: DataFrame, few: bool) -> DataFrame:
    """A side of a join with many more rows than Spark reckons, which would fill the driver if it were broadcast."""
    return df if few else df.hint("merge")


def segments(
    intervals: DataFrame,
    start: str,
    end: str,
    first: Sequence[str],
    by: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
    n: int | None = None,
) -> DataFrame:
    """Closed intervals as disjoint segments ``_from`` to ``_to`` (exclusive, in microseconds) of keys ``_k0..``.

    ``_first`` is the least struct of the ``first`` columns among the intervals
    open in the segment; where none is open there is no segment. The borders
    of a series are numbered, block by block; an interval covers a range of
    numbers and is entered at the nodes of a binary tree over them that make
    up the range, two a level at most. A segment takes the least entry on its
    way to the root. So an interval costs rows by the logarithm of the number
    of borders, whatever it spans and however many are open with it; nothing
    is collected into lists. ``n`` is the number of intervals, if it is known;
    no more than a block of them are kept in one partition and not shuffled.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    own = _own(intervals, start, end, first, by)
    n = own.count() if n is None else n
    few = 2 * n <= block_rows
    borders = (own.coalesce(1) if few else own).withColumn("_at", F.explode(F.array("_from", "_to")))
    if few:
        ranked = borders.withColumn("_rank", F.dense_rank().over(Window.partitionBy(*keys).orderBy("_at")).cast("bigint"))
    else:
        ranked = dense_index(borders, keys, ["_at"], "_rank", block_rows)
    ranked = settled(ranked).coalesce(1) if few else settled(ranked)
    # an interval's two borders meet again; copies of it fall together
    ranges = ranked.groupBy(*keys, "_first", "_from", "_to").agg(F.min("_rank").alias("_l"), F.max("_rank").alias("_r"))
    levels = F.sequence(F.lit(0), F.lit((2 * n).bit_length()))

    def node(level: Column, place: Column) -> Column:
        return F.struct(level.alias("level"), place.cast("bigint").alias("place"))

    def nodes(level: Column) -> Column:
        size = F.pow(F.lit(2), level).cast("bigint")
        left, right = F.ceil(F.col("_l") / size), F.floor(F.col("_r") / size)
        inside = left < right
        return F.array(F.when(inside & (left % 2 == 1), node(level, left)), F.when(inside & (right % 2 == 1), node(level, right - 1)))

    def above(level: Column) -> Column:
        return node(level, F.floor(F.col("_rank") / F.pow(F.lit(2), level).cast("bigint")))

    entries = ranges.select(*keys, "_first", F.explode(F.array_compact(F.flatten(F.transform(levels, nodes)))).alias("_n"))
    least = entries.groupBy(*keys, "_n").agg(F.min("_first").alias("_first"))
    right = least.select(*[F.col(k).alias(f"_n{k}") for k in keys], F.col("_n").alias("_nn"), "_first")
    places = ranked.select(*keys, "_at", "_rank").distinct()
    ways = places.select(*keys, "_rank", F.explode(F.transform(levels, above)).alias("_n"))
    on = [ways[k].eqNullSafe(right[f"_n{k}"]) for k in keys] + [ways["_n"] == right["_nn"]]
    found = _exploded(ways, few).join(right, all_of(on)).select(*keys, "_rank", "_first")
    # each border begins a segment and ends the one before
    ends = F.explode(
        F.array(
            F.struct(F.col("_rank").alias("rank"), F.col("_at").alias("low"), F.lit(None).cast("bigint").alias("high")),
            F.struct((F.col("_rank") - 1).alias("rank"), F.lit(None).cast("bigint").alias("low"), F.col("_at").alias("high")),
        )
    )
    marks = places.select(*keys, ends.alias("_e")).select(
        *keys, F.col("_e.rank").alias("_rank"), F.col("_e.low").alias("_from"), F.col("_e.high").alias("_to")
    )
    whole = marks.unionByName(found, allowMissingColumns=True).groupBy(*keys, "_rank")
    parts = whole.agg(F.min("_from").alias("_from"), F.min("_to").alias("_to"), F.min("_first").alias("_first"))
    return parts.where(F.col("_first").isNotNull()).drop("_rank")


#: Segments of one cell from which it gets a grid of its own.
CROWD = 32


def interval_join_first(
    df: DataFrame,
    ts: str,
    intervals: DataFrame,
    by: Sequence[str] = (),
    start: str = "start_ts",
    end: str = "end_ts",
    label: str = "label",
    seq: str = "seq",
    name: str | None = None,
    crowd: int = CROWD,
) -> DataFrame:
    """Label of the first interval, in ``seq`` order, that contains ``ts``.

    Intervals are closed. They are first turned into disjoint `segments`, each
    with the first interval open in it, so that a row meets one segment at
    most and the row count never changes. Segments are listed under the cells
    of a time grid as wide as the spans have room for borders, which lists
    each three times on average whatever their lengths; a cell with more than
    ``crowd`` of them gets a grid of its own, as often as it takes. Rows and
    segments then meet in one equality join on keys and cell. NULL keys match
    each other; a NULL stamp has no label. The segments are computed when the
    operator is called.
    """
    name = name or label
    require(intervals, [*by, start, end, label, seq])
    first, keys = [seq, start, end, label], [f"_k{i}" for i in range(len(by))]
    spans = _own(intervals, start, end, first, by).groupBy(*keys)
    spans = spans.agg(F.count("*").alias("n"), (F.max("_to") - F.min("_from")).cast("decimal(38,0)").alias("w"))
    n, span = spans.agg(F.sum("n"), F.sum("w")).first()
    rows = df.select(F.struct(*cols(df.columns)).alias("_row"), *[col(k).alias(n) for k, n in zip(by, keys)], micros(ts).alias("_t"))
    if not n:
        return rows.select("_row.*", F.lit(None).cast(intervals.schema[label].dataType).alias(name))
    grid = {"_low": F.lit(0).cast("bigint"), "_wide": F.lit(max(1, int(span) // (2 * n))).cast("bigint")}
    listed, rows, cells = settled(segments(intervals, start, end, first, by, n=n)).withColumns(grid), rows.withColumns(grid), []

    def cell(at: Column) -> Column:
        return F.floor((at - F.col("_low")) / F.col("_wide")).cast("bigint")

    while True:
        here = f"_c{len(cells)}"
        # the part of a segment inside its cell's grid
        begin = F.greatest(F.col("_from"), F.col("_low")) if cells else F.col("_from")
        close = F.least(F.col("_to"), F.col("_high")) if cells else F.col("_to")
        listed = listed.withColumn(here, F.explode(F.sequence(cell(begin), cell(close - 1))))
        rows = rows.withColumn(here, cell(F.col("_t")))
        cells.append(here)
        if 2 * n <= crowd:  # fewer segments than a cell may have
            break
        crowded = listed.groupBy(*keys, *cells, "_wide").agg(F.count("*").alias("_n"))
        crowded = crowded.where((F.col("_n") > crowd) & (F.col("_wide") > 1))
        if crowded.isEmpty():
            break
        finer = settled(crowded.withColumn("_fine", F.ceil(F.col("_wide") / F.col("_n")).cast("bigint")).drop("_wide", "_n"))
        listed, rows = (_regrid(x, finer, keys, cells) for x in (listed, rows))
    side = listed.select(*[F.col(k).alias(f"_s{k}") for k in [*keys, *cells]], "_from", "_to", "_first")
    on = [F.col(k).eqNullSafe(F.col(f"_s{k}")) for k in keys] + [F.col(c) == F.col(f"_s{c}") for c in cells]
    met = rows.join(_exploded(side, 2 * n <= BLOCK_ROWS), all_of([*on, F.col("_t") >= F.col("_from"), F.col("_t") < F.col("_to")]), "left")
    return met.select("_row.*", F.col("_first").getField(label).alias(name))


def _regrid(x: DataFrame, finer: DataFrame, keys: Sequence[str], cells: Sequence[str]) -> DataFrame:
    """Give crowded cells a finer grid that begins and ends with them; the others become one cell."""
    side = finer.select(*[F.col(k).alias(f"_f{k}") for k in [*keys, *cells]], "_fine")
    on = [F.col(k).eqNullSafe(F.col(f"_f{k}")) for k in keys] + [F.col(c) == F.col(f"_f{c}") for c in cells]
    low = F.col("_low") + F.col(cells[-1]) * F.col("_wide")
    kept = [c for c in x.columns if c not in ("_low", "_wide", "_high")]
    return x.join(side, all_of(on), "left").select(
        *kept, low.alias("_low"), (low + F.col("_wide")).alias("_high"), F.coalesce("_fine", "_wide").alias("_wide")
    )


def daylight(sun: DataFrame, rise: str, set_: str, pad_hours: int = 1) -> DataFrame:
    """Padded daylight bounds ``light_from`` and ``light_to`` of each day."""
    return sun.withColumns(
        {"light_from": plus(rise, -pad_hours, "HOUR"), "light_to": plus(set_, pad_hours, "HOUR")}
    )


def interval_join_daylight(
    df: DataFrame, sun: DataFrame, ts: str, date: str = "date", pad_hours: int = 1
) -> DataFrame:
    """Add ``in_daylight``: whether ``ts`` lies between rise and set, padded.

    ``sun`` has one row per ``date`` with ``rise`` and ``set`` stamps. NULL on
    days the table does not have.
    """
    lit_days = daylight(sun, "rise", "set", pad_hours).select(
        col(date).alias("_on"), "light_from", "light_to"
    )
    rows = df.withColumn("_day", F.to_date(col(ts)))
    return rows.join(lit_days, rows["_day"] == lit_days["_on"], "left").select(
        *cols(df.columns), col(ts).between(F.col("light_from"), F.col("light_to")).alias("in_daylight")
    )
