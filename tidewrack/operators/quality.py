"""Duplicates, set comparison, embedded headers, sorting and limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clock
from ..functions.columns import col, cols, keyed, matches, require
from .blocks import row_index
from .joins import anti_join_all
from .staging import attach, settled

COPIES_PER_SLICE = 100_000


def duplicate_count(df: DataFrame) -> DataFrame:
    """How many rows are second or later copies of a fully identical row."""
    per_row = df.groupBy(*cols(df.columns)).agg(F.count("*").alias("_n"))
    return per_row.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("n_duplicates"))


def duplicate_rows(df: DataFrame, name: str = "copy_no") -> DataFrame:
    """The second and later copies themselves, numbered from 2.

    Copies are counted with map-side aggregation and written out again from
    the count, in slices that are spread over tasks: a row repeated billions
    of times is never gathered in one place.
    """
    counted = df.groupBy(*cols(df.columns)).agg(F.count("*").alias("_n"))
    return repeat_rows(counted, "_n", first=2, name=name)


def repeat_rows(df: DataFrame, times: str, first: int = 1, name: str = "copy_no") -> DataFrame:
    """Each row once per number from ``first`` to its count in ``times``.

    Long runs are cut into slices that are shuffled before they are written
    out, so that one count does not become one task.
    """
    size, n = COPIES_PER_SLICE, col(times)
    rest = [c for c in df.columns if c != times]
    slices = (
        df.where(n >= first)
        .withColumn("_slice", F.explode(F.sequence(F.lit(0), F.floor((n - first) / size))))
        .repartition(F.col("_slice"), *cols(rest))
    )
    start = F.col("_slice") * size + first
    numbers = F.sequence(start.cast("bigint"), F.least(n, start + (size - 1)))
    return slices.select(*cols(rest), F.explode(numbers).alias(name))


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def key_repeats(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows whose key occurs more than once.

    Counting and a semi join; a window over the key would put all rows of a
    hot key into one task. NULL keys count as equal.
    """
    repeated = df.groupBy(*cols(keys)).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    right = keyed(repeated, keys)
    return df.join(right, matches(df, right, keys), "left_semi")


def set_equal(a: DataFrame, b: DataFrame, digits: int | None = None) -> DataFrame:
    """One row telling whether two tables hold the same set of rows.

    Order and multiplicity do not matter. With ``digits`` fractional columns
    are rounded half-even first. NULLs equal each other.
    """
    if set(a.columns) != set(b.columns):
        raise ValueError("tables have different columns")

    def prepared(df: DataFrame, side: str) -> DataFrame:
        kinds = dict((f.name, f.dataType) for f in df.schema.fields)
        out = [
            F.bround(col(c), digits).alias(c)
            if digits is not None and isinstance(kinds[c], T.DoubleType | T.FloatType)
            else col(c)
            for c in a.columns
        ]
        return df.select(*out, F.lit(side == "a").alias("_a"), F.lit(side == "b").alias("_b"))

    sides = (
        prepared(a, "a")
        .unionByName(prepared(b, "b"))
        .groupBy(*cols(a.columns))
        .agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    )
    return sides.agg(
        F.count_if(~F.col("_b")).alias("only_a"), F.count_if(~F.col("_a")).alias("only_b")
    ).select(
        ((F.col("only_a") == 0) & (F.col("only_b") == 0)).alias("set_equal"), "only_a", "only_b"
    )


def file_ranges(df: DataFrame, file: str, record: str, ts: str) -> DataFrame:
    """Record and stamp range of each file."""
    return df.groupBy(col(file)).agg(
        F.count("*").alias("n"),
        F.min(col(record)).alias("min_record"),
        F.max(col(record)).alias("max_record"),
        F.min(col(ts)).alias("min_ts"),
        F.max(col(ts)).alias("max_ts"),
    )


def prefix_difference(a: DataFrame, b: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows among the first ``nrow(b)`` of ``a`` that ``b`` does not have."""
    length = b.agg(F.count("*").alias("n")).scalar()
    head = row_index(a, [], order, "_i").where(F.col("_i") <= length).drop("_i")
    return anti_join_all(head, b)


def file_overlap(
    df: DataFrame, file: str, record: str, ts: str, first: str, second: str
) -> DataFrame:
    """Ranges per file, and how many leading rows of ``first`` (as many as
    ``second`` has) are absent from ``second``: 0 means a repeated prefix."""
    body = [c for c in df.columns if c != file]
    a = df.where(col(file) == first).select(*cols(body))
    b = df.where(col(file) == second).select(*cols(body))
    missing = prefix_difference(a, b, [record]).agg(F.count("*").alias("n")).scalar()
    return file_ranges(df, file, record, ts).withColumn("prefix_missing", missing)


def records_after(df: DataFrame, fixes: DataFrame, record: str) -> DataFrame:
    """Rows beyond the last corrected record."""
    return df.where(col(record) > fixes.agg(F.max(col(record)).alias("m")).scalar())


def head_rows(
    df: DataFrame, n: int, order: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """First ``n`` rows in a stated order, of the table or of each group.

    Either way each map task passes on at most ``n`` rows (per group).
    """
    require(df, [*order, *by])
    if not by:
        return df.orderBy(*cols(order)).limit(n)
    place = F.row_number().over(Window.partitionBy(*cols(by)).orderBy(*cols(order)))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def drop_first(
    df: DataFrame, n: int, order: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """All but the first ``n`` rows.

    Exactly ``n`` rows go (of each group, or all it has); which of several
    rows alike in ``order`` go is not defined. Rows beyond the last dropped
    one stay where they are; only those that share its place are compared
    with the dropped rows, as sets with multiplicities.
    """
    if n <= 0:
        return df
    head = settled(head_rows(df, n, order, by))
    last = head.groupBy(*cols(by)).agg(F.max(F.struct(*cols(order))).alias("_last"))
    placed = attach(df, last, by)
    here = F.struct(*cols(order))
    beyond = placed.where(here > F.col("_last")).select(*cols(df.columns))
    tied = placed.where(here == F.col("_last")).select(*cols(df.columns))
    gone = attach(head, last, by).where(here == F.col("_last")).select(*cols(df.columns))
    return beyond.unionByName(tied.exceptAll(gone))


def time_cutoff(
    df: DataFrame,
    ts: str,
    before: str,
    first_dropped: int,
    order: Sequence[str],
    by: Sequence[str] = (),
) -> DataFrame:
    """Rows stamped before a moment, without the first few of them."""
    kept = df.where(col(ts) < F.lit(before).cast("timestamp_ntz"))
    return drop_first(kept, first_dropped, order, by)


def union_all(tables: Sequence[DataFrame], lenient: bool = False) -> DataFrame:
    """Stack tables by name; only ``lenient`` fills missing columns with NULL."""
    if not tables:
        raise ValueError("nothing to stack")
    out = tables[0]
    for t in tables[1:]:
        if not lenient and set(t.columns) != set(out.columns):
            raise ValueError(f"columns differ: {sorted(set(t.columns) ^ set(out.columns))}")
        out = out.unionByName(t, allowMissingColumns=lenient)
    return out


def repair_embedded_headers(
    df: DataFrame,
    need_time: bool,
    date: str = "Date (MM/DD/YYYY)",
    time: str = "Time (HH:mm:ss)",
    sort: bool = True,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Drop stray header rows (their date does not parse) and sort by stamp.

    With ``need_time`` rows without a readable time go as well; otherwise
    they stay and sort last within their day. ``tie`` orders rows of the same
    stamp; with it a crowded stamp can be spread over tasks.
    """
    d = clock.parse_date(date, clock.MDY)
    t = F.try_to_timestamp(col(time), F.lit("H:mm:ss")).cast("timestamp_ntz")
    out = df.withColumns({"_d": d, "_t": t}).where(F.col("_d").isNotNull())
    if need_time:
        out = out.where(F.col("_t").isNotNull())
    if sort:
        out = out.orderBy(F.asc_nulls_last("_d"), F.asc_nulls_last("_t"), *cols(tie))
    return out.drop("_d", "_t")


def place_of_rows(df: DataFrame, name: str = "place") -> DataFrame:
    """Each row's place in the order the table comes in, from 0.

    One number per partition is counted first; rows stay where they are.
    """
    kept = settled_in_order(df)
    counts = sorted(map(tuple, kept.groupBy("_part").agg(F.count("*")).collect()))
    starts, base = [], 0
    for part, n in counts:
        starts.append((part, base))
        base += n
    right = df.sparkSession.createDataFrame(starts, "_p int, _base bigint")
    joined = kept.join(right, kept["_part"] == right["_p"])
    return joined.select(*cols(df.columns), (F.col("_base") + F.col("_row")).alias(name))


def settled_in_order(df: DataFrame) -> DataFrame:
    """The table written out with each row's partition and place in it."""
    row = F.monotonically_increasing_id()
    marked = df.withColumns({"_part": F.shiftright(row, 33).cast("int"), "_row": row.bitwiseAND(F.lit((1 << 33) - 1))})
    return settled(marked)


def sort_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ascending, NULLs last; a range-partitioned sort over the whole table."""
    return df.orderBy(*[F.asc_nulls_last(k) for k in keys])
