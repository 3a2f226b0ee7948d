"""Row-to-row operators on very long series.

A plain ``Window.partitionBy(station).orderBy(ts)`` sorts a whole station in
one task, and one station may hold a third of the data. Here a series is cut
into blocks of its ordering key, rows are shuffled and sorted by
(station, block) once, and one pass over the sorted blocks finds all that can
be known inside a block. Its result is written out; the rows at the block
borders are read from there, a scan over the blocks in their order carries
what crosses a border (the last few rows, a running count, the last value
seen), and this border table, one row per block, is joined to the rows. The
source is not read again. Series that need no cut are one block each: they
have no borders and are done with the pass alone.

``order`` names the ordering columns; the first must be a number, date or
timestamp. Together they should order a series completely, as Spark rows have
no other order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clock import micros
from ..functions.columns import all_of, col, cols, require
from .staging import settled

BLOCK_ROWS = 1 << 16
TEXT_BYTES = 7  # of a text, as one whole number

_STAMPS = T.TimestampNTZType | T.TimestampType
_FRACTIONS = T.DoubleType | T.FloatType


def order_number(df: DataFrame, name: str) -> Column:
    """An ordering column as a number of the same order and the same ties.

    Whole numbers, stamps, days and decimals of up to 18 digits become
    bigints; doubles and floats stay doubles.
    """
    kind = df.schema[name].dataType
    if isinstance(kind, _STAMPS):
        return micros(name)
    if isinstance(kind, T.DateType):
        return F.datediff(col(name), F.lit("1970-01-01").cast("date")).cast("bigint")
    if isinstance(kind, _FRACTIONS):
        return col(name).cast("double")
    if isinstance(kind, T.DecimalType):
        if kind.precision > 18:
            raise ValueError(f"{name} is {kind.simpleString()}: order by a decimal of at most 18 digits or a double")
        return (col(name) * F.lit(10**kind.scale).cast("decimal(19,0)")).cast("bigint")
    if isinstance(kind, T.NumericType):
        return col(name).cast("bigint")
    raise ValueError(f"{name} is {kind.simpleString()}: order by a number, date or timestamp")


def _numbers(df: DataFrame, name: str) -> Iterator[Column]:
    """The numbers that order by a column, one after the other; several for long texts, none for other kinds."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        longest = df.agg(F.max(F.octet_length(col(name)))).first()[0] or 0
        for at in range(1, longest + 1, TEXT_BYTES):
            digits = F.rpad(F.hex(F.substring(col(name).cast("binary"), at, TEXT_BYTES)), 2 * TEXT_BYTES, "0")
            yield F.conv(digits, 16, 10).cast("bigint")
    elif isinstance(kind, T.BooleanType):
        yield col(name).cast("bigint")
    elif isinstance(kind, T.NumericType | T.DateType | _STAMPS):
        yield order_number(df, name)


class Blocked:
    """A DataFrame cut into blocks, the window that walks inside one, and the scan across them."""

    def __init__(
        self,
        df: DataFrame,
        by: Sequence[str],
        order: Sequence[str],
        block_rows: int = BLOCK_ROWS,
    ):
        require(df, [*by, *order])
        self.by, self.order, self.columns = list(by), list(order), df.columns
        self.df = with_blocks(df, order, block_rows, by)
        #: Whether any series has more than one block.
        self.cut = len(self.df.schema["_blk"].dataType.fields) > 1
        self.window = Window.partitionBy("_grp", "_blk").orderBy(*cols(order))
        self.upto = self.window.rowsBetween(Window.unboundedPreceding, 0)
        #: Over the border table: one row per block, in block order.
        self.across = Window.partitionBy("_grp").orderBy("_blk")
        self.before = self.across.rowsBetween(Window.unboundedPreceding, -1)

    def passed(self, added: Mapping[str, Column], depth: int = 1) -> DataFrame:
        """The rows with columns from one pass over the sorted blocks.

        Where there are borders the result is written out, with each row's
        place from the top of its block and the rows left below it, of which
        no more than ``depth`` are counted.
        """
        if not self.cut:
            return self.df.select("*", *[c.alias(n) for n, c in added.items()])
        below = [F.coalesce(F.lead(F.lit(1), i).over(self.window), F.lit(0)) for i in range(1, depth + 1)]
        place = {"_top": F.row_number().over(self.window), "_left": sum(below[1:], below[0])}
        return settled(self.df.select("*", *[c.alias(n) for n, c in (added | place).items()]))

    def bordered(self, rows: DataFrame, border: DataFrame) -> DataFrame:
        """Border values onto rows; keys are never NULL, so plain equality."""
        return rows.join(settled(border), ["_grp", "_blk"], "left")


def with_blocks(
    df: DataFrame, order: Sequence[str], block_rows: int = BLOCK_ROWS, by: Sequence[str] = ()
) -> DataFrame:
    """Add ``_grp`` (the series) and ``_blk``: which block of its series a row lies in.

    A series of up to four times ``block_rows`` rows is one block. A longer
    one is cut into equal ranges of the first ordering column, and a range
    that still holds too many rows is cut again by its own range and row
    count. Rows that agree in the column are told apart by the next one, as
    many times as it takes; NULLs, infinities and NaN have ranges of their
    own. Only rows alike in all ordering columns stay together. Each cut
    counts the ordering columns with map-side aggregation; all of it is
    skipped for small tables.
    """
    order_number(df, order[0])  # refuses what cannot decide a block
    rows = df.withColumn("_grp", F.struct(*cols(by), F.lit(0).alias("_")))
    limit, levels = 4 * block_rows, []
    if df.select(*cols(order[:1])).count() > limit:
        for name in order:
            for at in _numbers(df, name):
                while (finer := _crowded(rows, levels, at, limit)) is not None:
                    rows = _cut(rows, df.columns, levels, at, finer, block_rows)
                    levels.append(f"_b{len(levels)}")
    return rows.select(*cols(df.columns), "_grp", F.struct(*levels, F.lit(0).alias("_")).alias("_blk"))


def _finite(x: Column) -> Column:
    """The number, NULL where it is NULL, NaN or infinite."""
    return F.when(F.abs(x) < float("inf"), x)


def _crowded(rows: DataFrame, levels: Sequence[str], at: Column, limit: int) -> DataFrame | None:
    """Blocks of more than ``limit`` rows that this number can cut, with its range; None without any."""
    marked = rows.select("_grp", *levels, at.alias("_at"), _finite(at).alias("_fin"))
    odd = F.when(F.col("_fin").isNull(), F.coalesce(F.col("_at").cast("string"), F.lit("none")))
    found = settled(
        marked.groupBy("_grp", *levels)
        .agg(
            F.count("*").alias("_n"),
            F.min("_fin").alias("_lo"),
            F.max("_fin").alias("_hi"),
            F.min(odd).alias("_odd0"),
            F.max(odd).alias("_odd1"),
        )
        .where(F.col("_n") > limit)
        .where(
            (F.col("_lo") < F.col("_hi"))
            | (F.col("_odd0") < F.col("_odd1"))
            | (F.col("_lo").isNotNull() & F.col("_odd0").isNotNull())
        )
        .select("_grp", *levels, "_n", "_lo", "_hi")
    )
    return None if found.isEmpty() else found


def _cut(
    rows: DataFrame, keep: Sequence[str], levels: Sequence[str], at: Column, finer: DataFrame, block_rows: int
) -> DataFrame:
    """One more level: the piece of its block's range that a row lies in; 0 in blocks that stay whole."""
    keys = ["_grp", *levels]
    right = finer.select(*[F.col(c).alias(f"_c{c}") for c in keys], "_n", "_lo", "_hi")
    joined = rows.withColumn("_at", at).join(right, all_of([F.col(c) == F.col(f"_c{c}") for c in keys]), "left")
    parts, x = F.ceil(F.col("_n") / block_rows), F.col("_at")
    if dict(joined.dtypes)["_at"] == "bigint":
        # in decimals, as the range of bigints does not fit one
        off, width = (F.expr(f"cast({e} as decimal(20,0))") for e in ("_at", "_hi"))
        low = F.expr("cast(_lo as decimal(20,0))")
        piece = F.floor((off - low) * parts.cast("decimal(10,0)") / (width - low + 1)).cast("bigint")
    else:
        # halves, as the range of doubles does not fit one; both steps keep the order
        span = F.col("_hi") / 2 - F.col("_lo") / 2
        piece = F.when(span > 0, F.floor((x / 2 - F.col("_lo") / 2) / span * parts).cast("bigint")).otherwise(
            F.when(x > F.col("_lo"), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
        )
    top = F.lit(1 << 62)
    placed = (
        F.when(F.col("_n").isNull(), F.lit(0))
        .when(x.isNull(), F.lit(-2))
        .when(x.cast("double") == float("-inf"), F.lit(-1))
        .when(F.isnan(x.cast("double")), top + 1)
        .when(x.cast("double") == float("inf"), top)
        .otherwise(piece)
    )
    return joined.select(*cols(keep), *keys, placed.cast("bigint").alias(f"_b{len(levels)}"))


def neighbours(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    lags: Sequence[int] = (),
    leads: Sequence[int] = (),
    first: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``_lag<k>``, ``_lead<k>`` and ``_first`` structs of ``columns``.

    A struct is NULL only where no such row exists; its fields may be NULL
    because the neighbouring row's are.
    """
    if not (lags or leads or first):
        raise ValueError("ask for at least one of lags, leads, first")
    b = Blocked(df, by, order, block_rows)
    named, w = F.struct(*[col(c) for c in columns]), b.window
    inside = {f"_lag{k}": F.lag(named, k).over(w) for k in lags} | {f"_lead{k}": F.lead(named, k).over(w) for k in leads}
    if first:
        inside["_first"] = F.first(named).over(b.upto)
    back, ahead = max(lags, default=0), max(leads, default=0)
    rows = b.passed(inside, max(back, ahead, 1))
    if not b.cut:
        return rows.select(*cols(b.columns), *cols(inside))

    def edge(near: Column, distance: Column) -> Column:
        """A block's rows at one of its ends, the outermost first."""
        found = F.sort_array(F.collect_list(F.when(near, F.struct(distance.alias("far"), named.alias("row")))))
        return F.transform(found, lambda x: x["row"])

    top, left = F.col("_top"), F.col("_left")
    near_top, near_end = top <= max(ahead, 1), left < back
    ends = rows.where(near_top | near_end).groupBy("_grp", "_blk")
    ends = ends.agg(edge(near_top, top).alias("_heads"), edge(near_end, left).alias("_tails"))
    border = ends.select(
        "_grp",
        "_blk",
        F.flatten(F.reverse(F.collect_list("_tails").over(b.across.rowsBetween(-max(back, 1), -1)))).alias("_past"),
        F.flatten(F.collect_list("_heads").over(b.across.rowsBetween(1, max(ahead, 1)))).alias("_ahead"),
        F.get(F.first("_heads").over(b.across.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias("_head"),
    )
    out = [F.when(top > k, F.col(f"_lag{k}")).otherwise(F.get("_past", F.lit(k) - top)).alias(f"_lag{k}") for k in lags]
    out += [F.when(left >= k, F.col(f"_lead{k}")).otherwise(F.get("_ahead", F.lit(k - 1) - left)).alias(f"_lead{k}") for k in leads]
    if first:
        out.append(F.col("_head").alias("_first"))
    return b.bordered(rows, border).select(*cols(b.columns), *out)


def fill_forward(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Replace NULLs in ``columns`` by the last value before them."""
    b = Blocked(df, by, order, block_rows)
    here = {f"_here{i}": F.last(col(c), ignorenulls=True).over(b.upto) for i, c in enumerate(columns)}
    rows = b.passed(here)
    if not b.cut:
        filled = {c: F.col(f"_here{i}").alias(c) for i, c in enumerate(columns)}
        return rows.select(*[filled.get(c, col(c)) for c in b.columns])
    carry = [F.last(h, ignorenulls=True).over(b.before).alias(f"_carry{i}") for i, h in enumerate(here)]
    border = rows.where("_left = 0").select("_grp", "_blk", *carry)
    filled = {c: F.coalesce(f"_here{i}", f"_carry{i}").alias(c) for i, c in enumerate(columns)}
    return b.bordered(rows, border).select(*[filled.get(c, col(c)) for c in b.columns])


Getter = Callable[[str], Column]


def step_and_fill(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    step: Callable[[Getter, Getter], Mapping[str, Column]],
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add columns made from each row and the one before it, NULLs replaced by the last value before them.

    ``step`` gives the columns from two functions of a column's name: its
    value in the row, and in the row before (one of ``columns``; NULL in the
    first row). The rows are shuffled once for both. In a block only the first
    row's step is not known inside it; the scan across the blocks works it out
    from the last row of the block before.
    """
    b = Blocked(df, by, order, block_rows)
    named = F.struct(*[col(c) for c in columns])
    lagged = F.lag(named, 1).over(b.window)
    stepped = b.df.withColumn("_lag", lagged)
    names = step(col, lambda c: F.col("_lag").getField(c))
    if b.cut:  # the first row of a block waits for the one before
        stepped = stepped.withColumn("_in", F.row_number().over(b.window) > 1)
        names = {n: F.when(F.col("_in"), c) for n, c in names.items()}
    stepped = stepped.select("*", *[c.alias(f"_s{i}") for i, c in enumerate(names.values())])
    b.df = stepped
    here = {f"_here{i}": F.last(f"_s{i}", ignorenulls=True).over(b.upto) for i in range(len(names))}
    rows = b.passed(here)
    if not b.cut:
        return rows.select(*cols(b.columns), *[F.col(h).alias(n) for h, n in zip(here, names)])
    # a block of one row is both its first and its last
    ends = rows.where("_top = 1 or _left = 0").groupBy("_grp", "_blk").agg(
        F.max(F.when(F.col("_top") == 1, F.struct(*cols(b.columns)))).alias("_head"),
        F.max(F.when(F.col("_left") == 0, named)).alias("_tail"),
        *[F.max(F.when(F.col("_left") == 0, F.col(h))).alias(h) for h in here],
    )
    ends = ends.withColumn("_before", F.lag("_tail").over(b.across))
    heads = step(lambda c: F.col("_head").getField(c), lambda c: F.col("_before").getField(c))
    ends = ends.select("_grp", "_blk", *here, *[c.alias(f"_head{i}") for i, c in enumerate(heads.values())])
    carried = [
        F.last(F.coalesce(f"_here{i}", f"_head{i}"), ignorenulls=True).over(b.before).alias(f"_carry{i}") for i in range(len(names))
    ]
    border = ends.select("_grp", "_blk", *[f"_head{i}" for i in range(len(names))], *carried)
    out = [F.coalesce(f"_here{i}", f"_head{i}", f"_carry{i}").alias(n) for i, n in enumerate(names)]
    return b.bordered(rows, border).select(*cols(b.columns), *out)


def _numbered(b: Blocked, place: Column, name: str) -> DataFrame:
    """The rows with a number that counts on from block to block."""
    rows = b.passed({"_place": place})
    if not b.cut:
        return rows.select(*cols(b.columns), F.col("_place").cast("bigint").alias(name))
    base = F.coalesce(F.sum("_place").over(b.before), F.lit(0)).alias("_base")
    border = rows.where("_left = 0").select("_grp", "_blk", base)
    number = (F.col("_base") + F.col("_place")).cast("bigint").alias(name)
    return b.bordered(rows, border).select(*cols(b.columns), number)


def row_index(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    name: str = "row_index",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Number the rows of each series from 1: place in block + rows before it."""
    b = Blocked(df, by, order, block_rows)
    return _numbered(b, F.row_number().over(b.window), name)


def dense_index(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    name: str = "rank",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Number the distinct ordering values of each series from 1; ties share a number.

    Rows that agree in all ordering columns lie in one block, so a value's
    number is its number in the block and the values of the blocks before.
    """
    b = Blocked(df, by, order, block_rows)
    return _numbered(b, F.dense_rank().over(b.window), name)
