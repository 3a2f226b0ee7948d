"""Monthly climatology, summaries and aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clock
from ..functions.columns import ColumnLike, col, cols, number
from .joins import left_join_key
from .quantiles import quantiles
from .staging import attach


def monthly_means(
    df: DataFrame, date: str, value: ColumnLike, by: Sequence[str] = (), name: str = "var"
) -> DataFrame:
    """Mean per series, year and month; NULL and NaN do not count."""
    return df.groupBy(
        *cols(by), clock.year(date).alias("year"), clock.month(date).alias("month")
    ).agg(F.avg(number(value)).alias(name))


def climatology_ref(
    monthly: DataFrame, by: Sequence[str] = (), value: str = "var", name: str = "ref"
) -> DataFrame:
    """Mean of the monthly means per month: each year weighs the same."""
    return monthly.groupBy(*cols(by), "month").agg(F.avg(number(value)).alias(name))


def climatology_sd(
    monthly: DataFrame, by: Sequence[str] = (), value: str = "var", mean: str = "mean", sd: str = "sd"
) -> DataFrame:
    """Mean and sample sd of the monthly means per month."""
    x = number(value)
    return monthly.groupBy(*cols(by), "month").agg(
        F.avg(x).alias(mean), F.when(F.count(x) > 1, F.stddev_samp(x)).alias(sd)
    )


def monthly_anomaly(
    df: DataFrame, date: str, value: ColumnLike, by: Sequence[str] = ()
) -> DataFrame:
    """Monthly mean, its long-term reference, and the difference.

    The reference comes from a window over the monthly means, which are at
    most twelve rows per series and year, so no self-join is needed and the
    window stays small however many observations a series has.
    """
    monthly = monthly_means(df, date, value, by)
    ref = F.avg("var").over(Window.partitionBy(*cols(by), "month"))
    anom = F.col("var") - F.col("ref")
    sign = F.when(F.col("anom") > 0, "pos").when(F.col("anom") <= 0, "neg")
    return (
        monthly.withColumn("ref", ref)
        .withColumn("date", F.make_date(F.col("year").cast("int"), F.col("month").cast("int"), F.lit(1)))
        .withColumn("anom", anom)
        .withColumn("sign", sign)
        .select(*cols(by), "year", "month", "date", "var", "ref", "anom", "sign")
    )


def standardise(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "z") -> DataFrame:
    """(x - mean) / sample sd over each whole series."""
    x = number(value)
    stats = df.groupBy(*cols(by)).agg(
        F.avg(x).alias("_mean"), F.when(F.count(x) > 1, F.stddev_samp(x)).alias("_sd")
    )
    return attach(df, stats, by).select(
        *cols(df.columns), F.try_divide(x - F.col("_mean"), F.col("_sd")).alias(name)
    )


def seasonal_pair(
    first: DataFrame,
    second: DataFrame,
    date: tuple[str, str],
    value: tuple[ColumnLike, ColumnLike],
    by: Sequence[str] = (),
    names: tuple[str, str] = ("a", "b"),
) -> DataFrame:
    """Monthly climatologies of two variables side by side."""
    season = [
        climatology_sd(monthly_means(d, t, v, by), by, mean=n, sd=f"{n}_sd")
        for d, t, v, n in zip((first, second), date, value, names)
    ]
    return left_join_key(season[0], season[1], [*by, "month"])


def active_counts(df: DataFrame, where: Column, by: Sequence[str], name: str = "n") -> DataFrame:
    return df.where(where).groupBy(*cols(by)).agg(F.count("*").alias(name))


def count_by_then_mean(df: DataFrame, where: Column, by: Sequence[str]) -> DataFrame:
    """Count the matching rows per group, then average the counts."""
    return active_counts(df, where, by).agg(F.avg("n").alias("mean_count"))


def range_of(df: DataFrame, value: str, by: Sequence[str] = (), na_rm: bool = True) -> DataFrame:
    """Minimum and maximum; without ``na_rm`` any NULL makes both NULL."""
    kind = df.schema[value].dataType
    x = number(value) if isinstance(kind, T.DoubleType | T.FloatType) else col(value)
    lo, hi = F.min(x), F.max(x)
    if not na_rm:
        whole = F.count(x) == F.count(F.lit(1))
        lo, hi = F.when(whole, lo), F.when(whole, hi)
    return df.groupBy(*cols(by)).agg(lo.alias("lo"), hi.alias("hi"))


def numeric_summary(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), accuracy: int = 10_000
) -> DataFrame:
    """Missing values, moments and quartiles of each numeric column.

    The moments of all columns are one wide aggregate whose result is turned
    into rows; only the quartiles look at one value per row.
    """
    wide = df.select(*cols(by), *[number(c).alias(f"_x{i}") for i, c in enumerate(columns)])

    def described(i: int, name: str) -> Column:
        x = F.col(f"_x{i}")
        return F.struct(
            F.lit(name).alias("variable"),
            (F.count("*") - F.count(x)).alias("n_missing"),
            (F.count(x) / F.count("*")).alias("complete_rate"),
            F.avg(x).alias("mean"),
            F.when(F.count(x) > 1, F.stddev_samp(x)).alias("sd"),
            F.min(x).alias("p0"),
            F.max(x).alias("p100"),
        )

    parts = wide.groupBy(*cols(by)).agg(F.array(*[described(i, c) for i, c in enumerate(columns)]).alias("_parts"))
    basic = parts.select(*cols(by), F.inline("_parts"))
    long = wide.select(
        *cols(by),
        F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"_x{i}").alias("value")) for i, c in enumerate(columns)])).alias("_p"),
    ).select(*cols(by), "_p.variable", "_p.value")
    keys = [*by, "variable"]
    inner = quantiles(long, keys, "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, accuracy)
    return left_join_key(basic, inner.drop("_n"), keys).select(
        *cols(keys), "n_missing", "complete_rate", "mean", "sd", "p0", "p25", "p50", "p75", "p100"
    )


def text_summary(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Missing values, lengths, empties and distinct values of text columns."""
    long = df.select(*cols(by), *[col(c).cast("string").alias(c) for c in columns]).unpivot(
        cols(by), cols(columns), "variable", "value"
    )
    x = F.col("value")
    return long.groupBy(*cols(by), "variable").agg(
        (F.count("*") - F.count(x)).alias("n_missing"),
        (F.count(x) / F.count("*")).alias("complete_rate"),
        F.min(F.length(x)).cast("bigint").alias("min_length"),
        F.max(F.length(x)).cast("bigint").alias("max_length"),
        F.count_if(x == "").alias("empty"),
        F.countDistinct(x).alias("n_unique"),
        F.count_if(x.rlike(r"^\s+$")).alias("whitespace"),
    )


def column_summary(
    df: DataFrame,
    numeric: Sequence[str] | None = None,
    texts: Sequence[str] | None = None,
    by: Sequence[str] = (),
    accuracy: int = 10_000,
) -> DataFrame:
    """One row per column (and group) describing what it holds.

    Without any columns named, all numeric and all text columns.
    """
    if numeric is None and texts is None:
        rest = [f for f in df.schema.fields if f.name not in by]
        numeric = [f.name for f in rest if isinstance(f.dataType, T.NumericType)]
        texts = [f.name for f in rest if isinstance(f.dataType, T.StringType)]
    parts = []
    if numeric:
        parts.append(numeric_summary(df, numeric, by, accuracy))
    if texts:
        parts.append(text_summary(df, texts, by))
    if not parts:
        raise ValueError("name at least one column")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def group_extent_label(
    df: DataFrame, by: Sequence[str], value: str, fun: str = "max", accuracy: int = 10_000
) -> DataFrame:
    """Per group: max, min or median as ``y`` and the row count as ``label``."""
    x = number(value)
    if fun in ("max", "min"):
        pick = F.max(x) if fun == "max" else F.min(x)
        return df.groupBy(*cols(by)).agg(pick.alias("y"), F.count("*").alias("label"))
    if fun != "median":
        raise ValueError("fun must be max, min or median")
    sizes = df.groupBy(*cols(by)).agg(F.count("*").alias("label"))
    mid = quantiles(df, by, value, {"y": 0.5}, accuracy).drop("_n")
    return attach(sizes, mid, by).select(*cols(by), "y", "label")


def mean_min_max_grouped(
    df: DataFrame, by: Sequence[str], value: str, suffix: str | None = None
) -> DataFrame:
    """Group mean, min and max on every row; one NULL makes all three NULL."""
    name = suffix or value
    x = number(value)
    whole = F.count(x) == F.count(F.lit(1))
    stats = df.groupBy(*cols(by)).agg(
        F.when(whole, F.avg(x)).alias(f"mean_{name}"),
        F.when(whole, F.min(x)).alias(f"min_{name}"),
        F.when(whole, F.max(x)).alias(f"max_{name}"),
    )
    return attach(df, stats, by)


def min_max_span(df: DataFrame, by: Sequence[str], ts: str) -> DataFrame:
    """First and last stamp per group, the seconds between, and the start as
    ``MM-dd HH:mm:ss`` text."""
    span = (clock.micros("end") - clock.micros("start")) / 1e6
    return (
        df.groupBy(*cols(by))
        .agg(F.min(col(ts)).alias("start"), F.max(col(ts)).alias("end"))
        .withColumn("span_seconds", span)
        .withColumn("start_text", F.date_format("start", "MM-dd HH:mm:ss"))
    )
