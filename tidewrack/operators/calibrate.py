"""Calibration curves, correlation, chlorophyll and cast sections."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chemistry, clock, text
from ..functions.columns import col, cols, number
from .climate import column_summary
from .filters import date_range_filter, drop_any_null, not_in
from .joins import right_join_2key
from .quality import repeat_rows
from .schema import split_label
from .staging import attach


def _number_argument(std_temp) -> list[float]:
    values = list(std_temp) if isinstance(std_temp, list | tuple) else [std_temp]
    if not values or any(isinstance(v, bool) or not isinstance(v, int | float) for v in values):
        raise ValueError("std_temp must be numeric")
    return [float(v) for v in values]


def select_params(columns: Sequence[str], param: str | Sequence[str] | None, temp: str) -> list[str]:
    """Calibration columns a user's patterns ask for, in table order.

    A pattern selects a column if it occurs in its name, literally or as a
    regular expression, in any case; an empty pattern or one that finds
    nothing is an error.
    """
    others = [c for c in columns if c != temp]
    if param is None:
        return others
    patterns = [param] if isinstance(param, str) else list(param)
    if any(p == "" for p in patterns):
        raise ValueError("empty parameter pattern")
    found = [c for c in others if any(p.lower() in c.lower() or re.search(p, c, re.I) for p in patterns)]
    if not found:
        raise ValueError(f"no parameter matches {patterns}")
    return found


def calibration_regression(
    df: DataFrame, std_temp: float = 20.0, param=None, temp: str = "temp"
) -> DataFrame:
    """Linear fit of each standard on temperature, predicted at ``std_temp``."""
    targets = _number_argument(std_temp)
    chosen = select_params(df.columns, param, temp)
    long = df.select(number(temp).alias("_t"), *[number(c).alias(c) for c in chosen]).unpivot(
        cols(["_t"]), cols(chosen), "param", "_y"
    )
    fit = long.groupBy("param").agg(
        F.regr_slope("_y", "_t").alias("_b"), F.regr_intercept("_y", "_t").alias("_a")
    )
    at = F.explode(F.array(*[F.lit(t) for t in targets])).alias("std_temp")
    return fit.select("param", "_a", "_b", at).select(
        "param", "std_temp", (F.col("_a") + F.col("_b") * F.col("std_temp")).alias("std_value")
    )


def calibration_interpolate(
    df: DataFrame, std_temp=20.0, param=None, temp: str = "temp"
) -> DataFrame:
    """Linear interpolation of each standard at ``std_temp``; NULL outside.

    Repeated temperatures are averaged. The neighbours of every target are
    picked by aggregation, so knots are neither sorted nor joined.
    """
    targets = _number_argument(std_temp)
    chosen = select_params(df.columns, param, temp)
    long = df.select(number(temp).alias("_t"), *[number(c).alias(c) for c in chosen]).unpivot(
        cols(["_t"]), cols(chosen), "param", "_y"
    )
    knots = (
        long.where(F.col("_t").isNotNull() & F.col("_y").isNotNull())
        .groupBy("param", "_t")
        .agg(F.avg("_y").alias("_y"))
    )
    t = F.col("_t")
    sides = [
        F.struct(
            F.lit(v).alias("std_temp"),
            F.max(F.when(t <= v, F.struct("_t", "_y"))).alias("lo"),
            F.min(F.when(t >= v, F.struct("_t", "_y"))).alias("hi"),
        )
        for v in targets
    ]
    flat = knots.groupBy("param").agg(F.array(*sides).alias("_s")).select("param", F.inline("_s"))
    x0, y0 = F.col("lo._t"), F.col("lo._y")
    x1, y1 = F.col("hi._t"), F.col("hi._y")
    line = F.when(x0 == x1, y0).when(
        x0 < x1, y0 + (y1 - y0) * F.try_divide(F.col("std_temp") - x0, x1 - x0)
    )
    return flat.select("param", "std_temp", line.alias("std_value"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    floor = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > floor else floor)
    total = d
    for m in range(1, 400):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > floor else floor)
            c = 1.0 + step / c
            c = c if abs(c) > floor else floor
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return total


def t_two_sided(t: float, df: float) -> float:
    """Two-sided tail probability of Student's t."""
    if not math.isfinite(t):
        return 0.0 if math.isinf(t) else math.nan
    a, b = df / 2.0, 0.5
    x = df / (df + t * t)
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def correlation_test(df: DataFrame, temp: str, params: Sequence[str]) -> DataFrame:
    """Pearson correlation of each parameter with ``temp``: t, p and 95% CI.

    The p-value is computed on the one row per parameter that is left after
    aggregation, as Spark SQL has no t distribution.
    """
    long = df.select(number(temp).alias("_t"), *[number(c).alias(c) for c in params]).unpivot(
        cols(["_t"]), cols(params), "param", "_y"
    )
    pairs = long.where(F.col("_t").isNotNull() & F.col("_y").isNotNull())
    r, n = F.col("estimate"), F.col("_n")
    z, se = F.atanh(r), 1.959963984540054 / F.sqrt(n - 3)

    @F.pandas_udf("double")
    def tail(t: pd.Series, df_: pd.Series) -> pd.Series:
        known = t.notna() & (df_ > 0)
        return pd.Series(
            [t_two_sided(a, b) if k else np.nan for a, b, k in zip(t, df_, known)], dtype="float64"
        )

    stats = (
        pairs.groupBy("param")
        .agg(F.corr("_t", "_y").alias("estimate"), F.count("*").alias("_n"))
        .withColumn("parameter", n - 2)
        .withColumn("statistic", F.when(n > 2, r * F.sqrt(F.try_divide(n - 2, 1 - r * r))))
    )
    p = F.nanvl(tail(F.col("statistic"), F.col("parameter")), F.lit(None))
    return stats.select(
        "param", "estimate", "statistic", p.alias("p_value"), "parameter",
        F.when(n > 3, F.tanh(z - se)).alias("conf_low"),
        F.when(n > 3, F.tanh(z + se)).alias("conf_high"),
    )


def with_chla(
    df: DataFrame, fo="F_0", fa="F_a", vol_ext="Vol_ext", vol_fil="Vol_fil", name="chla"
) -> DataFrame:
    return df.withColumn(name, chemistry.fluor_to_chla(fo, fa, vol_ext, vol_fil))


def clean_station(station: str) -> Column:
    """Sheet station (stray character, transect letter, padded number) to a label."""
    rest = F.substring(col(station), 2, 2147483647)
    transect, site = F.substring(rest, 1, 1), F.substring(rest, 2, 2147483647).try_cast("double")
    shown = F.when(site == F.floor(site), F.floor(site).cast("string")).otherwise(site.cast("string"))
    named = text.replace_value(transect, ["B"], "AlongBay")
    return F.when(col(station).isNotNull(), text.unite([named, shown], "_")).otherwise("NA_NA")


def fluorescence(fluor: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cleaned fluorescence sheet with its chlorophyll-a."""
    kept = fluor.where(not_in("Station", ["lab"]))
    clean = kept.select(
        clean_station("Station").alias("Station"),
        clock.parse_date("Date_col", clock.MDY).alias("Date"),
        text.recode("Sample", {"surface": "S", "deep": "D"}).alias("Sample"),
        *[col(c) for c in ("Replicate", "F_0", "F_a", "Vol_ext", "Vol_fil", "Notes")],
    )
    extra = [c for c in pairs.columns if c not in ("Station", "Date")]
    if not extra:  # keys alone add nothing to a join that keeps every reading
        return with_chla(clean)
    known = pairs.select(
        col("Station"), clock.parse_date("Date", clock.YMD).alias("Date"), *cols(extra)
    ).distinct()
    return with_chla(right_join_2key(known, clean, ["Station", "Date"]))


def chla_pipeline(fluor: DataFrame, pairs: DataFrame) -> DataFrame:
    """Final chlorophyll table: no lab replicates, detection limit attached."""
    return (
        fluorescence(fluor, pairs)
        .where(not_in("Notes", ["lab replicate"]))
        .select(
            "Station", "Date", "Sample", "Replicate",
            col("chla").alias("CHLA_N_ug/L"),
            F.lit(chemistry.DETECTION_LIMIT).alias("CHLA_N_MDL_ug/L"),
        )
    )


def chla_extremes(fluor: DataFrame, pairs: DataFrame) -> DataFrame:
    """Mean, min and max per station, date and grab; lab replicates apart.

    Every reading keeps a row. As its rows are all alike, a group is
    aggregated once and written out as often as it has readings.
    """
    replicate = text.replace_value("Replicate", ["1", "2"], "")
    lab = F.when(col("Notes").eqNullSafe("lab replicate"), " lab-rep").otherwise(replicate)
    labelled = fluorescence(fluor, pairs).withColumn("Sample", text.unite([col("Sample"), lab], ""))
    keys = ["Station", "Date", "Sample"]
    whole = F.count("chla") == F.count(F.lit(1))
    groups = labelled.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.when(whole, f("chla")).alias(f"{f.__name__}_chla") for f in (F.mean, F.min, F.max)],
    )
    return repeat_rows(groups, "_n", name="_copy").drop("_copy")


def profile_bin(
    ctd: DataFrame,
    station: str | None = None,
    start: str | None = None,
    end: str | None = None,
    station_col: str = "Station",
    date_col: str = "Date",
    pressure: str = "pressure_db",
    depth: str = "Depth.m",
) -> DataFrame:
    """Cast rows of one station and period, pressure floored to a depth bin."""
    kept = ctd if station is None else ctd.where(col(station_col) == station)
    kept = date_range_filter(kept, date_col, start, end)
    return drop_any_null(kept).select(
        *[F.floor(col(c)).cast("double").alias(depth) if c == pressure else col(c) for c in kept.columns]
    )


def _fill_segments(
    knots: DataFrame, keys: Sequence[str], at: str, z: str, index: str
) -> DataFrame:
    """Values at the whole-numbered grid places between neighbouring knots.

    ``at`` is the knot's place on the grid; each segment writes the places
    from its start up to, but not including, its end; the last knot writes
    its own.
    """
    w = Window.partitionBy(*cols(keys)).orderBy(at)
    seg = knots.withColumns({"_at2": F.lead(at).over(w), "_z2": F.lead(z).over(w)})
    first = F.ceil(col(at))
    last = F.when(F.col("_at2").isNull(), F.floor(col(at))).otherwise(F.ceil(F.col("_at2")) - 1)
    seg = seg.select("*", F.explode(F.when(first <= last, F.sequence(first, last))).alias(index))
    share = F.try_divide(col(index) - col(at), F.col("_at2") - col(at))
    value = F.when(F.col("_at2").isNull(), col(z)).otherwise(col(z) + (F.col("_z2") - col(z)) * share)
    keep = [c for c in knots.columns if c not in (at, z)]
    return seg.select(*cols(keep), index, value.alias(z))


def section_grid(
    df: DataFrame,
    value: str,
    x: str = "Date",
    y: str = "Depth.m",
    by: Sequence[str] = (),
    nx: int = 200,
    ny: int = 200,
) -> DataFrame:
    """Time-depth section on a regular ``nx`` x ``ny`` grid over the data.

    Repeated (date, depth) cells are averaged, then values are interpolated
    along depth inside each cast and along time at each grid depth. Grid
    cells outside the casts are left out. This is not a triangulation: it
    agrees with one at the measured cells and differs between them. The
    windows see one row per depth bin of a cast and one per cast date.
    """
    if nx < 2 or ny < 2:
        raise ValueError("a grid needs at least two lines each way")
    day = F.datediff(F.to_date(col(x)), F.lit("1970-01-01").cast("date")).cast("double")
    cells = (
        df.select(*cols(by), day.alias("_x"), number(y).alias("_y"), number(value).alias("z"))
        .where(F.col("_x").isNotNull() & F.col("_y").isNotNull() & F.col("z").isNotNull())
        .groupBy(*cols(by), "_x", "_y")
        .agg(F.avg("z").alias("z"))
    )
    extent = cells.groupBy(*cols(by)).agg(
        F.min("_x").alias("_x0"), F.max("_x").alias("_x1"),
        F.min("_y").alias("_y0"), F.max("_y").alias("_y1"),
    )

    def place(c: str, lo: str, hi: str, n: int) -> Column:
        return F.coalesce(
            F.round(F.try_divide((F.col(c) - F.col(lo)) * (n - 1), F.col(hi) - F.col(lo)), 9), F.lit(0.0)
        )

    placed = attach(cells, extent, by).select(
        *cols(by),
        place("_x", "_x0", "_x1", nx).alias("_u"),
        place("_y", "_y0", "_y1", ny).alias("_v"),
        "z",
    )
    along_depth = _fill_segments(placed, [*by, "_u"], "_v", "z", "j")
    grid = _fill_segments(along_depth, [*by, "j"], "_u", "z", "i")
    step = lambda lo, hi, k, n: F.col(lo) + F.col(k) * (F.col(hi) - F.col(lo)) / (n - 1)
    return attach(grid, extent, by).select(
        *cols(by),
        F.col("i").cast("bigint").alias("i"),
        F.col("j").cast("bigint").alias("j"),
        step("_x0", "_x1", "i", nx).alias("x"),
        step("_y0", "_y1", "j", ny).alias("y"),
        "z",
    )


def pre_post_table(pre: DataFrame, post: DataFrame, label: str = "x") -> DataFrame:
    """Readings before and after deployment, stacked, label split in two."""
    both = pre.withColumn("when", F.lit("pre")).unionByName(post.withColumn("when", F.lit("post")))
    return split_label(both, label, ["site", "year"], delimiter=" ")


def pre_post_compare(
    pre: DataFrame, post: DataFrame, value: str = "temp", by: Sequence[str] = ()
) -> DataFrame:
    """Summary of the stacked readings: overall, or by ``year`` or ``when``."""
    table = pre_post_table(pre, post)
    texts = [c for c in ("when", "site", "year") if c not in by]
    return column_summary(table, [value], texts, by)
