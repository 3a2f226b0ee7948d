"""Exact order statistics per group, safe for groups of any size.

Spark's ``percentile`` keeps every distinct value of a group in one task.
Here a mergeable sketch (``percentile_approx``) first brackets each wanted
rank; a second pass counts the values below a bracket and keeps, with their
counts, only those inside it. Both passes aggregate on the map side. While a
bracket holds more than ``SORTED`` distinct values, they are counted in equal
ranges and only the ranges of the wanted ranks are kept, so no task sorts
more than that, whatever the group's size. A rank that fell outside its
bracket is looked for again in wider ones, at last in the whole group.
Nothing is approximated. The passes run when the operator is called.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ColumnLike, cols, number
from .staging import attach, settled

ACCURACY = 10_000
MARGIN = 5.0  # bracket half-width, in units of the sketch's rank error
WIDER = 20.0  # by how much brackets grow after a miss
SORTED = 100_000  # distinct values of a bracket that one task may sort
PIECES = 1000


def order_stats(
    df: DataFrame,
    by: Sequence[str],
    value: ColumnLike,
    ranks: Mapping[str, tuple[float, Column]],
    accuracy: int = ACCURACY,
    margin: float = MARGIN,
    most: int = SORTED,
) -> DataFrame:
    """One row per group: its size ``_n`` and the value at each zero-based rank.

    ``ranks`` maps an output name to ``(p, rank)``; ``rank`` is an expression
    over the column ``_n``, best near ``p * _n``. NULL and NaN values are left
    out.
    """
    by = list(by)
    x = df.select(*cols(by), number(value).alias("_x")).where(F.col("_x").isNotNull())
    places = sorted({p for p, _ in ranks.values()})
    half = margin / accuracy
    edges = [e for p in places for e in (max(0.0, p - half), min(1.0, p + half))]
    sketch = x.groupBy(*cols(by)).agg(
        F.count("*").alias("_n"),
        F.percentile_approx("_x", [float(e) for e in edges], accuracy).alias("_edge"),
    )
    rows = attach(x, sketch, by)
    edge = [F.col("_edge").getItem(i) for i in range(len(edges))]
    # Every row goes to the first bracket it does not exceed: with its value if
    # it lies inside, as a mere count (NULL) if it lies in the gap below. Rows
    # above the last bracket are not needed. Groups the sketch holds whole are
    # one bracket.
    slot, inside = F.lit(None).cast("int"), F.lit(None).cast("double")
    for k in reversed(range(len(places))):
        fits = F.col("_x") <= edge[2 * k + 1]
        slot = F.when(fits, F.lit(k)).otherwise(slot)
        inside = F.when(fits, F.when(F.col("_x") >= edge[2 * k], F.col("_x"))).otherwise(inside)
    whole = F.col("_n") <= accuracy
    counted = settled(
        rows.select(
            *cols(by),
            "_n",
            F.when(whole, F.lit(0)).otherwise(slot).alias("_k"),
            F.when(whole, F.col("_x")).otherwise(inside).alias("_v"),
        )
        .where(F.col("_k").isNotNull())
        .groupBy(*cols(by), "_n", "_k", "_v")
        .agg(F.count("*").alias("_c"))
    )
    wanted = {name: rank.cast("bigint") for name, (_, rank) in ranks.items()}
    brackets = settled(_brackets(counted, by, wanted))
    missed, largest = brackets.agg(F.count_if("_miss"), F.max("_d")).first()
    if missed and half < 1.0:
        return order_stats(df, by, value, ranks, accuracy, margin * WIDER, most)
    values = counted.where(F.col("_v").isNotNull())
    while (largest or 0) > most:
        values, brackets = _narrowed(values, brackets, by)
        largest = brackets.agg(F.max("_d")).first()[0]
    within = (
        Window.partitionBy(*cols(by), "_k").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    )
    running = attach(
        values.withColumn("_upto", F.sum("_c").over(within)), brackets.select(*cols(by), "_k", "_below"), [*by, "_k"]
    )
    upto = F.col("_below") + F.col("_upto")
    found = [
        F.min(F.when((F.col("_below") <= rank) & (upto > rank), F.col("_v"))).alias(name)
        for name, rank in wanted.items()
    ]
    return running.groupBy(*cols(by), "_n").agg(*found)


def _brackets(counted: DataFrame, by: Sequence[str], wanted: Mapping[str, Column]) -> DataFrame:
    """Per bracket: rows below it, distinct values and their range, lowest and highest wanted rank inside.

    ``_miss`` tells that some rank of the group lies in none of its brackets.
    """
    held = F.col("_v").isNotNull()
    sums = counted.groupBy(*cols(by), "_n", "_k").agg(
        F.sum("_c").alias("_all"),
        F.sum(F.when(held, F.col("_c")).otherwise(0)).alias("_in"),
        F.count_if(held).alias("_d"),
        F.min("_v").alias("_lo"),
        F.max("_v").alias("_hi"),
    )
    group = Window.partitionBy(*cols(by))
    upto = group.orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    placed = sums.withColumn("_below", F.sum("_all").over(upto) - F.col("_in"))
    end = F.col("_below") + F.col("_in")
    inside = F.array(*[F.when((rank >= F.col("_below")) & (rank < end), rank) for rank in wanted.values()])
    placed = placed.withColumn("_ranks", F.array_compact(inside))
    met = F.sum(F.size("_ranks")).over(group)
    return placed.select(
        *cols(by), "_n", "_k", "_below", "_d", "_lo", "_hi",
        F.array_min("_ranks").alias("_first"),
        F.array_max("_ranks").alias("_last"),
        (met < len(wanted)).alias("_miss"),
    )


def _narrowed(
    values: DataFrame, brackets: DataFrame, by: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Values and brackets cut down to the equal ranges that hold the wanted ranks."""
    keys = [*by, "_k"]
    place = F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * PIECES)
    marked = attach(values, brackets.drop("_n", "_d", "_miss"), keys)
    marked = marked.withColumn("_bin", F.when(F.col("_hi") > F.col("_lo"), place).otherwise(F.lit(0)))
    bins = marked.groupBy(*cols(keys), "_n", "_below", "_first", "_last", "_bin").agg(F.sum("_c").alias("_c"))
    upto = Window.partitionBy(*cols(keys)).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("_top", F.col("_below") + F.sum("_c").over(upto))
    hit = (F.col("_top") > F.col("_first")) & (F.col("_top") - F.col("_c") <= F.col("_last"))
    bins = settled(bins.where(hit).select(*cols(keys), "_bin", (F.col("_top") - F.col("_c")).alias("_base")))
    kept = attach(marked, bins, [*keys, "_bin"]).where(F.col("_base").isNotNull())
    kept = settled(kept.select(*cols(by), "_n", "_k", "_v", "_c", "_base", "_first", "_last"))
    after = kept.groupBy(*cols(by), "_n", "_k").agg(
        F.min("_base").alias("_below"),
        F.count("*").alias("_d"),
        F.min("_v").alias("_lo"),
        F.max("_v").alias("_hi"),
        F.first("_first").alias("_first"),
        F.first("_last").alias("_last"),
    )
    return kept.select(*cols(by), "_n", "_k", "_v", "_c"), settled(after.withColumn("_miss", F.lit(False)))


def quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: ColumnLike,
    probs: Mapping[str, float],
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Linear-interpolated quantiles at ``(n - 1) * p``, one row per group."""
    ranks = {}
    for name, p in probs.items():
        at = (F.col("_n") - 1) * F.lit(float(p))
        ranks[f"_{name}_lo"] = (float(p), F.floor(at))
        ranks[f"_{name}_hi"] = (float(p), F.ceil(at))
    stats = order_stats(df, by, value, ranks, accuracy)
    out = []
    for name, p in probs.items():
        at = (F.col("_n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return stats.select(*cols(by), "_n", *out)
