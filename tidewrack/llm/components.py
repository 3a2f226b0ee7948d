"""Connected components of a graph given as links between integer nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import step_table


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has a link; component is its smallest reachable node.

    Rounds of large-star and small-star: each node hands the smallest node it
    knows to its neighbours until only stars are left. Every round is a
    grouped minimum (combined on the map side) and an equality join, so a hub
    node is no single task's burden. Rounds are cut by step tables in the
    shared folder. Null ends and self-links are ignored; repeated links count
    once.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    edges = step_table(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours go to the smallest known node
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = step_table(large.union(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct())
        # small star: smaller neighbours, and the node itself, go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = step_table(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        if _same(edges, after):
            break
        edges = after
    return after.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _same(x: DataFrame, y: DataFrame) -> bool:
    """Whether two sets of links agree, by count and two independent sums of hashes."""
    marks = [
        t.agg(
            F.count(F.lit(1)),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
            F.sum(F.hash("v", "u").cast("long")),
        ).first()
        for t in (x, y)
    ]
    return marks[0] == marks[1]
