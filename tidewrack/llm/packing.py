"""Packing token sequences by cutting-stock column generation.

Documents are cut where a whole sequence is full, so each leaves at most one
piece below the capacity. How many pieces there are of each length class is a
histogram of fixed size; a linear program over patterns (which lengths share a
sequence) is solved for it by column generation, a knapsack dynamic program
pricing new patterns. The rounded patterns are then dealt out: the r-th piece
of a length class has its place in the patterns by arithmetic, so pieces are
ranked in shards and never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ids_crc32, partitions, release_memory, step_table
from .tokens import encoder

CAPACITY = 2048
#: Lengths are rounded up to multiples of this for the linear program.
STEP = 16
#: Texts that a task holds as Python objects.
SLICE = 500


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens): every document's ids, cut at multiples of the capacity."""

    kinds = {"key": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        tokens, end = encoder(tokenizer), np.array([end_id], dtype=np.uint32)
        for batch in batches:
            # few texts at a time as Python objects, beside the encoder's words
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                at, rows = [], []
                for k, ids in enumerate(tokens.encode(part.column(1).to_pylist())):
                    ids = np.r_[ids, end]
                    for start in range(0, len(ids), capacity):
                        own = ids[start : start + capacity]
                        at.append(k)
                        rows.append((start, len(own), ids_crc32(own), len(ids)))
                found = [part.column(0).take(pa.array(at, pa.int64())), *map(pa.array, zip(*rows))]
                yield pa.record_batch(found, schema=pa.schema(kinds))

    own = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    return own.mapInArrow(cut, "key long, start long, length long, ids_crc32 long, doc_tokens long")


def best_pattern(value: np.ndarray, size: np.ndarray, capacity: int) -> np.ndarray:
    """Knapsack: how many of each size, within the capacity, are worth most; dynamic program over the capacity."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c], taken[c] = best[c - 1], -1
        fits = np.searchsorted(size, c, side="right")
        if fits:
            worth = value[:fits] + best[c - size[:fits]]
            i = int(worth.argmax())
            if worth[i] > best[c] + 1e-12:
                best[c], taken[c] = worth[i], i
    counts, c = np.zeros(len(size), dtype=np.int64), capacity
    while c > 0:
        if taken[c] >= 0:
            counts[taken[c]] += 1
            c -= size[taken[c]]
        else:
            c -= 1
    return counts


def solve(size: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-3) -> list[tuple[np.ndarray, int]]:
    """Patterns (counts per size) and how often each is used, meeting the demand exactly.

    ``size`` ascends. The linear program's optimum is approached within
    ``gap``; its solution is rounded down and what is left is filled greedily,
    largest first.
    """
    m = len(size)
    if not m:
        return []
    columns = np.diag(capacity // size).astype(np.float64)
    inverse = np.diag(1 / np.diag(columns))
    x = inverse @ demand.astype(np.float64)
    for _ in range(40 * m):
        price = inverse.sum(axis=0)
        column = best_pattern(price, size, capacity).astype(np.float64)
        if price @ column <= 1 + gap:
            break
        direction = inverse @ column
        up = np.flatnonzero(direction > 1e-9)
        leaves = up[np.argmin(x[up] / direction[up])]
        step = x[leaves] / direction[leaves]
        x = x - step * direction
        x[leaves] = step
        pivot = inverse[leaves] / direction[leaves]
        inverse -= np.outer(direction, pivot)
        inverse[leaves] = pivot
        columns[:, leaves] = column
    left, used = demand.astype(np.int64).copy(), []
    for column, often in zip(columns.T.astype(np.int64), np.floor(np.maximum(x, 0) + 1e-9).astype(np.int64)):
        inside = column > 0
        often = min(int(often), int((left[inside] // column[inside]).min())) if inside.any() else 0
        if often > 0:
            used.append((column, often))
            left -= often * column
    while left.any():
        column, room = np.zeros(m, dtype=np.int64), capacity
        for i in range(m - 1, -1, -1):
            column[i] = min(left[i], room // size[i])
            room -= column[i] * size[i]
        often = int((left[column > 0] // column[column > 0]).min())
        used.append((column, often))
        left -= often * column
    return used


def places(size: np.ndarray, patterns: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (class, from_rank, to_rank, each, sequence, slot): which ranks of a class a pattern takes, and where."""
    rank, sequence, rows = np.zeros(len(size), dtype=np.int64), 0, []
    for column, often in patterns:
        slot = 0
        for i in np.flatnonzero(column)[::-1]:
            each = int(column[i])
            rows.append((int(size[i]), int(rank[i]), int(rank[i]) + each * often, each, sequence, slot))
            rank[i] += each * often
            slot += each
        sequence += often
    return rows


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset) for every piece.

    Null and empty texts are one piece of the end id alone. Rows that repeat a
    key are documents of their own; an empty table gives an empty one. The
    driver sees one count for each of ``capacity / STEP`` length classes.
    """
    spark = docs.sparkSession
    cut = pieces(docs, tokenizer, end_id, capacity, key, text)
    shards = partitions(spark)
    cut = cut.withColumns(
        {
            "class": F.ceil(F.col("length") / STEP).cast("long"),
            "shard": F.pmod(F.xxhash64("key", "start", "ids_crc32"), F.lit(shards)),
        }
    )
    cut = step_table(cut)
    counted = cut.groupBy("class", "shard").agg(F.count(F.lit(1)).alias("n"))
    histogram = sorted(map(tuple, counted.groupBy("class").agg(F.sum("n")).collect()))
    size = np.array([c for c, _ in histogram], dtype=np.int64)
    demand = np.array([n for _, n in histogram], dtype=np.int64)
    rows = np.array(places(size, solve(size, demand, capacity // STEP)), dtype=np.int64).reshape(-1, 6)
    # at most one row for each class and pattern, and as many patterns as classes, whatever the data's size;
    # an Arrow table, as rows would start further Python workers beside those that still hold the tokenizer
    names = ["class", "from_rank", "to_rank", "each", "sequence", "slot"]
    layout = F.broadcast(spark.createDataFrame(pa.table(dict(zip(names, rows.T)))))

    before = Window.partitionBy("class").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("class", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("class", "shard").orderBy("key", "start", "ids_crc32")
    ranked = cut.withColumn("rank", F.row_number().over(order) - 1).join(bases, ["class", "shard"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("base"))
    dealt = ranked.join(layout, "class").filter("rank >= from_rank and rank < to_rank")
    nth = F.col("rank") - F.col("from_rank")
    dealt = dealt.withColumns(
        {
            "sequence_id": (F.col("sequence") + F.floor(nth / F.col("each"))).cast("long"),
            "place": F.col("slot") + nth % F.col("each"),
        }
    )
    inside = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset")
    return dealt.select("key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset)
