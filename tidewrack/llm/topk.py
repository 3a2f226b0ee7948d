"""Exact top-k by inner product with multi-resolution segment statistics.

A vector cut into segments has in each segment a mean and a deviation. From
these alone follows a lower bound of the distance of two vectors: the sum over
segments of length x (difference of means squared + difference of deviations
squared). As the statistics keep a vector's length, the bound turns into an
upper bound of the inner product. Bounds are taken from few segments to many,
each over what the coarser ones left; exact products are computed for the
survivors only.

Queries and vectors meet in blocks of bounded size, every query block with
every vector block; a block pair returns its k best per query, and ranks are
taken from those.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENTS = (1, 4, 16)
VECTOR_BLOCK = 4096
QUERY_BLOCK = 1024


def usable(vector: Column) -> Column:
    """True for vectors that are not null and hold only finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & finite


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component, as long."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Mean and deviation per segment, scaled so that squared differences add up to the distance's lower bound."""
    width = -(-x.shape[1] // segments)
    whole = np.zeros((len(x), segments * width))
    whole[:, : x.shape[1]] = x
    parts = whole.reshape(len(x), segments, width)
    return np.sqrt(width) * np.concatenate([parts.mean(axis=2), parts.std(axis=2)], axis=1)


def search(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, chunk: int = 64
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (query id, id, score) of each query: highest product, then smallest id; a query's own id is left out.

    Vectors are integers, one row each. Products are taken in doubles where
    those hold them exactly, else in 64-bit integers.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    levels = [(statistics(queries, s), statistics(vectors, s)) for s in SEGMENTS]
    norms, query_norms = (vectors.astype(float) ** 2).sum(axis=1), (queries.astype(float) ** 2).sum(axis=1)
    slack = 0.5 + 1e-9 * np.sqrt(norms.max(initial=0) * query_norms.max(initial=0))
    if np.sqrt(norms.max(initial=0) * query_norms.max(initial=0)) < 2**52:
        queries, vectors = queries.astype(float), vectors.astype(float)
    for a in range(0, len(queries), chunk):
        own = slice(a, a + chunk)
        size = query_norms[own, None] + norms[None, :]
        other = query_ids[own, None] != ids[None, :]

        def bound(q: np.ndarray, v: np.ndarray) -> np.ndarray:
            """Upper bound of products, through the lower bound of squared distances."""
            nearest = size - 2 * (q[own] @ v.T)
            return (size - nearest) / 2

        least, last = np.full(len(other), -np.inf), None
        if len(ids) > k:  # products of the most promising give each query a score to beat
            last = np.where(other, bound(*levels[-1]), -np.inf)
            seeds = np.argpartition(last, len(ids) - k - 1, axis=1)[:, len(ids) - k - 1 :]
            exact = np.einsum("qd,qsd->qs", queries[own], vectors[seeds]).astype(float)
            exact[~np.take_along_axis(other, seeds, axis=1)] = -np.inf
            least = -np.sort(-exact, axis=1)[:, k - 1]
        alive = other
        for level in levels[:-1]:
            alive = alive & (bound(*level) >= least[:, None] - slack)
        if last is not None:
            alive = alive & (last >= least[:, None] - slack)
        # what is among the k best meets or beats the seeds' k-th product
        if 8 * np.count_nonzero(alive) > alive.size:  # few are out: whole products cost less than picking pairs
            product = queries[own] @ vectors.T
            rows, cols = np.nonzero(alive & (product >= least[:, None]))
            score = product[rows, cols].astype(np.int64)
        else:
            rows, cols = np.nonzero(alive)
            score = np.einsum("pd,pd->p", queries[own][rows], vectors[cols]).astype(np.int64)
            good = score >= least[rows]
            rows, cols, score = rows[good], cols[good], score[good]
        order = np.lexsort((ids[cols], -score, rows))
        rows, cols, score = rows[order], cols[order], score[order]
        first = np.searchsorted(rows, rows)
        top = np.arange(len(rows)) - first < k
        out.append((query_ids[own][rows[top]], ids[cols[top]], score[top]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows of integers, shorter vectors filled with zeros."""
    x = np.zeros((len(vectors), width), dtype=np.int64)
    for row, v in zip(x, vectors):
        row[: len(v)] = v
    return x


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: int = 64,
    vector_block: int = VECTOR_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other vectors of each query, all if there are fewer.

    ``is_query`` is a condition on the key. Null vectors, those with null or
    non-finite components and those without key take no part. A key that
    repeats counts once, with the smallest of its quantised vectors. Vectors
    of different lengths are compared as if filled with zeros; an empty table
    has no result. Other columns are not used.
    """
    own = vectors.filter(usable(F.col(f"`{vector}`")) & F.col(f"`{key}`").isNotNull())
    own = own.select(
        F.col(f"`{key}`").cast("long").alias("id"), quantised(F.col(f"`{vector}`"), scale).alias("v"), is_query.alias("q")
    )
    own = own.groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    n, asked = own.agg(F.count("id"), F.count_if("q")).first()
    vector_blocks, query_blocks = (max(1, -(-m // size)) for m, size in ((n, vector_block), (asked, query_block)))

    def all_blocks(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    def block(count: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")

    base = own.select("id", "v", block(vector_blocks).alias("vb"), all_blocks(query_blocks).alias("qb"))
    queries = own.filter("q").select("id", "v", all_blocks(vector_blocks).alias("vb"), block(query_blocks).alias("qb"))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        width = max([1, *left["v"].map(len), *right["v"].map(len)])
        found = search(
            right["id"].to_numpy(), matrix(right["v"], width), left["id"].to_numpy(), matrix(left["v"], width), k
        )
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found)))

    near = (
        base.groupBy("vb", "qb")
        .cogroup(queries.groupBy("vb", "qb"))
        .applyInPandas(best, "query_id long, vec_id long, score long")
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
