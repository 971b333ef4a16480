"""Exact top-k inner products by sorted access without random access.

Every dimension is a list of the vectors sorted by their component. A query
reads each list from the end that its own component favours, band by band. A
vector's score is bounded below by what was read and the worst that its unread
lists can add, and above by the values at which those lists now stand. Once
the k-th best lower bound exceeds the upper bounds of all but a few
vectors, reading stops and the scores of those few are resolved.

A task holds one block of vectors as lists and reads them for one block of
queries at once: what a band adds is a product of two small matrices.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 8192  # vectors in a block
QUERIES = 512  # queries in a block
BANDS = 8  # sequential reads of a list


def quantise(vectors: DataFrame, scale: int = 64, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``vec_id, v``: components as ``floor(scale * x)``. Vectors that are null or
    hold a null, NaN or infinite component are left out, as are null keys."""
    x = F.transform(F.col(column), lambda c: c.cast("double"))
    sound = F.col(key).isNotNull() & F.col(column).isNotNull() & ~F.exists(
        x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(sound).select(
        F.col(key).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


class Lists:
    """The sorted lists of a block, cut into bands by rank."""

    def __init__(self, matrix: np.ndarray):
        n, d = matrix.shape
        self.matrix = matrix
        order = np.sort(self.matrix, axis=0)
        cuts = np.linspace(0, n, BANDS + 1).astype(int)
        # A value belongs to one band only, so equal components are read together.
        self.low = order[cuts[:-1]]  # lowest value of each band
        self.band = np.zeros((n, d), np.int8)
        for b in range(1, BANDS):
            self.band[self.matrix >= self.low[b]] = b
        self.top, self.bottom = order[-1], order[0]

    def read(self, band: int) -> np.ndarray:
        """Components of one band of every list, 0 elsewhere."""
        return np.where(self.band == band, self.matrix, self.matrix.dtype.type(0))


def search(lists: Lists, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int):
    """Query row, vector id and score of each query's ``k`` best in a block, itself excluded.

    All sums of products are whole numbers that the matrices' type holds exactly.
    """
    n, q = len(ids), len(queries)
    kind = lists.matrix.dtype
    rising, falling = np.maximum(queries, 0).astype(kind), np.minimum(queries, 0).astype(kind)
    partial = np.zeros((q, n), kind)
    own = query_ids[:, None] == ids[None, :]
    k_here = min(k + 1, n)  # the query itself may be among them
    live = np.arange(q)
    out = []
    seen_high, seen_low = np.zeros(lists.matrix.shape, kind), np.zeros(lists.matrix.shape, kind)
    for step in range(BANDS):
        up, down = BANDS - 1 - step, step
        high, low = lists.read(up), lists.read(down)
        partial[live] += rising[live] @ high.T + falling[live] @ low.T
        seen_high += lists.band == up
        seen_low += lists.band == down
        last = step == BANDS - 1
        if not last and step < BANDS // 2:
            continue  # bounds cannot part before half of each list is read
        # Where the lists stand now: nothing unread is better for a query, nothing worse than the far end.
        front_high, front_low = lists.low[up], lists.low[min(down + 1, BANDS - 1)]
        far_high, far_low = lists.bottom, lists.top
        best = rising[live] * front_high + falling[live] * front_low
        worst = rising[live] * far_high + falling[live] * far_low
        of_high, of_low = rising[live] > 0, falling[live] < 0
        unread = lambda x: (x.sum(1)[:, None] - (x * of_high) @ seen_high.T - (x * of_low) @ seen_low.T)
        upper = partial[live] + (0 if last else unread(best))
        lower = partial[live] + (0 if last else unread(worst))
        floor = np.partition(lower, n - k_here, axis=1)[:, n - k_here]
        rows, columns = np.nonzero(upper >= floor[:, None])
        few = np.bincount(rows, minlength=len(live)) <= max(4 * k_here, n // 64)
        done = np.ones(len(live), bool) if last else few
        chosen = done[rows]
        rows, columns = rows[chosen], columns[chosen]
        # Resolve: the final scores of the vectors that may qualify.
        score = partial[live[rows], columns] if last else np.einsum(
            "ij,ij->i", queries[live[rows]], lists.matrix[columns])
        rows = live[rows]
        keep = ~own[rows, columns]
        rows, columns, score = rows[keep], columns[keep], score[keep]
        order = np.lexsort((ids[columns], -score, rows))
        rows, columns, score = rows[order], columns[order], score[order]
        counts = np.bincount(rows, minlength=q)
        rank = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
        best_k = rank < k
        out.append((rows[best_k], columns[best_k], score[best_k]))
        live = live[~done]
        if not len(live):
            break
    rows, columns, score = (np.concatenate(x) for x in zip(*out))
    return rows, ids[columns], score.astype(np.int64)


def _block(k: int):
    schema_names = ["query_id", "vec_id", "score"]

    def rows(key, queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(vectors):
            return pd.DataFrame(columns=schema_names)
        ids, query_ids = vectors["vec_id"].to_numpy(np.int64), queries["vec_id"].to_numpy(np.int64)
        v, q = np.stack(vectors["v"].to_list()), np.stack(queries["v"].to_list())
        if not v.shape[1]:
            v, q = np.zeros((len(v), 1), np.int64), np.zeros((len(q), 1), np.int64)
        most = float(np.abs(v).max()) * float(np.abs(q).max()) * v.shape[1]
        if most >= 1 << 52:
            raise ValueError("components are too large for exact scores")
        kind = np.float32 if most < 1 << 23 else np.float64
        row, vec, score = search(Lists(v.astype(kind)), ids, q.astype(kind), query_ids, k)
        return pd.DataFrame({"query_id": query_ids[row], "vec_id": vec, "score": score})

    return rows


def topk_search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's ``k`` highest inner products.

    Both tables have ``vec_id`` and ``v`` (whole numbers), see ``quantise``. Ties go
    to the smaller ``vec_id``, ranks start at 1, and a vector is never its own
    answer. Rows that repeat a key count once, with the greatest vector. Vectors
    of different lengths are compared only with their like. A query without
    candidates gives no row; so do empty tables.
    """
    single = lambda df: df.groupBy("vec_id").agg(F.max("v").alias("v"))
    vectors, queries = single(vectors), single(queries)
    blocks = lambda df, size: max(1, math.ceil(df.count() / size))
    n_vectors, n_queries = blocks(vectors, BLOCK), blocks(queries, QUERIES)
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    dims = F.size("v").alias("dims")
    # Queries in blocks meet vectors in blocks: each side is copied once per block of the other.
    a = queries.select("vec_id", "v", dims, deal(n_queries).alias("i")).withColumn(
        "j", F.explode(F.sequence(F.lit(0), F.lit(n_vectors - 1))))
    b = vectors.select("vec_id", "v", dims, deal(n_vectors).alias("j")).withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    keys = ["dims", "i", "j"]
    near = a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(_block(k), "query_id long, vec_id long, score long")
    # The limit on the rank is applied before the shuffle as well as after it.
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
