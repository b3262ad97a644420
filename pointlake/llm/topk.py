"""Exact top-k by inner product: the threshold algorithm over sorted lists per dimension, block by block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from pointlake.llm.common import session, staged

#: Vectors of a block with its lists, and queries that visit it together.
BLOCK, QUERIES = 4096, 2048
#: Depth of the first round of sorted access; each later round goes four times as deep.
FIRST_DEPTH = 64


class Lists:
    """Sorted lists per dimension over a block of integer vectors."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        self.ids = ids
        self.order = np.argsort(matrix, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(matrix.T, self.order, axis=1)
        self.matrix = matrix.astype(np.float64)
        self.most = np.abs(matrix).max(axis=0, initial=0).astype(np.float64)
        self.exact = matrix

    def top(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best, ties to smaller ids, without rows of id ``own``."""
        best, scores = self.best(own, query, k)
        return self.ids[best], scores

    def best(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the k best, ties to smaller ids, without rows of id ``own``.

        Each round reads the lists deeper, from the end that raises the score, and scores what it meets for the first
        time. It stops when nothing unseen can reach the k-th score: what is unseen has at most the last values read.
        """
        n = len(self.ids)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        # Doubles hold the sums exactly up to 2^53; beyond, 64-bit integers do.
        exact = float(self.most @ np.abs(query)) < 2.0**53
        matrix, weights = (self.matrix, query.astype(np.float64)) if exact else (self.exact, query)
        seen = np.zeros(n, bool)
        if own is not None:
            seen |= self.ids == own
        members, scores = [], []
        low, high, kth, count = 0, min(FIRST_DEPTH, n), None, 0
        while True:
            met = np.zeros(n, bool)
            if len(up) or len(down):
                met[self.order[up, n - high : n - low]] = True
                met[self.order[down, low:high]] = True
            else:
                met[:] = True
            new = np.flatnonzero(met & ~seen)
            if len(new):
                seen[new] = True
                members.append(new)
                scores.append(matrix[new] @ weights)
                count += len(new)
            if high == n or not (len(up) or len(down)):
                break
            if count >= k:
                kth = -np.partition(-np.concatenate(scores), k - 1)[k - 1]
                bound = weights[up] @ self.sorted[up, n - high] + weights[down] @ self.sorted[down, high - 1]
                if kth > bound:
                    break
            low, high = high, min(4 * high, n)
        if not count:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        members, scores = np.concatenate(members), np.concatenate(scores)
        if count > k:
            keep = scores >= -np.partition(-scores, k - 1)[k - 1]
            members, scores = members[keep], scores[keep]
        best = np.lexsort((self.ids[members], -scores))[:k]
        return members[best], scores[best].astype(np.int64)


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component; without rows that are null, or hold nulls or non-finite values."""
    x = F.col(vec_col)
    whole = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.where(whole).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long")).alias("v")
    )


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """(dim, ``name``, ids, values): blocks of about ``size`` rows as two arrays."""
    count = rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("blocks"))
    return (
        rows.join(count, "dim").groupBy("dim", "blocks", F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks")).cast("int").alias(name))
        .agg(F.collect_list(F.struct("vec_id", "v", "times")).alias("rows"))
        .select("dim", name, F.col("blocks").alias(name + "s"), F.col("rows.vec_id").alias(name + "_ids"), F.flatten("rows.v").alias(name + "_v"), F.col("rows.times").alias(name + "_times"))
    )


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) over integer vectors (vec_id, v): the k highest inner products per query.

    Ties go to the smaller id; rows with the query's id are its own and no candidates. A row repeated as a whole is searched
    once and counts as often as it stands there, as a candidate and as a query. Only vectors of a query's dimension are compared. All queries in blocks visit all vectors in blocks; each visit
    returns k rows per query at most, and the best of these are kept. A null vector or id takes no part; an empty table
    gives no rows.
    """
    session(vectors)
    tidy = lambda df: df.select("vec_id", "v", F.size("v").alias("dim")).dropna().groupBy("vec_id", "v", "dim").agg(F.count(F.lit(1)).alias("times"))
    blocks = staged(_blocks(tidy(vectors), BLOCK, "block"))
    asked = staged(_blocks(tidy(queries), QUERIES, "ask"))
    counts = lambda df, n: df.select("dim", n).distinct()  # noqa: E731  one row per dimension
    left = blocks.join(counts(asked, "asks"), "dim").withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("asks") - 1)))
    right = asked.join(counts(blocks, "blocks"), "dim").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = left.join(right, ["dim", "block", "ask"]).select("dim", "block_ids", "block_v", "block_times", "ask_ids", "ask_v", "ask_times")

    def search(batches):
        for batch in batches:
            for dim, *arrays in zip(*(batch.column(c) for c in ("dim", "block_ids", "block_v", "block_times", "ask_ids", "ask_v", "ask_times"))):
                dim = dim.as_py()
                ids, values, times, ask_ids, ask_values, ask_times = (x.values.to_numpy() for x in arrays)
                lists = Lists(ids, values.reshape(len(ids), dim))
                out = [lists.best(q, v, k) for q, v in zip(ask_ids.tolist(), ask_values.reshape(len(ask_ids), dim))]
                sizes, places = [len(i) for i, _ in out], np.concatenate([i for i, _ in out])
                arrays = [np.repeat(ask_ids, sizes), ids[places], np.concatenate([s for _, s in out]), np.minimum(times[places], k) * np.minimum(np.repeat(ask_times, sizes), k)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in arrays], ["query_id", "vec_id", "score", "times"])

    found = met.mapInArrow(search, "query_id long, vec_id long, score long, times long")
    # More than k of one row never count.
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("times", F.lit(k))))).drop("times", "copy")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
