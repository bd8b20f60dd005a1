"""Exact top-k by integer inner product, by no-random-access aggregation over sorted lists.

Each block of candidates keeps, for every component, its values in order of magnitude. A query reads
each list in turn from its top down to where a value times the query's component falls below a bar, so
lists are read to different depths: the greater the query's component, the deeper. Depths are those of
``EDGES``, so that a batch of queries advances together: what lies above an edge of all lists is one
masked matrix, and the queries that read a list so far are its columns. What has been read gives each
candidate a lower and an upper bound: an unread value is worth at most the first unread one of its list,
either way. Candidates whose upper bound is below the k-th best lower bound are out, the bar is lowered,
and a query stops reading when no more than ``RESOLVE`` can still qualify, or the lists end. Only then
are rows looked at: the final scores of those left are resolved.

Blocks of candidates meet blocks of queries in tasks; each returns at most k rows a query, which are
merged. No block grows with the data.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut

K, SCALE, EVERY = 10, 1024, 100
#: Rows to a block of candidates and to a block of queries. Candidates are sent once for each block of queries and queries
#: once for each block of candidates, so that large blocks keep both few.
CANDIDATES, QUERIES = 8192, 8192
#: Candidates (k at least) whose final scores are resolved; the first bar as a share of the largest product; the factor by which it is lowered.
RESOLVE, START, STEP = 64, 0.03, 0.5
#: Shares of a list down to which it may be read, and queries that advance together.
EDGES = (2.0**-12, 2.0**-10, 2.0**-8, 2.0**-5, 0.25, 0.45, 0.6, 0.72, 0.82, 0.91, 1.0)
BATCH = 256
#: What a long holds.
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as long; null for a null vector, one with null or non-finite components, or one that no long holds."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * scale) >= float(1 << 63)))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


class Lists:
    """The lists of a block: ids ascending, values (n, d). ``read`` counts the entries that queries have read, ``offered`` all of them."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        most = max((abs(int(values.max(initial=0))), abs(int(values.min(initial=0)))))
        # exact in float64 below 2**53, else in Python's integers
        self.values = values[order].astype(np.float64 if 2 * most * most * max(1, values.shape[1]) < 2**53 else object)
        self.n, self.d = values.shape
        self.by_list = np.ascontiguousarray(self.values.T)
        size = np.abs(self.by_list)
        by_size = np.argsort(-size, axis=1, kind="stable")
        self.edges = np.unique([0, *(int(np.ceil(share * self.n)) for share in EDGES)])
        # the first edge below an entry's place, and what the first entry below an edge is worth (0 below the last)
        self.level = np.empty((self.d, self.n), np.int8)
        np.put_along_axis(self.level, by_size, np.searchsorted(self.edges, np.arange(self.n), side="right").astype(np.int8)[None], axis=1)
        self.below = np.zeros((len(self.edges), self.d), self.values.dtype)
        self.below[:-1] = np.take_along_axis(size, by_size[:, self.edges[:-1]], axis=1).T
        self.read = self.offered = 0

    def _bounds(self, q: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (queries, n) of the scores after list j is read to edge ``depth[:, j]``."""
        # sums of integers below 2**24 are exact in float32, in any order
        exact = self.values.dtype == object or 2 * float((np.abs(q) @ self.below[0]).max()) >= 2**24
        kind = self.values.dtype if exact else np.float32
        seen, slack = np.zeros((len(q), self.n), kind), np.zeros((len(q), self.n), kind)
        for e in np.unique(depth):
            here = np.where(depth == e, q, 0)
            if e > 0:
                seen += here.astype(kind) @ np.where(self.level <= e, self.by_list, 0).astype(kind)
            if e < len(self.edges) - 1:
                slack += (np.abs(here) * self.below[e]).astype(kind) @ (self.level > e).astype(kind)
        return seen - slack, seen + slack

    def tops(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query, ids and scores of the k best other than its own row, ties to smaller ids."""
        q = queries.astype(self.values.dtype)
        left = [np.nonzero(self.ids != i)[0] for i in query_ids]
        going = np.arange(len(q)) if self.n > max(k, RESOLVE) and self.d else np.arange(0)
        bar = (np.abs(q) * self.below[0]).max(axis=1) * START if len(going) else None
        while len(going):
            asked, ends = q[going], len(self.edges) - 1
            at = np.where(bar[going] < 1, 0, bar[going])[:, None, None]
            depth = np.minimum((np.abs(asked)[:, None, :] * self.below >= at).sum(axis=1), ends)
            low, high = self._bounds(asked, depth)
            own = self.ids == query_ids[going][:, None]
            low[own] = -np.inf
            kth = np.partition(low, self.n - k, axis=1)[:, self.n - k]
            able = (high >= kth[:, None]) & ~own
            used = asked != 0
            done = (able.sum(axis=1) <= max(k, RESOLVE)) | ((depth == ends) | ~used).all(axis=1)
            for row in np.nonzero(done)[0]:
                left[going[row]] = np.nonzero(able[row])[0]
                self.read += int(self.edges[depth[row]][used[row]].sum())
                self.offered += self.n * int(used[row].sum())
            bar = bar * STEP
            going = going[~done]
        return [self._resolved(rows, v, k) for rows, v in zip(left, q, strict=True)]

    def _resolved(self, rows: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        score = self.values[rows] @ q
        if self.values.dtype == object:
            score = np.clip(score, LEAST, MOST)
        best = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows][best], score[best]

    def top(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self.tops(np.array([query_id]), q[None], k)[0]


def top_k(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): each query's ``k`` best rows other than its own, ties to smaller ids.

    Vectors that are null or hold null or non-finite components take no part, nor do rows without an id or
    vectors of which a scaled component is beyond a long; a score beyond a long is held at its limit. Only
    vectors of one length are compared; fewer candidates than k give as many rows. Ids are unique: rows
    that share a query's id are its own. Vectors may repeat. An empty table gives an empty result.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), quantised(F.col(vector), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = cut(rows.where("v is not null and vec_id is not null").withColumn("d", F.size("v")), "vectors")
    counts = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    c_blocks, q_blocks = max(1, -(-counts.n // CANDIDATES)), max(1, -(-counts.q // QUERIES))
    # cogrouped keys are not made of one type by Spark: a long and an int of one value lie in different partitions
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select("d", block(c_blocks).alias("c"), every(q_blocks).alias("q"), "vec_id", "v")
    queries = rows.where("asks").select("d", every(c_blocks).alias("c"), block(q_blocks).alias("q"), "vec_id", "v")

    def meet(found: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(found) and len(asked):
            lists = Lists(found["vec_id"].to_numpy(np.int64), np.stack(found["v"].to_numpy()))
            for at in range(0, len(asked), BATCH):
                who = asked["vec_id"].to_numpy(np.int64)[at : at + BATCH]
                for i, (ids, scores) in zip(who.tolist(), lists.tops(who, np.stack(asked["v"].to_numpy()[at : at + BATCH]), k), strict=True):
                    out["query_id"] += [i] * len(ids)
                    out["vec_id"] += ids.tolist()
                    out["score"] += [int(s) for s in scores]
        return pd.DataFrame(out)

    key = ["d", "c", "q"]
    met = candidates.groupBy(*key).cogroup(queries.groupBy(*key)).applyInPandas(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
