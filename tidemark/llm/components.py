"""Connected components by alternating large-star and small-star rounds, all as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut


def _star(edges: DataFrame) -> DataFrame:
    """Large star: every larger neighbour of u is tied to the smallest node near u."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("b"), F.col("m").alias("a")).select("a", "b").where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Small star: u and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return tied.union(low.select(F.col("m").alias("a"), F.col("u").alias("b"))).where("a <> b").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) between long ids to rows (node, component), component being the least id reachable.

    Only nodes that occur in an edge get a row; loops are ignored; an empty input gives no rows. Each
    round is written to the shared folder; rounds grow with the logarithm of the longest path.
    """
    now = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        now = cut(_small_star(_star(now)), "edges")
        last, mark = mark, _mark(now)
        if mark == last:
            break
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(roots)
