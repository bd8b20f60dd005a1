import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.llm import topk
from tidemark.llm.queries import ORACLE_SQL, op7_topk


def slow(ids, values, query_id, q, k):
    scored = sorted((-sum(int(a) * int(b) for a, b in zip(v, q, strict=True)), i) for i, v in zip(ids, values, strict=True) if i != query_id)
    return [(i, -s) for s, i in scored[:k]]


@pytest.mark.parametrize("n,d,high", [(5, 3, 10), (300, 8, 50), (900, 64, 1000), (200, 4, 3), (50, 2, 10**9)])
def test_lists_against_brute_force(n, d, high):
    r = np.random.default_rng(n)
    values = r.integers(-high, high + 1, (n, d))
    values[n // 2 :] = values[: n - n // 2]  # ties
    ids = r.permutation(3 * n)[:n]
    lists = topk.Lists(ids, values)
    for q in range(0, n, max(1, n // 25)):
        got = lists.top(int(ids[q]), values[q], 10)
        assert list(zip(got[0].tolist(), map(int, got[1]), strict=True)) == slow(ids, values, ids[q], values[q], 10)
    zero = lists.top(-1, np.zeros(d, np.int64), 10)
    assert zero[0].tolist() == sorted(ids)[:10]


def test_reading_stops_early_on_skewed_lists():
    r = np.random.default_rng(1)
    values = (r.pareto(1.0, (20_000, 6)) * 100).astype(np.int64)
    lists = topk.Lists(np.arange(20_000), values)
    got = lists.top(-1, np.array([1, 1, 1, 1, 1, 1]), 3)
    assert got[0].tolist() == [i for i, _ in slow(range(20_000), values, -1, [1] * 6, 3)]
    assert lists.read < lists.offered / 100


def test_bounds_act_on_the_real_table():
    rows = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pydict()
    kept = [(i, np.floor(1024 * np.array(v, float))) for i, v in zip(rows["vec_id"], rows["embedding"], strict=True) if v and all(x is not None and np.isfinite(x) for x in v)]
    lists = topk.Lists(np.array([i for i, _ in kept]), np.array([v for _, v in kept]).astype(np.int64))
    for i, v in kept[::100]:
        ids, scores = lists.top(i, v, 10)
        s = lists.values @ v
        s[lists.ids == i] = -np.inf
        best = np.lexsort((lists.ids, -s))[:10]
        assert ids.tolist() == lists.ids[best].tolist() and scores.tolist() == s[best].tolist()
    assert lists.read < 0.8 * lists.offered


def test_frames(spark):
    rows = [(i, [float((i * 7 + k * k) % 11 - 5) / 7 for k in range(6)], "clash") for i in range(0, 230, 5)]
    rows += [(100, [0.1] * 6, "dup id"), (7, None, ""), (8, [None] * 6, ""), (9, [float("nan")] * 6, ""), (10_000, [float("inf")] * 6, ""), (300, [1.0, 2.0], ""), (301, [3.0, 1.0], ""), (None, [1.0] * 6, ""), (400, [], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = topk.top_k(df, F.col("vec_id") % 100 == 0, k=4).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    own = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int)) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    for q in (0, 200, 300):
        v = dict(own)[q]
        same = [(i, w) for i, w in own if len(w) == len(v)]
        assert found[q] == slow([i for i, _ in same], [w for _, w in same], q, v, 4)
    assert set(found) <= {0, 100, 200, 300}
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_components_and_scores_that_no_long_holds(spark):
    rows = [(100, [1e300, 1.0]), (200, [1e12, 1e12]), (1, [1e12, 1e12]), (2, [-1e12, 1e3]), (3, [1.0, 2.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(200, 1, topk.MOST), (200, 3, 1024000000000000 * 3072), (200, 2, topk.LEAST)]


def test_query_against_sql(spark):
    d = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{d}/embeddings.parquet'")
    got = op7_topk(spark, d)
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    assert sorted(map(tuple, got.collect())) == sorted(c.execute(ORACLE_SQL["op7_topk"]).fetchall())


def test_blocks_meet_in_many_partitions(spark, monkeypatch):
    """Without the merging of small partitions, which would hide keys that lie apart."""
    monkeypatch.setattr(topk, "CANDIDATES", 100)
    monkeypatch.setattr(topk, "QUERIES", 3)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        rows = [(i, [float((i * 7 + k * k) % 11 - 5) / 7 for k in range(6)]) for i in range(900)]
        got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0, k=3).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    own = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows]
    for q in range(0, 900, 100):
        assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == slow([i for i, _ in own], [w for _, w in own], q, own[q][1], 3)
