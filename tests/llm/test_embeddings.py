import duckdb
import numpy as np
import pytest

from tidemark.llm import embeddings
from tidemark.llm.queries import ORACLE_SQL, op6_embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, id string"


def fixture(seed=0, n=700, d=64):
    r = np.random.default_rng(seed)
    base = r.standard_normal((n, d))
    for i in range(0, n, 3):  # near copies at angles around the threshold, some of them chained
        base[i] = base[i - 1] / np.linalg.norm(base[i - 1]) * 3 + r.standard_normal(d) * r.choice([0.01, 0.05, 0.07, 0.075])
    base[200:330] = base[200] + r.standard_normal((130, d)) * 0.02  # a group of near copies
    base[400:420] = base[400]
    rows = [(i * 7 % 1009, [float(x) for x in v.astype(np.float32)], [0, 1, 1, None][i % 4] if i < 200 or i >= 420 else 1, "clash", "x") for i, v in enumerate(base)]
    rows += [(2000, None, 1, "", ""), (2001, [0.0] * d, 1, "", ""), (2002, [float("nan")] * d, 1, "", ""), (2003, [float("inf")] + [0.0] * (d - 1), 1, "", ""), (2004, [None] + [1.0] * (d - 1), 1, "", ""), (2005, [], 1, "", ""), (2006, [1.0, 2.0], 1, "", ""), (2007, [2.0, 4.0], 1, "", ""), (None, [1.0, 2.0], 1, "", ""), (2008, [0.0] * d, 1, "", ""), (2009, [-0.0, 1.0], 1, "", ""), (2010, [0.0, 1.0], 1, "", "")]
    return rows


def slow(rows, threshold=0.98):
    ok = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    n = len(rows)
    links = [set() for _ in range(n)]
    for i in range(n):
        for j in range(i):
            (a, v, k, *_), (b, w, m, *_) = rows[i], rows[j]
            if k is not None and k == m and a is not None and b is not None and ok(v) and ok(w) and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                if (x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())) >= threshold:
                    links[i].add(j)
                    links[j].add(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            more = links[todo.pop()] - seen
            seen |= more
            todo += more
        low = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(links[i]), low, low is None or rows[i][0] == low))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rows = fixture()
    got = embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == slow(rows)


def test_blocks_meet_each_other(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 20)
    rows = fixture(1, 500)
    got = embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA), centroids=8).collect()
    assert sorted(map(tuple, got), key=str) == slow(rows)


@pytest.mark.parametrize("d", [8, 64, 100])
def test_estimates_are_unbiased_and_bounds_hold(d):
    r = np.random.default_rng(3)
    u = r.standard_normal((400, d))
    u /= np.linalg.norm(u, axis=1)[:, None]
    true = u @ u.T
    codes = embeddings.Codes(u)
    estimate = codes.upper(slice(None), codes, slice(None), 0.0)
    off = ~np.eye(400, dtype=bool)
    assert abs((estimate - true)[off].mean()) < 0.01
    assert (codes.upper(slice(None), codes, slice(None), embeddings.CONFIDENCE) >= true - 1e-9).all()


@pytest.mark.parametrize("options", [{}, {"centroids": 32, "per_list": 20}, {"centroids": 8, "per_list": 20}])
def test_recall_of_the_lists_at_the_threshold(spark, options):
    r = np.random.default_rng(9)
    u = r.standard_normal((3000, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    w = r.standard_normal((3000, 64))
    w -= (w * u).sum(axis=1)[:, None] * u
    w = 0.9801 * u + np.sqrt(1 - 0.9801**2) * w / np.linalg.norm(w, axis=1)[:, None]
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(np.concatenate([u, w]))]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), **options)
    found = got.where("vec_id >= 3000 and component_id = vec_id - 3000").count()
    assert found >= 0.995 * 3000


def test_lists_stay_short_as_levels_are_added():
    r = np.random.default_rng(2)
    u = r.standard_normal((8000, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    longest = []
    for levels in (1, 2):
        found = embeddings.cells(u, embeddings.index(u[:1000], 32, levels), 5)
        assert found.shape == (8000, 5 * embeddings.FINE ** (levels - 1)) and all(len(set(x)) == len(x) for x in found[:200].tolist())
        longest.append(np.bincount(np.unique(found, return_inverse=True)[1].ravel()).max())
    assert longest[1] < longest[0] / 4


def test_empty(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_against_sql(spark):
    d = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{d}/embeddings.parquet'")
    assert sorted(map(tuple, op6_embeddings(spark, d).collect())) == sorted(c.execute(ORACLE_SQL["op6_embeddings"]).fetchall())
