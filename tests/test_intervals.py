"""Interval algebra against sets of days."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import intervals as I

SCHEMA = "entity string, source string, start date, end date, extra int"
KEYS = ["entity", "source"]
FIRST = dt.date(2026, 1, 1)


def drawn(r, n):
    day = lambda i: FIRST + dt.timedelta(days=i)
    rows = []
    for _ in range(n):
        a = r.randrange(60)
        rows.append((r.choice(["A", "B", None]), r.choice("st"), day(a), day(a + r.choice([-2, 0, 0, 1, 3, 9])), 1))
    return [*rows, ("A", "s", None, day(3), 1), ("A", "s", day(3), None, 1), *rows[:3]]


def days(rows):
    return {(r[0], r[1], r[2] + dt.timedelta(days=i)) for r in rows if r[2] and r[3] for i in range((r[3] - r[2]).days + 1)}


def is_merged(rows):
    by_key = {}
    for r in sorted(rows, key=lambda r: r[2]):
        last = by_key.get(r[:2])
        assert r[2] <= r[3] and (last is None or (r[2] - last).days > 1)
        by_key[r[:2]] = r[3]


@pytest.mark.parametrize("seed", range(3))
def test_against_days(spark, seed):
    r = random.Random(seed)
    left, right = drawn(r, 40), drawn(r, 25)
    a, b = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    for got, wanted in ((I.merged(a, KEYS), days(left)), (I.subtracted(a, b, KEYS), days(left) - days(right)), (I.common(a, b, KEYS), days(left) & days(right))):
        rows = [tuple(x) for x in got.collect()]
        assert days(rows) == wanted and got.columns == [*KEYS, "start", "end"]
        is_merged(rows)
    # the anti-join of single days, which the intervals replace
    single = lambda x: x.where("start <= end").select(*KEYS, F.explode(F.sequence("start", "end")).alias("d")).distinct()
    x, y = single(a), single(b)
    anti = x.join(y, x.entity.eqNullSafe(y.entity) & (x.source == y.source) & (x.d == y.d), "left_anti")
    assert {tuple(z) for z in anti.collect()} == days([tuple(z) for z in I.subtracted(a, b, KEYS).collect()])


def test_the_plan_has_no_join_and_one_shuffle(spark):
    a = spark.createDataFrame(drawn(random.Random(1), 9), SCHEMA)
    plan = I.subtracted(a, a, KEYS)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan
    assert plan.count("Exchange hashpartitioning(entity") <= 2  # sums by day, then by key


def test_latest_day_outages_and_empty_tables(spark):
    d = lambda i: FIRST + dt.timedelta(days=i)
    asked = spark.createDataFrame([("A", "s", d(0), d(20), 1), ("B", "s", d(12), d(20), 1)], SCHEMA)
    out = spark.createDataFrame([("A", "s", d(3), d(4), 1), ("A", "s", d(5), d(6), 1), ("A", "s", d(10), d(99), 1)], SCHEMA)
    got = I.collectable(asked, out, KEYS, F.lit(d(11))).orderBy("start").collect()
    assert [tuple(r) for r in got] == [("A", "s", d(0), d(2)), ("A", "s", d(7), d(9))]
    assert I.collectable(asked, out.limit(0), KEYS, F.lit(d(11))).select(I.n_days().alias("n")).first().n == 12
    assert I.subtracted(asked.limit(0), out, KEYS).count() == 0 and I.merged(out.limit(0), KEYS).count() == 0
