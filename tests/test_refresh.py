"""A refresh that recomputes dirty days only equals the full recompute."""

import datetime
import math
import random

import pytest

from tidemark.streaming import refresh

FIRST = datetime.date(2024, 1, 1)
N = 110
ITEM = "doc_id long, entity string, source string, date date, author long, community string, status string, ambiguous boolean, relevance double, score double, comments double, polarity double, label string, aspect string, confidence double"


def day(i):
    return FIRST + datetime.timedelta(i)


def item(rng, doc, entity, source, i, score=None):
    p = rng.uniform(-1, 1)
    return (doc, entity, source, day(i), rng.randint(1, 9), rng.choice(["a", "b", None]), rng.choice(["unique", "unique", "unique", "bot_repeat", "near_duplicate"]), rng.random() < 0.2, 0.8, score or rng.uniform(0, 50), 2.0, p, "positive" if p > 0.3 else "negative" if p < -0.3 else "uncertain", rng.choice(["investment", "product", "general"]), 0.7)


@pytest.fixture(scope="module")
def batches():
    rng = random.Random(11)
    rows, doc = [], 0
    for i in range(N):
        for entity in ("A", "B", "C"):
            for source in ("reddit", "wikipedia", "github"):
                if source == "github" and (entity != "A" or i not in (3, 80)):  # a series with long gaps
                    continue
                for _ in range(rng.choice([0, 1, 1, 2])):
                    doc += 1
                    rows.append(item(rng, doc, entity, source, i))
    late = [r for r in rows if r[3] in (day(30), day(31)) and r[1] == "B"]
    rest = [r for r in rows if r not in late]
    now = [r for r in rest if r[3] <= day(89)]
    then = [r for r in rest if r[3] > day(89)]
    changed = [(*now[5][:9], 999.0, *now[5][10:])]
    return [now, then, [*late, item(rng, 10**6, "A", "github", 20), item(rng, 10**6 + 1, "A", "reddit", N + 9)], changed]


def close(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


def same(got, wanted):
    assert got.columns == wanted.columns
    a, b = ({(r.entity, r.source, r.date): r for r in x.collect()} for x in (got, wanted))
    assert a.keys() == b.keys()
    for k in a:
        assert all(close(x, y) for x, y in zip(a[k], b[k])), (k, a[k], b[k])


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_batches_out_of_order_equal_the_full_recompute(spark, tmp_path, batches):
    entities = spark.createDataFrame([("A",), ("B",), ("C",)], "entity string")
    store = refresh.Store(f"file://{tmp_path}/store", FIRST, day(N - 1), ("reddit", "wikipedia", "github"))
    taken, seen = {}, []
    for rows in batches:
        before = files(tmp_path / "store" / "features") if taken else {}
        dirty = refresh.apply(spark.createDataFrame(rows, ITEM), entities, store)
        seen.append(dirty)
        taken |= {(r[0], r[3]): r for r in rows if r[3] < day(N)}
        wanted = refresh.full(spark.createDataFrame(list(taken.values()), ITEM), entities, store)
        same(store.table(spark, "features", wanted.schema), wanted)
        after = files(tmp_path / "store" / "features")
        kept = {p for p, t in before.items() if after.get(p) == t}
        assert {datetime.date.fromisoformat(p.split("date=")[1][:10]) for p in kept} == ({day(i) for i in range(N) if not any(a <= day(i) <= b for a, b in dirty)} if before else set())
    assert seen[0] == [(FIRST, day(N - 1))]
    assert seen[1] == [(day(90), day(N - 1))]
    # day 20 reaches 42 days; beyond, only the days before the next one on which that series is observed
    assert seen[2] == [(day(20), day(79))]
    assert seen[3] == [(day(0), day(refresh.REACH))]
    assert refresh.apply(spark.createDataFrame(batches[3], ITEM), entities, store) == seen[3]  # repeated: nothing changes
    same(store.table(spark, "features", wanted.schema), wanted)
    assert refresh.apply(spark.createDataFrame([], ITEM), entities, store) == []


def test_scans_are_of_the_days_that_windows_see(spark, tmp_path, batches):
    entities = spark.createDataFrame([("A",)], "entity string")
    store = refresh.Store(f"file://{tmp_path}/store", FIRST, day(N - 1), ("reddit",))
    refresh.apply(spark.createDataFrame([r for r in batches[0] if r[1] == "A" and r[2] == "reddit"], ITEM), entities, store)
    daily = store.table(spark, "metrics")
    made = refresh._features(daily.where(refresh._between(day(52), day(104))), None, entities, store, day(94), day(104))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(date") == plan.count("FileScan") == 1 and made.count() == 11


def test_runs():
    last = day(300)
    assert refresh.runs([day(5), day(250)], FIRST, last) == [(day(5), day(47)), (day(250), day(292))]
    assert refresh.runs([day(5), day(60), day(290)], FIRST, last) == [(day(5), day(102)), (day(290), last)]
    assert refresh.runs([], FIRST, last) == []


def test_a_stream_is_followed_and_resumed(spark, tmp_path, batches):
    entities = spark.createDataFrame([("A",)], "entity string")
    store = refresh.Store(f"file://{tmp_path}/store", FIRST, day(59), ("reddit", "github"))
    batches = [[r for r in b if r[1] == "A" and r[2] != "wikipedia"] for b in batches]
    for part in (batches[2], batches[0]):
        spark.createDataFrame(part, ITEM).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(ITEM).parquet(f"file://{tmp_path}/in")
        refresh.follow(stream, entities, store, f"file://{tmp_path}/state").awaitTermination()
    taken = {(r[0], r[3]): r for b in (batches[2], batches[0]) for r in b if r[3] <= day(59)}
    wanted = refresh.full(spark.createDataFrame(list(taken.values()), ITEM), entities, store)
    same(store.table(spark, "features", wanted.schema), wanted)
