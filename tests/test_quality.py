"""Quality events against sets of days; sources that say nothing of an entity; the catalogue of features."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import lab
from tidemark.operators.quality import quality_events
from tidemark.plans import views

DAY = lambda i: dt.date(2026, 3, 1) + dt.timedelta(days=i)


def test_quality_events(spark):
    last = 19
    days = {"whole": range(20), "few": [i for i in range(20) if i not in (2, 9, 10)], "many": [i for i in range(20) if i not in (0, 5, 6, 7, 8)], "stale": range(17), "edge": range(18), "none": [], "off": [1, 2], None: range(20)}
    covered = [(s, DAY(i)) for s, on in days.items() for i in on] + [("few", DAY(3)), ("whole", DAY(-5)), ("stale", DAY(25)), ("few", None)]
    states = [(s, "unavailable" if s == "off" else None if s == "few" else "live", None) for s in days if s] + [("gone", "unavailable", "no key")]
    got = quality_events(spark.createDataFrame(covered, "source string, date date"), spark.createDataFrame(states, "source string, state string, reason string"), ["source"], DAY(0), DAY(last))
    rows = {(r.source, r.kind): (r.severity, r.date) for r in got.collect()}
    wanted = {("off", "provider_unavailable"): ("warning", None), ("gone", "provider_unavailable"): ("warning", None)}
    for s, on in days.items():
        missing = sorted(set(range(20)) - set(on))
        if s in (None, "off"):
            continue
        if missing:
            wanted[s, "coverage_gap"] = ("warning" if len(missing) > 3 else "info", DAY(missing[0]))
        if on and max(on) < last - 2:
            wanted[s, "stale"] = ("warning", DAY(max(on)))
    assert rows == wanted and ("edge", "stale") not in rows and ("stale", "stale") in rows
    said = {(r.source, r.kind): r.message for r in got.collect()}
    assert said["many", "coverage_gap"] == "5 of the days 2026-03-01 to 2026-03-20 not collected, first 2026-03-01, 2026-03-06, 2026-03-07"
    assert said["gone", "provider_unavailable"] == "no key" and said["off", "provider_unavailable"] == "unavailable"


def test_unused_sources(spark):
    features = spark.createDataFrame([("A", DAY(d), s, ok) for d in (0, 1) for s, ok in (("x", True), ("y", False), ("z", None), ("u", True), ("n", False))], "entity string, date date, source string, available boolean")
    expected = spark.createDataFrame([("A", DAY(0), ["n"]), ("A", DAY(1), ["x", "y", "z"])], "entity string, date date, expected array<string>")
    states = spark.createDataFrame([("x", "live"), ("y", "stale"), ("u", "unavailable"), ("n", "live")], "source string, state string")
    got = {tuple(r) for r in views.unused_sources(features, expected, states).collect()}
    assert got == {("A", "y", "stale", True, False), ("A", "z", None, True, False), ("A", "u", "unavailable", False, True)}


def test_catalogue_leaves_out_what_is_not_known(spark):
    values = [F.lit(float(i)).alias(f) if i % 2 else F.lit(None).cast("double").alias(f) for i, f in enumerate(lab.FEATURES)]
    got = lab.catalogue(spark.range(2).select(F.col("id").cast("string").alias("entity"), F.lit(DAY(0)).alias("date"), *values)).collect()
    assert {(r.entity, r.feature, r.value) for r in got} == {(e, f, float(i)) for e in "01" for i, f in enumerate(lab.FEATURES) if i % 2}
