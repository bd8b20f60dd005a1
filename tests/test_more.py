"""Draws, display, finding entities, the document pipeline and the lab run on small frames."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark import queries as Q
from tidemark.functions import draws, shown
from tidemark.operators import classify, lab, resolve
from tidemark.plans import documents, lab_run, views


def test_draws_follow_their_distributions_and_repeat(spark):
    x = spark.range(20_000).select(draws.normal(1, F.col("id")).alias("n"), draws.poisson(F.lit(3.0), 2, F.col("id")).alias("p"), draws.poisson(F.lit(90.0), 2, F.col("id")).alias("q"), draws.integer(1, 6, 3, F.col("id")).alias("i"), draws.chance(0.2, 4, F.col("id")).alias("c"), draws.pick(F.array(F.lit("a"), F.lit("b")), 5, F.col("id")).alias("k"), draws.poisson(F.lit(0.0), 2, F.col("id")).alias("z"))
    s = x.agg(F.avg("n").alias("m"), F.stddev("n").alias("s"), F.avg("p").alias("p"), F.var_samp("p").alias("pv"), F.avg("q").alias("q"), F.min("i").alias("lo"), F.max("i").alias("hi"), F.avg("i").alias("i"), F.avg(F.col("c").cast("int")).alias("c"), F.count_if(F.col("k") == "a").alias("a"), F.sum("z").alias("z")).first()
    assert abs(s.m) < 0.03 and abs(s.s - 1) < 0.03 and abs(s.p - 3) < 0.06 and abs(s.pv - 3) < 0.2 and abs(s.q - 90) < 0.4
    assert (s.lo, s.hi, s.z) == (1, 6, 0) and abs(s.i - 3.5) < 0.05 and abs(s.c - 0.2) < 0.02 and abs(s.a - 10_000) < 400
    assert x.where("n is null or k is null").count() == 0 and x.orderBy("n").first() == x.repartition(3).orderBy("n").first()


def test_numbers_as_text(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(shown.capital(F.lit(v))) for v in (2.345e12, 7.6e9, 4.2e6)] == ["$2.35T" if round(2.345, 2) > 2.34 else "$2.34T", "$8B", "$4M"]
    assert one(shown.signed(F.lit(1.25), 1)) in ("+1.2", "+1.3") and one(shown.signed(F.lit(-2.0))) == "-2.0" and one(shown.signed(F.lit(None).cast("double"))) == "—"
    assert one(shown.percent(F.lit(0.125))) == "12.5%" and one(shown.fixed(F.lit(float("nan")))) == "—" and one(shown.minute(F.lit(dt.datetime(2026, 1, 2, 3, 4, 5)))) == "2026-01-02 03:04 UTC"


def test_entities_are_found_by_present_and_former_tickers(spark):
    u = spark.createDataFrame([("META", ["FB"]), ("FB", []), ("AA", None)], "entity string, previous array<string>")
    found = lambda t: [r.entity for r in views.find_entity(u, t).collect()]
    assert found("fb") == ["FB"] and found("meta") == ["META"] and found("A A") == [] and found("zz") == [] and found("' or 1") == []
    assert [r.entity for r in views.find_entity(u.where("entity <> 'FB'"), "FB").collect()] == ["META"]


def test_explorer_orders(spark):
    rows = [("b", "Über", 3, 10.0, "high", 5.0), ("A", "alpha", 1, None, "low", None), ("c", "Zed", 2, 90.0, "elevated", 70.0)]
    x = spark.createDataFrame(rows, "entity string, sector string, rank int, alt_signal_score double, hype_risk string, divergence double").withColumns({"attention_score": F.lit(1.0), "sentiment_score": F.lit(1.0), "anomaly_score": F.lit(99.0), "confidence": F.lit(80.0)})
    names = lambda **o: [r.entity for r in views.explorer(x, **o).collect()]
    assert names() == ["A", "c", "b"] and names(sort=("alt_signal_score", True)) == ["b", "c", "A"] and names(sort=("alt_signal_score", False)) == ["c", "b", "A"]
    assert names(ranges={"score_min": 5}) == ["c", "b"] and names(preset="bearish") == ["b"] and names(preset="divergent") == ["c"] and names(hype=True) == ["c", "b"]
    assert names(sort=("sector", True)) == ["A", "b", "c"] and names(sort=("hype_risk", False)) == ["b", "c", "A"] and names(text="ZE") == ["c"] and names(number=1, size=2) == ["b"]


def test_document_pipeline_step_by_step(spark):
    at = lambda i: dt.datetime(2026, 1, 1, 0, i)
    rows = [
        (1, "s", "<b>Qualo</b> news", "Qualo is a good name, they say, and Metrova is poor", None, "c", "u", at(1), 3.0, 0.0),
        (2, "s", "<b>Qualo</b> news", "Qualo is a good name, they say, and Metrova is poor", None, "d", "u", at(2), 3.0, 0.0),
        (3, "s", "", "der die das und ist nicht ein Qualo eine der die das", None, "c", "v", at(3), 1.0, 0.0),
        (4, "s", None, None, None, "c", None, at(4), 0.0, 0.0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, source string, title string, body string, url string, community string, author_hash string, published_at timestamp, score double, comments double")
    classifier = classify.LexiconClassifier(classify.Lexicon(values={"good": 1.0, "poor": -1.0}))
    done = documents.processed(docs, [resolve.Entity("QLO", "Qualo"), resolve.Entity("MET", "Metrova")], resolve.ContextWords())
    got = {r.doc_id: r for r in done.collect()}
    assert {i: r.status for i, r in got.items()} == {1: "unique", 2: "duplicate_exact", 3: "unique", 4: "unique"} and got[3].lang == "other" and got[3].matches is None
    found = {(r.doc_id, r.entity): r for r in documents.mentions(done, classifier).collect()}
    assert set(found) == {(1, "QLO"), (1, "MET"), (2, "QLO"), (2, "MET")} and found[2, "QLO"].label is None
    assert found[1, "QLO"].polarity == 0.0 and found[1, "QLO"].relevance == pytest.approx(0.93) and not found[1, "MET"].ambiguous


def test_lab_run_needs_enough_dates(spark):
    signals = spark.createDataFrame([(f"n{i}", dt.date(2026, 1, 1), 1.0, 50.0) for i in range(30)], "entity string, date date, attention_score double, confidence double")
    labels = signals.select("entity", "date", F.lit(5).alias("horizon"), F.lit(0.1).alias("ret"))
    universe = signals.select("entity", F.lit("s").alias("sector"), F.lit(1).alias("rank"))
    p = C.LabParams(features=("attention_score",), start="2026-01-01")
    features = Q.feats(spark, "/root/testdata/sf0.001").limit(0)
    with pytest.raises(lab_run.NotEnough):
        lab_run.run(features, signals, labels, universe, p)


def test_lab_run_tables(spark, tmp_path):
    d = "/root/testdata/sf0.01"
    p = C.LabParams(features=("attention_score", "confidence"), weights={"confidence": -1.0}, min_confidence=5.0)
    tables = lab_run.run(Q.feats(spark, d), Q.signals(spark, d), Q.returns(spark, d), Q.panel.universe(spark, d), p, Q.mood(spark, d))
    assert set(tables) == {"summary", "quintiles", "curve", "splits", "walk_forward", "baselines", "sectors", "months", "floors", "coverage", "integrity", "removals", "regimes"}
    assert lab_run.verdict(tables) in ("supported", "not supported", "inconclusive")
    q = tables["quintiles"].collect()
    assert [r.quintile for r in sorted(q)] == [1, 2, 3, 4, 5] and math.isclose(sum(r.n for r in q), tables["summary"].first().observations)
    lab_run.store({"quintiles": tables["quintiles"]}, str(tmp_path), "r1")
    assert spark.read.parquet(f"{tmp_path}/quintiles").where("run = 'r1'").count() == 5


def test_scenarios_without_dates_have_a_row(spark):
    rows = spark.createDataFrame([], "date date, entity string, sector string, signal double, ret double, eligible int")
    assert [(r.name, r.dates, r.mean_rank_ic) for r in lab.scenarios({"none": rows}, 5).collect()] == [("none", 0, None)]
