"""Runs: totals against counts of what was written, failures, look-ups and models."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.config import LabParams
from tidemark.plans import lab_run
from tidemark.plans.ledger import ERRORS, Ledger, by_source


@pytest.fixture()
def ledger(spark, tmp_path):
    return Ledger(spark, f"file://{tmp_path}/runs")


def test_totals_are_counts_of_what_was_written(spark, ledger, tmp_path):
    rows = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("source"), (F.col("id") % 7).alias("x")).repartition(5)
    totals = by_source(["a", "b"], {"rows": F.lit(True), "large": F.col("x") > 3}) | {"all": F.count("*"), "sum": F.sum("x"), "none": F.sum(F.lit(None).cast("long"))}
    with ledger.run("ingest", {"first": "2026-01-01"}, {"classifier": "lexicon@1"}) as run:
        run.write(rows, f"{tmp_path}/out", totals, by=["source"])
        run.write(rows.where("x = 99"), f"{tmp_path}/empty", {"all": F.count("*"), "empty": F.count("*")})
        run.write(rows.limit(3), f"{tmp_path}/more", {"all": F.count("*")})
    back = spark.read.parquet(f"{tmp_path}/out")
    got = ledger.find(run.id).totals
    for s in "ab":
        assert got[f"{s}.rows"] == back.where(F.col("source") == s).count() and got[f"{s}.large"] == back.where((F.col("source") == s) & (F.col("x") > 3)).count()
    assert got["all"] == back.count() + 3 == 1003 and got["empty"] == got["none"] == 0 and got["sum"] == back.agg(F.sum("x")).first()[0]
    assert {(r.name, r.value) for r in ledger.totals().collect()} == set(got.items())


def test_totals_of_a_plan_with_shuffles(spark, ledger, tmp_path):
    rows = spark.range(5000).select((F.col("id") % 50).alias("k")).groupBy("k").count()
    with ledger.run("grouped") as run:
        run.write(rows, f"{tmp_path}/out", {"groups": F.count("*"), "rows": F.sum("count")})
    assert ledger.find(run.id).totals == {"groups": 50, "rows": 5000}


def test_a_failed_run_is_recorded_and_its_error_goes_on(spark, ledger, tmp_path):
    with pytest.raises(ValueError, match="no such day"), ledger.run("ingest") as run:
        run.write(spark.range(4), f"{tmp_path}/out", {"rows": F.count("*")})
        for i in range(ERRORS + 5):
            run.error(f"page {i}")
        raise ValueError("no such day")
    (r,) = ledger.runs().collect()
    assert (r.status, r.totals) == ("failed", {"rows": 4, "errors": ERRORS + 6}) and r.finished_at >= r.started_at and len(r.errors) == ERRORS
    assert ledger.as_of(F.current_timestamp()).count() == 0 and ledger.meta().count() == 0


def test_a_run_whose_write_fails(spark, ledger, tmp_path):
    bad = spark.range(10).select(F.raise_error(F.lit("broken row")).alias("x"))
    with pytest.raises(Exception, match="broken row"), ledger.run("ingest") as run:
        run.write(bad, f"{tmp_path}/out", {"rows": F.count("*")})
    assert ledger.find(run.id).status == "failed" and "rows" not in ledger.find(run.id).totals


def test_a_run_under_way_and_an_id_used_twice(ledger):
    with ledger.run("ingest", run_id="r1"):
        assert ledger.find("r1").status == "running" and ledger.runs().first().status == "running"
    with pytest.raises(ValueError, match="already"), ledger.run("ingest", run_id="r1"):
        pass
    assert ledger.runs().count() == 1 and ledger.find("r1").status == "succeeded" and ledger.find("r2") is None


def test_as_of_meta_and_models(ledger):
    times = []
    for i, (job, failed) in enumerate([("a", False), ("b", False), ("a", False), ("a", True)]):
        try:
            with ledger.run(job, models={"composite": f"weights@{i // 2}"}) as run:
                run.meta |= {"last": str(i), f"of_{job}": str(i)}
                if failed:
                    raise RuntimeError
        except RuntimeError:
            pass
        times.append(ledger.find(run.id).finished_at)
    at = lambda t: {r.job: r.meta["last"] for r in ledger.as_of(F.lit(t)).collect()}
    assert at(times[0] - dt.timedelta(microseconds=1)) == {} and at(times[0]) == {"a": "0"} and at(times[1]) == {"a": "0", "b": "1"}
    assert at(times[3]) == {"a": "2", "b": "1"}
    assert {r.key: r.value for r in ledger.meta().collect()} == {"last": "2", "of_a": "2", "of_b": "1"}
    assert {(r.kind, r.version, r.runs) for r in ledger.models().collect()} == {("composite", "weights@0", 2), ("composite", "weights@1", 2)}


def test_no_runs(ledger):
    assert ledger.runs().count() == ledger.totals().count() == ledger.meta().count() == ledger.models().count() == 0 and ledger.find("x") is None


def test_a_stored_lab_run_is_found_with_its_parameters(spark, ledger, tmp_path):
    p = LabParams(features=("alt_signal_score", "divergence"), weights={"divergence": -1.5}, exclude_sources=("github",), horizon=10, start="2026-01-05", top_rank=50, sectors=("ASIA",), min_confidence=25.0)
    tables = {"summary": spark.createDataFrame([(1, 0.5)], "dates int, t double"), "curve": spark.createDataFrame([], "date date, spread double")}
    one = lab_run.keep(ledger, tables, p, f"{tmp_path}/lab")
    two = lab_run.keep(ledger, {"summary": spark.createDataFrame([(2, 0.1)], "dates int, t double")}, LabParams(), f"{tmp_path}/lab")
    run, got, back = lab_run.look_up(ledger, f"{tmp_path}/lab", one)
    assert got == p and run.status == "succeeded" and json.loads(run.params)["horizon"] == 10 and set(back) == {"summary", "curve"}
    assert [tuple(r) for r in back["summary"].collect()] == [(1, 0.5)] and back["curve"].columns == ["date", "spread"] and back["curve"].count() == 0
    assert lab_run.look_up(ledger, f"{tmp_path}/lab", two)[1] == LabParams() and lab_run.look_up(ledger, f"{tmp_path}/lab", "other") is None
    assert spark.read.parquet(f"{tmp_path}/lab/summary").groupBy("run").count().count() == 2
