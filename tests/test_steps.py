"""Stored steps follow their input files."""

import shutil

import pyarrow.parquet as pq
import pytest

from tidemark import queries as Q
from tidemark.plans import steps
from tidemark.sources import panel
from tidemark.sources.files import Folder, identity

D = "/root/testdata/sf0.001"
PANEL = "lineitem orders supplier nation region part customer".split()


@pytest.fixture
def tables(tmp_path):
    for t in PANEL:
        shutil.copy(f"{D}/{t}.parquet", tmp_path / f"{t}.parquet")
    return tmp_path


def total(spark, d):
    return Q.QUERIES["daily_event_counts"](spark, str(d)).agg({"n": "sum"}).first()[0] or 0


def test_a_replaced_table_is_seen_and_an_unchanged_one_is_reused(spark, tables, monkeypatch):
    first = total(spark, tables)
    lines = pq.read_table(f"{D}/lineitem.parquet")
    pq.write_table(lines.slice(0, lines.num_rows // 5), tables / "lineitem.parquet")
    fresh = panel.items(spark, str(tables)).count()
    assert total(spark, tables) == fresh < first
    monkeypatch.setattr(panel, "items", lambda *_: pytest.fail("made again"))  # nothing is held in this process: a later session finds the same
    assert total(spark, tables) == fresh
    monkeypatch.undo()
    shutil.copy(f"{D}/lineitem.parquet", tables / "lineitem.parquet")
    assert total(spark, tables) == first


def test_steps_on_the_way_see_one_state(spark, tables):
    calls = []

    @steps.stored("nation")
    def low(s, d):
        calls.append("low")
        shutil.copy(f"{D}/region.parquet", f"{d}/more.parquet")
        return s.read.parquet(f"{d}/nation.parquet")

    @steps.stored("nation")
    def high(s, d):
        calls.append("high")
        return low(s, d).groupBy("n_regionkey").count()

    assert high(spark, str(tables)).count() == 5 and high(spark, str(tables)).count() == 5 and low(spark, str(tables)).count() == 25
    assert calls == ["high", "low"]
    steps.forget(spark, str(tables))
    high(spark, str(tables))
    assert calls == ["high", "low"] * 2


def test_a_version_without_its_manifest_is_not_there_and_old_ones_go(spark, tables):
    @steps.stored("nation")
    def step(s, d):
        return s.range(3)

    home = steps._home(spark, str(tables), "step")
    spark.range(9).write.parquet(f"{home.path}/table-of-a-lost-driver")
    assert step(spark, str(tables)).count() == 3
    for i in range(3):
        pq.write_table(pq.read_table(f"{D}/nation.parquet").slice(0, 3 + i), tables / "nation.parquet")
        step(spark, str(tables))
    assert sum(n.endswith(".json") for n, _ in home.names()) == 4  # superseded a moment ago: readers may still be there
    assert steps.reap(home, keep=2, grace=0) == 2
    assert sum(n.endswith(".json") for n, _ in home.names()) == 2 and step(spark, str(tables)).count() == 3


def test_identity_is_of_path_length_and_time(spark, tables):
    paths = [f"{tables}/nation.parquet", f"{tables}/region.parquet"]
    first = identity(spark, paths)
    assert identity(spark, paths) == first
    shutil.copy(f"{D}/nation.parquet", tables / "nation2.parquet")
    assert identity(spark, [f"{tables}/nation2.parquet", paths[1]]) != first


def test_the_first_of_two_sessions_wins(spark, tmp_path):
    home = Folder(spark, f"file://{tmp_path}/x")
    assert home.names() == [] and home.read("a") is None
    assert home.put("a", "one", "a.tmp") and not home.put("a", "two", "a.tmp") and home.read("a") == "one"
