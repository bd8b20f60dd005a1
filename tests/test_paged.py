"""Paged data sources: windows, cursors, filters, offsets; and the universe file."""

import datetime as dt
import json
import sys
from dataclasses import dataclass

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidemark.sources import paged, providers

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this file
D0 = dt.date(2026, 3, 1)


def day(i):
    return D0 + dt.timedelta(i)


def stamp(i, hours=12):
    return dt.datetime(2026, 3, 1, tzinfo=dt.UTC).timestamp() + i * 86400 + hours * 3600


@dataclass(frozen=True)
class Search:
    """Three hits a day, two a page; says in a file what it was asked for."""

    log: str
    days: int = 8

    def page(self, entity, since, until, cursor):
        with open(self.log, "a") as f:
            f.write(json.dumps([entity, str(since), str(until), cursor]) + "\n")
        hits = [{"objectID": f"{entity}-{i}-{k}", "title": "t", "author": "a", "points": 1.0, "num_comments": 2.0, "created_at_i": int(stamp(i, k))} for i in range(self.days) if since <= day(i) < until for k in range(3)]
        n = int(cursor or 0)
        return json.dumps({"hits": hits[2 * n : 2 * n + 2], "page": n, "nbPages": -(-len(hits) // 2)})

    def latest(self):
        return day(self.days - 1)


@dataclass(frozen=True)
class Listing:
    """One post a day, newest first, two a page."""

    log: str

    def page(self, entity, since, until, cursor):
        with open(self.log, "a") as f:
            f.write(f"{entity} {cursor}\n")
        at = int(cursor or 9)
        posts = [{"data": {"id": f"{entity}{i}", "subreddit": entity, "author": "u", "title": "t", "selftext": None, "score": 1.0, "num_comments": 0.0, "created_utc": stamp(i), "over_18": i == 6}} for i in range(at, max(at - 2, -1), -1)]
        return json.dumps({"data": {"children": posts, "after": str(at - 2) if at >= 2 else None}})

    def latest(self):
        return day(9)


def asked(log):
    return [json.loads(x) for x in open(log)]


def test_windows_pages_and_pushed_filters(spark, tmp_path):
    log = str(tmp_path / "log")
    source = paged.paged("search_test", Search(log), paged.by_number)
    pages = paged.read_pages(spark, source, ["A", "B", "C"], day(0), day(7), step=2)
    raw = pages.where((F.col("since") >= F.lit(day(4))) & (F.col("entity").isin("A", "B")) & (F.col("page") >= 0))
    plan = raw._jdf.queryExecution().executedPlan().toString()
    left = plan.split("Filter (")[1].split("\n")[0]
    assert "page" in left and ">= 2026" not in left and "entity" not in left.replace("isnotnull(entity", "")  # what was pushed is not done again
    docs = providers.parse_search_hits(raw, "salt")
    assert sorted(r.external_id for r in docs.collect()) == sorted(f"{e}-{i}-{k}" for e in "AB" for i in range(4, 8) for k in range(3))
    calls = asked(log)
    assert {(e, s) for e, s, _, _ in calls} == {(e, str(day(i))) for e in "AB" for i in (4, 6)}  # other windows were never asked for
    assert {c for *_, c in calls} == {None, "1", "2"}
    same = spark.createDataFrame([(r.json,) for r in raw.collect()], "json string")
    assert sorted(map(str, providers.parse_search_hits(same, "salt").collect())) == sorted(map(str, docs.collect()))


def test_a_listing_stops_at_the_start(spark, tmp_path):
    log = str(tmp_path / "log")
    source = paged.paged("listing_test", Listing(log), paged.by_cursor)
    raw = paged.read_pages(spark, source, ["x"], day(5), day(8), step=30)
    got = providers.parse_listing(raw, F.lit(day(5)).cast("timestamp"), F.lit(day(9)).cast("timestamp"), "salt").collect()
    assert sorted(r.external_id for r in got) == ["x5", "x7", "x8"]  # 6 is for adults, 9 is later
    assert open(log).read().split("\n")[:-1] == ["x None", "x 7", "x 5"]  # the third page reaches what is older


def test_a_stream_asks_for_new_days_only(spark, tmp_path):
    log, got = str(tmp_path / "log"), []
    for days in (3, 3, 5):
        open(log, "w").close()
        spark.dataSource.register(paged.paged("search_stream", Search(log, days), paged.by_number))
        stream = spark.readStream.format("search_stream").options(entities='["A"]', start=str(day(0)), end=str(day(30))).load()
        run = stream.writeStream.format("json").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
        run.awaitTermination()
        got.append(sorted({s for _, s, _, _ in asked(log)}))
    assert got == [[str(day(i)) for i in range(3)], [], [str(day(i)) for i in (3, 4)]]
    raw = spark.read.schema(paged.PAGES).json(f"file://{tmp_path}/out")
    assert providers.parse_search_hits(raw, "salt").count() == 15


def test_a_repeated_cursor_and_a_missing_page_end_a_window():
    class Loop:
        def page(self, entity, since, until, cursor):
            return json.dumps({"data": {"children": [], "after": "same"}})

    w = paged.Window("x", day(0), day(1))
    assert len(list(paged._pages(Loop(), paged.by_cursor, w))) == 2
    assert list(paged._pages(type("None_", (), {"page": lambda *_: None})(), paged.by_number, w)) == []


def company(rank, ticker, **more):
    return {"rank": rank, "ticker": ticker, "name": f"{ticker} Inc", "sector": "S", "marketCapUsd": 10.0 - rank} | more


def test_universe_file(spark, tmp_path):
    for d, companies in (("2026-01-01", [company(1, "OLD")]), ("2026-06-30", [company(1, "AA", previousIdentifiers=[{"ticker": "A0", "until": "2020-01-01"}, {"ticker": "AA", "until": "2021-01-01"}]), company(2, "BB")])):
        (tmp_path / f"universe-{d}.json").write_text(json.dumps({"asOf": d, "source": "s", "companies": companies}, indent=1))
    rows = paged.universe_file(spark, f"file://{tmp_path}").orderBy("rank").collect()
    assert [(r.rank, r.ticker, r.previous_tickers) for r in rows] == [(1, "AA", ["A0"]), (2, "BB", [])] and rows[0].as_of == dt.date(2026, 6, 30)
    (tmp_path / "universe-2026-07-01.json").write_text(json.dumps({"asOf": "2026-07-01", "companies": [company(1, "AA"), company(1, "AA"), company(3, "")]}))
    with pytest.raises(ValueError, match=r"1 companies are incomplete.*rank \[1\].*ticker \['AA'\]"):
        paged.universe_file(spark, f"file://{tmp_path}")
