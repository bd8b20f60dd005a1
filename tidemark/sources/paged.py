"""Paged sources as Spark data sources: search pages by number, listings by cursor, back to the start.

A source is asked for an entity and a window of days, page after page. Spark plans a partition for each entity
and window, so that windows are read side by side, repeated alone after a failure, and left out by filters; what
fetches a page is given, so that recorded responses and live ones are read alike. Rows are whole pages; the
parsers of ``providers`` make documents of them.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

PAGES = "entity string, since date, until date, page int, json string"
DAY = datetime.timedelta(1)


class Fetcher(Protocol):
    """Called in tasks, so it must be picklable. Days are from ``since`` up to, not with, ``until``."""

    def page(self, entity: str, since: datetime.date, until: datetime.date, cursor: str | None) -> str | None: ...

    def latest(self) -> datetime.date: ...


Follow = Callable[[dict, int, datetime.date], str | None]


def by_number(response: dict, page: int, since: datetime.date) -> str | None:
    """The next page of a search, while there are more."""
    return str(page + 1) if page + 1 < int(response.get("nbPages") or 0) else None


def by_cursor(response: dict, page: int, since: datetime.date) -> str | None:
    """The next page of a listing, newest first, until an item is older than the window."""
    data = response.get("data") or {}
    start = datetime.datetime.combine(since, datetime.time(), datetime.UTC).timestamp()
    older = any((c.get("data") or {}).get("created_utc", start) < start for c in data.get("children") or [])
    return None if older else data.get("after") or None


@dataclass
class Window(InputPartition):
    entity: str
    since: datetime.date
    until: datetime.date

    def __post_init__(self) -> None:
        super().__init__((self.entity, self.since, self.until))


def _pages(fetcher: Fetcher, follow: Follow, w: Window) -> Iterator[tuple]:
    cursor, page, met = None, 0, set()
    while cursor not in met:  # a source that repeats a cursor would go round for ever
        met.add(cursor)
        text = fetcher.page(w.entity, w.since, w.until, cursor)
        if text is None:
            return
        yield w.entity, w.since, w.until, page, text
        cursor = follow(json.loads(text), page, w.since)
        if cursor is None:
            return
        page += 1


class _Asked:
    """Entities and windows of a request: options entities (a JSON list), start and end (days, both included), step (days a window)."""

    def __init__(self, options: dict[str, str]):
        self.entities = [str(e) for e in json.loads(options.get("entities", "[]"))]
        self.start, self.end = (datetime.date.fromisoformat(options[k]) for k in ("start", "end"))
        self.step = int(options.get("step", "1"))
        if self.step < 1:
            raise ValueError("step must be a day or more")

    def windows(self, start: datetime.date, end: datetime.date) -> Iterator[Window]:
        since = start
        while since <= end:
            until = min(since + self.step * DAY, end + DAY)
            yield from (Window(e, since, until) for e in self.entities)
            since = until


_COMPARED = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], fetcher: Fetcher, follow: Follow):
        self.asked, self.fetcher, self.follow, self.filters = _Asked(options), fetcher, follow, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Comparisons of entity, since and until choose the windows; all others are left to Spark."""
        for f in filters:
            if type(f) in _COMPARED and f.attribute in (("entity",), ("since",), ("until",)):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Window]:
        return [w for w in self.asked.windows(self.asked.start, self.asked.end) if all(_COMPARED[type(f)](getattr(w, f.attribute[0]), f.value) for f in self.filters)]

    def read(self, partition: Window) -> Iterator[tuple]:
        return _pages(self.fetcher, self.follow, partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets are days: a batch asks for the whole days since the last one, up to the source's latest."""

    def __init__(self, options: dict[str, str], fetcher: Fetcher, follow: Follow):
        self.asked, self.fetcher, self.follow = _Asked(options), fetcher, follow

    def initialOffset(self) -> dict:  # noqa: N802
        return {"day": self.asked.start.isoformat()}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"day": (max(min(self.fetcher.latest(), self.asked.end) + DAY, self.asked.start)).isoformat()}

    def partitions(self, start: dict, end: dict) -> list[Window]:
        first, last = (datetime.date.fromisoformat(x["day"]) for x in (start, end))
        return list(self.asked.windows(first, last - DAY))

    def read(self, partition: Window) -> Iterator[tuple]:
        return _pages(self.fetcher, self.follow, partition)


def paged(source: str, fetcher: Fetcher, follow: Follow) -> type[DataSource]:
    """A data source to register, under the name ``source``."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return source

        def schema(self) -> str:
            return PAGES

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return _Reader(dict(self.options), fetcher, follow)

        def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:  # noqa: N802
            return _StreamReader(dict(self.options), fetcher, follow)

    return Paged


@dataclass(frozen=True)
class Recorded:
    """Recorded search pages: a Parquet table of (page, json) partitioned by entity and day, on any file system that Arrow opens."""

    path: str
    last: datetime.date

    def page(self, entity: str, since: datetime.date, until: datetime.date, cursor: str | None) -> str | None:
        import pyarrow.fs as fs
        import pyarrow.parquet as pq

        store, base = fs.FileSystem.from_uri(self.path)
        folder = f"{base}/entity={entity}/day={since.isoformat()}"
        if until - since != DAY or store.get_file_info(folder).type == fs.FileType.NotFound:
            return None
        wanted = int(cursor or 0)
        for f in store.get_file_info(fs.FileSelector(folder)):
            if f.base_name.endswith(".parquet"):
                found = pq.read_table(store.open_input_file(f.path), filters=[("page", "=", wanted)], columns=["json"])
                if found.num_rows:
                    return found.column("json")[0].as_py()
        return None

    def latest(self) -> datetime.date:
        return self.last


def read_pages(spark: SparkSession, source: type[DataSource], entities: list[str], start: datetime.date, end: datetime.date, step: int = 1) -> DataFrame:
    """Pages of the windows between two days, both included; filters on entity, since and until leave out windows before they are asked for."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(entities=json.dumps(entities), start=start.isoformat(), end=end.isoformat(), step=str(step)).load()


UNIVERSE = "asOf date, source string, companies array<struct<rank:int,ticker:string,name:string,sector:string,marketCapUsd:double,previousIdentifiers:array<struct<ticker:string,until:date>>>>"


def universe_file(spark: SparkSession, path: str) -> DataFrame:
    """The latest dated snapshot among the JSON files at ``path``: as_of, rank, ticker, name, sector, market_cap_usd, previous_tickers.

    A snapshot without a date, a company without ticker, name or a positive rank, and a rank or ticker that
    occurs twice are errors; all are named at once.
    """
    files = spark.read.schema(UNIVERSE).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    if files.where("asOf is null or companies is null").count():
        raise ValueError("a universe file has no date or no companies")
    latest = files.agg(F.max("asOf").alias("asOf"))
    rows = files.join(latest, "asOf").select("asOf", F.explode("companies").alias("c")).select(F.col("asOf").alias("as_of"), "c.*")
    bad = rows.where("rank is null or rank < 1 or coalesce(trim(ticker), '') = '' or coalesce(trim(name), '') = '' or marketCapUsd <= 0").count()
    twice = {c: [r[0] for r in rows.groupBy(c).count().where("count > 1").orderBy(c).limit(5).collect()] for c in ("rank", "ticker")}
    if bad or any(twice.values()):
        raise ValueError(f"universe: {bad} companies are incomplete; more than one company has " + ", ".join(f"{c} {v}" for c, v in twice.items() if v))
    previous = F.filter(F.transform(F.coalesce("previousIdentifiers", F.array()), lambda p: p["ticker"]), lambda t: t != F.col("ticker"))
    return rows.select("as_of", "rank", "ticker", "name", "sector", F.col("marketCapUsd").alias("market_cap_usd"), previous.alias("previous_tickers"))
