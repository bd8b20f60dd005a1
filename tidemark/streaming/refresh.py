"""Refresh of late items that recomputes only what they change.

Items, daily metrics and features are tables with a partition for each day. A batch of items replaces those with
its keys; the days it touches are dirty in the metrics, and in the features each dirty day reaches as far ahead
as the windows look back. Only dirty days are computed, from the days that their windows see and the state of
the day before those, and only their partitions are swapped.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark import config as C
from tidemark.operators import features, metrics
from tidemark.sources import sinks
from tidemark.sources.files import Folder
from tidemark.sources.shared import cut

#: Days that a feature looks back: the oldest day of the baseline, and the short window of that day.
REACH = C.SHORT_WINDOW + C.BASELINE_WINDOW - 1 + C.SHORT_WINDOW - 1
DAY = datetime.timedelta(1)


def runs(days: list[datetime.date], first: datetime.date, last: datetime.date, reach: int = REACH) -> list[tuple[datetime.date, datetime.date]]:
    """The days from ``first`` to ``last`` that changes on ``days`` reach, as ranges; those that see each other's input are one."""
    out: list[tuple[datetime.date, datetime.date]] = []
    for day in sorted(days):
        a, b = max(day, first), min(day + reach * DAY, last)
        if a > b:
            continue
        if out and a <= out[-1][1] + (reach + 1) * DAY:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@dataclass(frozen=True)
class Store:
    """Tables of a panel under ``path``: items, metrics and features of the days from ``first`` to ``last``."""

    path: str
    first: datetime.date
    last: datetime.date
    sources: tuple[str, ...] = C.SOURCES

    def days(self, spark: SparkSession, name: str) -> set[datetime.date]:
        """The days that a table has partitions of."""
        return {datetime.date.fromisoformat(n[5:]) for n, _ in Folder(spark, f"{self.path}/{name}").names() if n.startswith("date=")}

    def table(self, spark: SparkSession, name: str, schema=None) -> DataFrame | None:
        if not self.days(spark, name):
            return None
        return spark.read.parquet(f"{self.path}/{name}") if schema is None else spark.read.schema(schema).parquet(f"{self.path}/{name}").select(*schema.names)

    def swap(self, rows: DataFrame, name: str) -> None:
        """Replace the partitions of the days that ``rows`` has, all at the end, so that ``rows`` may be made from what they replace."""
        sinks.replace_partitions(rows, f"{self.path}/{name}", ["date"])


def _on(days: list[datetime.date]):
    return F.col("date").isin(days)


def _between(a: datetime.date, b: datetime.date):
    return (F.col("date") >= F.lit(a)) & (F.col("date") <= F.lit(b))


def _features(daily: DataFrame, before: DataFrame | None, entities: DataFrame, store: Store, a: datetime.date, b: datetime.date) -> DataFrame:
    """Features of the days from ``a`` to ``b``. ``daily`` has the metrics of these and of the days their windows see, ``before`` the features of the day before those."""
    spark = daily.sparkSession
    start = max(a - REACH * DAY, store.first)
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(b))).alias("date"))
    grid = entities.select("entity").crossJoin(spark.createDataFrame([(s,) for s in store.sources], "source string")).crossJoin(days)
    spine = grid.join(daily.withColumn("observed", F.lit(True)), [*features.SERIES, "date"], "left").withColumn("observed", F.coalesce("observed", F.lit(False)))
    made = features.source_features(spine).where(_between(a, b))
    if before is None:
        return made
    seen = before.select(*features.SERIES, F.col("last_observed_date").alias("seen_before"))
    made = made.join(seen, features.SERIES, "left").withColumn("last_observed_date", F.coalesce("last_observed_date", "seen_before"))
    return made.withColumn("freshness_days", F.datediff("date", "last_observed_date")).drop("seen_before")


def full(items: DataFrame, entities: DataFrame, store: Store) -> DataFrame:
    """Features of all days, computed at once from all items."""
    daily = metrics.daily_source_metrics(items, entities, items.select("source", "date").distinct())
    return _features(daily, None, entities, store, store.first, store.last)


def apply(batch: DataFrame, entities: DataFrame, store: Store) -> list[tuple[datetime.date, datetime.date]]:
    """Take a batch of items into the store; the ranges of days whose features were computed anew.

    ``batch`` has the columns of items; a row replaces that of its doc_id and day, of rows with one doc_id and
    day the largest stays; items out of the store's days are ignored. A batch that is repeated changes nothing.
    """
    spark = batch.sparkSession
    batch = batch.where(_between(store.first, store.last))
    batch = spark.read.schema(batch.schema).parquet(cut(batch, "batch"))
    touched = [r[0] for r in batch.select("date").distinct().collect()]
    if not touched:
        return []
    old = store.table(spark, "items", batch.schema)
    merged = sinks.merged(batch.limit(0) if old is None else old.where(_on(touched)), batch, ["doc_id", "date"]).select(*batch.columns)
    store.swap(merged, "items")
    items = store.table(spark, "items", batch.schema).where(_on(touched))
    daily = metrics.daily_source_metrics(items, entities, items.select("source", "date").distinct())
    before = store.table(spark, "metrics", daily.schema)
    was = None if before is None else before.where(_on(touched)).select(*features.SERIES, "date")
    was = None if was is None else spark.read.schema(was.schema).parquet(cut(was, "observed-before"))
    store.swap(daily, "metrics")
    new = store.table(spark, "metrics", daily.schema).where(_on(touched))
    # a day newly observed also is the last observed one of later days, until the next: those with an older one are dirty too
    appeared = new.select(*features.SERIES, F.col("date").alias("day"))
    if was is not None:
        appeared = appeared.join(was.withColumnRenamed("date", "day"), [*features.SERIES, "day"], "left_anti")
    done = store.table(spark, "features", full(items, entities, store).schema)
    dirty = runs(touched, store.first, store.last)
    if done is None:
        dirty = [(store.first, store.last)]
    else:
        latest = appeared.groupBy(*features.SERIES).agg(F.sort_array(F.collect_set("day")).alias("days"))
        stale = done.where(F.col("date") > min(touched)).select(*features.SERIES, "date", "last_observed_date").join(latest, features.SERIES)
        newest = F.array_max(F.filter("days", lambda d: d <= F.col("date")))
        stale = stale.where(newest.isNotNull() & (F.col("last_observed_date").isNull() | (newest > F.col("last_observed_date"))))
        more = [r[0] for r in stale.select("date").distinct().collect()]
        missing = sorted({store.first + i * DAY for i in range((store.last - store.first).days + 1)} - store.days(spark, "features"))
        for day in [*more, *missing]:
            if not any(a <= day <= b for a, b in dirty):
                dirty.append((day, day))
        dirty = _joined(dirty)
    daily_all = store.table(spark, "metrics", daily.schema)
    made = []
    for a, b in dirty:
        start = max(a - REACH * DAY, store.first)
        seen = done.where(F.col("date") == F.lit(start - DAY)) if done is not None and start > store.first else None
        made.append(_features(daily_all.where(_between(start, b)), seen, entities, store, a, b))
    store.swap(reduce(DataFrame.unionByName, made), "features")
    return dirty


def _joined(found: list[tuple[datetime.date, datetime.date]]) -> list[tuple[datetime.date, datetime.date]]:
    """Ranges in order; those whose windows would read the state of a day that is dirty itself are one."""
    out: list[tuple[datetime.date, datetime.date]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1] + (REACH + 1) * DAY:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def follow(stream: DataFrame, entities: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """A stream of items into the store, batch by batch, until what is there is taken."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, _: apply(batch, entities, store) and None).start()
