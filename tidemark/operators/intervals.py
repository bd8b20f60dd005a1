"""Spans of days as intervals (S19, U2): coverage, outages and what is left of one without the other.

A span is a row of keys with ``start`` and ``end``, both inclusive. Days are never exploded and spans never
joined: the ends of all spans of a key are summed by day, which shrinks a key to its different days before
anything is shuffled, and one pass over those days in order counts the spans open on each side.

Spans with a null end or a start after their end are empty and take no part; null keys are keys like any
other; spans may overlap, repeat and touch. What comes out is merged: spans of a key neither overlap nor
touch. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ends(spans: DataFrame, keys: list[str], side: str) -> DataFrame:
    """(keys, day, left, right): by how much the number of open spans of a side changes on a day."""
    x = spans.where(F.col("start") <= F.col("end"))
    ends = F.array(F.struct(F.col("start").alias("day"), F.lit(1).alias("by")), F.struct(F.date_add("end", 1).alias("day"), F.lit(-1).alias("by")))
    x = x.select(*keys, F.explode(ends).alias("e"))
    return x.select(*keys, "e.day", *[(F.col("e.by") if side == s else F.lit(0)).alias(s) for s in ("left", "right")])


def _swept(left: DataFrame, right: DataFrame | None, keys: list[str], holds: Callable[[Column, Column], Column]) -> DataFrame:
    ends = _ends(left, keys, "left")
    if right is not None:
        ends = ends.unionByName(_ends(right, keys, "right"))
    days = ends.groupBy(*keys, "day").agg(F.sum("left").alias("left"), F.sum("right").alias("right"))
    by_key = Window.partitionBy(*keys).orderBy("day")
    until = by_key.rowsBetween(Window.unboundedPreceding, 0)
    x = days.withColumns({"on": holds(F.sum("left").over(until) > 0, F.sum("right").over(until) > 0)})
    x = x.withColumn("was", F.lag("on", 1, False).over(by_key)).where(F.col("on") != F.col("was"))
    # what is left are days on which a span begins or has just ended, in turn
    x = x.withColumn("next", F.lead("day").over(by_key)).where("on")
    return x.select(*keys, F.col("day").alias("start"), F.date_sub("next", 1).alias("end"))


def merged(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end): the days of any span, as few spans as can be."""
    return _swept(spans, None, keys, lambda left, right: left)


def subtracted(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end): the days of a left span that no right span of the key has."""
    return _swept(left, right, keys, lambda left, right: left & ~right)


def common(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end): the days that both sides have."""
    return _swept(left, right, keys, lambda left, right: left & right)


def of_days(rows: DataFrame, keys: list[str], day: str = "date") -> DataFrame:
    """(keys, start, end): runs of consecutive days on which there are rows."""
    return merged(rows.select(*keys, F.col(day).alias("start"), F.col(day).alias("end")), keys)


def n_days() -> Column:
    """Days of a span."""
    return F.date_diff("end", "start") + 1


def collectable(requested: DataFrame, outages: DataFrame, keys: list[str], latest: Column) -> DataFrame:
    """Requested spans up to the latest day, without the recorded outages."""
    return subtracted(requested.withColumn("end", F.least("end", latest)), outages, keys)
