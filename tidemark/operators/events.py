"""Anomaly events: first crossing of a threshold, then a refractory period by entity, source and kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config as C


def crossings(signals: DataFrame) -> DataFrame:
    """(entity, date, source, kind, z) of every event kind on the day its threshold is first crossed; yesterday's missing value counts as 0."""
    order = Window.partitionBy("entity").orderBy("date")
    yesterday = lambda c: F.when(F.date_add(F.lag("date").over(order), 1) == F.col("date"), F.lag(c).over(order))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    x = signals.withColumns(
        {
            "p_sources": yesterday("per_source"),
            "p_change": zero(yesterday("sentiment_change")),
            "p_hype": F.coalesce(yesterday("hype_risk"), F.lit("low")),
            "p_divergence": zero(yesterday("divergence")),
            "p_product": zero(yesterday("product_divergence")),
        }
    )

    def event(when: Column, source: str, kind: str, z: Column) -> Column:
        return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(source).alias("source"), F.lit(kind).alias("kind"), z.cast("double").alias("z")))

    found = []
    for s in C.SOURCES:
        own, before = F.col("per_source")[s], zero(F.col("p_sources")[s]["z"])
        on = own["available"] & own["z"].isNotNull()
        found += [event(on & (own["z"] >= C.EVENT_Z) & (before < C.EVENT_Z), s, "attention_spike", own["z"]), event(on & (own["z"] <= -C.EVENT_Z) & (before > -C.EVENT_Z), s, "attention_drop", own["z"])]
    change, product = F.col("sentiment_change"), F.col("product_divergence")
    found += [
        event((F.abs(change) >= C.EVENT_Z) & (F.abs("p_change") < C.EVENT_Z), "cross", "sentiment_shift", change),
        event((F.col("hype_risk") == "high") & (F.col("p_hype") != "high"), "reddit", "hype", zero(F.col("retail_crowding"))),
        event((F.col("divergence") >= C.DIVERGENCE_EVENT) & (F.col("p_divergence") < C.DIVERGENCE_EVENT), "cross", "divergence", F.col("divergence") / 25),
        event((product <= C.PRODUCT_EVENT) & (F.col("p_product") > C.PRODUCT_EVENT), "cross", "product_divergence", product / 0.1),
    ]
    return x.select("entity", "date", F.explode(F.array_compact(F.array(*found))).alias("e")).select("entity", "date", "e.*")


def refractory(events: DataFrame, days: int = C.REFRACTORY_DAYS, keys: tuple[str, ...] = ("entity", "source", "kind"), date: str = "date") -> DataFrame:
    """Keeps an event if none was kept within ``days`` days before it (a greedy rule, so one fold over each key's distinct dates).

    The dates of a key are bounded by the calendar, not by the number of events; repeated rows of a kept
    date stay once.
    """
    dates = events.groupBy(*keys).agg(F.array_sort(F.collect_set(date)).alias("dates"))
    kept = F.aggregate("dates", F.array().cast("array<date>"), lambda a, d: F.when((F.size(a) == 0) | (F.datediff(d, F.element_at(a, -1)) > days), F.array_append(a, d)).otherwise(a))
    chosen = dates.select(*keys, F.explode(kept).alias(date))
    return events.join(chosen, [*keys, date], "left_semi").dropDuplicates([*keys, date])
