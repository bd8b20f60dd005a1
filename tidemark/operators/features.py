"""Rolling features of an (entity, source) series: point in time, missing days apart from zero days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions.stats import clip, mad, median

SERIES = ["entity", "source"]


def on_spine(metrics: DataFrame, days: DataFrame, entities: DataFrame) -> DataFrame:
    """A row for each entity, source and day of ``days``; ``observed`` tells those that ``metrics`` has."""
    grid = entities.select("entity").crossJoin(metrics.select("source").distinct()).crossJoin(days)
    return grid.join(metrics.withColumn("observed", F.lit(True)), [*SERIES, "date"], "left").withColumn("observed", F.coalesce("observed", F.lit(False)))


def level(source: Column) -> Column:
    """Log of engagement-adjusted mentions for text, of the value otherwise."""
    return F.log1p(F.when(source.isin(*C.TEXT_SOURCES), F.coalesce("engagement_adj", "value")).otherwise(F.col("value")))


def source_features(spine: DataFrame) -> DataFrame:
    """All windows share one partitioning and order, so the series are shuffled and sorted once."""
    order = Window.partitionBy(*SERIES).orderBy("date")
    w = lambda a, b: order.rowsBetween(-a, -b)
    week, before = w(6, 0), w(13, 7)
    x = spine.withColumn("level", F.when(F.col("observed"), level(F.col("source"))))
    x = x.withColumn("m7", F.when(F.count("level").over(week) >= C.MIN_SHORT, F.avg("level").over(week)))
    base = w(C.SHORT_WINDOW + C.BASELINE_WINDOW - 1, C.SHORT_WINDOW)
    last = F.max(F.when(F.col("observed"), F.col("date"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumns(
        {
            "baseline": F.collect_list("m7").over(base),
            "base_sd": F.stddev_samp("m7").over(base),
            "day_sd": F.stddev_samp("level").over(base),
            "recent": F.avg("level").over(w(2, 0)),
            "n_recent": F.count("level").over(w(2, 0)),
            "prior": F.avg("level").over(w(9, 3)),
            "n_prior": F.count("level").over(w(9, 3)),
            "last_observed_date": last,
            "obs_short": F.count("level").over(week),
            "activity7": F.avg("value").over(week),
        }
    )
    x = x.withColumn("freshness_days", F.datediff("date", "last_observed_date")).withColumn("obs_baseline", F.size("baseline"))
    enough = F.col("m7").isNotNull() & (F.col("obs_baseline") >= C.MIN_BASELINE)
    x = x.withColumn("center", median(F.col("baseline")))
    scale = F.greatest(F.coalesce(mad(F.col("baseline"), F.col("center")), F.lit(0.0)), F.coalesce("base_sd", F.lit(0.0)), F.lit(C.SCALE_FLOOR))
    day_scale = F.greatest(F.coalesce("day_sd", F.lit(0.0)), F.lit(C.SCALE_FLOOR)) / F.sqrt(F.lit(2.0))
    x = x.withColumn("abnormal_z", F.when(enough, clip((F.col("m7") - F.col("center")) / scale, -C.Z_CLIP, C.Z_CLIP)))
    x = x.withColumn("accel_z", F.when(enough & (F.col("n_recent") >= 2) & (F.col("n_prior") >= 4), clip((F.col("recent") - F.col("prior")) / day_scale, -C.Z_CLIP, C.Z_CLIP)))
    x = x.withColumn("available", enough & F.coalesce(F.col("freshness_days") <= C.FRESH_LIMIT, F.lit(False)))

    text = F.col("source").isin(*C.TEXT_SOURCES) & (F.col("obs_short") > 0)
    weight = F.coalesce("sentiment_weight", F.lit(0.0))

    def shrunk(c: str, frame, k: float) -> Column:
        on = F.col(c).isNotNull() & (weight > 0)
        total = F.sum(F.when(on, weight)).over(frame)
        return F.when(total > 0, F.sum(F.when(on, F.col(c) * weight)).over(frame) / (total + k))

    def by_mentions(value: Column) -> Column:
        n = F.when(value.isNotNull(), F.col("mention_count"))
        return F.try_divide(F.sum(value * n).over(week), F.nullif(F.sum(n).over(week).cast("double"), F.lit(0.0)))

    mentions, mentions_before = F.coalesce(F.sum("mention_count").over(week), F.lit(0)), F.coalesce(F.sum("mention_count").over(before), F.lit(0))
    said = text & (mentions >= C.MIN_MENTIONS)
    x = x.withColumns(
        {
            "mentions7": F.when(text, mentions),
            "authors7": F.when(text, F.coalesce(F.sum("unique_authors").over(week), F.lit(0))),
            "engagement7": F.when(text, F.coalesce(F.sum("engagement_adj").over(week), F.lit(0.0))),
            "sentiment7": F.when(said, shrunk("net_sentiment", week, C.SENTIMENT_K)),
            "sentiment_prev7": F.when(text & (mentions_before >= C.MIN_MENTIONS), shrunk("net_sentiment", before, C.SENTIMENT_K)),
            "pos_share7": F.when(said, shrunk("pos_share", week, 0.0)),
            "neg_share7": F.when(said, shrunk("neg_share", week, 0.0)),
            "sentiment_confidence7": F.when(said, shrunk("sentiment_confidence", week, 0.0)),
            **{f"{a}7": F.when(said, shrunk(f"{a}_sentiment", week, C.ASPECT_K)) for a in ("investment", "product", "reputation")},
            **{f"{c}7": F.when(text, by_mentions(F.col(f"{c}_ratio"))) for c in ("dup", "bot", "ambiguity")},
            "breadth7": F.when(text, by_mentions(F.try_divide(F.lit(1.0), F.when(F.col("community_hhi") > 0, F.col("community_hhi"))))),
        }
    )
    x = x.withColumn("sentiment_change", F.col("sentiment7") - F.col("sentiment_prev7"))
    own = "obs_short obs_baseline last_observed_date freshness_days activity7 abnormal_z accel_z available mentions7 authors7 engagement7 sentiment7 sentiment_prev7 sentiment_change pos_share7 neg_share7 sentiment_confidence7 investment7 product7 reputation7 dup7 bot7 ambiguity7 breadth7"
    return x.select(*SERIES, "date", "observed", "mention_count", "value", *own.split())
