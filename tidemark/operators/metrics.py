"""Items to one row for each entity, source and day, with explicit zeros on covered days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions.stats import rounded

ASPECTS = ("investment", "product", "reputation")


def engagement_weight(relevance: Column, score: Column, comments: Column) -> Column:
    """Weight of a mention."""
    return relevance * (1 + F.log1p(F.greatest(score, F.lit(0.0))) / 2 + F.log1p(F.greatest(comments, F.lit(0.0))) / 4)


def polarity_weights(rows: DataFrame) -> DataFrame:
    """Adds w, sw (w times confidence), aw (sw times the aspect's weight) and polar, 0 if uncertain."""
    aspect = F.coalesce(*[F.when(F.col("aspect") == a, F.lit(w)) for a, w in C.ASPECT_WEIGHTS.items()])
    w = engagement_weight(F.col("relevance"), F.col("score"), F.col("comments"))
    rows = rows.withColumn("w", w).withColumn("sw", F.col("w") * F.col("confidence"))
    return rows.withColumn("aw", F.col("sw") * aspect).withColumn("polar", F.when(F.col("label") == "uncertain", 0.0).otherwise(F.col("polarity")))


def daily_text_metrics(items: DataFrame) -> DataFrame:
    """Observed entity-days of text sources. One aggregation by (entity, source, date, community) feeds both the sums and the concentration of communities."""
    rows = polarity_weights(items.where((F.col("relevance") >= C.MIN_RELEVANCE) & F.col("source").isin(*C.TEXT_SOURCES)))
    unique = F.col("status") == "unique"
    only = lambda c: F.when(unique, c)
    key = ["entity", "source", "date"]
    negative = (F.col("label") == "negative") | ((F.col("label") == "sarcastic") & (F.col("polarity") < 0))
    sums = {
        "docs": F.count_if(unique),
        "bot": F.count_if(F.col("status") == "bot_repeat"),
        "dup": F.count_if(~F.col("status").isin("unique", "bot_repeat")),
        "ambiguous": F.count_if(unique & F.col("ambiguous")),
        "engagement": F.sum(only(F.col("w"))),
        "weight": F.sum(only(F.col("aw"))),
        "net": F.sum(only(F.col("aw") * F.col("polar"))),
        "conf": F.sum(only(F.col("aw") * F.col("confidence"))),
        "pos": F.sum(only(F.when(F.col("label") == "positive", F.col("aw")))),
        "neg": F.sum(only(F.when(negative, F.col("aw")))),
    }
    for a in ASPECTS:
        sums |= {f"{a}_num": F.sum(only(F.when(F.col("aspect") == a, F.col("sw") * F.col("polar")))), f"{a}_den": F.sum(only(F.when(F.col("aspect") == a, F.col("sw"))))}
    by_community = rows.groupBy(*key, "community").agg(*[e.alias(k) for k, e in sums.items()])
    in_community = F.when(F.col("community").isNotNull() & (F.col("docs") > 0), F.col("docs"))
    totals = by_community.groupBy(*key).agg(
        *[F.sum(k).alias(k) for k in sums],
        F.count(in_community).alias("community_count"),
        F.try_divide(F.sum(in_community * in_community), F.pow(F.sum(in_community), F.lit(2.0))).alias("hhi"),
    )
    authors = rows.where(unique).groupBy(*key).agg(F.count_distinct("author").alias("unique_authors"))
    totals = totals.join(authors, key, "left")
    every = F.col("docs") + F.col("dup") + F.col("bot")
    share = lambda c: rounded(F.try_divide(F.coalesce(F.col(c), F.lit(0.0)), F.when(F.col("weight") > 0, F.col("weight"))), 4)
    return totals.select(
        *key,
        F.col("docs").cast("double").alias("value"),
        F.col("docs").alias("mention_count"),
        F.coalesce("unique_authors", F.lit(0)).cast("long").alias("unique_authors"),
        rounded(F.coalesce("engagement", F.lit(0.0)), 4).alias("engagement_adj"),
        rounded(F.coalesce("weight", F.lit(0.0)), 4).alias("sentiment_weight"),
        share("net").alias("net_sentiment"),
        share("pos").alias("pos_share"),
        share("neg").alias("neg_share"),
        share("conf").alias("sentiment_confidence"),
        *[F.try_divide(F.col(f"{a}_num"), F.when(F.col(f"{a}_den") > 0, F.col(f"{a}_den"))).alias(f"{a}_sentiment") for a in ASPECTS],
        rounded(F.coalesce(F.try_divide(F.col("dup").cast("double"), every.cast("double")), F.lit(0.0)), 4).alias("dup_ratio"),
        rounded(F.coalesce(F.try_divide(F.col("bot").cast("double"), every.cast("double")), F.lit(0.0)), 4).alias("bot_ratio"),
        rounded(F.coalesce(F.try_divide(F.col("ambiguous").cast("double"), F.col("docs").cast("double")), F.lit(0.0)), 4).alias("ambiguity_ratio"),
        F.col("community_count"),
        rounded(F.col("hhi"), 4).alias("community_hhi"),
    )


ZERO = ("value", "mention_count", "unique_authors", "engagement_adj", "sentiment_weight", "dup_ratio", "bot_ratio", "ambiguity_ratio", "community_count")


def with_zero_rows(metrics: DataFrame, entities: DataFrame, covered: DataFrame) -> DataFrame:
    """Every entity has a row on every covered day of a text source, zero if nothing was said; uncovered days have none."""
    grid = covered.where(F.col("source").isin(*C.TEXT_SOURCES)).crossJoin(entities.select("entity"))
    out = grid.join(metrics, ["entity", "source", "date"], "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(metrics.schema[c].dataType)) for c in ZERO}).select(*metrics.columns)


def numeric_metrics(items: DataFrame) -> DataFrame:
    """Observed entity-days of numeric sources, the sum of scores as value."""
    return items.where(~F.col("source").isin(*C.TEXT_SOURCES)).groupBy("entity", "source", "date").agg(F.sum("score").alias("value"))


def daily_source_metrics(items: DataFrame, entities: DataFrame, covered: DataFrame) -> DataFrame:
    """Text rows with zeros and numeric rows in one table."""
    text = with_zero_rows(daily_text_metrics(items), entities, covered)
    return text.unionByName(numeric_metrics(items), allowMissingColumns=True)
