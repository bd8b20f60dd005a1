"""View queries over signals, universe, items and labels."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import ViewQuery
from tidemark.functions.stats import rounded


def rows(signals: DataFrame, universe: DataFrame, q: ViewQuery, date: Column | None = None) -> DataFrame:
    """The day's row of every name with its score's change over the window (F16, J9). The latest day by default."""
    chosen = universe if q.sector == "all" else universe.where(F.col("sector") == q.sector)
    day = signals.agg(F.max("date").alias("day")) if date is None else signals.select(date.alias("day")).limit(1)
    on = signals.join(F.broadcast(day), F.col("date").isin(F.col("day")) | (F.col("date") == F.date_sub("day", q.window)))
    past = on.where("date < day").select("entity", F.col("alt_signal_score").alias("past_score"))
    today = on.where("date = day").drop("day").where(F.coalesce("confidence", F.lit(0.0)) >= q.min_confidence)
    out = chosen.join(today, "entity", "left" if q.min_confidence == 0 else "inner")
    return out.join(past, "entity", "left").withColumn("score_change", rounded(F.col("alt_signal_score") - F.col("past_score"), 1))


def top(rows_: DataFrame, by: str, n: int = 6, ascending: bool = False) -> DataFrame:
    """Nulls excluded, ties by entity."""
    return rows_.where(F.col(by).isNotNull()).orderBy(F.asc(by) if ascending else F.desc(by), "entity").limit(n)


def ranked_table(rows_: DataFrame, n: int = 12) -> DataFrame:
    """T2."""
    return rows_.orderBy(F.coalesce("alt_signal_score", F.lit(-1.0)).desc(), "entity").limit(n)


def kpis(rows_: DataFrame) -> DataFrame:
    """A11."""
    scored = F.col("alt_signal_score").isNotNull()
    return rows_.agg(F.count("*").alias("names"), rounded(100 * F.try_divide(F.count_if(F.col("alt_signal_score") > 50).cast("double"), F.nullif(F.count_if(scored).cast("double"), F.lit(0.0)))).alias("breadth"), F.count_if(F.col("attention_score") >= 90).alias("unusual"), F.count_if(F.col("anomaly_score") >= 95).alias("anomalies"), rounded(F.avg("confidence")).alias("mean_confidence"))


def histogram(rows_: DataFrame, column: str = "alt_signal_score") -> DataFrame:
    """Twenty bins of width 5 over 0 to 100, the top edge in the last; empty bins are 0 (A10)."""
    counts = rows_.where(F.col(column).isNotNull()).groupBy(F.least(F.lit(19), F.floor(F.col(column) / 5)).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    bins = rows_.sparkSession.range(20).select(F.col("id").alias("bin"))
    return bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def mood_series(signals: DataFrame) -> DataFrame:
    """Confidence-weighted mood, quartiles of sentiment, mean attention over names with sentiment, by day."""
    w = F.greatest(F.lit(1.0), F.col("confidence"))
    return signals.where("sentiment_score is not null").groupBy("date").agg((F.sum(F.col("sentiment_score") * w) / F.sum(w)).alias("mood"), F.percentile("sentiment_score", F.lit(0.25)).alias("p25"), F.percentile("sentiment_score", F.lit(0.75)).alias("p75"), F.avg("attention_score").alias("attention"), F.count("*").alias("n"))


def sector_summary(rows_: DataFrame) -> DataFrame:
    """A8, A9."""
    return rows_.groupBy("sector").agg(F.count("*").alias("names"), F.avg("alt_signal_score").alias("score"), F.avg("sentiment_score").alias("sentiment"), F.avg("attention_score").alias("attention"), F.avg("score_change").alias("change"))


def sector_by_source(features: DataFrame, universe: DataFrame, sources: tuple[str, ...]) -> DataFrame:
    """Mean attention z by sector, a column for each source."""
    return features.join(universe.select("entity", "sector"), "entity").groupBy("sector").pivot("source", list(sources)).agg(rounded(F.avg("abnormal_z"), 6))


def narratives(items: DataFrame) -> DataFrame:
    """Counts of labels by aspect."""
    return items.groupBy("aspect").agg(F.count("*").alias("n"), *[F.count_if(F.col("label") == x).alias(x) for x in ("positive", "negative", "uncertain")])


def top_terms(rows_: DataFrame, group: str, terms: str, n: int = 6) -> DataFrame:
    """The most frequent terms of each group, ties by term."""
    counts = rows_.select(group, F.explode(terms).alias("term")).where("term <> ''").groupBy(group, "term").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "term"))
    return counts.withColumn("place", place).where(F.col("place") <= n)


def activity_pivot(metrics: DataFrame, entity: str, sources: tuple[str, ...]) -> DataFrame:
    """V3: one row a day, a column for each source."""
    return metrics.where(F.col("entity") == entity).groupBy("date").pivot("source", list(sources)).agg(F.sum("value"))


PRESETS = {
    "bullish": "alt_signal_score >= 55 and confidence >= 50",
    "bearish": "alt_signal_score <= 45 and confidence >= 50",
    "unusual": "coalesce(attention_score >= 90, false) or coalesce(anomaly_score >= 95, false)",
    "divergent": "divergence >= 60",
    "hype": "hype_risk <> 'low'",
}


def presets(rows_: DataFrame) -> DataFrame:
    """names that each preset keeps, in one pass."""
    return rows_.select("entity", F.explode(F.array_compact(F.array(*[F.when(F.expr(c), F.lit(k)) for k, c in PRESETS.items()]))).alias("preset"))


def search(universe: DataFrame, text: str, n: int = 8) -> DataFrame:
    """Exact, then prefix of the id, then prefix of the name, then anywhere."""
    t, e, s = text.lower(), F.lower("entity"), F.lower("sector")
    place = F.when(e == t, 0).when(e.startswith(t), 1).when(s.startswith(t), 2).when(e.contains(t) | s.contains(t), 3)
    return universe.withColumn("place", place).where("place is not null").orderBy("place", "entity").limit(n)


def page(rows_: DataFrame, by: str, number: int, size: int = 25, ascending: bool = False) -> DataFrame:
    """Nulls last either way."""
    order = F.asc_nulls_last(by) if ascending else F.desc_nulls_last(by)
    return rows_.orderBy(order, "entity").offset(number * size).limit(size)


def overall_state(states: DataFrame) -> DataFrame:
    """V13."""
    return states.agg(F.when(F.bool_and(F.col("state") == "live"), "live").when(F.bool_or(F.col("state").isin("unavailable", "stale")), "stale").otherwise("demo").alias("state"))


def source_status(covered: DataFrame, end: Column, lag: int = 2) -> DataFrame:
    """Latest covered day by source; stale if it is more than ``lag`` days before the end."""
    return covered.groupBy("source").agg(F.max("date").alias("latest"), F.count("*").alias("days")).withColumn("state", F.when(F.col("latest") < F.date_sub(end, lag), "stale").otherwise("live"))


def source_days(metrics: DataFrame, entity: str, first: Column, last: Column, disabled: tuple[str, ...] = ()) -> DataFrame:
    """An entity's daily metrics of some days by source, without sources turned off (V5)."""
    own = metrics.where((F.col("entity") == entity.upper()) & F.col("date").between(first, last))
    return own.where(~F.col("source").isin(*disabled)) if disabled else own


def unused_sources(features: DataFrame, expected: DataFrame, states: DataFrame) -> DataFrame:
    """(entity, source, state, expected, available) on the last day of the sources that say nothing of an entity: those
    unavailable, and those expected of it but not available (V14). A source without a state has a null one."""
    day = features.agg(F.max("date").alias("date"))
    last = features.join(day, "date", "left_semi").select("entity", "date", "source", F.coalesce("available", F.lit(False)).alias("available"))
    x = last.join(expected, ["entity", "date"], "left").join(states.select("source", "state"), "source", "left")
    x = x.withColumn("expected", F.coalesce(F.array_contains("expected", F.col("source")), F.lit(False)))
    return x.where(F.col("state").eqNullSafe("unavailable") | (F.col("expected") & ~F.col("available"))).select("entity", "source", "state", "expected", "available")


TICKER = r"^[A-Za-z.\-]{1,10}$"


def find_entity(universe: DataFrame, asked: str) -> DataFrame:
    """The row of a ticker in any case, or of the name that had it before (J16, F18); none for what is no ticker.

    ``universe`` may have an array column ``previous``.
    """
    own = F.upper("entity") == asked.upper()
    before = F.array_contains("previous", asked.upper()) if "previous" in universe.columns else F.lit(False)
    named = universe.where(own | before) if re.match(TICKER, asked) else universe.limit(0)
    return named.orderBy(own.desc(), "entity").limit(1)


def items_of(mentions: DataFrame, documents: DataFrame, sentiments: DataFrame, entity: str, first: Column, last: Column, n: int = 60, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """An entity's most engaged unique documents of some days, with what was said of it.

    mentions (doc_id, entity, date, relevance), documents (doc_id, status, score, ...), sentiments (doc_id,
    entity, label, aspect, ...). ``key``, which may be more columns than doc_id, tells documents apart in all
    three and orders those of one score. Only sentiments of the documents chosen are joined.
    """
    key = list(key)
    own = mentions.where((F.col("entity") == entity) & F.col("date").between(first, last))
    chosen = own.join(documents.where("status = 'unique'"), key).orderBy(F.desc("score"), *key).limit(n)
    said = sentiments.where(F.col("entity") == entity).drop("entity").join(chosen.select(*key), key, "left_semi")
    return chosen.join(said, key, "left")


def narratives_of(sentiments: DataFrame, mentions: DataFrame, entity: str, first: Column, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(aspect, items, positive, negative, neutral, sarcastic) of an entity's mentions since a day (J3, A13); uncertain is neutral.

    ``key`` tells documents apart in both tables.
    """
    rows = sentiments.where(F.col("entity") == entity).join(mentions.where(F.col("date") >= first).select(*key, "entity"), [*key, "entity"])
    of = lambda *labels: F.count_if(F.col("label").isin(*labels))
    return rows.groupBy("aspect").agg(F.count("*").alias("items"), of("positive").alias("positive"), of("negative").alias("negative"), of("neutral", "uncertain").alias("neutral"), of("sarcastic").alias("sarcastic"))


def score_and_return(signals: DataFrame, labels: DataFrame, entity: str, horizon: int = 5) -> DataFrame:
    """(date, score, ret in percent) of an entity where both are known."""
    later = labels.where((F.col("entity") == entity) & (F.col("horizon") == horizon)).select("date", rounded(F.col("ret") * 100, 2).alias("ret"))
    return signals.where((F.col("entity") == entity) & F.col("alt_signal_score").isNotNull()).select("date", F.col("alt_signal_score").alias("score")).join(later, "date")


def latest_events(events: DataFrame, universe: DataFrame, since: Column | None = None, entity: str | None = None, sector: str = "all", source: str = "all", n: int = 14) -> DataFrame:
    """The last events (F14, T3), by date descending, then entity, source and kind; a source's own and those across sources."""
    x = events if since is None else events.where(F.col("date") >= since)
    x = x if entity is None else x.where(F.col("entity") == entity)
    x = x if source == "all" else x.where(F.col("source").isin(source, "cross"))
    x = x if sector == "all" else x.join(universe.where(F.col("sector") == sector).select("entity"), "entity", "left_semi")
    return x.orderBy(F.desc("date"), "entity", "source", "kind").limit(n)


#: Ranges of the explorer: column and lower or upper bound. Sort orders of presets: column, ascending.
RANGES = {"score_min": "alt_signal_score >= {}", "score_max": "alt_signal_score <= {}", "attention_min": "attention_score >= {}", "sentiment_min": "sentiment_score >= {}", "sentiment_max": "sentiment_score <= {}"}
ORDERS = {"bearish": ("alt_signal_score", True), "unusual": ("attention_score", False), "divergent": ("divergence", False), "bullish": ("alt_signal_score", False)}
HYPE_ORDER = ("low", "elevated", "high")


def explorer(rows_: DataFrame, text: str = "", ranges: dict[str, float] | None = None, preset: str | None = None, hype: bool = False, sort: tuple[str, bool] | None = None, number: int = 0, size: int = 25) -> DataFrame:
    """A page of the table of names (V12): a missing value fails a range (F10); the preset's order by default.

    Missing values come last in either order; texts are compared regardless of case and accents, hype by
    its degree, lists by their length (T5).
    """
    x = rows_
    if text.strip():
        t = text.strip().lower()
        x = x.where(F.lower("entity").contains(t) | F.lower("sector").contains(t))
    for key, value in (ranges or {}).items():
        x = x.where(F.expr(RANGES[key].format(float(value))))
    if preset is not None:
        x = x.where(F.expr(PRESETS[preset]))
    if hype:
        x = x.where("hype_risk <> 'low'")
    by, ascending = sort or ORDERS.get(preset, ("rank", True))
    kind = dict(x.dtypes)[by]
    key = F.col(by)
    if by == "hype_risk":
        key = F.array_position(F.array(*map(F.lit, HYPE_ORDER)), F.col(by))
    elif kind == "string":
        key = F.collate(F.col(by), "UNICODE_CI_AI")
    elif kind.startswith("array"):
        key = F.size(by)
    return x.orderBy(key.asc_nulls_last() if ascending else key.desc_nulls_last(), "entity").offset(number * size).limit(size)


def source_coverage(signals: DataFrame, sources: tuple[str, ...]) -> DataFrame:
    """(source, names): names with the source available on the last day."""
    last = signals.join(signals.agg(F.max("date").alias("date")), "date", "left_semi")
    counted = last.agg(*[F.count_if(F.array_contains("sources_available", s)).alias(s) for s in sources])
    return counted.unpivot([], list(sources), "source", "names")


def overview(signals: DataFrame, universe: DataFrame, events: DataFrame, q: ViewQuery) -> dict[str, DataFrame]:
    """The parts of the overview (V1): kpis, mood, sectors, histogram, lists of names, events and the ranked table."""
    x = rows(signals, universe, q)
    start = F.date_sub(F.lit(signals.agg(F.max("date").alias("d")).first().d), q.window - 1)
    chosen = signals.where(F.col("date") >= start)
    if q.sector != "all":
        chosen = chosen.join(universe.where(F.col("sector") == q.sector).select("entity"), "entity", "left_semi")
    best = "alt_signal_score" if q.source == "all" else "sentiment_score"
    return {
        "kpis": kpis(x),
        "mood": mood_series(chosen),
        "sectors": sector_summary(x),
        "histogram": histogram(x),
        "bullish": top(x, best),
        "bearish": top(x, best, ascending=True),
        "rising": top(x, "attention_acceleration"),
        "unusual": top(x, "attention_score"),
        "disagreements": top(x, "divergence"),
        "events": latest_events(events, universe, start, None, q.sector, q.source),
        "ranked": ranked_table(x),
    }
