"""Cross-source composite of an entity-day: blends, confidence, components, penalties, scores.

``wide`` brings the sources of an entity-day into one row, null where a source has none; everything else
is expressions over that row and two windows over the day.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions.stats import clip, norm_cdf, rounded, weighted_mean, z_cross

FIELDS = ("available", "abnormal_z", "accel_z", "freshness_days", "mentions7", "sentiment7", "sentiment_change", "investment7", "product7", "dup7", "bot7", "ambiguity7", "breadth7")


def wide(features: DataFrame) -> DataFrame:
    """(entity, date) with a struct column for each source (a pivot without a second shuffle: one conditional aggregate)."""
    one = lambda s: F.first(F.when(F.col("source") == s, F.struct(*FIELDS)), ignorenulls=True).alias(s)
    return features.groupBy("entity", "date").agg(*[one(s) for s in C.SOURCES])


def expected_sources(features: DataFrame, full_history: bool = False) -> DataFrame:
    """(entity, date, expected): a numeric source once it has had a row, a text source once the entity was mentioned.

    Point in time by default, so that later rows never change a day; ``full_history`` looks at all days.
    """
    text = F.col("source").isin(*C.TEXT_SOURCES)
    counts = F.when(text, F.col("mention_count") > 0).otherwise(F.col("observed"))
    frame = Window.partitionBy("entity", "source")
    frame = frame if full_history else frame.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    ever = F.max(F.coalesce(counts, F.lit(False))).over(frame)
    return features.withColumn("ever", ever).groupBy("entity", "date").agg(F.array_sort(F.collect_list(F.when(F.col("ever"), F.col("source")))).alias("expected"))


def _mean(values: list[Column]) -> Column:
    n = reduce(lambda a, b: a + b, [F.when(v.isNotNull(), 1).otherwise(0) for v in values])
    total = reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) for v in values])
    return F.try_divide(total, F.nullif(n.cast("double"), F.lit(0.0)))


def composite(features: DataFrame, expected: DataFrame, weights: dict[str, float] | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """One row for each entity-day; ``exclude`` leaves sources out before anything is computed."""
    share = C.component_weights(weights)
    used = [s for s in C.SOURCES if s not in exclude]
    x = wide(features).join(expected, ["entity", "date"], "left")
    x = x.withColumn("expected", F.array_except(F.coalesce("expected", F.array().cast("array<string>")), F.array(*[F.lit(s) for s in exclude]).cast("array<string>")))
    ok = {s: F.coalesce(F.col(f"{s}.available"), F.lit(False)) for s in used}
    text = {s: F.coalesce(F.col(f"{s}.freshness_days") <= C.FRESH_LIMIT, F.lit(False)) for s in used if s in C.TEXT_SOURCES}
    if_ok = lambda s, f: F.when(ok[s], F.col(f"{s}.{f}"))
    if_text = lambda s, f: F.when(text[s], F.col(f"{s}.{f}"))
    blend = lambda f: weighted_mean([(if_ok(s, f), C.ATTENTION_WEIGHTS[s]) for s in used])
    tone = lambda f: weighted_mean([(if_text(s, f), C.SENTIMENT_WEIGHTS[s]) for s in text]) if text else F.lit(None).cast("double")
    none = F.array().cast("array<double>")
    x = x.withColumns(
        {
            "attention_z": blend("abnormal_z"),
            "accel_raw": blend("accel_z"),
            "sentiment": tone("sentiment7"),
            "sentiment_change_raw": tone("sentiment_change"),
            "pooled_product": tone("product7"),
            "pooled_investment": tone("investment7"),
            "zs": F.array_compact(F.array(*[if_ok(s, "abnormal_z") for s in used])) if used else none,
            "sents": F.array_compact(F.array(*[if_text(s, "sentiment7") for s in text])) if text else none,
            "sources_available": F.array_compact(F.array(*[F.when(ok[s], F.lit(s)) for s in used])) if used else F.array().cast("array<string>"),
            "text_mentions7": reduce(lambda a, b: a + b, [F.coalesce(if_text(s, "mentions7"), F.lit(0)) for s in text], F.lit(0).cast("long")),
            "dup": F.coalesce(_mean([if_text(s, "dup7") for s in text]), F.lit(0.0)) if text else F.lit(0.0),
            "bots": F.coalesce(_mean([if_text(s, "bot7") for s in text]), F.lit(0.0)) if text else F.lit(0.0),
            "amb": F.coalesce(_mean([if_text(s, "ambiguity7") for s in text]), F.lit(0.0)) if text else F.lit(0.0),
            "worst_fresh": F.coalesce(F.array_max(F.array_compact(F.array(*[F.when(ok[s], F.coalesce(F.col(f"{s}.freshness_days"), F.lit(7))) for s in used]))), F.lit(7)) if used else F.lit(7),
        }
    )
    day = Window.partitionBy("date")
    x = x.withColumn("accel", z_cross(F.col("accel_raw"), day)).withColumn("sent_chg", z_cross(F.col("sentiment_change_raw"), day))

    n, zs = F.size("zs"), F.col("zs")
    total = F.aggregate(zs, F.lit(0.0), lambda a, z: a + z)
    center = F.try_divide(total, n.cast("double"))
    spread = F.sqrt(F.try_divide(F.aggregate(zs, F.lit(0.0), lambda a, z: a + (z - center) * (z - center)), n.cast("double")))
    gap = F.when(F.size("sents") >= 2, F.abs(F.get("sents", F.lit(0)) - F.get("sents", F.lit(1))))
    attention_agrees = 1 - clip(spread / 2, 0.0, 1.0)
    agree = F.when(gap.isNull(), attention_agrees).otherwise(0.6 * attention_agrees + 0.4 * (1 - clip(gap / 0.5, 0.0, 1.0)))
    diverge = F.greatest(clip((F.array_max(zs) - F.array_min(zs) - 1.5) / 4.5, 0.0, 1.0), F.coalesce(clip((gap - 0.15) / 0.6, 0.0, 1.0), F.lit(0.0)))
    n_ok, n_expected = F.size("sources_available"), F.size("expected")
    n_numeric = F.size(F.array_except("sources_available", F.array(*map(F.lit, C.TEXT_SOURCES))))
    x = x.withColumns(
        {
            "agreement": F.when(n >= 2, rounded(100 * agree)),
            "divergence": F.when(n >= 2, rounded(100 * diverge)),
            "coverage": F.coalesce(F.try_divide(n_ok.cast("double"), n_expected.cast("double")), F.lit(0.0)),
            "sample": 1 - F.exp(-(F.col("text_mentions7") + 8 * n_numeric) / C.SAMPLE_SCALE),
            "freshness": F.exp(-F.greatest(F.lit(0), F.col("worst_fresh") - C.STALE_AFTER) / 3.0),
            "quality": 1 - clip(0.5 * F.col("dup") + F.col("bots") + 0.5 * F.col("amb"), 0.0, 0.9),
            "tone": F.coalesce(F.tanh(4 * F.col("sentiment")), F.lit(0.0)),
        }
    )
    strength = reduce(lambda a, b: a * b, [F.pow(k, F.lit(e)) for k, e in C.EXPONENTS.items()])
    unusual = [if_ok(s, "abnormal_z") for s in C.UNUSUAL_SOURCES if s in used]
    up = F.size(F.filter(zs, lambda z: z > 0.5))
    one_sided = lambda v: F.tanh(F.greatest(F.lit(0.0), v) / 2) * F.col("tone")
    parts = {
        "abnormal_attention": F.when(F.col("attention_z").isNotNull(), one_sided(F.col("attention_z"))),
        "sentiment": F.tanh(2.5 * F.col("sentiment")),
        "attention_acceleration": F.when(F.col("accel").isNotNull(), one_sided(F.col("accel"))),
        "sentiment_acceleration": F.tanh(F.col("sent_chg") / 2),
        "confirmation": F.when(n >= 2, F.when(up >= 2, up / n * F.col("tone")).otherwise(0.0)),
        "unusual_source": F.when(_mean(unusual).isNotNull(), one_sided(_mean(unusual))) if unusual else F.lit(None).cast("double"),
    }
    x = x.withColumn("confidence", F.when(n_ok > 0, rounded(100 * strength)).otherwise(0.0)).withColumn("components", F.struct(*[v.cast("double").alias(k) for k, v in parts.items()]))
    x = x.withColumn("contributions", F.struct(*[(F.col(f"components.{k}") * share[k]).alias(k) for k in parts]))
    raw = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"contributions.{k}"), F.lit(0.0)) for k in parts])
    some = reduce(lambda a, b: a | b, [F.col(f"components.{k}").isNotNull() for k in parts])

    zz = {s: F.coalesce(F.col(f"{s}.abnormal_z"), F.lit(0.0)) for s in used}
    lone = [ok[s] & (zz[s] >= C.PENALTIES["hype"][0]) & reduce(lambda a, b: a & b, [~ok[o] | (zz[o] < C.HYPE_OTHERS) for o in used if o != s], F.lit(True)) for s in used]
    attention = F.array_compact(F.array(*[F.when(ok[s], F.lit(C.ATTENTION_WEIGHTS[s])) for s in used])) if used else none
    dominance = F.coalesce(F.try_divide(F.array_max(attention), F.aggregate(attention, F.lit(0.0), lambda a, w: a + w)), F.lit(1.0))
    hits = {
        "tiny_sample": F.col("text_mentions7") < C.PENALTIES["tiny_sample"][0],
        "duplicates": F.col("dup") > C.PENALTIES["duplicates"][0],
        "single_source": (n_ok <= 1) | (dominance > C.PENALTIES["single_source"][0]),
        "stale": F.col("freshness") < C.PENALTIES["stale"][0],
        "ambiguity": F.col("amb") > C.PENALTIES["ambiguity"][0],
        "bots": F.col("bots") > C.PENALTIES["bots"][0],
        "hype": reduce(lambda a, b: a | b, lone, F.lit(False)),
    }
    x = x.withColumn("penalties", F.array_compact(F.array(*[F.when(hit, F.struct(F.lit(k).alias("key"), F.lit(C.PENALTIES[k][1]).alias("amount"))) for k, hit in hits.items()])))
    x = x.withColumn("penalty_total", F.least(F.lit(C.PENALTY_CAP), F.aggregate("penalties", F.lit(0.0), lambda a, p: a + p.amount)))
    x = x.withColumn("raw", raw).withColumn("adjusted", F.col("raw") * F.sqrt(F.col("confidence") / 100) * (1 - F.col("penalty_total")))

    tests = F.array_compact(F.array_append("zs", F.col("sent_chg")))
    most = F.array_max(F.transform(tests, lambda t: F.abs(t)))
    tail = F.least(F.lit(1.0), F.size(tests) * 2 * (1 - norm_cdf(most)))
    crowd = {s: if_ok(s, "abnormal_z") for s in used}
    reddit = crowd.get("reddit", F.lit(None).cast("double"))
    others = [crowd[s] for s in used if s != "reddit"]
    crowding = reddit - (F.coalesce(_mean(others), F.lit(0.0)) if others else F.lit(0.0))
    field = lambda s, f: if_ok(s, f) if s in used else F.lit(None).cast("double")
    x = x.withColumn("crowding", crowding)
    high = ((reddit >= 3) & (F.col("crowding") >= 2)) | ((reddit >= 2) & (F.col("bots") > C.PENALTIES["bots"][0]))
    return x.withColumns(
        {
            "alt_signal_score": F.when(some, rounded(50 + 50 * clip(F.col("adjusted"), -1.0, 1.0), 1)),
            "raw_score": F.when(some, rounded(50 + 50 * clip(F.col("raw"), -1.0, 1.0), 1)),
            "attention_score": rounded(100 * norm_cdf(F.col("attention_z")), 1),
            "sentiment_score": rounded(100 * F.tanh(2.5 * F.col("sentiment")), 1),
            "attention_acceleration": rounded(F.col("accel"), 2),
            "sentiment_change": rounded(F.col("sent_chg"), 2),
            "anomaly_score": F.when(F.size(tests) > 0, rounded(100 * (1 - tail), 1)),
            "hype_risk": F.when(F.coalesce(high, F.lit(False)), "high").when((reddit >= 2) & (F.col("crowding") >= 1.25), "elevated").otherwise("low"),
            "wiki_shock": field("wikipedia", "abnormal_z"),
            "product_divergence": F.when(F.col("text_mentions7") >= 15, rounded(F.col("pooled_product") - F.col("pooled_investment"), 2)),
            "dev_acceleration": field("github", "accel_z"),
            "search_acceleration": field("search", "accel_z"),
            "community_breadth": field("reddit", "breadth7"),
            "retail_crowding": rounded(F.col("crowding"), 2),
            "per_source": F.map_filter(F.create_map(*[e for s in C.SOURCES for e in (F.lit(s), F.when(F.col(s).isNotNull(), F.struct(F.col(f"{s}.abnormal_z").alias("z"), F.col(f"{s}.accel_z").alias("accel"), F.col(f"{s}.sentiment7").alias("sentiment"), F.col(f"{s}.mentions7").alias("mentions7"), F.col(f"{s}.freshness_days").alias("freshness_days"), (ok[s] if s in used else F.lit(False)).alias("available"))))]), lambda k, v: v.isNotNull()),
        }
    ).drop("zs", "sents", "tone", *C.SOURCES)


def single_source_view(signals: DataFrame, source: str) -> DataFrame:
    """Attention by a logistic curve of the source's z, sentiment by tanh; no composite score."""
    own = F.col("per_source")[source]
    return signals.select("entity", "date", rounded(100 / (1 + F.exp(-1.702 * own["z"])), 1).alias("attention_score"), rounded(100 * F.tanh(2.5 * own["sentiment"]), 1).alias("sentiment_score"), F.lit(None).cast("double").alias("alt_signal_score"), own["mentions7"].alias("mentions7"))
