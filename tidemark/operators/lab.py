"""Cross-sectional research statistics: per-date stats, summaries, curves, splits, walk-forward."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import config as C
from tidemark.functions.stats import average_rank, clip, pearson, t_stat, z_cross

#: Features that a run can test (B2), all of alternative data.
FEATURES = ("alt_signal_score", "attention_score", "sentiment_score", "attention_acceleration", "sentiment_change", "agreement", "divergence", "wiki_shock", "product_divergence", "dev_acceleration", "community_breadth", "retail_crowding", "search_acceleration")


def catalogue(signals: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """(entity, date, feature, value): a row for each feature that is known of an entity on a day (B2)."""
    wide = signals.select("entity", "date", *[F.col(f).cast("double").alias(f) for f in features])
    return wide.unpivot(["entity", "date"], list(features), "feature", "value").where("value is not null")


def sections(signals: DataFrame, labels: DataFrame, universe: DataFrame, features: dict[str, float], horizon: int, top_rank: int | None = None, sectors: tuple[str, ...] = (), min_confidence: float = 0.0) -> DataFrame:
    """(date, entity, sector, signal, ret, eligible): the signal of eligible names joined to their labels.

    One feature counts as it is; of several, the weighted sum of their cross-sectional scores, missing ones
    skipped. ``eligible`` is the size of the chosen universe.
    """
    chosen = universe
    if top_rank is not None:
        chosen = chosen.where(F.col("rank") <= top_rank)
    if sectors:
        chosen = chosen.where(F.col("sector").isin(*sectors))
    chosen = chosen.withColumn("eligible", F.count("*").over(Window.partitionBy()))
    x = signals.join(chosen.select("entity", "sector", "eligible"), "entity").where(F.coalesce("confidence", F.lit(0.0)) >= min_confidence)
    if len(features) == 1:
        x = x.withColumn("signal", F.col(next(iter(features))))
    else:
        day = Window.partitionBy("date")
        x = x.withColumns({f"_z{i}": z_cross(F.col(f), day) for i, f in enumerate(features)})
        any_ = F.coalesce(*[F.col(f"_z{i}") for i in range(len(features))])
        total = sum((F.coalesce(F.col(f"_z{i}") * w, F.lit(0.0)) for i, w in enumerate(features.values())), F.lit(0.0))
        x = x.withColumn("signal", F.when(any_.isNotNull(), total))
    x = x.where("signal is not null and weekday(date) < 5")
    return x.join(labels.where(F.col("horizon") == horizon).select("entity", "date", "ret"), ["entity", "date"]).select("date", "entity", "sector", "signal", "ret", "eligible")


def ranked(rows: DataFrame, group: list[str]) -> DataFrame:
    """Adds average ranks of signal and ret within ``group``."""
    w = Window.partitionBy(*group)
    return rows.withColumn("signal_rank", average_rank(w.orderBy("signal"), Window.partitionBy(*group, "signal"))).withColumn("ret_rank", average_rank(w.orderBy("ret"), Window.partitionBy(*group, "ret")))


def date_stats(rows: DataFrame, min_names: int = C.MIN_CROSS_SECTION, by: tuple[str, ...] = ()) -> DataFrame:
    """Per date (and ``by``, as the name of a scenario) with at least ``min_names`` names: IC, rank IC, quintile means, spread, hit rate, top and bottom names.

    Quintiles are by position in the order of (signal, entity): floor(5 i / n).
    """
    day = Window.partitionBy(*by, "date")
    x = ranked(rows, [*by, "date"]).withColumn("n", F.count("*").over(day)).where(F.col("n") >= min_names)
    x = x.withColumn("quintile", F.floor((F.row_number().over(day.orderBy("signal", "entity")) - 1) * 5 / F.col("n")).cast("int"))
    x = x.withColumn("mid_signal", F.percentile("signal", F.lit(0.5)).over(day)).withColumn("mid_ret", F.percentile("ret", F.lit(0.5)).over(day))
    counted = (F.col("signal") != F.col("mid_signal")) & (F.col("ret") != F.col("mid_ret"))
    hit = (F.col("signal") > F.col("mid_signal")) == (F.col("ret") > F.col("mid_ret"))
    of = lambda q, c: F.when(F.col("quintile") == q, F.col(c))
    out = x.groupBy(*by, "date").agg(
        F.count("*").alias("n"),
        F.max("eligible").alias("eligible"),
        pearson(F.col("signal"), F.col("ret")).alias("ic"),
        pearson(F.col("signal_rank"), F.col("ret_rank")).alias("rank_ic"),
        *[F.avg(of(q, "ret")).alias(f"q{q + 1}") for q in range(5)],
        F.try_divide(F.count_if(counted & hit).cast("double"), F.nullif(F.count_if(counted).cast("double"), F.lit(0.0))).alias("hit_rate"),
        F.array_sort(F.collect_list(of(4, "entity"))).alias("top"),
        F.array_sort(F.collect_list(of(0, "entity"))).alias("bottom"),
    )
    return out.withColumn("spread", F.col("q5") - F.col("q1"))


def quintiles(rows: DataFrame, min_names: int = C.MIN_CROSS_SECTION) -> DataFrame:
    """``rows`` of dates with at least ``min_names`` names, with ``quintile`` (0 to 4) by position in the order of (signal, entity)."""
    day = Window.partitionBy("date")
    x = rows.withColumn("n", F.count("*").over(day)).where(F.col("n") >= min_names)
    return x.withColumn("quintile", F.floor((F.row_number().over(day.orderBy("signal", "entity")) - 1) * 5 / F.col("n")).cast("int"))


def pooled_quintiles(rows: DataFrame) -> DataFrame:
    """(quintile from 1, mean, median, n) of the returns of all dates together."""
    return quintiles(rows).groupBy((F.col("quintile") + 1).alias("quintile")).agg(F.avg("ret").alias("mean"), F.percentile("ret", F.lit(0.5)).alias("median"), F.count("*").alias("n"))


def coverage(rows: DataFrame, dates: DataFrame, eligible: int, ends: int = 10) -> DataFrame:
    """One row: the mean share of eligible names with a signal and a label over all ``dates``, the first and the last ``ends``."""
    counts = dates.select("date").join(rows.groupBy("date").agg(F.count("*").alias("n")), "date", "left")
    share = counts.select("date", (F.coalesce("n", F.lit(0)) / F.nullif(F.lit(float(eligible)), F.lit(0.0))).alias("share"))
    at, total = F.row_number().over(Window.orderBy("date")), F.count("*").over(Window.partitionBy())
    share = share.withColumns({"at": at, "total": total})
    return share.agg(F.avg("share").alias("coverage"), F.avg(F.when(F.col("at") <= ends, F.col("share"))).alias("first"), F.avg(F.when(F.col("at") > F.col("total") - ends, F.col("share"))).alias("last"))


def scenarios(named: dict[str, DataFrame], horizon: int, min_dates: int = C.MIN_SCENARIO_DATES) -> DataFrame:
    """(name, dates, mean_rank_ic, t_stat) of the sections of each scenario, in one pass with the name as a column.

    A scenario of fewer than ``min_dates`` usable dates has neither mean nor t; one of none has a row with 0.
    """
    rows = reduce(DataFrame.unionByName, [r.withColumn("name", F.lit(k)) for k, r in named.items()])
    found = summary(date_stats(rows, by=("name",)), horizon, ["name"], bootstrap=False)
    enough = lambda c: F.when(F.col("dates") >= min_dates, F.col(c)).alias(c)
    names = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, named))).alias("name"))
    return names.join(found.select("name", "dates", enough("mean_rank_ic"), enough("t_stat")), "name", "left").withColumn("dates", F.coalesce("dates", F.lit(0)))


def with_steps(stats: DataFrame, horizon: int, group: list[str] | None = None) -> DataFrame:
    """Adds ``step`` (position by date) and ``apart``: every horizon-th date, whose returns don't overlap."""
    order = Window.partitionBy(*(group or [])).orderBy("date")
    return stats.withColumn("step", F.row_number().over(order) - 1).withColumn("apart", F.col("step") % horizon == 0)


def bootstrap_ci(values: np.ndarray, block: int = C.BOOTSTRAP_BLOCK, rounds: int = C.BOOTSTRAP_ROUNDS, seed: int = 7) -> tuple[float, float] | None:
    """Moving-block bootstrap interval of a mean, in order of the values; None below eight."""
    n = len(values)
    if n < 8:
        return None
    b = max(1, min(block, n // 4))
    starts = np.random.default_rng(seed).integers(0, n - b + 1, (rounds, -(-n // b)))
    means = values[(starts[:, :, None] + np.arange(b)).reshape(rounds, -1)[:, :n]].mean(axis=1)
    return tuple(np.quantile(means, [0.025, 0.975]))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _bootstrap(values: pd.Series) -> pd.Series:
    return values.map(lambda v: list(bootstrap_ci(np.asarray(v, float)) or [None, None]))


def summary(stats: DataFrame, horizon: int, group: list[str] | None = None, bootstrap: bool = True) -> DataFrame:
    """One row (for each group): means over dates, inference on non-overlapping dates only."""
    x = with_steps(stats, horizon, group)
    apart = lambda c: F.when(F.col("apart"), F.col(c))
    error = F.stddev_samp(apart("rank_ic")) / F.sqrt(F.nullif(F.count(apart("rank_ic")).cast("double"), F.lit(0.0)))
    out = x.groupBy(*(group or [])).agg(
        F.count("*").alias("dates"),
        F.count_if("apart").alias("apart_dates"),
        F.sum("n").alias("observations"),
        F.avg("ic").alias("mean_ic"),
        F.avg("rank_ic").alias("mean_rank_ic"),
        F.stddev_samp("rank_ic").alias("ic_std"),
        F.try_divide(F.avg("rank_ic"), F.nullif(F.stddev_samp("rank_ic"), F.lit(0.0))).alias("ic_ir"),
        t_stat(apart("rank_ic")).alias("t_stat"),
        (F.avg(apart("rank_ic")) - 1.96 * F.nullif(error, F.lit(0.0))).alias("ci_low"),
        (F.avg(apart("rank_ic")) + 1.96 * F.nullif(error, F.lit(0.0))).alias("ci_high"),
        F.avg("hit_rate").alias("hit_rate"),
        F.avg(apart("spread")).alias("mean_spread"),
        t_stat(apart("spread")).alias("spread_t_stat"),
        F.try_divide(F.count_if(F.col("rank_ic") > 0).cast("double"), F.nullif(F.count("rank_ic").cast("double"), F.lit(0.0))).alias("positive_ic_share"),
        *([F.array_sort(F.collect_list(F.when(F.col("apart") & F.col("rank_ic").isNotNull(), F.struct("date", "rank_ic")))).alias("_ics")] if bootstrap else []),
    )
    if bootstrap:
        out = out.withColumn("_ci", _bootstrap(F.col("_ics.rank_ic"))).withColumn("bootstrap_low", F.get("_ci", F.lit(0))).withColumn("bootstrap_high", F.get("_ci", F.lit(1))).drop("_ci", "_ics")
    return out


def spread_curve(stats: DataFrame, horizon: int) -> DataFrame:
    """(date, spread, cumulative, drawdown, turnover_top, turnover_bottom) over non-overlapping dates."""
    x = with_steps(stats, horizon).where("apart and spread is not null")
    order = Window.orderBy("date")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("equity", F.exp(F.sum(F.log1p(clip(F.col("spread"), -0.99, 10.0))).over(so_far)))
    x = x.withColumn("peak", F.greatest(F.lit(1.0), F.max("equity").over(so_far)))

    def turnover(c: str) -> Column:
        before = F.lag(c).over(order)
        return F.when(F.size(before) > 0, 1 - F.size(F.array_intersect(before, F.col(c))) / F.size(before))

    return x.select("date", "spread", (F.col("equity") - 1).alias("cumulative"), (F.col("equity") / F.col("peak") - 1).alias("drawdown"), turnover("top").alias("turnover_top"), turnover("bottom").alias("turnover_bottom"))


def group_ic(rows: DataFrame, horizon: int, group: str = "sector", min_names: int = C.MIN_GROUP) -> DataFrame:
    """Mean rank IC within groups of at least ``min_names`` names a date."""
    x = rows.withColumn("n", F.count("*").over(Window.partitionBy("date", group))).where(F.col("n") >= min_names)
    by_day = ranked(x, ["date", group]).groupBy("date", group).agg(pearson(F.col("signal_rank"), F.col("ret_rank")).alias("ic")).where("ic is not null")
    x = with_steps(by_day, horizon, [group])
    return x.groupBy(group).agg(F.count("*").alias("dates"), F.avg("ic").alias("mean_rank_ic"), t_stat(F.when(F.col("apart"), F.col("ic"))).alias("t_stat"))


def by_month(stats: DataFrame, horizon: int) -> DataFrame:
    """(month, dates, mean_rank_ic, t_stat, mean_spread)."""
    rows = stats.withColumn("month", F.date_format("date", "yyyy-MM"))
    return summary(rows, horizon, ["month"], bootstrap=False).select("month", "dates", "mean_rank_ic", "t_stat", "mean_spread")


def splits(stats: DataFrame, fractions: tuple[float, float, float] = C.SPLIT) -> DataFrame:
    """Adds ``split``: calibration, validation or test, in order of date."""
    n = F.count("*").over(Window.partitionBy())
    i = F.row_number().over(Window.orderBy("date")) - 1
    first, second = F.floor(n * F.lit(fractions[0])), F.floor(n * F.lit(round(fractions[0] + fractions[1], 9)))
    return stats.withColumn("split", F.when(i < first, "calibration").when(i < second, "validation").otherwise("test"))


def walk_forward(candidates: DataFrame, horizon: int, folds: int = C.FOLDS, min_train: int | None = None) -> DataFrame:
    """(candidate, date, rank_ic) to one row a fold: the candidate of largest absolute mean IC on the dates before, its sign, and its mean IC on the fold.

    Folds are cut by date over the dates of any candidate, so that candidates with missing dates stay aligned.
    """
    dates = candidates.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))
    first = F.greatest(F.lit(20), F.floor(F.col("n") * 0.4)) if min_train is None else F.lit(min_train)
    dates = dates.withColumn("first", first.cast("long")).withColumn("size", F.ceil((F.col("n") - F.col("first")) / folds))
    cuts = dates.select("date", "i", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"), (F.col("first") + F.col("size") * F.col("fold")).alias("begin"), "size", "n")
    cuts = cuts.where((F.col("begin") < F.col("n")) & (F.col("i") < F.col("begin") + F.col("size"))).withColumn("part", F.when(F.col("i") < F.col("begin"), "train").otherwise("test"))
    means = cuts.join(candidates, "date").groupBy("fold", "candidate").agg(F.avg(F.when(F.col("part") == "train", F.col("rank_ic"))).alias("train_ic"), F.avg(F.when(F.col("part") == "test", F.col("rank_ic"))).alias("test_ic"), F.count_if((F.col("part") == "test") & F.col("rank_ic").isNotNull()).alias("test_dates"))
    best = F.row_number().over(Window.partitionBy("fold").orderBy(F.desc_nulls_last(F.abs("train_ic")), "candidate"))
    return means.withColumn("r", best).where("r = 1 and train_ic is not null").select("fold", "candidate", F.signum("train_ic").cast("int").alias("sign"), "train_ic", (F.col("test_ic") * F.signum("train_ic")).alias("test_ic"), "test_dates")


def regimes(stats: DataFrame, mood: DataFrame) -> DataFrame:
    """Adds ``regime``: whether the day's mood is above the median mood of the dates."""
    x = stats.join(mood.select("date", "mood"), "date")
    return x.withColumn("regime", F.when(F.col("mood") >= F.percentile("mood", F.lit(0.5)).over(Window.partitionBy()), "high").otherwise("low"))


def verdict(full_mean: float | None, test_t: float | None, test_mean: float | None) -> str:
    """Holds up if the held-out |t| is at least 2 and its sign is that of the full sample."""
    if None in (full_mean, test_t, test_mean):
        return "inconclusive"
    return "supported" if abs(test_t) >= 2 and (test_mean > 0) == (full_mean > 0) else "not supported"


def integrity(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of rows and of look-ahead violations."""
    f = features.agg(F.count("*").alias("feature_rows"), F.count_if(F.col("last_observed_date") > F.col("date")).alias("feature_violations"))
    return f.crossJoin(labels.agg(F.count("*").alias("label_rows"), F.count_if((F.col("entry_date") <= F.col("date")) | (F.col("exit_date") <= F.col("entry_date"))).alias("label_violations")))
