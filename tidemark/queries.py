"""Named queries over the star-schema tables, and the SQL each must agree with."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import config as C
from tidemark import oracle as O
from tidemark.functions import stats as S
from tidemark.operators import composite, events, features, intervals, lab, labels, metrics
from tidemark.plans import steps
from tidemark.sources import panel

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def shown(df: DataFrame, *columns: str) -> DataFrame:
    """Selected columns; doubles rounded to six decimals, so that the order of summation doesn't show."""
    kinds = dict(df.dtypes)
    return df.select(*[S.rounded(F.col(c), 6).alias(c) if kinds[c] == "double" else F.col(c) for c in (columns or df.columns)])


def shown_sql(columns: str, source: str, doubles: str = "") -> str:
    return "select " + ", ".join([*columns.split(), *[f"{O.r6(c)} as {c}" for c in doubles.split()]]) + f" from {source}"


# The panel, built step by step. Steps that several queries use are tables kept for the present state of their
# input files, so that a query reads the rows of the step it starts from instead of joining and sorting anew.

PANEL = ("lineitem", "orders", "supplier", "nation", "region", "part", "customer")
stored = steps.stored(*PANEL)


@steps.stored(*PANEL, version="2")
def items(spark: SparkSession, d: str) -> DataFrame:
    """With ``line``, a number of each item's own: several lines may have one order and number, and so one doc_id."""
    return panel.items(spark, d).withColumn("line", F.monotonically_increasing_id())


@stored
def daily(spark: SparkSession, d: str) -> DataFrame:
    rows = items(spark, d)
    return metrics.daily_source_metrics(rows, panel.universe(spark, d), panel.covered_days(rows))


def spine(spark: SparkSession, d: str) -> DataFrame:
    n = C.HISTORY_DAYS + C.LOOKBACK_DAYS
    days = panel.as_of(spark, d).select(F.explode(F.sequence(F.date_sub("as_of", n - 1), F.col("as_of"))).alias("date"))
    return features.on_spine(daily(spark, d), days, panel.universe(spark, d))


@stored
def feats(spark: SparkSession, d: str) -> DataFrame:
    return features.source_features(spine(spark, d))


def composed(spark: SparkSession, d: str, **options) -> DataFrame:
    f = feats(spark, d)
    return composite.composite(f, composite.expected_sources(f), **options)


@stored
def signals(spark: SparkSession, d: str) -> DataFrame:
    return composed(spark, d)


@stored
def returns(spark: SparkSession, d: str) -> DataFrame:
    """Labels of every entity-day of the panel; the days need no signal to be known."""
    grid = panel.universe(spark, d).select("entity").crossJoin(spine_days(spark, d))
    return labels.forward_returns(panel.prices(spark, d), grid)


def sections(spark: SparkSession, d: str, feature: str = "attention_z", horizon: int = 5) -> DataFrame:
    rows = lab.sections(signals(spark, d), returns(spark, d), panel.universe(spark, d), {feature: 1.0}, horizon)
    return rows.withColumn("signal", S.rounded(F.col("signal"), 6)).withColumn("ret", S.rounded(F.col("ret"), 6))


def stats(spark: SparkSession, d: str) -> DataFrame:
    return lab.date_stats(sections(spark, d))


# Aggregation (A1-A6), sources and set operations

METRIC = "entity source date mention_count unique_authors community_count"
METRIC_DOUBLES = "value engagement_adj pos_share neg_share net_sentiment sentiment_weight sentiment_confidence investment_sentiment product_sentiment reputation_sentiment dup_ratio bot_ratio ambiguity_ratio community_hhi"


@query(O.sql(shown_sql(METRIC, "metrics", METRIC_DOUBLES), "metrics"))
def daily_source_metrics(spark, d):
    return shown(daily(spark, d), *METRIC.split(), *METRIC_DOUBLES.split())


@query(O.sql(f"select entity, source, date, {O.r6('hhi')} as hhi, community_count from communities", "communities"))
def hhi(spark, d):
    rows = metrics.daily_text_metrics(items(spark, d)).where("community_count > 0").select("entity", "source", "date", "community_count")
    unique = metrics.polarity_weights(items(spark, d).where(F.col("source").isin(*C.TEXT_SOURCES))).where("status = 'unique'")
    counts = unique.groupBy("entity", "source", "date", "community").count().groupBy("entity", "source", "date").agg((F.sum(F.col("count") * F.col("count")) / F.pow(F.sum("count"), F.lit(2.0))).alias("hhi"))
    return shown(rows.join(counts, ["entity", "source", "date"]))


@query(O.sql("select entity, source, date, count(*) as n from items group by all", "items"))
def daily_event_counts(spark, d):
    return items(spark, d).groupBy("entity", "source", "date").agg(F.count("*").alias("n"))


@query(O.sql("select entity, sector, rank, round(cap, 2) as cap from universe", "universe"))
def universe(spark, d):
    return panel.universe(spark, d).select("entity", "sector", "rank", F.round("cap", 2).alias("cap"))


@query(O.sql("select entity, sector, rank from universe where rank <= 10 and sector <> 'ASIA'", "universe"))
def universe_top_filtered(spark, d):
    return panel.universe(spark, d).where("rank <= 10 and sector <> 'ASIA'").select("entity", "sector", "rank")


@query("select n_name as entity, r_name as sector, count(*) as customers from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all")
def inner_members(spark, d):
    t = lambda n: panel.table(spark, d, n)
    nation, region, customer = t("nation"), t("region"), t("customer")
    rows = customer.join(nation, customer.c_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
    return rows.groupBy(F.col("n_name").alias("entity"), F.col("r_name").alias("sector")).agg(F.count("*").alias("customers"))


@query("select o_orderkey, o_custkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_discount >= 0.095)")
def semi_docs(spark, d):
    line = panel.table(spark, d, "lineitem").where("l_discount >= 0.095")
    orders = panel.table(spark, d, "orders")
    return orders.join(line, orders.o_orderkey == line.l_orderkey, "left_semi").select("o_orderkey", "o_custkey")


@query(O.sql("select u.entity, s.source, d.date from universe u cross join (select distinct source from items) s cross join days d except select entity, source, date from items", "universe", "days", "items"))
def anti_gap_days(spark, d):
    """Expected less collected days of every entity, by source."""
    rows = items(spark, d)
    expected = panel.universe(spark, d).select("entity").crossJoin(rows.select("source").distinct()).crossJoin(spine_days(spark, d))
    return expected.join(rows.select("entity", "source", "date").distinct(), ["entity", "source", "date"], "left_anti")


@query(O.sql("""select entity, source, min(date) as first_day, max(date) as last_day, count(*) as n from (
        select *, date - row_number() over (partition by entity, source order by date)::int as run from (
            select u.entity, s.source, d.date from universe u cross join (select distinct source from items) s cross join days d except select entity, source, date from items)) group by entity, source, run""", "universe", "days", "items"))
def gap_intervals(spark, d):
    """Spans of days without rows of every entity, by source (S19, U2): the requested span less the runs of collected days."""
    rows = items(spark, d)
    n = C.HISTORY_DAYS + C.LOOKBACK_DAYS
    whole = panel.as_of(spark, d).select(F.date_sub("as_of", n - 1).alias("start"), F.col("as_of").alias("end"))
    requested = panel.universe(spark, d).select("entity").crossJoin(rows.select("source").distinct()).crossJoin(whole)
    gaps = intervals.subtracted(requested, intervals.of_days(rows, ["entity", "source"]), ["entity", "source"])
    return gaps.select("entity", "source", F.col("start").alias("first_day"), F.col("end").alias("last_day"), intervals.n_days().cast("long").alias("n"))


def spine_days(spark: SparkSession, d: str) -> DataFrame:
    n = C.HISTORY_DAYS + C.LOOKBACK_DAYS
    return panel.as_of(spark, d).select(F.explode(F.sequence(F.date_sub("as_of", n - 1), F.col("as_of"))).alias("date"))


@query(O.sql("select source, date, count(*) as entities, count(*) filter (where mention_count = 0) as zeros from metrics where source in ('reddit', 'hackernews') group by all", "metrics"))
def cross_zero_fill(spark, d):
    return daily(spark, d).where(F.col("source").isin(*C.TEXT_SOURCES)).groupBy("source", "date").agg(F.count("*").alias("entities"), F.count_if(F.col("mention_count") == 0).alias("zeros"))


@query(O.sql("select a.entity, a.source, a.date, a.value, b.value as before from metrics a left join metrics b on a.entity = b.entity and a.source = b.source and b.date = a.date - 7 where a.source = 'search'", "metrics"))
def self_lag_join(spark, d):
    """A day against the same day a week before."""
    now = metrics.numeric_metrics(items(spark, d)).where("source = 'search'")
    before = now.select("entity", "source", F.date_add("date", 7).alias("date"), F.col("value").alias("before"))
    return now.join(before, ["entity", "source", "date"], "left").select("entity", "source", "date", "value", "before")


@query("select 'orders' as kind, o_orderkey as id from orders where o_totalprice > 400000 union all select 'lines', l_orderkey from lineitem where l_quantity >= 50")
def union_sources(spark, d):
    a = panel.table(spark, d, "orders").where("o_totalprice > 400000").select(F.lit("orders").alias("kind"), F.col("o_orderkey").alias("id"))
    return a.unionByName(panel.table(spark, d, "lineitem").where("l_quantity >= 50").select(F.lit("lines").alias("kind"), F.col("l_orderkey").alias("id")))


@query("select o_orderdate::date as date from orders except select l_shipdate::date from lineitem where l_discount > 0.09")
def except_days(spark, d):
    a = panel.table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date"))
    return a.subtract(panel.table(spark, d, "lineitem").where("l_discount > 0.09").select(F.col("l_shipdate").cast("date")))


@query("select c_nationkey as key from customer where c_acctbal > 9000 intersect select s_nationkey from supplier where s_acctbal > 5000")
def intersect_members(spark, d):
    a = panel.table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("key"))
    return a.intersect(panel.table(spark, d, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


# Statistics (M1-M9)


@query("select p_brand, floor(avg(p_retailprice) * 1e6 + 0.5) / 1e6 as mean, floor(stddev_samp(p_retailprice) * 1e6 + 0.5) / 1e6 as sd, count(*) as n from part group by all")
def stats_summary(spark, d):
    return shown(panel.table(spark, d, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("mean"), F.stddev_samp("p_retailprice").alias("sd"), F.count("*").alias("n")))


@query("select p_brand, floor(quantile_cont(p_retailprice, 0.25) * 1e6 + 0.5) / 1e6 as p25, floor(median(p_retailprice) * 1e6 + 0.5) / 1e6 as p50, floor(quantile_cont(p_retailprice, 0.9) * 1e6 + 0.5) / 1e6 as p90 from part group by all")
def quantile_type7(spark, d):
    return shown(panel.table(spark, d, "part").groupBy("p_brand").agg(*[F.percentile("p_retailprice", F.lit(q)).alias(n) for n, q in (("p25", 0.25), ("p50", 0.5), ("p90", 0.9))]))


@query("select p_brand, floor(1.4826 * mad(p_retailprice) * 1e6 + 0.5) / 1e6 as mad from part group by all")
def mad(spark, d):
    """Two exact medians, each pre-aggregated by value; no array of a brand's prices."""
    rows = panel.table(spark, d, "part").select("p_brand", "p_retailprice")
    centers = rows.groupBy(F.col("p_brand").alias("of")).agg(F.percentile("p_retailprice", F.lit(0.5)).alias("center"))
    apart = rows.join(centers, F.col("p_brand").eqNullSafe(F.col("of"))).withColumn("apart", F.abs(F.col("p_retailprice") - F.col("center")))
    return shown(apart.groupBy("p_brand").agg((F.percentile("apart", F.lit(0.5)) * 1.4826).alias("mad")))


@query(f"select p_partkey, {O.r6(O.cdf('((p_size - 25) / 10.0)'))} as cdf from part")
def normcdf(spark, d):
    return shown(panel.table(spark, d, "part").select("p_partkey", S.norm_cdf((F.col("p_size") - 25) / 10.0).alias("cdf")))


# Rolling features

KEY = "entity source date"


@query(O.sql(shown_sql(KEY, "feats", "abnormal_z activity7"), "feats"))
def attention_z(spark, d):
    return shown(feats(spark, d), *KEY.split(), "abnormal_z", "activity7")


@query(O.sql(shown_sql(KEY, "feats", "accel_z"), "feats"))
def accel_z(spark, d):
    return shown(feats(spark, d), *KEY.split(), "accel_z")


SHRUNK = "sentiment7 sentiment_prev7 sentiment_change investment7 product7 reputation7 pos_share7 neg_share7 sentiment_confidence7"


@query(O.sql(shown_sql(KEY, "feats", SHRUNK), "feats"))
def shrunk_sentiment(spark, d):
    return shown(feats(spark, d), *KEY.split(), *SHRUNK.split())


@query(O.sql(shown_sql(f"{KEY} last_observed_date freshness_days available obs_short obs_baseline", "feats"), "feats").replace("obs_baseline from feats", "obs_baseline::int as obs_baseline from feats"))
def freshness(spark, d):
    return feats(spark, d).select(*KEY.split(), "last_observed_date", "freshness_days", "available", "obs_short", "obs_baseline")


@query(O.sql(shown_sql(f"{KEY} mentions7 authors7", "feats", "engagement7 dup7 bot7 ambiguity7 breadth7"), "feats"))
def quality_ratios(spark, d):
    return shown(feats(spark, d), *f"{KEY} mentions7 authors7 engagement7 dup7 bot7 ambiguity7 breadth7".split())


# Composite (C1-C18) and events

ED = "entity date"


@query(O.sql(shown_sql(ED, "signals", "accel_raw accel sentiment_change_raw sent_chg"), "signals"))
def cross_z(spark, d):
    return shown(signals(spark, d), *f"{ED} accel_raw accel sentiment_change_raw sent_chg".split())


@query(O.sql(f"select entity, date, {', '.join(f'{O.r6(a)} as {b}' for a, b in (('abnormal_attention', 'abnormal_attention'), ('sentiment_part', 'sentiment'), ('attention_acceleration_part', 'attention_acceleration'), ('sentiment_acceleration', 'sentiment_acceleration'), ('confirmation', 'confirmation'), ('unusual_source', 'unusual_source')))} from signals", "signals"))
def composite_components(spark, d):
    return shown(signals(spark, d).select("entity", "date", "components.*"))


@query(O.sql(shown_sql(ED, "signals", "confidence coverage sample freshness quality agreement divergence"), "signals"))
def confidence(spark, d):
    return shown(signals(spark, d), *f"{ED} confidence coverage sample freshness quality agreement divergence".split())


@query(O.sql(f"select entity, date, array_to_string(penalty_keys, ',') as penalties, {O.r6('penalty_total')} as penalty_total from signals", "signals"))
def penalties(spark, d):
    return shown(signals(spark, d).withColumn("penalties", F.array_join(F.col("penalties.key"), ",")), "entity", "date", "penalties", "penalty_total")


SCORES = "alt_signal_score raw_score attention_score sentiment_score attention_acceleration sentiment_change"


@query(O.sql(shown_sql(ED, "signals", SCORES), "signals"))
def composite_score(spark, d):
    return shown(signals(spark, d), *ED.split(), *SCORES.split())


@query(O.sql(shown_sql(f"{ED} hype_risk", "signals", "anomaly_score retail_crowding product_divergence wiki_shock search_acceleration"), "signals"))
def anomaly_score(spark, d):
    return shown(signals(spark, d), *f"{ED} hype_risk anomaly_score retail_crowding product_divergence wiki_shock search_acceleration".split())


def _crossings_sql() -> str:
    parts = [
        f"select entity, date, '{s}' as source, 'attention_{k}' as kind, z from (select entity, date, {O._ok(s, 'abnormal_z')} as z, coalesce(case when lag(date) over w = date - 1 then lag({s}_abnormal_z) over w end, 0.0) as b from signals window w as (partition by entity order by date)) where {test}"
        for s in C.SOURCES
        for k, test in (("spike", "z >= 3.5 and b < 3.5"), ("drop", "z <= -3.5 and b > -3.5"))
    ]
    cross = (("cross", "sentiment_shift", "sentiment_change", "sentiment_change", "abs(v) >= 3.5 and abs(b) < 3.5"), ("cross", "divergence", "divergence", "divergence / 25", "v >= 85 and b < 85"), ("cross", "product_divergence", "product_divergence", "product_divergence / 0.1", "v <= -0.6 and b > -0.6"))
    parts += [f"select entity, date, '{s}', '{k}', z from (select entity, date, {v} as v, {z} as z, coalesce(case when lag(date) over w = date - 1 then lag({v}) over w end, 0.0) as b from signals window w as (partition by entity order by date)) where {test}" for s, k, v, z, test in cross]
    parts.append("select entity, date, 'reddit', 'hype', z from (select entity, date, hype_risk as v, coalesce(retail_crowding, 0.0) as z, coalesce(case when lag(date) over w = date - 1 then lag(hype_risk) over w end, 'low') as b from signals window w as (partition by entity order by date)) where v = 'high' and b <> 'high'")
    return " union all ".join(parts)


@query(O.sql(f"select entity, date, source, kind, {O.r6('z')} as z from ({_crossings_sql()})", "signals"))
def events_crossing(spark, d):
    return shown(events.crossings(signals(spark, d)), "entity", "date", "source", "kind", "z")


@query(
    """with recursive e as (select distinct c_nationkey as entity, o_orderdate::date as date from orders join customer on o_custkey = c_custkey where o_totalprice > 450000),
    k as (select entity, min(date) as date from e group by 1 union all select k.entity, (select min(e.date) from e where e.entity = k.entity and e.date > k.date + 7) from k where k.date is not null)
    select entity, date from k where date is not null"""
)
def refractory(spark, d):
    orders, customer = panel.table(spark, d, "orders"), panel.table(spark, d, "customer")
    found = orders.where("o_totalprice > 450000").join(customer, orders.o_custkey == customer.c_custkey).select(F.col("c_nationkey").alias("entity"), F.col("o_orderdate").cast("date").alias("date"))
    return events.refractory(found, keys=("entity",)).select("entity", "date")


@query(O.sql(f"select entity, date, {O.r6(O.rnd('100 / (1 + exp(-1.702 * search_abnormal_z))', 1))} as attention_score, {O.r6(O.rnd('100 * tanh(2.5 * search_sentiment7)', 1))} as sentiment_score from signals", "signals"))
def single_source_view(spark, d):
    return shown(composite.single_source_view(signals(spark, d), "search"), "entity", "date", "attention_score", "sentiment_score")


# Labels and research statistics


@query(O.sql("select entity, date, horizon, entry_date, exit_date, " + O.r6("ret") + " as ret from returns", "returns"))
def forward_returns(spark, d):
    return shown(returns(spark, d))


@query(O.sql("select date, entity, q as quintile from ranked where n >= 20", "ranked"))
def quintiles(spark, d):
    return lab.quintiles(sections(spark, d)).select("date", "entity", "quintile")


@query(O.sql(shown_sql("date n", "stats", "ic rank_ic"), "stats"))
def rank_ic(spark, d):
    return shown(stats(spark, d), "date", "n", "ic", "rank_ic")


@query(O.sql("select date, n, array_to_string(top, ',') as top, array_to_string(bottom, ',') as bottom, " + ", ".join(f"{O.r6(c)} as {c}" for c in ("q1", "q2", "q3", "q4", "q5", "hit_rate")) + " from stats", "stats"))
def date_stats(spark, d):
    x = stats(spark, d).withColumn("top", F.array_join("top", ",")).withColumn("bottom", F.array_join("bottom", ","))
    return shown(x, "date", "n", "top", "bottom", "q1", "q2", "q3", "q4", "q5", "hit_rate")


_A = lambda c: f"(case when apart then {c} end)"
_SUMMARY = {
    "mean_ic": "avg(ic)",
    "mean_rank_ic": "avg(rank_ic)",
    "ic_std": "stddev_samp(rank_ic)",
    "ic_ir": "avg(rank_ic) / stddev_samp(rank_ic)",
    "t_stat": f"avg({_A('rank_ic')}) / (stddev_samp({_A('rank_ic')}) / sqrt(count({_A('rank_ic')})))",
    "ci_low": f"avg({_A('rank_ic')}) - 1.96 * stddev_samp({_A('rank_ic')}) / sqrt(count({_A('rank_ic')}))",
    "hit_rate": "avg(hit_rate)",
    "mean_spread": f"avg({_A('spread')})",
    "spread_t_stat": f"avg({_A('spread')}) / (stddev_samp({_A('spread')}) / sqrt(count({_A('spread')})))",
    "positive_ic_share": "count(*) filter (where rank_ic > 0)::double / count(rank_ic)",
}


@query(O.sql("select count(*) as dates, count(*) filter (where apart) as apart_dates, sum(n)::bigint as observations, " + ", ".join(f"{O.r6(e)} as {k}" for k, e in _SUMMARY.items()) + " from apart", "apart"))
def summary_stats(spark, d):
    return shown(lab.summary(stats(spark, d), 5, bootstrap=False), "dates", "apart_dates", "observations", *_SUMMARY)


@query(
    O.sql(
        f"select date, {O.r6('spread')} as spread, {O.r6('e - 1')} as cumulative, {O.r6('e / greatest(1.0, max(e) over (order by date)) - 1')} as drawdown from (select date, spread, exp(sum(ln(1 + least(10.0, greatest(-0.99, spread)))) over (order by date)) as e from apart where apart and spread is not null)",
        "apart",
    )
)
def spread_curve(spark, d):
    return shown(lab.spread_curve(stats(spark, d), 5), "date", "spread", "cumulative", "drawdown")


@query(O.sql(f"select date, {O.r6('1 - len(list_intersect(p, top))::double / len(p)')} as turnover_top, {O.r6('1 - len(list_intersect(b, bottom))::double / len(b)')} as turnover_bottom from (select date, top, bottom, lag(top) over (order by date) as p, lag(bottom) over (order by date) as b from apart where apart and spread is not null)", "apart"))
def turnover(spark, d):
    return shown(lab.spread_curve(stats(spark, d), 5), "date", "turnover_top", "turnover_bottom")


@query(
    O.sql(
        f"""select sector, count(*) as dates, {O.r6('avg(ic)')} as mean_rank_ic from (select date, sector, covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) as ic from (
        select date, sector, rank() over (partition by date, sector order by signal) + (count(*) over (partition by date, sector, signal) - 1) / 2.0 as a, rank() over (partition by date, sector order by ret) + (count(*) over (partition by date, sector, ret) - 1) / 2.0 as b, count(*) over (partition by date, sector) as n from sections) where n >= 4 group by 1, 2) where ic is not null group by 1""",
        "sections",
    )
)
def sector_ic(spark, d):
    return shown(lab.group_ic(sections(spark, d), 5, min_names=4), "sector", "dates", "mean_rank_ic")


@query(O.sql(f"select strftime(date, '%Y-%m') as month, count(*) as dates, {O.r6('avg(rank_ic)')} as mean_rank_ic from stats group by 1", "stats"))
def month_ic(spark, d):
    return shown(lab.by_month(stats(spark, d), 5), "month", "dates", "mean_rank_ic")


_MOOD = "select date, floor(sum(sentiment_score * greatest(1, confidence)) / sum(case when sentiment_score is not null then greatest(1, confidence) end) * 1e6 + 0.5) / 1e6 as mood from signals group by 1"


def mood(spark: SparkSession, d: str) -> DataFrame:
    weight = F.greatest(F.lit(1.0), F.col("confidence"))
    return signals(spark, d).groupBy("date").agg(S.rounded(F.try_divide(F.sum(F.col("sentiment_score") * weight), F.sum(F.when(F.col("sentiment_score").isNotNull(), weight))), 6).alias("mood"))


@query(O.sql(f"select regime, count(*) as dates, {O.r6('avg(rank_ic)')} as mean_rank_ic from (select case when mood >= median(mood) over () then 'high' else 'low' end as regime, rank_ic from stats join ({_MOOD}) using (date)) group by 1", "stats", "signals"))
def regime_ic(spark, d):
    return shown(lab.regimes(stats(spark, d), mood(spark, d)).groupBy("regime").agg(F.count("*").alias("dates"), F.avg("rank_ic").alias("mean_rank_ic")))


@query(O.sql("select date, case when i < floor(nd * 0.6) then 'calibration' when i < floor(nd * 0.8) then 'validation' else 'test' end as split from apart", "apart"))
def splits(spark, d):
    return lab.splits(stats(spark, d)).select("date", "split")


def candidates(spark: SparkSession, d: str) -> DataFrame:
    found = [lab.date_stats(sections(spark, d, f)).select(F.lit(f).alias("candidate"), "date", "rank_ic") for f in ("attention_z", "alt_signal_score")]
    return found[0].unionByName(found[1])


@query(O.sql(f"select fold, name as candidate, sign(train_ic)::int as sign, {O.r6('train_ic')} as train_ic, {O.r6('test_ic * sign(train_ic)')} as test_ic, test_dates from (select *, row_number() over (partition by fold order by abs(train_ic) desc nulls last, name) as r from folds) where r = 1 and train_ic is not null", "folds"))
def walk_forward(spark, d):
    """Folds by date over two candidates."""
    return shown(lab.walk_forward(candidates(spark, d), 5))


@query()
def bootstrap_ci(spark, d):
    return shown(lab.summary(stats(spark, d), 5), "dates", "bootstrap_low", "bootstrap_high")


@query(O.sql("select count(*) as feature_rows, count(*) filter (where last_observed_date > date) as feature_violations, (select count(*) from returns) as label_rows, 0::bigint as label_violations from feats", "feats", "returns"))
def integrity(spark, d):
    return lab.integrity(feats(spark, d), returns(spark, d))


@query(O.sql(f"select floor_at, count(*) as names, {O.r6('avg(alt_signal_score)')} as mean_score from signals cross join (values (0), (25), (50), (70)) f(floor_at) where coalesce(confidence, 0) >= floor_at group by 1", "signals"))
def sensitivity(spark, d):
    """Confidence floors as a scenario column in one pass."""
    floors = spark.createDataFrame([(0,), (25,), (50,), (70,)], "floor_at int")
    x = signals(spark, d).crossJoin(F.broadcast(floors)).where(F.coalesce("confidence", F.lit(0.0)) >= F.col("floor_at"))
    return shown(x.groupBy("floor_at").agg(F.count("*").alias("names"), F.avg("alt_signal_score").alias("mean_score")))


@query()
def source_exclusion(spark, d):
    """The composite without one source (C17); tested against a frame that never had it."""
    return shown(composed(spark, d, exclude=("reddit",)), *ED.split(), *SCORES.split())


# Text operators

from tidemark.config import ViewQuery  # noqa: E402
from tidemark.functions import text as X  # noqa: E402
from tidemark.operators import classify, dedupe, resolve  # noqa: E402
from tidemark.plans import views  # noqa: E402
from tidemark.sources import paged, providers, sinks  # noqa: E402
from tidemark.sources.shared import shared_dir  # noqa: E402
from tidemark.streaming import refresh, streams  # noqa: E402

_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
for _e, _v in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("apos", "''"), ("nbsp", " "), ("#x27", "''"), ("amp", "&")):
    _CLEAN = f"replace({_CLEAN}, '&{_e};', '{_v}')"
_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(text), 'https?://\S+', ' ', 'g'), '[^a-z0-9$ ]', ' ', 'g'), ' +', ' ', 'g'))"


@query(rf"select page_id, length(t) as chars, md5(t) as digest from (select page_id, left(trim(regexp_replace({_CLEAN}, '\s+', ' ', 'g')), 4000) as t from pages)")
def clean_html(spark, d):
    x = panel.table(spark, d, "pages").select("page_id", X.clean_text(F.col("html")).alias("t"))
    return x.select("page_id", F.char_length("t").cast("long").alias("chars"), F.md5(F.col("t").cast("binary")).alias("digest"))


_URL = r"""lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || regexp_replace(lower(regexp_extract(url, '://([^/?#]+)', 1)), '^(www\.|m\.|old\.|amp\.)', '') || regexp_replace(regexp_extract(url, '://[^/?#]+([^?#]*)', 1), '/+$', '')
  || case when len(p) > 0 then '?' || array_to_string(p, '&') else '' end"""
_PARAMS = r"""list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda q: q <> '' and not regexp_matches(lower(q), '^(utm_|ref|fbclid|gclid|share|si=)'))"""


@query(f"select page_id, {_URL} as canon from (select page_id, url, {_PARAMS} as p from pages)")
def canonical_url(spark, d):
    return panel.table(spark, d, "pages").select("page_id", X.canonical_url(F.col("url")).alias("canon"))


@query(f"select canon, count(*) as n, min(page_id) as first from (select page_id, {_URL} as canon from (select page_id, url, {_PARAMS} as p from pages)) group by 1")
def url_dedupe(spark, d):
    return canonical_url(spark, d).groupBy("canon").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))


def _words_sql(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


@query(
    rf"""select doc_id, case when letters > 20 and latin / letters < 0.6 then 'other' when n < 4 then 'unknown' when other > en and other >= 2 then 'other' when en = 0 and n >= 8 then 'unknown' else 'en' end as lang,
    {O.r6("case when letters > 20 and latin / letters < 0.6 then 0.9 when n < 4 then 0.3 when other > en and other >= 2 then least(0.95, 0.5 + other / n) when en = 0 and n >= 8 then 0.4 else least(0.99, 0.6 + en / n) end::double")} as confidence from (
    select doc_id, letters, latin, len(tok) as n, len(list_filter(tok, lambda t: t in {_words_sql(X.ENGLISH)})) as en, len(list_filter(tok, lambda t: t in {_words_sql(X.OTHER)})) as other from (
    select doc_id, len(regexp_extract_all(text, '\p{{L}}')) as letters, len(regexp_extract_all(text, '[A-Za-z]')) as latin, regexp_extract_all(lower(text), '[a-z'']+') as tok from documents))"""
)
def lang_detect(spark, d):
    return shown(panel.table(spark, d, "documents").select("doc_id", X.language(F.col("text")).alias("x")).select("doc_id", "x.lang", "x.confidence"))


def _as_items(x: DataFrame) -> DataFrame:
    """Documents as text items in order of id; source as author and language as community.

    A fifth has no URL, a fifth one of 97 with tracking parameters, a fifth a discussion page of their own.
    """
    i = F.col("doc_id")
    url = F.when(i % 5 == 1, F.concat(F.lit("https://www.example.org/a/"), i % 97, F.lit("/?utm_source=x"))).when(i % 5 == 2, F.concat(F.lit("https://old.reddit.com/r/x/"), i % 7)).when(i % 5 > 2, F.concat(F.lit("http://m.example.com/item?b="), i))
    return x.select("doc_id", url.alias("url"), F.col("lang").alias("community"), F.col("source").alias("author_hash"), "text", F.timestamp_seconds("doc_id").alias("published_at"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    return _as_items(panel.table(spark, d, "documents"))


_STAGES = f"""with n as (select doc_id, lang, {_NORM} as norm, case when doc_id % 5 = 1 then doc_id % 97 when doc_id % 5 > 2 then doc_id + 1000 end as link from documents),
    u as (select *, link is not null and row_number() over (partition by link order by doc_id) > 1 as later, first_value(lang) over (partition by link order by doc_id) as first_lang from n),
    e as (select doc_id, row_number() over (partition by norm order by doc_id) > 1 as again from u where not later and length(norm) >= 12)
    select doc_id, case when later and lang is not distinct from first_lang then 'duplicate_url' when later then 'crosspost' when again then 'duplicate_exact' else 'unique' end as status from u left join e using (doc_id)"""


@query(_STAGES)
def exact_dedupe(spark, d):
    return dedupe.exact_statuses(_items(spark, d)).select("doc_id", F.coalesce("status", F.lit("unique")).alias("status"))


@query()
def near_dedupe(spark, d):
    """All stages with the bot flag; held against a sequential model in the tests."""
    return dedupe.statuses(_items(spark, d)).select("doc_id", "status")


@query(f"""{_STAGES.split("select doc_id, case when later", 1)[0].replace("first_value(lang)", "first_value(doc_id) over (partition by link order by doc_id) as first_doc, first_value(lang)").replace("row_number() over (partition by norm", "first_value(doc_id) over (partition by norm order by doc_id) as same, row_number() over (partition by norm")}
    select u.doc_id, case when later and lang is not distinct from first_lang then 'duplicate_url' when later then 'crosspost' when e.again then 'duplicate_exact' else 'unique' end as status,
        case when later then first_doc when e.again then e.same end as duplicate_of, case when later then case when f.again then f.same else first_doc end when e.again then e.same end as retained
    from u left join e on e.doc_id = u.doc_id left join e as f on f.doc_id = u.first_doc""")
def exact_originals(spark, d):
    """What each duplicate of the first two stages repeats, and the item retained at the end of the chain."""
    return dedupe.originals(_items(spark, d), near=False)


@query()
def near_originals(spark, d):
    """What each duplicate of all stages repeats; held against a sequential model in the tests."""
    return dedupe.originals(_items(spark, d))


@query("select event_id, 'h' || left(sha256('salt:' || event_type || ':' || user_id), 16) as author from events")
def author_hash(spark, d):
    return panel.table(spark, d, "events").select("event_id", X.author_hash(F.lit("salt"), F.col("event_type"), F.col("user_id").cast("string")).alias("author"))


@query(f"select l_orderkey, l_linenumber, {O.r6('0.8::double * (1 + ln(1 + greatest(l_quantity, 0.0)) / 2 + ln(1 + greatest(l_linenumber, 0.0)) / 4)')} as w from lineitem")
def engagement(spark, d):
    x = panel.table(spark, d, "lineitem")
    return shown(x.select("l_orderkey", "l_linenumber", metrics.engagement_weight(F.lit(0.8), F.col("l_quantity"), F.col("l_linenumber").cast("double")).alias("w")))


@query(r"select doc_id, len(t)::int as n, md5(array_to_string(t, ' ')) as digest from (select doc_id, regexp_extract_all(text, '\$?[A-Za-z0-9](?:[A-Za-z0-9&''’+.\-]*[A-Za-z0-9+])?') as t from documents)")
def tokenize(spark, d):
    x = panel.table(spark, d, "documents").select("doc_id", X.tokens(F.col("text")).alias("t"))
    return x.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


# The tables' prose is invented, so the two queries below give meaning to its function words. The values are binary
# fractions, so that sums don't depend on their order.
ENTITIES = [
    resolve.Entity("THE", "Of The", names=("In the",), products=("To",), vetoes=("of the th",), ambiguous_names=("In the",)),
    resolve.Entity("UND", "Der", misspellings=("die und",), subsidiaries=("und der",), previous_tickers=("In",)),
    resolve.Entity("DE", "De La", names=("des", "en el"), ambiguous_ticker=True),
]
CONTEXT = resolve.ContextWords(strong=frozenset({"is", "est"}), finance=frozenset({"and", "et"}), ordinary_products=frozenset({"to"}))
LEXICON = classify.Lexicon(
    values={"the": 0.25, "der": 0.375, "el": 0.5, "le": -0.375, "la": -0.25, "it": -0.625, "on": 1.125, "und": 0.125},
    phrases={("of", "the"): 0.75, ("de", "la"): -0.75},
    intensifiers={"is": 1.5, "die": 0.5},
    negators=frozenset({"or", "und", "et"}),
    hedges=frozenset({"for", "für", "por", "pour"}),
    sarcasm=(("with", "that"),),
    cues={"investment": frozenset({"to"}), "product": frozenset({"and", "des"}), "reputation": frozenset({"was", "las", "in"})},
)


@query()
def entity_mentions(spark, d):
    """Resolution of whole documents, their first line as title; held against recorded results in the tests."""
    x = panel.table(spark, d, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"), F.regexp_replace("text", r"(?s)\A[^\n]*\n?", "").alias("body"))
    x = x.select("doc_id", resolve.resolve(F.col("title"), F.col("body"), ENTITIES, CONTEXT).alias("matches"))
    return resolve.mentions(x).select("doc_id", "entity", "relevance", "ambiguous", F.array_join("reasons", ",").alias("reasons"))


@query()
def entity_rejections(spark, d):
    """Matches by outcome, rejected ones with why, from the table function in SQL; held against a plain scan in the tests."""
    panel.table(spark, d, "documents").createOrReplaceTempView("resolvable_documents")
    spark.udtf.register("resolve_entities", resolve.table_function(ENTITIES, CONTEXT))
    return spark.sql(r"""select doc_id, entity, coalesce(why, 'accepted') as outcome, count(*) as n, min(at) as first_at from resolvable_documents,
        lateral resolve_entities(substring_index(text, '\n', 1), regexp_replace(text, r'(?s)\A[^\n]*\n?', ''), rejected => true) group by all""")


def _lexicon_sql(x: classify.Lexicon) -> str:
    """The classification as list expressions, position by position; phrases are of two tokens and marks of sarcasm alike."""
    of = lambda table: "(case t[i] " + " ".join(f"when '{w}' then {v}" for w, v in table.items()) + " end)"
    at = lambda p, i="i": f"coalesce(t[{i}] = '{p[0]}' and t[{i} + 1] = '{p[1]}', false)"
    some = lambda words: _words_sql(sorted(words))
    phrase = " + ".join(f"(case when {at(p)} then {v} else 0 end)" for p, v in x.phrases.items())
    here = "(" + " or ".join(at(p) for p in x.phrases) + ")"
    taken = f"({here} or (i > 1 and ({' or '.join(at(p, '(i - 1)') for p in x.phrases)})))"
    strong = "(case when i > 1 then coalesce(" + of(x.intensifiers).replace("t[i]", "t[i - 1]") + ", 1.0) else 1.0 end)"
    negated = f"(case when i > 1 and len(list_filter(t[greatest(1, i - 3) : i - 1], lambda w: w in {some(x.negators)} or ends_with(w, 'n''t'))) > 0 then -0.8 else 1.0 end)"
    weight = f"(({phrase}) + (case when not {taken} then coalesce({of(x.values)}, 0.0) else 0.0 end))::double * {strong} * {negated}"
    hit = f"(case when {here} then 1 else 0 end) + (case when not {taken} and {of(x.values)} is not null then 1 else 0 end)"
    marks = " or ".join(at(m) for m in x.sarcasm)
    count = lambda words: f"len(list_filter(t, lambda w: w in {some(words)}))"
    token = r"/s\b|[\x{A9}\x{AE}\x{203C}-\x{2049}\x{2122}\x{2194}-\x{21AA}\x{231A}-\x{27BF}\x{2934}-\x{2B55}\x{1F000}-\x{1FAFF}]|\?|[\p{L}\p{N}$][\p{L}\p{N}''’\-]*"
    cases = {"raw": "coalesce(list_sum(ws), 0.0)::double", "hits": "coalesce(list_sum(hs), 0)"}
    return f"""with a as (select doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '{token}'), lambda w: replace(lower(w), '’', chr(39))) as t from documents),
      b as (select doc_id, t, list_transform(range(1, len(t) + 1), lambda i: {weight}) as ws, list_transform(range(1, len(t) + 1), lambda i: {hit}) as hs, len(list_filter(range(1, len(t) + 1), lambda i: {marks})) > 0 as sarcastic,
        {count(x.hedges)} + (case when list_contains(t, '?') then 1 else 0 end) as hedged, {count(x.cues["investment"])} as ci, {count(x.cues["product"])} as cp, {count(x.cues["reputation"])} as cr from a),
      c as (select *, {cases["raw"]} as raw, {cases["hits"]} as hits from b),
      e as (select *, hedged >= 2 or (hedged >= 1 and abs(raw) < 1.5) as uncertain, case when sarcastic then case when raw = 0 then -0.1 else -0.5 * tanh(raw / 3) end else tanh(raw / 3) end as s from c)
      select doc_id, {O.rnd("s", 3)} as score, case when sarcastic then 'sarcastic' when uncertain and abs(s) < 0.3 then 'uncertain' when s > 0.15 then 'positive' when s < -0.15 then 'negative' else 'neutral' end as label,
        case when greatest(ci, cp, cr) = 0 then 'general' when ci >= cp and ci >= cr then 'investment' when cp >= cr then 'product' else 'reputation' end as aspect,
        {O.rnd("case when hits = 0 then 0.5 else least(1.0, (0.35 + 0.45 * (1 - exp(-hits / 2)) + 0.2 * abs(s)) * (case when sarcastic then 0.5 else 1.0 end) * (case when uncertain then 0.75 else 1.0 end)) end::double", 3)} as confidence from e"""


@query(_lexicon_sql(LEXICON))
def lexicon_sentiment(spark, d):
    """Classification of whole documents."""
    x = panel.table(spark, d, "documents").select("doc_id", classify.classify(F.col("text"), F.lit(None).cast("array<int>"), classify.LexiconClassifier(LEXICON)).alias("s"))
    return x.select("doc_id", "s.score", "s.label", "s.aspect", "s.confidence")


# Views (V1-V12) and sinks

_LAST = "date = (select max(date) from signals)"


def view_rows(spark: SparkSession, d: str, q: ViewQuery = ViewQuery()) -> DataFrame:
    return views.rows(signals(spark, d), panel.universe(spark, d), q)


@query(O.sql(f"select entity, alt_signal_score, confidence from signals where {_LAST} and alt_signal_score is not null order by alt_signal_score desc, entity limit 6", "signals"))
def overview_top(spark, d):
    return views.top(view_rows(spark, d), "alt_signal_score").select("entity", "alt_signal_score", "confidence")


@query(O.sql(f"select count(*) as names, {O.rnd('100.0 * count(*) filter (where alt_signal_score > 50) / nullif(count(alt_signal_score), 0)')} as breadth, count(*) filter (where attention_score >= 90) as unusual, count(*) filter (where anomaly_score >= 95) as anomalies, {O.rnd('avg(confidence)')} as mean_confidence from signals where {_LAST}", "signals"))
def kpis(spark, d):
    return views.kpis(view_rows(spark, d))


@query(O.sql("select b.bin, count(s.entity) as n from range(20) b(bin) left join signals s on s.alt_signal_score is not null and least(19, floor(s.alt_signal_score / 5)) = b.bin group by 1", "signals"))
def histogram20(spark, d):
    return views.histogram(signals(spark, d))


@query(O.sql(f"select date, {O.r6('sum(sentiment_score * greatest(1, confidence)) / sum(greatest(1, confidence))')} as mood, {O.r6('quantile_cont(sentiment_score, 0.25)')} as p25, {O.r6('quantile_cont(sentiment_score, 0.75)')} as p75, {O.r6('avg(attention_score)')} as attention, count(*) as n from signals where sentiment_score is not null group by 1", "signals"))
def mood_series(spark, d):
    return shown(views.mood_series(signals(spark, d)))


@query(
    O.sql(
        f"""select u.sector, count(*) as names, {O.r6('avg(s.alt_signal_score)')} as score, {O.r6('avg(s.sentiment_score)')} as sentiment, {O.r6('avg(s.attention_score)')} as attention, {O.r6('avg(' + O.rnd('s.alt_signal_score - p.alt_signal_score', 1) + ')')} as change
        from universe u left join (select * from signals where {_LAST}) s using (entity) left join (select * from signals where date = (select max(date) - 30 from signals)) p using (entity) group by 1""",
        "signals",
        "universe",
    )
)
def sector_heatmap(spark, d):
    return shown(views.sector_summary(view_rows(spark, d)))


@query(O.sql("select aspect, count(*) as n, count(*) filter (where label = 'positive') as positive, count(*) filter (where label = 'negative') as negative, count(*) filter (where label = 'uncertain') as uncertain from items group by 1", "items"))
def narratives(spark, d):
    return views.narratives(items(spark, d))


@query(r"select lang, term, n, place::int as place from (select *, row_number() over (partition by lang order by n desc, term) as place from (select lang, term, count(*) as n from (select lang, unnest(regexp_split_to_array(text, '[ \n]+')) as term from documents) where term <> '' group by all)) where place <= 6")
def top_terms(spark, d):
    x = panel.table(spark, d, "documents").select("lang", F.split("text", "[ \\n]+").alias("terms"))
    return views.top_terms(x, "lang", "terms")


@query(O.sql("select date, " + ", ".join(f"sum(value) filter (where source = '{s}') as {s}" for s in C.SOURCES) + " from metrics where entity = 'NATION_7' group by 1", "metrics"))
def activity_pivot(spark, d):
    return views.activity_pivot(daily(spark, d), "NATION_7", C.SOURCES)


@query(O.sql(f"select entity, unnest(list_filter([case when alt_signal_score >= 55 and confidence >= 50 then 'bullish' end, case when alt_signal_score <= 45 and confidence >= 50 then 'bearish' end, case when attention_score >= 90 or anomaly_score >= 95 then 'unusual' end, case when divergence >= 60 then 'divergent' end, case when hype_risk <> 'low' then 'hype' end], lambda x: x is not null)) as preset from signals where {_LAST}", "signals"))
def explorer_presets(spark, d):
    return views.presets(view_rows(spark, d))


@query(O.sql("select entity, sector, case when lower(entity) = 'ri' then 0 when starts_with(lower(entity), 'ri') then 1 when starts_with(lower(sector), 'ri') then 2 else 3 end as place from universe where contains(lower(entity), 'ri') or contains(lower(sector), 'ri') order by 3, 1 limit 8", "universe"))
def search_rank(spark, d):
    return views.search(panel.universe(spark, d), "ri").select("entity", "sector", "place")


@query(O.sql(f"select date, alt_signal_score, {O.r6('attention_z')} as attention_z, hype_risk from signals where entity = 'NATION_7' and date > (select max(date) - 90 from signals)", "signals"))
def entity_detail(spark, d):
    x = signals(spark, d).where("entity = 'NATION_7'")
    last = panel.as_of(spark, d)
    return shown(x.join(F.broadcast(last), F.col("date") > F.date_sub("as_of", 90)), "date", "alt_signal_score", "attention_z", "hype_risk")


@query(O.sql("select source, max(date) as latest, count(*) as days, case when max(date) < (select as_of - 2 from last_day) then 'stale' else 'live' end as state from covered group by 1", "covered"))
def source_status(spark, d):
    return views.source_status(panel.covered_days(items(spark, d)), F.lit(panel.last_day(spark, d)))


@query("""select case when regexp_matches(c, '[",]') then '"' || replace(c, '"', '""') || '"' else c end || ',' || p_partkey as line from (select p_partkey, case when regexp_matches(p_name, '^[=+@-]') then '''' || p_name else p_name end as c from part)""")
def csv_export(spark, d):
    return sinks.csv_lines(panel.table(spark, d, "part").select("p_name", "p_partkey"))


# The research run and its parts (V9, B9, B10, A15, A21), pages of entities and the explorer

from tidemark.config import LabParams  # noqa: E402
from tidemark.plans import documents, lab_run  # noqa: E402


def _scenario_sql(names: list[str], rows: str, needs: tuple[str, ...], floor: int = 1) -> str:
    """Dates, mean rank IC and t of every fifth date, by name, of rows (name, date, entity, signal, ret)."""
    rank = lambda c: f"rank() over (partition by name, date order by {c}) + (count(*) over (partition by name, date, {c}) - 1) / 2.0"
    known = lambda e: O.r6(f"case when count(*) >= {floor} then {e} end")
    t = "avg(rank_ic) filter (where apart) / (stddev_samp(rank_ic) filter (where apart) / sqrt(count(rank_ic) filter (where apart)))"
    return O.sql(
        f"""select v.name, coalesce(dates, 0) as dates, mean_rank_ic, t_stat from (values {", ".join(f"('{n}')" for n in names)}) v(name) left join (
        select name, count(*) as dates, {known("avg(rank_ic)")} as mean_rank_ic, {known(t)} as t_stat from (
        select *, (row_number() over (partition by name order by date) - 1) % 5 = 0 as apart from (
        select name, date, covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) as rank_ic from (
        select name, date, {rank("signal")} as a, {rank("ret")} as b, count(*) over (partition by name, date) as n from ({rows})) where n >= 20 group by name, date)) group by name) using (name)""",
        *needs,
    )


_LABELLED = "signals s join returns r on r.entity = s.entity and r.date = s.date and r.horizon = 5 join (select min(date) + 37 as first from signals) on s.date >= first and isodow(s.date) < 6"
_UNIFORM = lambda k: f"((('0x' || substr(md5('42:' || s.date::varchar || ':' || s.entity || ':{k}'), 1, 13))::bigint + 0.5) / 4503599627370496.0)"
_NAMED = lambda name, signal: f"select '{name}' as name, s.date, s.entity, {signal} as signal, floor(r.ret * 1e6 + 0.5) / 1e6 as ret from {_LABELLED} where {signal} is not null"


def _run_sections(spark: SparkSession, d: str, p: LabParams) -> lab_run.Sections:
    """The run's sections, with returns rounded so that ties don't hang on the order of summation."""
    rounded = returns(spark, d).withColumn("ret", S.rounded(F.col("ret"), 6))
    return lab_run.sections_of(rounded, panel.universe(spark, d), lab_run.trading_dates(signals(spark, d), p), p)


@query(_scenario_sql(["random", "attention", "composite"], " union all ".join([_NAMED("random", f"(sqrt(-2 * ln({_UNIFORM(0)})) * cos(2 * pi() * {_UNIFORM(1)}))"), _NAMED("attention", "s.attention_score"), _NAMED("composite", "s.alt_signal_score")]), ("signals", "returns")))
def lab_baselines(spark, d):
    return shown(lab_run.baselines(_run_sections(spark, d, LabParams()), signals(spark, d), 5))


_AT_FLOORS = f"select f::varchar as name, x.* exclude (confidence) from (select s.date, s.entity, s.alt_signal_score as signal, floor(r.ret * 1e6 + 0.5) / 1e6 as ret, s.confidence from {_LABELLED} where s.alt_signal_score is not null) x cross join (values (0), (25), (50), (70)) v(f) where coalesce(x.confidence, 0) >= f"


@query(_scenario_sql(["0", "25", "50", "70"], _AT_FLOORS, ("signals", "returns"), 5))
def lab_sensitivity(spark, d):
    return shown(lab_run.floors(_run_sections(spark, d, LabParams()), signals(spark, d), {"alt_signal_score": 1.0}, 5))


@query()
def lab_removals(spark, d):
    """Leave one source out, five composites; the composite without a source is tested against a frame that never had it."""
    return shown(lab_run.without_sources(_run_sections(spark, d, LabParams()), lambda out: composed(spark, d, exclude=out), {"alt_signal_score": 1.0}, 5))


@query(O.sql(f"select q + 1 as quintile, {O.r6('avg(ret)')} as mean, {O.r6('median(ret)')} as median, count(*) as n from ranked where n >= 20 group by 1", "ranked"))
def pooled_quintiles(spark, d):
    return shown(lab.pooled_quintiles(sections(spark, d)))


@query(
    O.sql(
        f"""select {O.r6("avg(share)")} as coverage, {O.r6("avg(share) filter (where i <= 10)")} as first, {O.r6("avg(share) filter (where i > total - 10)")} as last from (
        select *, row_number() over (order by date) as i, count(*) over () as total from (
        select d.date, coalesce(c.n, 0)::double / (select count(*) from universe) as share from (select distinct date from signals where isodow(date) < 6) d left join (select date, count(*) as n from sections group by 1) c using (date)))""",
        "signals", "sections", "universe",
    )
)
def coverage(spark, d):
    dates = signals(spark, d).select("date").distinct().where(F.weekday("date") < 5)
    return shown(lab.coverage(sections(spark, d), dates, panel.universe(spark, d).count()))


@query()
def lab_report(spark, d):
    """A whole run's summary and verdict; its parts have queries with SQL of their own."""
    tables = lab_run.run(feats(spark, d), signals(spark, d), returns(spark, d), panel.universe(spark, d), LabParams(features=("attention_score",)), mood(spark, d))
    return shown(tables["summary"].withColumn("verdict", F.lit(lab_run.verdict(tables))), "verdict", "dates", "observations", "mean_rank_ic", "t_stat", "mean_spread")


#: What tells items apart: lines of one order and number are items each.
ITEM = ("doc_id", "line")


def _three(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mentions, documents and sentiments as the three tables they are, from the items of text sources."""
    x = items(spark, d).where(F.col("source").isin(*C.TEXT_SOURCES))
    return x.select(*ITEM, "entity", "date", "relevance"), x.select(*ITEM, "source", "community", "status", "score"), x.select(*ITEM, "entity", "label", "aspect", "confidence")


@query(O.sql(f"select doc_id, date, source, community, score, label, aspect, {O.r6('confidence')} as confidence from items where entity = 'NATION_7' and source in ({O.T}) and status = 'unique' and date between (select as_of - 13 from last_day) and (select as_of from last_day) order by score desc, doc_id limit 60", "items", "last_day"))
def entity_items(spark, d):
    last = F.lit(panel.last_day(spark, d))
    return shown(views.items_of(*_three(spark, d), "NATION_7", F.date_sub(last, 13), last, key=ITEM), "doc_id", "date", "source", "community", "score", "label", "aspect", "confidence")


@query(O.sql(f"select aspect, count(*) as items, count(*) filter (where label = 'positive') as positive, count(*) filter (where label = 'negative') as negative, count(*) filter (where label in ('neutral', 'uncertain')) as neutral, count(*) filter (where label = 'sarcastic') as sarcastic from items where entity = 'NATION_7' and source in ({O.T}) and date >= (select as_of - 29 from last_day) group by 1", "items", "last_day"))
def entity_narratives(spark, d):
    found, _, said = _three(spark, d)
    return views.narratives_of(said, found, "NATION_7", F.date_sub(F.lit(panel.last_day(spark, d)), 29), ITEM)


@query(O.sql(f"select s.date, s.alt_signal_score as score, {O.rnd('ret * 100', 2)} as ret from signals s join returns r on r.entity = s.entity and r.date = s.date and r.horizon = 5 where s.entity = 'NATION_7' and s.alt_signal_score is not null", "signals", "returns"))
def score_and_return(spark, d):
    return views.score_and_return(signals(spark, d), returns(spark, d), "NATION_7")


_EVENT_COLUMNS = "entity, date, source, kind"


@query(O.sql(f"select {_EVENT_COLUMNS} from ({_crossings_sql()}) join universe using (entity) where sector <> 'EUROPE' and sector = (select min(sector) from universe) and source in ('reddit', 'cross') order by date desc, entity, source, kind limit 14", "signals", "universe"))
def recent_events(spark, d):
    u = panel.universe(spark, d)
    first = u.agg(F.min("sector").alias("s")).first().s
    return views.latest_events(events.crossings(signals(spark, d)), u, None, None, first, "reddit").select(*_EVENT_COLUMNS.split(", "))


@query(O.sql(f"select entity, alt_signal_score, attention_score, confidence from signals where {_LAST} and alt_signal_score >= 50 and attention_score >= 30 and attention_score is not null and hype_risk is not null order by attention_score desc, entity limit 5", "signals"))
def explorer_page(spark, d):
    """Range filters, an order of one's own, the first page."""
    x = views.explorer(view_rows(spark, d), ranges={"score_min": 50, "attention_min": 30}, sort=("attention_score", False), size=5)
    return x.select("entity", "alt_signal_score", "attention_score", "confidence")


@query(O.sql(f"select entity, sector, hype_risk from universe left join (select * from signals where {_LAST}) using (entity) order by lower(sector) desc, entity limit 10 offset 10", "signals", "universe"))
def explorer_sorted(spark, d):
    """By text with a collation, descending, the second page."""
    return views.explorer(view_rows(spark, d), sort=("sector", False), number=1, size=10).select("entity", "sector", "hype_risk")


@query(O.sql("select source, count(*) filter (where list_contains(sources_available, source)) as names from signals cross join (values " + ", ".join(f"('{s}')" for s in C.SOURCES) + f") v(source) where {_LAST} group by 1", "signals"))
def source_coverage(spark, d):
    return views.source_coverage(signals(spark, d), C.SOURCES)


@query("select p_partkey, '$' || case when p_retailprice * 1e6 >= 1e9 then floor(p_retailprice / 1e3 + 0.5)::bigint || 'B' else floor(p_retailprice + 0.5)::bigint || 'M' end as cap, case when p_size > 25 then '+' else '' end || printf('%.1f', (p_size - 25)::double) as size from part")
def display(spark, d):
    from tidemark.functions import shown as texts

    return panel.table(spark, d, "part").select("p_partkey", texts.capital(F.col("p_retailprice") * 1e6).alias("cap"), texts.signed(F.col("p_size") - 25).alias("size"))


@query(f"select c_custkey, {O.r6('''((('0x' || substr(md5('7:' || c_custkey::varchar || ':0'), 1, 13))::bigint + 0.5) / 4503599627370496.0)''')} as u, (3 + floor((('0x' || substr(md5('7:' || c_custkey::varchar || ':0'), 1, 13))::bigint + 0.5) / 4503599627370496.0 * 8))::bigint as k from customer")
def seeded_draws(spark, d):
    from tidemark.functions import draws

    key = F.col("c_custkey")
    return shown(panel.table(spark, d, "customer").select("c_custkey", draws.uniform(7, key).alias("u"), draws.integer(3, 10, 7, key).alias("k")))


@query()
def document_pipeline(spark, d):
    """Documents cleaned, told apart by language, deduplicated, resolved, classified and counted by day; tested step by step."""
    x = panel.table(spark, d, "documents")
    own = _items(spark, d).drop("text").join(x.select("doc_id", F.lit("").alias("title"), F.col("text").alias("body"), F.lit("reddit").alias("source"), F.lit(1.0).alias("score"), F.lit(0.0).alias("comments")), "doc_id")
    found = documents.mentions(documents.processed(own, ENTITIES, CONTEXT), classify.LexiconClassifier(LEXICON))
    return shown(metrics.daily_text_metrics(found), "entity", "source", "date", "mention_count", "net_sentiment", "dup_ratio")


# Streams (R1-R7)


@query(f"select ts::date as date, event_type, count(*) as n, {O.r6('sum(value)')} as value from events group by all")
def stream_tumbling(spark, d):
    return shown(streams.drain(streams.tumbling(streams.closed(streams.events(spark, d), panel.table(spark, d, "events")))))


@query("select (ts::date + k::int)::date as date, event_type, count(*) as n from events cross join range(7) r(k) group by all")
def stream_sliding(spark, d):
    return streams.drain(streams.sliding(streams.closed(streams.events(spark, d), panel.table(spark, d, "events")))).select("date", "event_type", "n")


@query("select user_id, event_type from events group by all")
def stream_dedupe(spark, d):
    return streams.drain(streams.first_seen(streams.events(spark, d), ["user_id", "event_type"])).select("user_id", "event_type")


@query(
    """with recursive e as (select distinct user_id, event_type, ts::date as date from events),
    k as (select user_id, event_type, min(date) as date from e group by all union all select user_id, event_type, (select min(e.date) from e where e.user_id = k.user_id and e.event_type = k.event_type and e.date > k.date + 7) from k where k.date is not null)
    select user_id, event_type, date from k where date is not null"""
)
def stream_refractory(spark, d):
    return streams.drain(streams.refractory(streams.events(spark, d))).select("user_id", "event_type", F.col("ts").cast("date").alias("date"))


@query(O.sql(shown_sql(f"{KEY} last_observed_date freshness_days available", "feats", "abnormal_z activity7 accel_z sentiment7 sentiment_change"), "feats"))
def stream_refreshed(spark, d):
    """Features kept by a refresh that takes the items in three batches, each with items of any day (R1, V10). Lines of one number are items each."""
    rows, last = items(spark, d).withColumn("doc_id", F.monotonically_increasing_id()), panel.last_day(spark, d)
    base = f"{shared_dir(spark)}/tidemark/refresh-{uuid.uuid4().hex}"
    rows.repartition(3, "doc_id").write.parquet(f"{base}/arriving")
    store = refresh.Store(f"{base}/store", last - datetime.timedelta(C.HISTORY_DAYS + C.LOOKBACK_DAYS - 1), last)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/arriving")
    refresh.follow(stream, panel.universe(spark, d), store, f"{base}/state").awaitTermination()
    return shown(store.table(spark, "features", feats(spark, d).schema), *KEY.split(), "last_observed_date", "freshness_days", "available", "abnormal_z", "activity7", "accel_z", "sentiment7", "sentiment_change")


@query()
def stream_flagged(spark, d):
    """Documents as a stream, each with its status within its language, near copies included (R4); held against the batch form in the tests."""
    documents_ = spark.readStream.schema(panel.table(spark, d, "documents").schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/documents.parquet*")
    return streams.drain(streams.flagged(_as_items(documents_), scope="community")).select(F.col("scope").alias("lang"), "doc_id", "status")


# Paged sources


@query("select event_id::varchar as external_id, event_type as title, ts::date as date, round(value, 6) as score from events where ts::date >= (select max(ts)::date - 9 from events) and event_type <> 'click'")
def paged_search(spark, d):
    """Events as recorded pages of search hits, 100 a page, read back window by window over their last ten days."""
    x = panel.table(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    types, (first, last) = [r[0] for r in x.select("event_type").distinct().collect()], x.agg(F.min("day"), F.max("day")).first()
    hit = F.struct(F.col("event_id").cast("string").alias("objectID"), F.col("event_type").alias("title"), F.col("user_id").cast("string").alias("author"), F.col("value").alias("points"), F.lit(0.0).alias("num_comments"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("created_at_i"))
    window = Window.partitionBy("event_type", "day")
    numbered = x.select(F.col("event_type").alias("entity"), "day", hit.alias("hit"), F.floor((F.row_number().over(window.orderBy("event_id")) - 1) / 100).cast("int").alias("page"), F.ceil(F.count("*").over(window) / 100).alias("nbPages"))
    pages = numbered.groupBy("entity", "day", "page").agg(F.to_json(F.struct(F.collect_list("hit").alias("hits"), F.first("page").alias("page"), F.first("nbPages").alias("nbPages"))).alias("json"))
    base = f"{shared_dir(spark)}/tidemark/recorded-{uuid.uuid4().hex}"
    pages.write.partitionBy("entity", "day").parquet(base)
    source = paged.paged("recorded_search", paged.Recorded(base, last), paged.by_number)
    raw = paged.read_pages(spark, source, types, first, last).where((F.col("since") >= F.lit(last - datetime.timedelta(9))) & (F.col("entity") != "click"))
    found = providers.parse_search_hits(raw, "salt")
    return found.select("external_id", "title", F.col("published_at").cast("date").alias("date"), F.round("engagement.score", 6).alias("score"))


# Runs, quality events, entity build, per-source views

from tidemark.operators import quality  # noqa: E402
from tidemark.plans import ledger  # noqa: E402
from tidemark.sources import entities  # noqa: E402

_KEPT = f"source in ({O.T}) and date > (select as_of - {C.RETENTION_DAYS} from last_day) and relevance >= {C.MIN_RELEVANCE}"


@query(
    O.sql(
        f"""select v.source, n.name, coalesce(case n.name when 'documents' then documents when 'kept' then kept else observations end, 0) as value from (values {", ".join(f"('{s}')" for s in C.SOURCES)}) v(source)
        cross join (values ('documents'), ('kept'), ('observations')) n(name) left join (select source, count(*) filter (where source in ({O.T})) as documents,
        count(*) filter (where {_KEPT}) as kept, count(*) filter (where source not in ({O.T})) as observations from items group by 1) using (source)""",
        "items", "last_day",
    )
)
def run_totals(spark, d):
    """Items written by source as a run, and what the ledger says of it: totals gathered by the tasks that wrote."""
    last = panel.last_day(spark, d)
    text = F.col("source").isin(*C.TEXT_SOURCES)
    kept = text & (F.col("date") > F.date_sub(F.lit(last), C.RETENTION_DAYS)) & (F.col("relevance") >= C.MIN_RELEVANCE)
    book = ledger.Ledger(spark)
    with book.run("ingest", {"end": str(last)}, {"composite": C.COMPOSITE_VERSION}) as run:
        run.write(items(spark, d), f"{shared_dir(spark)}/tidemark/ingested-{run.id}", ledger.by_source(C.SOURCES, {"documents": text, "kept": kept, "observations": ~text}), by=["source"])
        run.meta["as_of"] = str(last)
    return book.totals().where(F.col("run_id") == run.id).select(F.substring_index("name", ".", 1).alias("source"), F.substring_index("name", ".", -1).alias("name"), "value")


@query(
    O.sql(
        f"""select entity, source, severity, kind, date from (
        select entity, source, case when count(*) > 3 then 'warning' else 'info' end as severity, 'coverage_gap' as kind, min(date) as date from (
            select u.entity, s.source, d.date from universe u cross join (select distinct source from items) s cross join days d except select entity, source, date from items) group by 1, 2
        union all select entity, source, 'warning', 'stale', max(date) from items group by 1, 2 having max(date) < (select as_of - {C.STALE_AFTER} from last_day))""",
        "universe", "days", "items", "last_day",
    )
)
def quality_events(spark, d):
    """Gaps and stale data of every entity, by source (K5)."""
    rows, last = items(spark, d), panel.last_day(spark, d)
    states = panel.universe(spark, d).select("entity").crossJoin(rows.select("source").distinct()).select("entity", "source", F.lit("live").alias("state"), F.lit(None).cast("string").alias("reason"))
    found = quality.quality_events(rows, states, ["entity", "source"], last - datetime.timedelta(C.HISTORY_DAYS + C.LOOKBACK_DAYS - 1), last)
    return found.select("entity", "source", "severity", "kind", "date")


@query(O.sql(f"select 'attention_z' as feature, 5 as horizon, q + 1 as quintile, {O.r6('avg(ret)')} as mean, {O.r6('median(ret)')} as median, count(*) as n from ranked where n >= 20 group by q", "ranked"))
def stored_run(spark, d):
    """A research run's quintiles, stored with its parameters and found again by its id."""
    book, home = ledger.Ledger(spark), f"{shared_dir(spark)}/tidemark/lab"
    run_id = lab_run.keep(book, {"quintiles": lab.pooled_quintiles(sections(spark, d))}, LabParams(features=("attention_z",)), home)
    _, p, tables = lab_run.look_up(book, home, run_id)
    return shown(tables["quintiles"].select(F.lit(p.features[0]).alias("feature"), F.lit(p.horizon).alias("horizon"), "*"))


@query(
    r"""with c as (select 'S' || s_suppkey as entity, case s_suppkey % 4 when 0 then 'The ' || s_name || ' Holdings, Inc.' when 1 then s_name || ' & Co.' when 2 then s_name || ' Group plc' else s_name end as name, n_name as sector from supplier join nation on s_nationkey = n_nationkey),
    k as (select *, trim(regexp_replace(regexp_replace(name, '^The\s+', '', 'i'), '(,?\s+(Inc\.?|Holdings|Group|plc|& Co\.?)){1,3}$', '', 'i')) as derived from c),
    f as (select 'S' || (c_custkey % 40) as entity, string_agg('C' || c_custkey, ';' order by 'C' || c_custkey) as previous from customer group by 1)
    select k.entity, sector, case when p_name is null or p_name = derived then derived else p_name || ';' || derived end as short_names, coalesce(p_brand, '') as products, coalesce(lower(p_type), '') as exclusions,
      length(k.entity) <= 2 as ambiguous_ticker, coalesce(f.previous, '') as previous, derived as search_term
    from k left join part on k.entity = 'S' || p_partkey left join f on f.entity = k.entity"""
)
def entity_build(spark, d):
    """Suppliers as companies with legal forms, parts as overrides, customers as former tickers."""
    t = lambda n: panel.table(spark, d, n)
    key, name = F.col("s_suppkey"), F.col("s_name")
    full = F.when(key % 4 == 0, F.concat(F.lit("The "), name, F.lit(" Holdings, Inc."))).when(key % 4 == 1, F.concat(name, F.lit(" & Co."))).when(key % 4 == 2, F.concat(name, F.lit(" Group plc"))).otherwise(name)
    ticker = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    companies = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(ticker("S", key).alias("entity"), full.alias("name"), F.col("n_name").alias("sector"))
    overrides = t("part").select(ticker("S", F.col("p_partkey")).alias("entity"), F.array("p_name").alias("short_names"), F.array("p_brand").alias("products"), F.array("p_type").alias("exclusions"))
    former = t("customer").select(ticker("S", F.col("c_custkey") % 40).alias("entity"), ticker("C", F.col("c_custkey")).alias("ticker"))
    lists = ("short_names", "products", "exclusions", "previous")
    return entities.entities(companies, overrides, former).select("entity", "sector", "ambiguous_ticker", "search_term", *[F.array_join(c, ";").alias(c) for c in lists])


@query(
    r"""with w as (select doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ws from documents),
    g as (select doc_id, unnest(list_distinct(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])))) as r from w),
    a as (select distinct lower(unnest([ws[1], array_to_string(ws[1:2], ' ')])) as alias from w where len(ws) > 0),
    n as (select alias, count(distinct doc_id) filter (where r = alias) as plain, count(distinct doc_id) filter (where r <> alias) as cased from a left join g on lower(r) = alias group by alias)
    select alias, plain, cased, plain > 0 and plain * 2 >= plain + cased as ambiguous from n"""
)
def alias_ambiguity(spark, d):
    """The first word and the first two words of each document as aliases, and how all documents write them."""
    docs = panel.table(spark, d, "documents").select("text")
    names = docs.select(F.explode(F.array(*[F.regexp_extract("text", p, 0) for p in (entities.WORD, rf"{entities.WORD}(?:{entities.GAP}{entities.WORD})?")])).alias("alias"))
    return entities.alias_use(names, docs)


_BY_SOURCE = {"dev_acceleration": O._ok("github", "accel_z"), "community_breadth": O._ok("reddit", "breadth7")}


@query(O.sql(f"select feature, entity, count(*) as n, {O.r6('avg(value)')} as mean from ({' union all '.join(f'''select '{f}' as feature, entity, {_BY_SOURCE.get(f, f)} as value from signals''' for f in lab.FEATURES)}) where value is not null group by 1, 2", "signals"))
def feature_catalogue(spark, d):
    """All features that a run can test, unpivoted, by entity (B2)."""
    return shown(lab.catalogue(signals(spark, d)).groupBy("feature", "entity").agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


@query(O.sql(f"select source, date, mention_count, {O.r6('value')} as value, {O.r6('net_sentiment')} as net_sentiment from metrics where entity = 'NATION_7' and source <> 'github' and date between (select as_of - 29 from last_day) and (select as_of from last_day)", "metrics", "last_day"))
def source_view(spark, d):
    """An entity's last thirty days by source, one source being turned off (V5)."""
    last = F.lit(panel.last_day(spark, d))
    return shown(views.source_days(daily(spark, d), "nation_7", F.date_sub(last, 29), last, ("github",)), "source", "date", "mention_count", "value", "net_sentiment")


_STATES_SQL = "(select source, case when max(date) < (select as_of - 2 from last_day) then 'stale' else 'live' end as state from covered group by 1)"


@query(O.sql(f"select f.entity, f.source, state, true as expected, false as available from feats f join expected using (entity, date) left join {_STATES_SQL} using (source) where date = (select max(date) from feats) and list_contains(expected, f.source) and not coalesce(available, false)", "feats", "expected", "covered", "last_day"))
def unused_sources(spark, d):
    """Sources expected of an entity that give nothing on the last day."""
    rows = feats(spark, d)
    return views.unused_sources(rows, composite.expected_sources(rows), source_status(spark, d))


@query(O.sql(f"select case when bool_and(state = 'live') then 'live' when bool_or(state in ('unavailable', 'stale')) then 'stale' else 'demo' end as state from {_STATES_SQL}", "covered", "last_day"))
def overall_state(spark, d):
    """One state of all sources."""
    return views.overall_state(source_status(spark, d))


@query(O.sql("select sector, " + ", ".join(f"{O.r6('avg(abnormal_z) filter (where source = ' + repr(s) + ')')} as {s}" for s in C.SOURCES) + " from feats join universe using (entity) group by 1", "feats", "universe"))
def sector_by_source(spark, d):
    """Mean attention by sector, a column for each source."""
    return views.sector_by_source(feats(spark, d), panel.universe(spark, d), C.SOURCES)


@query(O.sql(f"select entity, sector, alt_signal_score, confidence from universe left join (select * from signals where {_LAST}) using (entity) order by coalesce(alt_signal_score, -1) desc, entity limit 12", "signals", "universe"))
def ranked_table(spark, d):
    """The overview's table."""
    return views.ranked_table(view_rows(spark, d)).select("entity", "sector", "alt_signal_score", "confidence")
