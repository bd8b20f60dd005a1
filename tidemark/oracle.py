"""Equivalent DuckDB SQL of the queries, put together from common table expressions."""

from __future__ import annotations

from tidemark import config as C

T = "'reddit', 'hackernews'"
OUT = "floor(({}) * 1e6 + 0.5) / 1e6"


def r6(x: str) -> str:
    return OUT.format(x)


def r4(x: str) -> str:
    return f"floor(({x}) * 10000.0 + 0.5) / 10000.0"


def rnd(x: str, digits: int = 0) -> str:
    p = 10.0**digits
    return f"floor(({x}) * {p} + 0.5) / {p}"


def cdf(z: str) -> str:
    t = f"(1.0 / (1.0 + 0.3275911 * (abs({z}) / sqrt(2.0))))"
    x = f"(abs({z}) / sqrt(2.0))"
    erf = f"(1.0 - ((((({t} * 1.061405429 - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t}) * exp(-{x} * {x}))"
    return f"(case when {z} >= 0 then (1.0 + {erf}) / 2.0 else (1.0 - {erf}) / 2.0 end)"


def clip(x: str, a: float, b: float) -> str:
    return f"(case when ({x}) is not null then least({b}, greatest({a}, {x})) end)"


ASPECT_CASE = " ".join(f"when '{a}' then {w}" for a, w in C.ASPECT_WEIGHTS.items())
DAYS = C.HISTORY_DAYS + C.LOOKBACK_DAYS

CTE: dict[str, str] = {
    "last_day": "select max(o_orderdate)::date as as_of from orders",
    "universe": """select n_name as entity, r_name as sector, coalesce(cap, 0.0) as cap, row_number() over (order by round(coalesce(cap, 0.0), 2) desc, n_name)::int as rank
      from nation join region on n_regionkey = r_regionkey left join (select c_nationkey, sum(c_acctbal) as cap from customer group by 1) on c_nationkey = n_nationkey""",
    "items": f"""select l_orderkey * 10 + l_linenumber as doc_id, n_name as entity, r_name as sector,
        case o_orderpriority when '1-URGENT' then 'reddit' when '2-HIGH' then 'hackernews' when '3-MEDIUM' then 'wikipedia' when '4-NOT SPECIFIED' then 'search' when '5-LOW' then 'github' end as source,
        l_shipdate::date as date, o_custkey as author, p_brand as community,
        case when l_tax > 0.065 then 'near_duplicate' when l_tax < 0.005 then 'bot_repeat' else 'unique' end as status,
        l_linestatus = 'O' as ambiguous, 0.8::double as relevance, l_quantity as score, l_linenumber::double as comments, (0.05::double - l_discount) * 20 as polarity,
        case when (0.05::double - l_discount) * 20 > 0.3 then 'positive' when (0.05::double - l_discount) * 20 < -0.3 then 'negative' else 'uncertain' end as label,
        ['investment', 'product', 'reputation', 'general'][l_linenumber % 4 + 1] as aspect, 0.5::double + l_linenumber / 20.0::double as confidence
      from lineitem, last_day, orders, supplier, nation, region, part
      where l_orderkey = o_orderkey and l_suppkey = s_suppkey and s_nationkey = n_nationkey and n_regionkey = r_regionkey and l_partkey = p_partkey
        and l_shipdate::date > as_of - {DAYS} and l_shipdate::date <= as_of""",
    "weighted": f"""select *, sw * case aspect {ASPECT_CASE} end as aw, case when label = 'uncertain' then 0.0 else polarity end as polar
      from (select *, w * confidence as sw from (select *, relevance * (1 + ln(1 + greatest(score, 0.0)) / 2 + ln(1 + greatest(comments, 0.0)) / 4) as w from items where source in ({T}) and relevance >= 0.5))""",
    "communities": """select entity, source, date, sum(pow(c / t, 2)) as hhi, count(*) as community_count from (
        select entity, source, date, count(*) as c, sum(count(*)) over (partition by entity, source, date) as t from weighted where status = 'unique' and community is not null group by entity, source, date, community) group by 1, 2, 3""",
    "sums": """select entity, source, date, count(*) filter (where status = 'unique') as docs, count(*) filter (where status = 'bot_repeat') as bot,
        count(*) filter (where status not in ('unique', 'bot_repeat')) as dup, count(*) filter (where status = 'unique' and ambiguous) as amb,
        count(distinct case when status = 'unique' then author end) as authors, coalesce(sum(w) filter (where status = 'unique'), 0.0) as engagement,
        sum(aw) filter (where status = 'unique') as wt, sum(aw * polar) filter (where status = 'unique') as net, sum(aw * confidence) filter (where status = 'unique') as conf,
        coalesce(sum(aw) filter (where status = 'unique' and label = 'positive'), 0.0) as pos, coalesce(sum(aw) filter (where status = 'unique' and label = 'negative'), 0.0) as neg,
        sum(sw * polar) filter (where status = 'unique' and aspect = 'investment') / sum(sw) filter (where status = 'unique' and aspect = 'investment') as investment,
        sum(sw * polar) filter (where status = 'unique' and aspect = 'product') / sum(sw) filter (where status = 'unique' and aspect = 'product') as product,
        sum(sw * polar) filter (where status = 'unique' and aspect = 'reputation') / sum(sw) filter (where status = 'unique' and aspect = 'reputation') as reputation
      from weighted group by 1, 2, 3""",
    "covered": "select distinct source, date from items",
    "metrics": f"""select u.entity, c.source, c.date, coalesce(docs, 0)::double as value, coalesce(docs, 0)::bigint as mention_count, coalesce(authors, 0)::bigint as unique_authors,
        {r4("coalesce(engagement, 0.0)")} as engagement_adj, {r4("coalesce(wt, 0.0)")} as sentiment_weight, {r4("net / wt")} as net_sentiment, {r4("pos / wt")} as pos_share, {r4("neg / wt")} as neg_share,
        {r4("conf / wt")} as sentiment_confidence, investment as investment_sentiment, product as product_sentiment, reputation as reputation_sentiment,
        {r4("coalesce(dup::double / nullif(docs + dup + bot, 0), 0.0)")} as dup_ratio, {r4("coalesce(bot::double / nullif(docs + dup + bot, 0), 0.0)")} as bot_ratio,
        {r4("coalesce(amb::double / nullif(docs, 0), 0.0)")} as ambiguity_ratio, coalesce(community_count, 0)::bigint as community_count, {r4("hhi")} as community_hhi
      from (select * from covered where source in ({T})) c cross join universe u
        left join sums s on s.entity = u.entity and s.source = c.source and s.date = c.date left join communities h on h.entity = u.entity and h.source = c.source and h.date = c.date
      union all by name select entity, source, date, sum(score) as value from items where source not in ({T}) group by 1, 2, 3""",
    "days": f"select unnest(generate_series(as_of - {DAYS - 1}, as_of, interval 1 day))::date as date from last_day",
    "spine": """select u.entity, s.source, d.date, m.* exclude (entity, source, date), m.entity is not null as observed
      from universe u cross join (select distinct source from metrics) s cross join days d left join metrics m on m.entity = u.entity and m.source = s.source and m.date = d.date""",
    "leveled": f"select *, case when observed then ln(1 + case when source in ({T}) then coalesce(engagement_adj, value) else value end) end as level from spine",
    "short": """select *, case when count(level) over w >= 4 then avg(level) over w end as m7 from leveled
      window w as (partition by entity, source order by date rows between 6 preceding and current row)""",
    "based": """select *, list_filter(list(m7) over b, lambda x: x is not null) as baseline, stddev_samp(m7) over b as base_sd, stddev_samp(level) over b as day_sd,
        avg(level) over (o rows between 2 preceding and current row) as recent, count(level) over (o rows between 2 preceding and current row) as n_recent,
        avg(level) over (o rows between 9 preceding and 3 preceding) as prior, count(level) over (o rows between 9 preceding and 3 preceding) as n_prior,
        max(case when observed then date end) over (o rows between unbounded preceding and current row) as last_observed_date, count(level) over w as obs_short, avg(value) over w as activity7
      from short window o as (partition by entity, source order by date), b as (partition by entity, source order by date rows between 36 preceding and 7 preceding), w as (partition by entity, source order by date rows between 6 preceding and current row)""",
    "centered": "select *, coalesce(len(baseline), 0) as obs_baseline, list_aggregate(baseline, 'median') as center, (date - last_observed_date)::int as freshness_days from based",
}


def _shrunk(c: str, frame: str, k: float) -> str:
    on = f"{c} is not null and coalesce(sentiment_weight, 0.0) > 0"
    total = f"sum(case when {on} then sentiment_weight end) over {frame}"
    return f"(case when {total} > 0 then sum(case when {on} then {c} * sentiment_weight end) over {frame} / ({total} + {k}) end)"


def _by_mentions(v: str) -> str:
    n = f"case when {v} is not null then mention_count end"
    return f"(sum({v} * ({n})) over w / nullif(sum({n}) over w, 0))"


_TEXT = f"source in ({T}) and obs_short > 0"
_SAID = f"{_TEXT} and coalesce(sum(mention_count) over w, 0) >= 3"
CTE["feats"] = f"""select *, sentiment7 - sentiment_prev7 as sentiment_change from (select entity, source, date, observed, mention_count, value, obs_short, obs_baseline, last_observed_date, freshness_days, activity7,
    case when m7 is not null and obs_baseline >= 20 then {clip("(m7 - center) / greatest(coalesce(list_aggregate(list_transform(baseline, lambda x: abs(x - center)), 'median') * 1.4826, 0.0), coalesce(base_sd, 0.0), 0.08)", -4.0, 4.0)} end as abnormal_z,
    case when m7 is not null and obs_baseline >= 20 and n_recent >= 2 and n_prior >= 4 then {clip("(recent - prior) / (greatest(coalesce(day_sd, 0.0), 0.08) / sqrt(2.0))", -4.0, 4.0)} end as accel_z,
    m7 is not null and obs_baseline >= 20 and coalesce(freshness_days <= 7, false) as available,
    case when {_TEXT} then coalesce(sum(mention_count) over w, 0)::bigint end as mentions7, case when {_TEXT} then coalesce(sum(unique_authors) over w, 0)::bigint end as authors7,
    case when {_TEXT} then coalesce(sum(engagement_adj) over w, 0.0) end as engagement7,
    case when {_SAID} then {_shrunk("net_sentiment", "w", 4.0)} end as sentiment7,
    case when {_TEXT} and coalesce(sum(mention_count) over p, 0) >= 3 then {_shrunk("net_sentiment", "p", 4.0)} end as sentiment_prev7,
    {", ".join(f"case when {_SAID} then {_shrunk(c, 'w', 0.0)} end as {c}7" for c in ("pos_share", "neg_share", "sentiment_confidence"))},
    {", ".join(f"case when {_SAID} then {_shrunk(c + '_sentiment', 'w', 6.0)} end as {c}7" for c in ("investment", "product", "reputation"))},
    {", ".join(f"case when {_TEXT} then {_by_mentions(c + '_ratio')} end as {c}7" for c in ("dup", "bot", "ambiguity"))},
    case when {_TEXT} then {_by_mentions("(case when community_hhi > 0 then 1.0 / community_hhi end)")} end as breadth7
  from centered window w as (partition by entity, source order by date rows between 6 preceding and current row), p as (partition by entity, source order by date rows between 13 preceding and 7 preceding))"""

CTE["expected"] = f"""select entity, date, list(source order by source) filter (where ever) as expected from (
    select entity, source, date, max(coalesce(case when source in ({T}) then mention_count > 0 else observed end, false)) over (partition by entity, source order by date rows between unbounded preceding and current row) as ever from feats) group by 1, 2"""
_FIELDS = ("available", "abnormal_z", "accel_z", "freshness_days", "mentions7", "sentiment7", "sentiment_change", "investment7", "product7", "dup7", "bot7", "ambiguity7", "breadth7")
CTE["wide"] = "select entity, date, " + ", ".join(f"max({f}) filter (where source = '{s}') as {s}_{f}" for s in C.SOURCES for f in _FIELDS) + " from feats group by 1, 2"


def _ok(s: str, f: str) -> str:
    return f"(case when coalesce({s}_available, false) then {s}_{f} end)"


def _tx(s: str, f: str) -> str:
    return f"(case when coalesce({s}_freshness_days <= 7, false) then {s}_{f} end)"


def _wm(pairs: list[tuple[str, float]]) -> str:
    return f"(({' + '.join(f'coalesce({v} * {w}::double, 0.0)' for v, w in pairs)}) / nullif({' + '.join(f'(case when {v} is not null then {w}::double else 0.0 end)' for v, w in pairs)}, 0.0))"


def _avg(vs: list[str]) -> str:
    return f"list_aggregate([{', '.join(vs)}], 'avg')"


CTE["pre"] = "select *, " + ", ".join(
    [
        _wm([(_ok(s, "abnormal_z"), C.ATTENTION_WEIGHTS[s]) for s in C.SOURCES]) + " as attention_z",
        _wm([(_ok(s, "accel_z"), C.ATTENTION_WEIGHTS[s]) for s in C.SOURCES]) + " as accel_raw",
        *[_wm([(_tx(s, f), C.SENTIMENT_WEIGHTS[s]) for s in C.TEXT_SOURCES]) + f" as {n}" for f, n in (("sentiment7", "sentiment"), ("sentiment_change", "sentiment_change_raw"), ("product7", "pooled_product"), ("investment7", "pooled_investment"))],
        f"list_filter([{', '.join(_ok(s, 'abnormal_z') for s in C.SOURCES)}], lambda x: x is not null) as zs",
        f"list_filter([{', '.join(_tx(s, 'sentiment7') for s in C.TEXT_SOURCES)}], lambda x: x is not null) as sents",
        f"list_filter([{', '.join(f'''(case when coalesce({s}_available, false) then '{s}' end)''' for s in C.SOURCES)}], lambda x: x is not null) as sources_available",
        " + ".join(f"coalesce({_tx(s, 'mentions7')}, 0)" for s in C.TEXT_SOURCES) + " as text_mentions7",
        *[f"coalesce({_avg([_tx(s, f) for s in C.TEXT_SOURCES])}, 0.0) as {n}" for f, n in (("dup7", "dup"), ("bot7", "bots"), ("ambiguity7", "amb"))],
        f"coalesce(list_aggregate([{', '.join(f'(case when coalesce({s}_available, false) then coalesce({s}_freshness_days, 7) end)' for s in C.SOURCES)}], 'max'), 7) as worst_fresh",
    ]
) + " from wide left join expected using (entity, date)"
CTE["crossed"] = """select *, (accel_raw - avg(accel_raw) over d) / nullif(stddev_samp(accel_raw) over d, 0.0) as accel, (sentiment_change_raw - avg(sentiment_change_raw) over d) / nullif(stddev_samp(sentiment_change_raw) over d, 0.0) as sent_chg
  from pre window d as (partition by date)"""
_GAP = "(case when len(sents) >= 2 then abs(sents[1] - sents[2]) end)"
_ATT = f"(1 - {clip('''list_aggregate(zs, 'stddev_pop') / 2''', 0.0, 1.0)})"
CTE["factors"] = f"""select *, case when len(zs) >= 2 then {rnd(f"100 * case when {_GAP} is null then {_ATT} else 0.6 * {_ATT} + 0.4 * (1 - {clip(_GAP + ' / 0.5', 0.0, 1.0)}) end")} end as agreement,
    case when len(zs) >= 2 then {rnd(f"100 * greatest({clip('''(list_aggregate(zs, 'max') - list_aggregate(zs, 'min') - 1.5) / 4.5''', 0.0, 1.0)}, coalesce({clip(f'({_GAP} - 0.15) / 0.6', 0.0, 1.0)}, 0.0))")} end as divergence,
    coalesce(len(sources_available)::double / nullif(len(expected), 0), 0.0) as coverage, 1 - exp(-(text_mentions7 + 8 * len(list_filter(sources_available, lambda x: x not in ({T})))) / 40.0::double) as sample,
    exp(-greatest(0, worst_fresh - 2) / 3.0::double) as freshness, 1 - {clip("0.5 * dup + bots + 0.5 * amb", 0.0, 0.9)} as quality, coalesce(tanh(4 * sentiment), 0.0) as tone from crossed"""
_UN = _avg([_ok(s, "abnormal_z") for s in C.UNUSUAL_SOURCES])
CTE["parts"] = f"""select *, case when len(sources_available) > 0 then {rnd("100 * pow(coverage, 0.35) * pow(sample, 0.3) * pow(freshness, 0.15) * pow(quality, 0.2)")} else 0.0 end as confidence,
    case when attention_z is not null then tanh(greatest(0.0, attention_z) / 2) * tone end as abnormal_attention, tanh(2.5 * sentiment) as sentiment_part,
    case when accel is not null then tanh(greatest(0.0, accel) / 2) * tone end as attention_acceleration_part, tanh(sent_chg / 2) as sentiment_acceleration,
    case when len(zs) >= 2 then case when len(list_filter(zs, lambda z: z > 0.5)) >= 2 then len(list_filter(zs, lambda z: z > 0.5))::double / len(zs) * tone else 0.0 end end as confirmation,
    case when {_UN} is not null then tanh(greatest(0.0, {_UN}) / 2) * tone end as unusual_source from factors"""
_PARTS = {"abnormal_attention": 0.25, "sentiment_part": 0.30, "attention_acceleration_part": 0.20, "sentiment_acceleration": 0.10, "confirmation": 0.10, "unusual_source": 0.05}
_AW = "[" + ", ".join(f"(case when coalesce({s}_available, false) then {w}::double end)" for s, w in C.ATTENTION_WEIGHTS.items()) + "]"
_LONE = " or ".join(
    f"(coalesce({s}_available, false) and coalesce({s}_abnormal_z, 0.0) >= 3 and " + " and ".join(f"(not coalesce({o}_available, false) or coalesce({o}_abnormal_z, 0.0) < 1)" for o in C.SOURCES if o != s) + ")" for s in C.SOURCES
)
_HITS = {"tiny_sample": "text_mentions7 < 15", "duplicates": "dup > 0.3", "single_source": f"(len(sources_available) <= 1 or coalesce(list_aggregate({_AW}, 'max') / list_aggregate({_AW}, 'sum'), 1.0) > 0.8)", "stale": "freshness < 0.6", "ambiguity": "amb > 0.3", "bots": "bots > 0.15", "hype": f"({_LONE})"}
CTE["penalised"] = f"""select *, least(0.8, {" + ".join(f"(case when {h} then {C.PENALTIES[k][1]}::double else 0.0 end)" for k, h in _HITS.items())}) as penalty_total,
    list_filter([{", ".join(f"(case when {h} then '{k}' end)" for k, h in _HITS.items())}], lambda x: x is not null) as penalty_keys,
    {" + ".join(f"coalesce({p} * {w}::double, 0.0)" for p, w in _PARTS.items())} as raw, {_ok("reddit", "abnormal_z")} - coalesce({_avg([_ok(s, "abnormal_z") for s in C.SOURCES if s != "reddit"])}, 0.0) as crowding,
    list_filter(list_append(zs, sent_chg), lambda x: x is not null) as tests from parts"""
_SOME = " or ".join(f"{p} is not null" for p in _PARTS)
_MOST = "list_aggregate(list_transform(tests, lambda x: abs(x)), 'max')"
_RZ = _ok("reddit", "abnormal_z")
CTE["signals"] = f"""select *, case when {_SOME} then {rnd(f"50 + 50 * {clip('raw * sqrt(confidence / 100) * (1 - penalty_total)', -1.0, 1.0)}", 1)} end as alt_signal_score,
    case when {_SOME} then {rnd(f"50 + 50 * {clip('raw', -1.0, 1.0)}", 1)} end as raw_score, case when attention_z is not null then {rnd("100 * " + cdf("attention_z"), 1)} end as attention_score, {rnd("100 * tanh(2.5 * sentiment)", 1)} as sentiment_score,
    {rnd("accel", 2)} as attention_acceleration, {rnd("sent_chg", 2)} as sentiment_change,
    case when len(tests) > 0 then {rnd(f"100 * (1 - least(1.0, len(tests) * 2 * (1 - {cdf(_MOST)})))", 1)} end as anomaly_score,
    case when coalesce(({_RZ} >= 3 and crowding >= 2) or ({_RZ} >= 2 and bots > 0.15), false) then 'high' when {_RZ} >= 2 and crowding >= 1.25 then 'elevated' else 'low' end as hype_risk,
    case when text_mentions7 >= 15 then {rnd("pooled_product - pooled_investment", 2)} end as product_divergence, {rnd("crowding", 2)} as retail_crowding, {_ok("wikipedia", "abnormal_z")} as wiki_shock, {_ok("search", "accel_z")} as search_acceleration from penalised"""

CTE["prices"] = """select n_name as entity, l_shipdate::date as date, avg(l_extendedprice / l_quantity) as close from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
  where isodow(l_shipdate::date) < 6 group by 1, 2"""
CTE["led"] = "select entity, date, close, " + ", ".join(f"lead(date, {h}) over w as d{h}, lead(close, {h}) over w as c{h}" for h in C.HORIZONS) + " from prices window w as (partition by entity order by date)"
CTE["entries"] = "select s.entity, s.date, min(p.date) as entry_date from (select distinct entity, date from signals) s join prices p on p.entity = s.entity and p.date > s.date group by 1, 2"
CTE["returns"] = " union all ".join(f"select e.entity, e.date, {h} as horizon, e.entry_date, l.d{h} as exit_date, l.c{h} / l.close - 1 as ret from entries e join led l on l.entity = e.entity and l.date = e.entry_date where l.c{h} is not null and l.close > 0" for h in C.HORIZONS)
CTE["sections"] = """select s.date, s.entity, u.sector, floor(s.attention_z * 1e6 + 0.5) / 1e6 as signal, floor(r.ret * 1e6 + 0.5) / 1e6 as ret, (select count(*) from universe) as eligible from signals s join universe u using (entity) join returns r on r.entity = s.entity and r.date = s.date and r.horizon = 5
  where s.attention_z is not null and isodow(s.date) < 6"""
CTE["ranked"] = """select *, count(*) over (partition by date) as n, rank() over (partition by date order by signal) + (count(*) over (partition by date, signal) - 1) / 2.0 as sr, rank() over (partition by date order by ret) + (count(*) over (partition by date, ret) - 1) / 2.0 as rr,
    floor((row_number() over (partition by date order by signal, entity) - 1) * 5 / count(*) over (partition by date))::int as q, median(signal) over (partition by date) as ms, median(ret) over (partition by date) as mr from sections"""
CTE["stats"] = """select date, count(*) as n, covar_pop(signal, ret) / nullif(stddev_pop(signal) * stddev_pop(ret), 0) as ic, covar_pop(sr, rr) / nullif(stddev_pop(sr) * stddev_pop(rr), 0) as rank_ic,
    avg(ret) filter (where q = 0) as q1, avg(ret) filter (where q = 1) as q2, avg(ret) filter (where q = 2) as q3, avg(ret) filter (where q = 3) as q4, avg(ret) filter (where q = 4) as q5,
    count(*) filter (where signal <> ms and ret <> mr and (signal > ms) = (ret > mr))::double / nullif(count(*) filter (where signal <> ms and ret <> mr), 0) as hit_rate,
    list(entity order by entity) filter (where q = 4) as top, list(entity order by entity) filter (where q = 0) as bottom from ranked where n >= 20 group by date"""
CTE["apart"] = "select *, (row_number() over (order by date) - 1) % 5 = 0 as apart, row_number() over (order by date) - 1 as i, count(*) over () as nd, q5 - q1 as spread from stats"

_RANKS = lambda c: f"rank() over (partition by name, date order by {c}) + (count(*) over (partition by name, date, {c}) - 1) / 2.0"
CTE["rivals"] = " union all ".join(
    f"select '{f}' as name, s.date, s.entity, floor(s.{f} * 1e6 + 0.5) / 1e6 as signal, floor(r.ret * 1e6 + 0.5) / 1e6 as ret from signals s join returns r on r.entity = s.entity and r.date = s.date and r.horizon = 5 where s.{f} is not null and isodow(s.date) < 6"
    for f in ("attention_z", "alt_signal_score")
)
CTE["candidates"] = f"""select name, date, covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) as rank_ic from (
    select name, date, {_RANKS("signal")} as a, {_RANKS("ret")} as b, count(*) over (partition by name, date) as n from rivals) where n >= 20 group by name, date"""
CTE["cuts"] = """select *, ceil((n - first) / 4)::bigint as size from (select date, row_number() over (order by date) - 1 as i, count(*) over () as n, greatest(20, floor(count(*) over () * 0.4))::bigint as first from (select distinct date from candidates))"""
CTE["folds"] = """select f.fold::int as fold, c.name, avg(rank_ic) filter (where i < first + size * fold) as train_ic, avg(rank_ic) filter (where i >= first + size * fold) as test_ic, count(rank_ic) filter (where i >= first + size * fold) as test_dates
    from candidates c join cuts d using (date) cross join range(4) f(fold) where first + size * fold < n and i < first + size * (fold + 1) group by 1, 2"""

NEEDS = {
    "items": ["last_day"], "weighted": ["items"], "communities": ["weighted"], "sums": ["weighted"], "covered": ["items"], "metrics": ["covered", "universe", "sums", "communities", "items"], "days": ["last_day"],
    "spine": ["universe", "metrics", "days"], "leveled": ["spine"], "short": ["leveled"], "based": ["short"], "centered": ["based"], "feats": ["centered"], "expected": ["feats"], "wide": ["feats"], "pre": ["wide", "expected"],
    "crossed": ["pre"], "factors": ["crossed"], "parts": ["factors"], "penalised": ["parts"], "signals": ["penalised"], "led": ["prices"], "entries": ["signals", "prices"], "returns": ["entries", "led"],
    "sections": ["signals", "universe", "returns"], "ranked": ["sections"], "stats": ["ranked"], "apart": ["stats"],
    "rivals": ["signals", "returns"], "candidates": ["rivals"], "cuts": ["candidates"], "folds": ["cuts"],
}


def sql(select: str, *needs: str) -> str:
    """``select`` after the expressions it needs, in order, each materialised once."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in needs:
        add(n)
    return ("with " + ", ".join(f"{n} as materialized ({CTE[n]})" for n in order) + " " if order else "") + select
