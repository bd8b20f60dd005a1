"""Behaviour on small fixtures: point-in-time features, labels, events, research statistics, duplicates, resolution."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions import stats as S
from tidemark.functions import text as X
from tidemark.operators import classify, composite, dedupe, events, features, lab, labels, metrics, resolve
from tidemark.plans import views
from tidemark.sources import providers, sinks

DAY = dt.date(2026, 1, 1)
day = lambda i: DAY + dt.timedelta(days=i)
METRIC = "entity string, source string, date date, value double, mention_count long, unique_authors long, engagement_adj double, sentiment_weight double, net_sentiment double, pos_share double, neg_share double, sentiment_confidence double, investment_sentiment double, product_sentiment double, reputation_sentiment double, dup_ratio double, bot_ratio double, ambiguity_ratio double, community_count long, community_hhi double"


def series(spark, values, source="wikipedia", entity="A"):
    """values: {day number: value}"""
    rows = [(entity, source, day(i), float(v)) + (None,) * 16 for i, v in values.items()]
    return spark.createDataFrame(rows, METRIC)


def feats(spark, m, n):
    days = spark.createDataFrame([(day(i),) for i in range(n)], "date date")
    return features.source_features(features.on_spine(m, days, m.select("entity").distinct()))


def test_spike_clips_and_future_rows_change_nothing(spark):
    r = random.Random(1)
    base = {i: 10 + r.random() for i in range(80)} | {79: 10_000}
    at = lambda m: {x.date: x for x in feats(spark, m, 80).collect()}
    a, b = at(series(spark, base)), at(series(spark, {**base, **{i: 500 for i in range(61, 80)}}))
    assert a[day(79)].abnormal_z == C.Z_CLIP and a[day(79)].available
    assert a[day(5)].abnormal_z is None and not a[day(5)].available
    assert all(a[day(i)] == b[day(i)] for i in range(61))


def test_gap_is_missing_and_zero_is_not(spark):
    base = {i: 10 for i in range(60)}
    gap = {x.date: x for x in feats(spark, series(spark, {i: v for i, v in base.items() if i < 49}), 60).collect()}[day(59)]
    assert gap.abnormal_z is None and not gap.available and gap.freshness_days == 11
    zero = {x.date: x for x in feats(spark, series(spark, {**base, **{i: 0 for i in range(49, 60)}}), 60).collect()}[day(59)]
    assert zero.abnormal_z == -C.Z_CLIP and zero.available and zero.freshness_days == 0


def test_zero_rows_only_on_covered_days(spark):
    item = lambda **k: {"entity": "A", "source": "reddit", "date": day(0), "author": 1, "community": "c", "status": "unique", "ambiguous": False, "relevance": 0.9, "score": 0.0, "comments": 0.0, "polarity": 0.5, "label": "positive", "aspect": "general", "confidence": 0.5, **k}
    rows = spark.createDataFrame([item(), item(author=2), item(status="near_duplicate"), item(relevance=0.1)], "entity string, source string, date date, author long, community string, status string, ambiguous boolean, relevance double, score double, comments double, polarity double, label string, aspect string, confidence double")
    entities = spark.createDataFrame([("A",), ("B",)], "entity string")
    covered = spark.createDataFrame([("reddit", day(0)), ("reddit", day(2))], "source string, date date")
    got = {(r.entity, r.date): r for r in metrics.daily_source_metrics(rows, entities, covered).collect()}
    assert set(got) == {(e, day(i)) for e in "AB" for i in (0, 2)}
    a = got["A", day(0)]
    assert (a.mention_count, a.unique_authors, a.community_hhi) == (2, 2, 1.0) and a.dup_ratio == pytest.approx(1 / 3, abs=1e-4)
    assert got["B", day(2)].mention_count == 0 and got["B", day(2)].net_sentiment is None


def test_excluding_a_source_equals_never_having_had_it(spark):
    r, parts = random.Random(2), []
    for e in "ABC":
        for s in C.SOURCES:
            text = s in C.TEXT_SOURCES
            for i in range(60):
                v = float(r.randrange(5, 30))
                parts.append((e, s, day(i), v) + ((int(v), int(v), v, v, r.uniform(-1, 1), 0.3, 0.2, 0.5, 0.1, 0.2, 0.3, 0.1, 0.0, 0.1, 3, 0.4) if text else (None,) * 16))
    f = feats(spark, spark.createDataFrame(parts, METRIC), 60)
    show = ["entity", "date", "alt_signal_score", "confidence", "agreement", "anomaly_score", "hype_risk"]
    out = composite.composite(f, composite.expected_sources(f), exclude=("reddit",)).select(*show)
    never = f.where("source <> 'reddit'")
    other = composite.composite(never, composite.expected_sources(never)).select(*show)
    assert sorted(map(str, out.collect())) == sorted(map(str, other.collect()))
    full = composite.composite(f, composite.expected_sources(f)).where(F.col("date") == day(59)).collect()
    for x in full:
        assert sum(v or 0 for v in x.contributions) == pytest.approx(x.raw) and 0 <= x.confidence <= 100
    assert sum(C.component_weights({"sentiment": -1}).values()) == pytest.approx(1) and C.component_weights({"sentiment": -1})["sentiment"] == 0


def test_refractory_is_greedy(spark):
    rows = spark.createDataFrame([("A", "s", "k", day(i), 1.0) for i in (1, 3, 8, 9, 9, 20)] + [("B", "s", "k", day(3), 1.0)], "entity string, source string, kind string, date date, z double")
    got = sorted((r.entity, (r.date - DAY).days) for r in events.refractory(rows).collect())
    assert got == [("A", 1), ("A", 9), ("A", 20), ("B", 3)]


def test_labels_enter_strictly_after_and_stop_at_the_last_price(spark):
    # Thursday to Wednesday
    dates = [dt.date(2026, 1, d) for d in (1, 2, 5, 6, 7)]
    prices = spark.createDataFrame([("A", d, 100.0 + 10 * i) for i, d in enumerate(dates)], "entity string, date date, close double")
    ask = spark.createDataFrame([("A", dt.date(2026, 1, d)) for d in (1, 2, 3, 6, 7)], "entity string, date date")
    got = {(r.date.day, r.horizon): (r.entry_date.day, r.exit_date.day, r.ret) for r in labels.forward_returns(prices, ask, (1, 2)).collect()}
    assert got[1, 1] == (2, 5, pytest.approx(120 / 110 - 1)) and got[3, 1][:2] == got[2, 1][:2] == (5, 6)
    assert got[3, 2][:2] == (5, 7) and (6, 1) not in got and (7, 1) not in got


def planted(spark, beta, n_dates=12, names=60, seed=3):
    r = np.random.default_rng(seed)
    rows = []
    for t in range(n_dates):
        for i in range(names):
            s = float(r.normal())
            rows.append((day(7 * t), f"n{i:02d}", f"g{i % 5}", s, float(beta * s * 0.01 + r.normal() * 0.01), names))
    return spark.createDataFrame(rows, "date date, entity string, sector string, signal double, ret double, eligible int")


def test_planted_and_null_relations(spark):
    s = lab.summary(lab.date_stats(planted(spark, 1.0)), 1).first()
    assert s.mean_rank_ic > 0.3 and s.t_stat > 5 and s.bootstrap_low > 0
    z = lab.summary(lab.date_stats(planted(spark, 0.0, 40)), 1).first()
    assert abs(z.mean_rank_ic) < 0.06 and z.bootstrap_low < z.bootstrap_high
    assert lab.date_stats(planted(spark, 1.0, names=19)).count() == 0
    g = lab.group_ic(planted(spark, 1.0), 1).collect()
    assert len(g) == 5 and all(x.mean_rank_ic > 0.2 for x in g)


def test_quintiles_steps_splits_and_turnover(spark):
    stats = lab.date_stats(planted(spark, 1.0, 10, 22))
    row = stats.first()
    assert len(row.bottom) == 5 and len(row.top) == 4  # floor(5 i / 22)
    assert sum(r.apart for r in lab.with_steps(stats, 5).collect()) == 2
    got = [r.split for r in lab.splits(stats).orderBy("date").collect()]
    assert got == ["calibration"] * 6 + ["validation"] * 2 + ["test"] * 2
    rows = spark.createDataFrame([(day(0), 0.1, ["a", "b"], ["c"]), (day(1), -0.5, ["b", "d"], ["c"])], "date date, spread double, top array<string>, bottom array<string>")
    curve = lab.spread_curve(rows, 1).orderBy("date").collect()
    assert curve[1].turnover_top == 0.5 and curve[1].turnover_bottom == 0 and curve[1].cumulative == pytest.approx(-0.45) and curve[1].drawdown == pytest.approx(-0.5)


def test_walk_forward_picks_on_the_past_and_keeps_dates_aligned(spark):
    rows = [("good", day(i), -0.3) for i in range(60)] + [("bad", day(i), 0.01) for i in range(60) if i % 3]
    got = lab.walk_forward(spark.createDataFrame(rows, "candidate string, date date, rank_ic double"), 1).orderBy("fold").collect()
    assert [r.candidate for r in got] == ["good"] * 4 and all(r.sign == -1 and r.test_ic == pytest.approx(0.3) for r in got)
    assert sum(r.test_dates for r in got) == 60 - 24


def test_constant_series_has_no_correlation(spark):
    x = spark.createDataFrame([(1.0, float(i)) for i in range(5)], "a double, b double")
    assert x.agg(S.pearson(F.col("a"), F.col("b")).alias("r"), S.t_stat(F.col("a")).alias("t")).first() == (None, None)
    y = spark.createDataFrame([([3.0, 1.0, 2.0, 10.0],), ([],)], "v array<double>").select(S.median(F.col("v")).alias("m"), S.mad(F.col("v")).alias("d")).collect()
    assert y[0].m == 2.5 and y[0].d == pytest.approx(1.4826) and y[1].m is None
    assert spark.range(1).select(S.rounded(F.lit(-2.5)).alias("r")).first().r == -2


def test_text_functions(spark):
    one = lambda f, *v: spark.createDataFrame([v], ", ".join(f"c{i} string" for i in range(len(v)))).select(f(*[F.col(f"c{i}") for i in range(len(v))]).alias("x")).first().x
    assert one(X.clean_text, "<script>a</script><b>x</b>&amp;lt;&nbsp;y​z\x07") == "x &lt; yz"
    assert one(X.canonical_url, "HTTPS://www.Ex.com/A/?utm_x=1&b=2&ref=3#f") == "https://ex.com/A?b=2" and one(X.canonical_url, "no url") is None
    assert one(X.language, "el perro de la casa y los gatos que viven en la calle").lang == "other"
    assert one(X.language, "el perro de la casa y los gatos que viven en la calle").confidence == 0.95 and one(X.language, "the cats sat there sleeping").confidence == pytest.approx(0.8)
    assert one(X.language, "\u0440\u0435\u043a\u0430 " * 9).confidence == 0.9 and one(X.language, "les th\u00e9s " * 8).lang == "other"
    assert one(X.language, "the cat of the house is in the street and it was there").lang == "en" and one(X.language, "hi").lang == "unknown"
    assert one(lambda c: X.preview(c, 3), "abcdef") == "ab…" and one(lambda c: X.preview(c, 3), "abc") == "abc"
    a, b = "the quick brown fox jumps over the lazy dog again and again near the old river bank today", "the quick brown fox jumps over the lazy dog again and again near the old river bank tonight"
    assert one(lambda x, y: X.hamming(X.simhash(x), X.simhash(y)), a, a + " !!") == 0 and one(lambda x, y: X.hamming(X.simhash(x), X.simhash(y)), a, b) < 20


def slow_statuses(items):
    urls, texts, kept, flagged, out = {}, set(), [], {}, {}
    for i, _, canon, norm, community, author, fp in items:
        status = "unique"
        if canon is not None and "://reddit.com/r/" in canon:
            canon = None
        if canon is not None and canon in urls:
            status = "duplicate_url" if urls[canon] == community else "crosspost"
        else:
            if canon is not None:
                urls[canon] = community
            if len(norm) >= 12:
                if norm in texts:
                    status = "duplicate_exact"
                else:
                    texts.add(norm)
                    if any((fp ^ k).bit_count() <= 3 for k in kept):
                        status = "near_duplicate"
                    else:
                        kept.append(fp)
        if status in ("duplicate_exact", "near_duplicate") and author is not None:
            flagged[author] = flagged.get(author, 0) + 1
            if flagged[author] >= 2:
                status = "bot_repeat"
        out[i] = status
    return out


def test_duplicates_against_a_sequential_model(spark, monkeypatch):
    r, rows = random.Random(5), []
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(r.choice(words) for _ in range(30)) for _ in range(25)]
    for i in range(160):
        t = r.choice(texts).split()
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            t[r.randrange(len(t))] = r.choice(words)
        rows.append((i, r.choice([None, None, None, f"http://x/{r.randrange(30)}", f"https://www.reddit.com/r/a/{r.randrange(4)}"]), r.choice("ab"), r.choice(["u1", "u2", None]), " ".join(t) if i % 20 else "short", dt.datetime(2026, 1, 1) + dt.timedelta(minutes=i // 2)))
    df = spark.createDataFrame(rows, "doc_id long, url string, community string, author_hash string, text string, published_at timestamp")
    model = df.select("doc_id", "published_at", X.canonical_url(F.col("url")).alias("canon"), X.normalised(F.col("text")).alias("norm"), "community", "author_hash", X.simhash(F.col("text")).alias("fp")).orderBy("published_at", "doc_id").collect()
    expected = slow_statuses([(m.doc_id, m.published_at, m.canon, m.norm, m.community, m.author_hash, m.fp & (1 << 64) - 1) for m in model])
    got = {x.doc_id: x.status for x in dedupe.statuses(df).collect()}
    assert got == expected and len(set(expected.values())) >= 5


LISTS = resolve.ContextWords(strong=frozenset("stake calls".split()), finance=frozenset("profit".split()), ordinary_products=frozenset({"lamp"}), generic=frozenset({"works"}))
NAMES = [
    resolve.Entity("ORR", "Orrin Works", names=("Orrin",), products=("Lanterna", "Lamp"), vetoes=("orrin street",), ambiguous_names=("Orrin",), misspellings=("Orin Works",), previous_tickers=("OW",)),
    resolve.Entity("MET", "Metrova", products=("Metrova Cloud",), subsidiaries=("Skydock",), ambiguous_ticker=True),
    resolve.Entity("QLO", "Qualo"),
    resolve.Entity("ZED", "Zedra Bank"),
    resolve.Entity("YAK", "Yakima"),
]


def test_resolution_by_its_rules():
    r = resolve.Resolver(NAMES, LISTS)
    found = lambda t, b="": [(m.entity, m.reason) for m in r.matches(t, b)]
    assert found("", "I bought $qlo and QLO today, not qlo") == [("QLO", "cashtag"), ("QLO", "ticker")]
    assert found("orrin works grows") == [("ORR", "name")]
    assert found("Orrin spoke") == [] and found("orrin profit") == [] and found("Orrin profit") == [("ORR", "name+context")]
    assert found("Orrin spoke of the Lanterna") == [("ORR", "product"), ("ORR", "name+context")]  # own product elsewhere
    assert found("lanterna") == [] and found("Lamp") == [] and found("Lamp profit") == [("ORR", "product+context")] and found("lamp profit") == []
    assert found("Orrin Street profit and Orrin Works") == [] and found("aqualo Qualox") == []  # a veto reaches over what is near
    assert found("Orrin Street " + "x " * 60 + "Orrin Works") == [("ORR", "name")]
    assert found("MET us there") == [] and found("MET profit") == [] and found("MET stake") == [("MET", "ticker+context")] and found("MET and Metrova") == [("MET", "name"), ("MET", "ticker+context")]
    assert found("THEY ALL SHOUT ABOUT MET STAKE AND MORE AND MORE") == [] and found("$MET THEY ALL SHOUT ABOUT AND MORE AND MORE") == [("MET", "cashtag")]
    assert found("metrova cloud") == [("MET", "product")] and found("Skydock") == [("MET", "subsidiary")] and found("orin works") == [("ORR", "misspelling")]
    assert found("OW holders") == [("ORR", "previous_ticker")] and found("ow") == [] and r.matches(None, None) == []
    m = r.matches("Qualo", "and Metrova’s Skydock")
    assert [(x.text, x.at, x.in_title) for x in m] == [("Qualo", 0, True), ("Skydock", 20, False)]


WORDS = classify.Lexicon(
    values={"good": 1.0, "grand": 2.0, "poor": -1.5, "sold": -1.0},
    phrases={("to", "the", "top"): 2.5},
    intensifiers={"very": 1.5},
    negators=frozenset({"not"}),
    hedges=frozenset({"maybe", "perhaps"}),
    sarcasm=(("/s",), ("yeah", "right")),
    cues={"investment": frozenset({"stake", "sold"}), "product": frozenset({"app"}), "reputation": frozenset({"court"})},
)


def test_classification_by_its_rules():
    of = classify.LexiconClassifier(WORDS).classify
    three = lambda x: math.floor(x * 1000 + 0.5) / 1000
    assert of("very good app")[:3] == (three(math.tanh(0.5)), "positive", "product") and of("very good app").direction is None
    assert of("very good stake").direction == "bullish" and of("sold").direction == "bearish" and of("stake").direction == "neutral"
    assert of("not good").score == three(math.tanh(-0.8 / 3)) and of("not good").negated and of("isn\u2019t very good").score == three(math.tanh(-1.2 / 3))
    assert of("not a b c good").score > 0  # beyond three tokens
    assert of("to the top").terms == ["to the top"] and of("to the top").score == three(math.tanh(2.5 / 3))
    assert of("grand /s").label == "sarcastic" and of("grand /s").score == three(-0.5 * math.tanh(2 / 3)) and of("yeah right").score == -0.1
    assert of("maybe good").uncertain and of("maybe good").label == "positive" and of("maybe not good").label == "uncertain"
    assert not of("maybe grand").uncertain and of("maybe perhaps grand").uncertain and of("grand? ?").uncertain is False
    assert of("app stake").aspect == "investment" and of("court app").aspect == "product" and of("nothing").aspect == "general"
    assert of(None)[:5] == (0.0, "neutral", "general", 0.5, None) and of("constructor").confidence == 0.5
    assert of("good").confidence == three(0.35 + 0.45 * (1 - math.exp(-0.5)) + 0.2 * math.tanh(1 / 3))
    long = "poor " * 40 + "x " * 60 + "Qualo is good"
    assert of(long).score < 0 < of(long, [long.index("Qualo")]).score


def test_mentions_are_diluted(spark):
    rows = spark.createDataFrame([(1, "Orrin Works and Metrova and Qualo", ""), (2, "$QLO $QLO", ""), (3, "", "Orrin Works Metrova Qualo Zedra Bank Yakima YAK"), (4, None, None)], "doc_id long, title string, body string")
    found = resolve.mentions(rows.select("doc_id", resolve.resolve(F.col("title"), F.col("body"), NAMES, LISTS).alias("matches")))
    got = {(r.doc_id, r.entity): r for r in found.collect()}
    assert got[1, "ORR"].relevance == pytest.approx(0.765) and got[2, "QLO"].relevance == 1.0 and got[3, "ZED"].relevance == pytest.approx(0.51)
    assert got[3, "YAK"].relevance == pytest.approx(round((0.9 + 0.03) * 0.6, 3)) and got[3, "YAK"].reasons == ["name", "ticker"] and not got[3, "YAK"].ambiguous and len(got) == 9
    order = {r.doc_id: [m.entity for m in r.mentions] for r in resolve.by_relevance(found).collect()}
    assert order[3][0] == "YAK" and order[1] == ["MET", "ORR", "QLO"]


def test_recorded_mentions_of_the_query():
    """Results for the query's entities, worked out by hand."""
    from tidemark import queries as Q

    r = resolve.Resolver(Q.ENTITIES, Q.CONTEXT)
    assert [(m.entity, m.reason, m.text) for m in r.matches("", "It is In the house of the man. To be and To go.")] == [("THE", "name", "of the"), ("THE", "name+context", "In the"), ("THE", "product+context", "To"), ("THE", "product+context", "To")]
    assert [(m.entity, m.reason) for m in r.matches("Der Tag und der Abend", "In DE la vie")] == [("UND", "name"), ("UND", "subsidiary"), ("UND", "previous_ticker"), ("DE", "name")]
    assert r.matches("", "of the thing") == [] and [m.reason for m in r.matches("", "de est DE")] == ["ticker+context"]


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w"), (3, "w")], "k int, v string")
    assert sorted(map(tuple, sinks.merged(a, b.unionByName(spark.createDataFrame([(3, "v")], "k int, v string")), ["k"]).collect())) == [(1, "x"), (2, "z"), (3, "w")]
    assert [tuple(r) for r in sinks.insert_ignore(a, b, ["k"]).collect()] == [(3, "w")]
    path = str(tmp_path / "t")
    for rows in ([("d1", 1), ("d2", 2)], [("d2", 9)], [("d2", 9)]):
        sinks.replace_partitions(spark.createDataFrame(rows, "date string, v int"), path, ["date"])
    assert sorted((r.date, r.v) for r in spark.read.parquet(path).collect()) == [("d1", 1), ("d2", 9)]
    lines = [r.line for r in sinks.csv_lines(spark.createDataFrame([("=1+1", -2.5, ["a", "b"], None), ('q"', 1.0, [], "a,b")], "a string, b double, c array<string>, d string")).collect()]
    assert lines == ["'=1+1,-2.5,a;b,", '"q""",1.0,,"a,b"']


def test_providers(spark):
    raw = spark.createDataFrame([("A", '{"items":[{"article":"A","timestamp":"2026010300","views":7}]}')], "ticker string, json string")
    assert providers.parse_page_views(raw).first().asDict() == {"source_id": "wikipedia", "ticker": "A", "date": day(2), "value": 7.0}
    raw = spark.createDataFrame([("A", '[{"type":"x","created_at":"2026-01-03T10:00:00Z"},{"type":"x","created_at":"2026-01-03T23:00:00Z"}]')], "ticker string, json string")
    assert providers.parse_events(raw).first().value == 2.0
    raw = spark.createDataFrame([('{"hits":[{"objectID":"1","title":"t","author":"a","created_at_i":5},{"objectID":"1","title":"t","author":"a","created_at_i":5}]}',)], "json string")
    assert providers.parse_search_hits(raw, "salt").count() == 1
    assert providers.registry({}, {"reddit"})["reddit"].fetch(spark, None, "", "").documents.count() == 0
    spark.dataSource.register(providers.SyntheticNumeric)
    x = spark.read.format("synthetic_numeric").option("tickers", "A,B").option("days", "5").load()
    assert x.count() == 10 and x.where("value < 0").count() == 0
    rows = [("AA-B", "Alpha Inc. Class B", "t", "NYSE", "US", 5.0, False), ("AA", "Alpha Inc", "t", "NYSE", "US", 9.0, False), ("ET", "Some ETF", "t", "NYSE", "US", 99.0, True), ("ZZ", "Zed Corp", "t", "NASDAQ", "US", 7.0, False)]
    u = providers.select_universe(spark.createDataFrame(rows, "symbol string, companyName string, sector string, exchangeShortName string, country string, marketCap double, isEtf boolean").withColumns({"isFund": F.lit(False), "isActivelyTrading": F.lit(True)}))
    assert [(r["rank"], r.ticker) for r in u.orderBy("rank").collect()] == [(1, "AA"), (2, "ZZ")]


def test_views_and_parameters(spark):
    q = C.ViewQuery.parse({"window": "12", "source": "nope", "min_confidence": "x"})
    assert (q.window, q.source, q.min_confidence) == (30, "all", 0.0)
    with pytest.raises(ValueError):
        C.LabParams(horizon=3)
    x = spark.createDataFrame([(0.0,), (4.9,), (100.0,), (None,)], "alt_signal_score double")
    got = {r.bin: r.n for r in views.histogram(x).collect()}
    assert got[0] == 2 and got[19] == 1 and len(got) == 20 and sum(got.values()) == 3
    assert lab.verdict(0.1, 2.5, 0.2) == "supported" and lab.verdict(0.1, 2.5, -0.2) == "not supported" and lab.verdict(None, 1, 1) == "inconclusive"
    assert math.isclose(spark.range(1).select(S.norm_cdf(F.lit(1.96)).alias("p")).first().p, 0.975, abs_tol=1e-4)
