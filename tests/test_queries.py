"""Every query with SQL is held against DuckDB on the small tables."""

import datetime

import duckdb
import pytest

from tidemark import queries as Q

D = "/root/testdata/sf0.001"
#: One query for each layer runs here; the driver compares all of them.
LAYERS = ["universe", "gap_intervals", "daily_source_metrics", "hhi", "anti_gap_days", "cross_zero_fill", "self_lag_join", "attention_z", "shrunk_sentiment", "quality_ratios", "composite_score", "penalties", "events_crossing", "refractory", "forward_returns", "quantile_type7", "mad", "normcdf", "clean_html", "canonical_url", "lang_detect", "exact_dedupe", "author_hash", "tokenize", "top_terms", "csv_export", "search_rank", "overview_top", "histogram20", "explorer_presets", "stream_tumbling", "stream_sliding", "stream_dedupe", "stream_refractory", "lexicon_sentiment", "lab_baselines", "lab_sensitivity", "pooled_quintiles", "coverage", "entity_items", "entity_narratives", "score_and_return", "recent_events", "explorer_page", "explorer_sorted", "source_coverage", "display", "seeded_draws", "engagement", "walk_forward", "entity_build", "alias_ambiguity", "run_totals", "quality_events", "feature_catalogue", "source_view", "unused_sources", "overall_state", "sector_by_source", "ranked_table"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages".split():
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v.isoformat() if isinstance(v, datetime.date) else v


@pytest.mark.parametrize("name", LAYERS)
def test_query_equals_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, D)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    found = duck.execute(Q.ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)
