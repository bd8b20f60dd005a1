"""Queries and operators do the whole of their job: no prefix, no bound on rounds, no task that takes all rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark import queries as Q
from tidemark.operators import classify, dedupe


def test_sentiment_reads_whole_documents(spark, tmp_path):
    pad = "plain words without a value " * 20
    ends = ["le le le", "on on on", "on des", "und on", "la la for", "on with that", "is on in las", ""]
    rows = [(i, pad + e) for i, e in enumerate(ends)] + [(100, "on"), (101, ""), (102, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in Q.QUERIES["lexicon_sentiment"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    own = classify.LexiconClassifier(Q.LEXICON)
    for i, text in rows:
        v = own.classify(text)
        assert tuple(got[i])[1:] == (v.score, v.label, v.aspect, v.confidence)
    # these labels and aspects are due to words after the first 200 characters
    assert got[0].label == "negative" and got[1].label == "positive" and got[3].label == "negative" and got[5].label == "sarcastic"
    assert got[2].aspect == "product" and got[6].aspect == "reputation"


def chain(n, seed=1):
    """Fingerprints each near (2 or 3 bits) only the ones before and after."""
    r, out = random.Random(seed), [0]
    while len(out) < n:
        new = out[-1]
        for bit in r.sample(range(64), r.choice([2, 3])):
            new ^= 1 << bit
        if all((new ^ x).bit_count() > 3 for x in out[:-1]):
            out.append(new)
    return [x - (1 << 64) if x >> 63 else x for x in out]


def test_long_chains_of_near_copies_are_decided(spark, monkeypatch):
    fps = chain(90)
    monkeypatch.setattr(dedupe.X, "simhash", lambda text: F.regexp_extract(text, r"(-?\d+)$", 1).cast("long"))
    rows = [(i, None, "c", f"a{i % 3}", f"version {i} of the text {fp}", dt.datetime(2026, 1, 1) + dt.timedelta(minutes=i)) for i, fp in enumerate(fps)]
    df = spark.createDataFrame(rows, "doc_id long, url string, community string, author_hash string, text string, published_at timestamp")
    got = {r.doc_id: r.status for r in dedupe.statuses(df).collect()}
    # every second version repeats the one before, which is retained; an author's second is a bot_repeat
    seen, expected = set(), {}
    for i in range(len(fps)):
        expected[i] = "unique" if i % 2 == 0 else "bot_repeat" if i % 3 in seen else "near_duplicate"
        if i % 2:
            seen.add(i % 3)
    assert got == expected


@pytest.mark.parametrize("name", ["exact_dedupe", "near_dedupe", "mad"])
def test_no_task_takes_the_rows_of_a_common_key(spark, name):
    plan = Q.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "collect_list" not in plan


def test_statuses_of_null_and_common_keys(spark):
    schema = "doc_id long, url string, community string, author_hash string, text string, published_at timestamp"
    at = lambda i: dt.datetime(2026, 1, 1) + dt.timedelta(minutes=i)
    rows = [(0, "http://x/1", None, "u", "one text about a river", at(5)), (1, "http://x/1", None, "u", "two text about a mill", at(6)), (2, "http://x/1", "b", None, "three", at(7)), (3, None, "b", None, "One text, about a river!", at(8)), (4, None, "b", None, None, at(8)), (5, None, "b", None, "short", at(9)), (6, None, "b", None, "short", at(9)), (7, None, "b", "u", "one text about a river", at(4)), (8, None, "b", "u", "one text about a river", at(10))]
    got = {r.doc_id: r.status for r in dedupe.statuses(spark.createDataFrame(rows, schema)).collect()}
    # 7 is the earliest of the text; 0 and 8 are by one author
    assert got == {7: "unique", 0: "duplicate_exact", 1: "duplicate_url", 2: "crosspost", 3: "duplicate_exact", 4: "unique", 5: "unique", 6: "unique", 8: "bot_repeat"}
