"""The pairs of near fingerprints are met by shuffles at any size."""

from pyspark.sql import functions as F

from tidemark import queries as Q
from tidemark.operators import dedupe


def test_no_side_of_the_pairs_is_sent_to_all(spark):
    x = spark.range(400).select(F.xxhash64("id").alias("fp"))
    x = x.union(x.select(F.col("fp").bitwiseXOR(F.lit(0b1011 << 20)))).union(x.limit(50).select(F.col("fp").bitwiseXOR(F.lit(0b11011 << 40))))
    pairs = dedupe.candidate_pairs(x)
    got = {(r.fp, r.fp2) for r in pairs.collect()}
    fps = [r.fp for r in x.collect()]
    assert got == {(a, b) for a in fps for b in fps if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= dedupe.MAX_BITS} and len(got) >= 800
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_originals_send_no_side_of_the_pairs(spark, monkeypatch):
    made, real = [], dedupe.candidate_pairs
    monkeypatch.setattr(dedupe, "candidate_pairs", lambda *a: made.append(real(*a)) or made[-1])
    text = F.concat(F.lit("one text of some length, number "), F.col("id"))
    rows = spark.range(60).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("url"), F.lit("c").alias("community"), F.lit("a").alias("author_hash"), text.alias("text"), F.timestamp_seconds("id").alias("published_at"))
    assert dedupe.originals(rows).count() == 60
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in made]
    assert plans and all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in plans)


def test_the_document_pipeline_sends_no_side_of_the_pairs(spark, monkeypatch):
    made, real = [], dedupe.candidate_pairs
    monkeypatch.setattr(dedupe, "candidate_pairs", lambda *a: made.append(real(*a)) or made[-1])
    assert Q.QUERIES["document_pipeline"](spark, "/root/testdata/sf0.001").count() > 0
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in made]
    assert plans and all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in plans)
