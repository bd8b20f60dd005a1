"""Streams with state variables against their batch forms."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark import queries as Q
from tidemark.operators import dedupe
from tidemark.streaming import streams

SCHEMA = "doc_id long, url string, community string, author_hash string, text string, published_at timestamp, source string"


@pytest.fixture(scope="module")
def rows():
    r, out = random.Random(8), []
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(r.choice(words) for _ in range(30)) for _ in range(20)]
    for i in range(150):
        t = r.choice(texts).split()
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            t[r.randrange(len(t))] = r.choice(words)
        text = "short" if i % 20 == 0 else None if i % 33 == 0 else "" if i % 31 == 0 else " ".join(t)
        out.append((i, r.choice([None, None, f"http://x/{r.randrange(20)}", "https://www.reddit.com/r/a/1"]), r.choice(["a", "b", None]), r.choice(["u1", "u2", None]), text, dt.datetime(2026, 1, 1) + dt.timedelta(minutes=i // 2), r.choice("st")))
    return out


@pytest.mark.parametrize("sizes", [(150,), (40, 1, 9, 100)])
def test_flagging_equals_the_batch_form_under_any_split(spark, tmp_path, rows, sizes):
    at, got = 0, []
    for n in sizes:
        spark.createDataFrame(rows[at : at + n], SCHEMA).repartition(3).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        at += n
        stream = spark.readStream.schema(SCHEMA).parquet(f"file://{tmp_path}/in")
        run = streams.flagged(stream).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    got = {(r.scope, r.doc_id): r.status for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    wanted = {}
    for scope in "st":
        part = spark.createDataFrame([r for r in rows if r[6] == scope], SCHEMA)
        wanted |= {(scope, r.doc_id): r.status for r in dedupe.statuses(part).collect()}
    assert got == wanted and len(set(wanted.values())) == 6


def test_query_over_the_whole_table(spark):
    d = "/root/testdata/sf0.001"
    got = {(r.lang, r.doc_id): r.status for r in Q.QUERIES["stream_flagged"](spark, d).collect()}
    items = Q._items(spark, d)
    wanted = {}
    for (lang,) in items.select("community").distinct().collect():
        wanted |= {(lang, r.doc_id): r.status for r in dedupe.statuses(items.where(F.col("community").eqNullSafe(lang))).collect()}
    assert got == wanted
