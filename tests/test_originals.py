"""What duplicates repeat, against a sequential model that sees the items one by one."""

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark import queries as Q
from tidemark.functions import text as X
from tidemark.operators import dedupe

SCHEMA = "doc_id long, url string, community string, author_hash string, text string, published_at timestamp"


def model(df):
    """{doc_id: (duplicate_of, retained)} in order of publication; the earliest retained fingerprint counts."""
    canon = X.canonical_url(F.col("url"))
    rows = df.select("doc_id", "published_at", F.when(~canon.rlike(dedupe.OWN_PAGES), canon).alias("canon"), X.normalised(F.col("text")).alias("norm"), X.simhash(F.col("text")).alias("fp")).orderBy("published_at", "doc_id").collect()
    urls, texts, kept, of = {}, {}, [], {}
    for r in rows:
        first = urls.setdefault(r.canon, r.doc_id) if r.canon is not None else r.doc_id
        if first == r.doc_id and len(r.norm or "") >= dedupe.MIN_CHARS:
            first = texts.setdefault(r.norm, r.doc_id)
            if first == r.doc_id:
                first = next((d for fp, d in kept if ((fp ^ r.fp) & (1 << 64) - 1).bit_count() <= dedupe.MAX_BITS), r.doc_id)
                if first == r.doc_id:
                    kept.append((r.fp, r.doc_id))
        of[r.doc_id] = None if first == r.doc_id else first

    def end(d):
        return d if of[d] is None else end(of[d])

    return {d: (o, None if o is None else end(o)) for d, o in of.items()}


def drawn(seed, n=220):
    r, out = random.Random(seed), []
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(r.choice(words) for _ in range(30)) for _ in range(15)]
    for i in range(n):
        t = r.choice(texts).split()
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            t[r.randrange(len(t))] = r.choice(words)
        text = "short" if i % 20 == 0 else None if i % 33 == 0 else "" if i % 31 == 0 else " ".join(t)
        out.append((i, r.choice([None, None, f"http://x/{r.randrange(25)}", "https://www.reddit.com/r/a/1"]), r.choice(["a", "b", None]), r.choice(["u1", None]), text, dt.datetime(2026, 1, 1) + dt.timedelta(minutes=i // 2)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_the_model(spark, seed):
    df = spark.createDataFrame(drawn(seed), SCHEMA)
    got = dedupe.originals(df).collect()
    wanted = model(df)
    assert {r.doc_id: (r.duplicate_of, r.retained) for r in got} == wanted and len(got) == len(wanted)
    assert {r.doc_id: r.status for r in got} == {r.doc_id: r.status for r in dedupe.statuses(df).collect()}
    unique = {r.doc_id for r in got if r.status == "unique"}
    assert all((r.retained in unique) == (r.status != "unique") for r in got)
    assert any(r.duplicate_of != r.retained for r in got)  # chains


def test_a_chain_through_all_stages(spark, monkeypatch):
    monkeypatch.setattr(dedupe.X, "simhash", lambda text: F.when(text.rlike(r"\d$"), F.regexp_extract(text, r"(\d+)$", 1)).try_cast("long"))
    at = dt.datetime(2026, 1, 1)
    rows = [(1, None, "long enough text 0"), (2, None, "long enough other 1"), (3, "http://x/1", "long enough other 1"), (4, "http://x/1", "short"), (5, None, "")]
    df = spark.createDataFrame([(i, u, "a", None, t, at) for i, u, t in rows], SCHEMA)
    got = {r.doc_id: (r.status, r.duplicate_of, r.retained) for r in dedupe.originals(df).collect()}
    assert got == {1: ("unique", None, None), 2: ("near_duplicate", 1, 1), 3: ("duplicate_exact", 2, 1), 4: ("duplicate_url", 3, 1), 5: ("unique", None, None)}


def test_hot_key_is_dealt_out_and_empty_tables(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("k"))
    table = rows.select("k").distinct().withColumn("of", F.col("k") * 2)
    got = dedupe._looked_up(rows, "k", table)
    assert got.where(F.col("of") != F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") * 2).otherwise(-2)).count() == 0 and got.count() == 3000
    empty = spark.createDataFrame([], SCHEMA)
    assert dedupe.originals(empty).count() == 0 and dedupe.originals(empty, near=False).count() == 0


def test_the_first_two_stages_in_sql(spark):
    d = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{d}/documents.parquet'")
    key = lambda r: tuple((x is not None, x) for x in r)
    got = Q.QUERIES["exact_originals"](spark, d).select("doc_id", "status", "duplicate_of", "retained").collect()
    wanted = c.execute(Q.ORACLE_SQL["exact_originals"]).fetchall()
    assert sorted(map(tuple, got), key=key) == sorted(wanted, key=key) and any(r[2] is not None for r in wanted)


def test_query_against_the_model(spark):
    d = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.duplicate_of, r.retained) for r in Q.QUERIES["near_originals"](spark, d).collect()}
    assert got == model(Q._items(spark, d))
