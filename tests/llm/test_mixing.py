import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing
from tidemark.llm.queries import op3_mixing


def slow_targets(sizes, weights=(5, 2, 1), cap=3):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, out, open_ = sum(sizes.values()), {}, set(order)
    while True:
        share = (total - sum(out.values())) / max(1, sum(w[s] for s in open_))
        above = {s for s in open_ if share * w[s] > cap * sizes[s]}
        if not above:
            return out | {s: share * w[s] for s in open_}
        out |= {s: cap * sizes[s] for s in above}
        open_ -= above


def docs_of(spark, n=400):
    rows = []
    for i in range(n):
        source = ["hot"] * 3 + ["b", "a", "é", None, "tiny"]
        s = source[i % len(source)]
        size = 1 if s == "tiny" else (i * 37) % 211 if i != 5 else 30_000
        rows.append((i, None if i % 97 == 0 else " ".join(f"w{i}_{k}" for k in range(size)), "en", s, 0, "clash"))
    rows += [rows[8], rows[8], (None, "null id words", "en", "b", 0, "x"), (3, "same id", None, "a", None, None), (900, " \t\n", "en", "empty", 0, "")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string")


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def check_report(rows, got):
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + words(r[1])
    expected = slow_targets(sizes)
    assert len(got) == len(rows)
    taken = dict.fromkeys(sizes, 0)
    by_id = {(r[0], words(r[1])): r[3] for r in rows}
    for g in got:
        s = by_id[g.doc_id, g.size]
        assert g.source_size == sizes[s] and math.isclose(g.target, expected[s], abs_tol=1e-6)
        assert 0 <= g.taken <= 3 * g.size
        taken[s] += g.taken
    for s in sizes:
        assert abs(taken[s] - expected[s]) <= 0.5 + 1e-6, s


def test_report_against_brute_force(spark):
    rows, docs = docs_of(spark)
    got = mixing.mix_report(docs, block_words=16, shard_blocks=32).collect()
    check_report(rows, got)
    for partitions in (5, 1):
        again = mixing.mix_report(docs.repartition(partitions), block_words=16, shard_blocks=32).collect()
        assert sorted(map(str, got)) == sorted(map(str, again))


def test_many_repeats_agree_under_any_partitioning(spark):
    rows = [(1, f"one two three {i % 3}" * (i % 3 + 1), "a") for i in range(60)] + [(i, "w " * i, "b") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [sorted(map(str, mixing.mix_report(docs.repartition(p), block_words=4, shard_blocks=4).collect())) for p in (1, 3, 7)]
    assert got[0] == got[1] == got[2]
    assert [mixing.numbered(mixing.sized_rows(docs.repartition(4), [])).groupBy("content").agg(F.countDistinct("copy").alias("c"), F.max("copy").alias("m"), F.count("*").alias("n")).where("c <> n or m <> n - 1").count()] == [0]


def test_the_tree_decides_the_shards(spark, monkeypatch):
    _, docs = docs_of(spark)

    def shards(**options):
        out = {}
        for r in mixing.mix_report(docs, block_words=16, shard_blocks=32, **options).collect():
            for run in r.runs:
                out.setdefault(run.shard, []).append((run.place, r.doc_id, run["pass"], run.from_word, run.n_words))
        return {s: sorted(x, key=str) for s, x in out.items()}

    one, two = shards(), shards(tree_seed=1)
    assert len(one) > 8 and one.keys() == two.keys() and one != two
    assert sum(run[4] for x in one.values() for run in x) == sum(run[4] for x in two.values() for run in x)
    monkeypatch.setattr(mixing, "splitting_tree", lambda quotas, levels, seed: quotas.select(F.lit(0).cast("long").alias("shard"), "sx", F.lit(0).cast("long").alias("offset"), "quota"))
    assert len(shards()) == 1


def test_blocks_are_disjoint_and_shards_even(spark):
    _, docs = docs_of(spark)
    rows = mixing.sized_rows(docs, [])
    _, taken = mixing.draw(rows, block_words=16, shard_blocks=32)
    got = taken.collect()
    blocks = {(r.sx, r.block, r["pass"]): (r.shard, r.place) for r in got}
    assert len({(r.sx, r.block, r["pass"], r.shard, r.place) for r in got}) == len(blocks)
    shards = [s for s, _ in blocks.values()]
    sizes = np.bincount(shards)
    assert sizes.max() - sizes.min() <= 1 and len(sizes) > 8
    for s in set(shards):
        places = sorted(p for t, p in blocks.values() if t == s)
        assert places == list(range(1, len(places) + 1))


def test_draws_follow_the_hypergeometric_distribution(spark):
    good, total, n = 30, 100, 40
    u = "(pmod(xxhash64(11, id), 9007199254740992L) + 0.5D) / 9007199254740992D"
    got = np.array([r.d for r in spark.range(20_000).select(F.expr(mixing.hypergeometric(f"{good}L", f"{total}L", f"{n}L", u)).alias("d")).collect()])
    p = np.array([math.comb(good, k) * math.comb(total - good, n - k) / math.comb(total, n) for k in range(good + 1)])
    seen = np.bincount(got, minlength=good + 1) / len(got)
    assert np.abs(seen - p).max() < 0.012 and abs(got.mean() - 12) < 0.1


@pytest.mark.parametrize("good,total,n", [(0, 0, 0), (0, 5, 2), (5, 5, 2), (3, 5, 0), (3, 5, 5), (1, 1, 1), (10**9, 3 * 10**9, 10**6)])
def test_draws_at_the_edges(spark, good, total, n):
    d = spark.range(1).select(F.expr(mixing.hypergeometric(f"{good}L", f"{total}L", f"{n}L", "0.37D")).alias("d")).first().d
    assert max(0, n - total + good) <= d <= min(good, n)
    if total > 10**6:
        assert abs(d - n * good / total) < 2000


@pytest.mark.parametrize("block_words", [16, 500])
def test_mixed_rows(spark, block_words):
    rows, docs = docs_of(spark, 120)
    report = {}
    for r in mixing.mix_report(docs, block_words=block_words).collect():
        report[r.doc_id] = report.get(r.doc_id, 0) + r.taken
    got = mixing.mixed(docs, block_words=block_words)
    assert got.dtypes == docs.dtypes
    out, texts = {}, {(r[0], r[1]) for r in rows}
    for r in got.collect():
        assert words(r.text) <= block_words
        out[r.doc_id] = out.get(r.doc_id, 0) + words(r.text)
        assert r.n_chars == len(r.text)
        whole = next(t for d, t in texts if d == r.doc_id and t and r.text.split()[0] in t.split())
        assert set(r.text.split()) <= set(whole.split())
    assert {k: v for k, v in report.items() if v} == out


def test_mixed_rows_lie_by_shard_in_order_of_place(spark):
    rows = [(i, f"d{i}", "ab"[i % 2]) for i in range(200)]  # a word each, a block each
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    where = {}
    for r in mixing.mix_report(docs, block_words=1, shard_blocks=16).collect():
        for run in r.runs:
            where.setdefault(run.shard, []).append((run.place, r.doc_id))
    expected = {tuple(d for _, d in sorted(x)) for x in where.values()}
    got = mixing.mixed(docs, block_words=1, shard_blocks=16).withColumn("p", F.spark_partition_id()).collect()
    lists = {}
    for r in got:
        lists.setdefault(r.p, []).append(r.doc_id)
    found = set()
    for x in lists.values():
        while x:
            own = next(e for e in expected if tuple(x[: len(e)]) == e)
            found.add(own)
            x = x[len(own) :]
    assert found == expected and len(expected) >= 8


def test_empty_and_wordless(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_report(docs).count() == 0
    docs = spark.createDataFrame([(1, "", None), (2, None, "a")], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.mix_report(docs).collect()] == [(0, 0.0, 0)] * 2
    assert mixing.mixed(docs).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    check_report(docs, op3_mixing(spark, d).collect())
