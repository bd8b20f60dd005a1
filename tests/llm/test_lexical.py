"""op11 against brute force, whatever the tiers, shards and blocks."""

import math
import random
import re
from collections import Counter

import pytest

from tidemark.llm import lexical

FIND = re.compile(lexical.TERM).findall


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def model(docs, items, k):
    held = [(d, Counter(FIND(low(t)))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_all, l_all = len(held), sum(n for *_, n in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in items:
        terms = {w: math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[w] + 1))) for w in set(FIND(low(text)))}
        scores = [(sum(w * (10**9 * c[t] // (1000 * c[t] + 20 * (50 + 50 * n * n_all // l_all))) for t, w in terms.items() if c[t]), d) for d, c, n in held]
        best = sorted((-s, d is None, d if d is not None else 0) for s, d in scores if s > 0)[:k]
        out += [(item, i, None if none else d, -s) for i, (s, none, d) in enumerate(best, 1)]
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, weights=[60 / (j + 1) for j in range(60)], k=rng.randint(1, 40)))) for i in range(300)]
    docs += [(7, docs[7][1]), (7, docs[7][1]), (900, None), (901, ""), (902, "?!"), (None, "w3 w4 w59"), (903, "W1 w2 " * 3000), (904, "Éte été 雪 w5"), (905, "été 雪")]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(25)] + [(1, "w0"), (None, "été w59"), (77, None), (78, "nowhere"), (79, "w1 W1 w2 w2 ÉTÉ")]
    return docs, items


@pytest.mark.parametrize(
    "k, options",
    [(50, {}), (5, {"tiers": (2, 3), "shard_docs": 20}), (5, {"tiers": (1,), "shard_docs": 7, "wanted_most": 0}), (3, {"tiers": (4, 8, 16), "shard_postings": 50}), (400, {"tiers": (3,), "shard_docs": 40})],
)
def test_rank_equals_brute_force(spark, k, options):
    docs, items = corpus()
    d = spark.createDataFrame([(*x, 1, "y") for x in docs], "doc_id long, text string, shard long, terms string").repartition(3)
    i = spark.createDataFrame([(*x, 2) for x in items], "item_id long, text string, rank long")
    got = lexical.rank(d, i, k, **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == model(docs, items, k)


def test_blocks_of_items(spark):
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = lexical.search(lexical.build(d, tiers=(2,), shard_docs=50), i, 4, block_terms=60)
    assert sorted(map(tuple, got.collect()), key=repr) == model(docs, items, 4)


def test_high_impacts_prove_items_and_the_rest_falls_through(spark):
    """A rare term is proven in the first tier; common terms alone need lower ones."""
    docs = [(i, "common word " + ("rare " * 5 if i < 3 else "filler " * (i % 17))) for i in range(400)]
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    index = lexical.build(d, tiers=(4, 16))
    rows = {(r["tier"]): r for r in index.tiered.collect()}
    assert sorted(rows) == [0, 1, 2]
    of = {t: w for t, w in zip(rows[0]["terms"], lexical.np.frombuffer(bytes(rows[0]["residual"]), lexical.np.int64))}
    assert of["rare"] == 0 and of["common"] > 0
    for terms, weights, proven in ((["rare"], [5000], True), (["common", "word"], [3, 3], False)):
        s = lexical._Searcher([(0, terms, weights)], {}, 2, lexical._arrow(index.tiered.schema))
        tier = rows[0].asDict()
        lists = [{"at": lexical.np.frombuffer(bytes(tier["at"]), lexical.np.int32), "impact": lexical.np.frombuffer(bytes(tier["impact"]), lexical.np.int32), "of": {}}]
        ends = lexical.np.cumsum(lexical.np.frombuffer(bytes(tier["counts"]), lexical.np.int32)).tolist()
        lists[0]["of"] = {w: (a, b, int(of[w])) for w, a, b in zip(tier["terms"], [0, *ends], ends)}
        _, reach, scores, lows = s.one(tier["docs"], lists, terms, weights, 1)
        assert (reach == 0) == proven and len(lows) == 2


def test_empty_tables(spark):
    d, i = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.rank(d, i).collect() == []
    assert lexical.rank(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), i.limit(0)).collect() == []
