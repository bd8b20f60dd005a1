import random

import numpy as np
import pytest
import xxhash

from tidemark.llm import simhash
from tidemark.llm.components import components
from tidemark.llm.queries import op1_simhash


def slow_print(text):
    words = []
    for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" "):
        if w:
            words.append(w)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints):
    """prints: list of (doc_id, fingerprint) to the list of smallest reachable doc_ids."""
    label = list(range(len(prints)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                label[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return [low.get(root(i)) for i in range(len(prints))]


TEXTS = [None, "", " \n", "One", "one", "ONE two", "a b c", "A  b\tc", "a b c d e f g h", "a b c d e f g h!", "é x y z", "x" * 5000, "word " * 20000, "wide 日本 words here and there"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == slow_print(text)


def near(r, n):
    base = [r.getrandbits(64) for _ in range(3)]
    out = {b ^ sum(1 << p for p in r.sample(range(64), r.randrange(0, 4))) for b in base for _ in range(n)}
    return np.array(sorted(out), np.uint64)


@pytest.mark.parametrize("n", [3, 60, 700])
def test_forest_of_a_list(n):
    r = random.Random(n)
    base = r.getrandbits(64) & ~0xFFFF
    values = np.array(sorted({base | r.getrandbits(16) for _ in range(n)}), np.uint64)
    got = simhash.forest(values, 2)
    expected = slow_components(list(enumerate(map(int, values))))
    assert got.tolist() == expected


def test_links_find_all_and_only_near_pairs(spark):
    values = near(random.Random(1), 150)
    prints = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    found = {(r.node): r.component for r in components(simhash.links(prints)).collect()}
    expected = slow_components(list(enumerate(map(int, values))))
    signed = values.view(np.int64).tolist()
    for i, v in enumerate(signed):
        group = {signed[j] for j in range(len(signed)) if expected[j] == expected[i]}
        assert found.get(v, v) == min(group)


@pytest.mark.parametrize("max_bits,hot", [(2, 4), (1, 1024), (3, 6), (0, 1024)])
def test_links_of_hot_routes_and_other_bounds(spark, max_bits, hot):
    values = near(random.Random(2), 40)
    found = {(r.node): r.component for r in components(simhash.links(spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long"), max_bits, hot)).collect()}
    label, signed = list(range(len(values))), values.view(np.int64).tolist()
    for _ in range(len(values)):
        label = [min(label[j] for j in range(len(values)) if (int(values[i]) ^ int(values[j])).bit_count() <= max_bits) for i in range(len(values))]
    for i, v in enumerate(signed):
        assert found.get(v, v) == min(signed[j] for j in range(len(signed)) if label[j] == label[i])


def test_tallies_count_the_lists_that_pairs_share():
    r = np.random.default_rng(4)
    lists = r.integers(0, 5, (60, 4))
    a, b, count = simhash.tallies(lists)
    expected = {(i, j): int((lists[i] == lists[j]).sum()) for i in range(60) for j in range(i + 1, 60) if (lists[i] == lists[j]).any()}
    assert dict(zip(zip(a.tolist(), b.tolist()), count.tolist())) == expected


def test_only_pairs_that_reach_the_count_are_verified(monkeypatch):
    base = 0x0102030405060708
    # route 0 has positions 0 to 3; five pairs share two or more of positions 4 to 7, five fewer
    values = np.array([base, base ^ (1 << 40) ^ (1 << 48), base ^ (7 << 32) ^ (1 << 40) ^ (1 << 48), base ^ 0x0101010100000000, base ^ (3 << 32)], np.uint64)
    verified = []
    real = np.bitwise_count
    monkeypatch.setattr(simhash.np, "bitwise_count", lambda x: verified.append(len(x)) or real(x))
    a, b = simhash.counted_links(values, np.zeros(5, np.int64), np.zeros(5, np.int64), 2)
    assert sorted(zip(a.tolist(), b.tolist())) == [(0, 1), (0, 4), (1, 3)] and verified == [5]
    assert simhash.counted_links(values, np.arange(5), np.zeros(5, np.int64), 2)[0].size == 0


def test_long_chain_of_edges(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(5, 5), (1000, 1001)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


def rows(spark):
    r = random.Random(3)
    texts = TEXTS + [" ".join(r.choice("ab cd ef gh ij kl".split()) for _ in range(40)) for _ in range(20)]
    texts += [t + " extra" for t in texts if t] + texts[:6]
    data = [(100 - i, t, "clash") for i, t in enumerate(texts)] + [(7, "a b c", "same id"), (None, "no id at all", None), (None, "a b c", None)]
    return data, spark.createDataFrame(data, "doc_id long, text string, component_id string")


def test_near_duplicates_against_brute_force(spark):
    data, docs = rows(spark)
    prints = [(d, slow_print(t)) for d, t, _ in data]
    expected = sorted(zip([str(d) for d, _ in prints], [f"{p:016x}" for _, p in prints], map(str, slow_components(prints)), strict=True))
    got = simhash.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == expected


def test_keep_one_row_of_each_group(spark):
    data, docs = rows(spark)
    docs = docs.union(docs.limit(5))
    kept = simhash.keep_one(docs).collect()
    groups = {slow for slow in slow_components([(d, slow_print(t)) for d, t, _ in data])}
    assert sorted(str(r.doc_id) for r in kept) == sorted(map(str, groups))
    assert kept[0].asDict().keys() == {"doc_id", "text", "component_id"}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0 and simhash.keep_one(docs).count() == 0


def test_query_over_whole_table(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    prints = [(i, slow_print(t)) for i, t in docs]
    expected = sorted(zip([i for i, _ in prints], [f"{p:016x}" for _, p in prints], slow_components(prints), strict=True))
    assert sorted(tuple(r) for r in op1_simhash(spark, d).collect()) == expected
