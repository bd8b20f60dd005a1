"""op13 against a plain model."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import divergence

FIND = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+").findall


def model(rows, top, min_docs):
    rows = [tuple(x or "" for x in r) for r in rows]
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    out = []
    for lang in {r[0] for r in rows}:
        docs = [(s, FIND(low(t))) for x, s, t in rows if x == lang]
        df = Counter(w for _, ws in docs for w in set(ws))
        kept = [w for w, n in df.items() if n >= min_docs]
        counts = {s: Counter() for s, _ in docs}
        for s, ws in docs:
            counts[s].update(w for w in ws if w in set(kept))
        whole = sum(counts.values(), Counter())
        share = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept}
        q = share(whole)
        p = {s: share(c) for s, c in counts.items()}
        for s in counts:
            pairs = [(-sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept), o.encode(), o) for o in counts if o != s]
            terms = [(-((p[s][w] - q[w]) ** 2 // q[w]), w.encode(), w) for w in kept if counts[s][w] and p[s][w] > q[w]]
            out += [(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", w, -v, i) for i, (v, _, w) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


ROWS = [
    ("en", "a", "The cat the CAT sat"), ("en", "a", "the cat ran"), ("en", "b", "the dog sat; the dog ran"), ("en", "b", "dog dog the"),
    ("en", "c", ""), ("en", None, None), ("en", "d", "été ÉTÉ 雪 the"), ("en", "d", "été the 雪"), ("en", "é", "the the cat dog été"), ("en", "\U0001f600", "cat \U0001f600 dog"), ("en", "￮", "cat dog sat"),
    (None, "a", "lonely words"), ("fr", "a", "rare"), ("fr", "b", "words"), ("", "z", "the lonely lonely"), ("en", "a", "the cat ran"), ("en", "long", "the " * 5000 + "zebra sat ran"),
]


@pytest.mark.parametrize("options", [{}, {"slice_terms": 2, "seats": 4}, {"slice_terms": 3, "small": 0}, {"top": 2, "min_docs": 1, "slice_terms": 2}])
def test_audit_equals_the_model(spark, options):
    docs = spark.createDataFrame([(*r, 1, "x") for r in ROWS], "lang string, source string, text string, seat long, term string")
    got = divergence.audit(docs, **options)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == model(ROWS, options.get("top", 200), options.get("min_docs", 3))


def test_rows_of_a_group_in_any_order_give_the_same_audit(spark, monkeypatch):
    # the mix differs at each call, as the order of fetched rows does on several executors
    blocks = divergence._blocks

    def mixed(seats):
        inner = blocks(seats)

        def run(key, rows):
            return inner(key, rows.take(np.random.default_rng().permutation(rows.num_rows)))

        return run

    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    rows = [("en", "abc"[i % 3], " ".join(words[j] for j in range(300) for _ in range(1 + (i * j) % 7))) for i in range(12)]
    monkeypatch.setattr(divergence, "_blocks", mixed)
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert sorted(map(tuple, divergence.audit(docs, slice_terms=100).collect())) == model(rows, 200, 3)


def test_blocks_do_not_depend_on_the_order_of_rows():
    by = pa.array([[{"source": "ab"[i % 2], "n": i + 1}] for i in range(50)], pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())])))
    rows = pa.table({"term": [f"t{i:02}" for i in range(50)], "total": list(range(1, 51)), "by": by})
    key = (pa.scalar("en"), pa.scalar(0))

    def read(table):
        own, *seats = [divergence._unpacked(d).to_pydict() for d in table.column("data").to_pylist()]
        return own, [dict(zip(s["source"], zip(s["at"], s["n"]))) for s in seats]

    assert read(divergence._blocks(2)(key, rows)) == read(divergence._blocks(2)(key, rows.take(list(range(49, -1, -1)))))


def test_tasks_hand_on_before_they_hold_too_much(spark, monkeypatch):
    batches = [divergence.pa.RecordBatch.from_pydict({"lang": ["en"] * 2, "source": ["a", "b"], "text": ["one two", "two three"]})] * 3
    monkeypatch.setattr(divergence, "HELD", 3)
    out = [r for b in divergence._tally(iter(batches)) for r in b.to_pylist()]
    assert len(out) == 12 and sum(r["n"] for r in out if r["term"] == "two") == 6


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).collect() == []


@pytest.mark.parametrize("seats", [2, 4, 8, 14])
def test_all_seats_meet_once_and_each_plays_a_round(seats):
    rounds = divergence.tournament(seats)
    assert len(rounds) == seats - 1 and all(sorted(x for p in r for x in p) == list(range(seats)) for r in rounds)
    assert len({frozenset(p) for r in rounds for p in r}) == seats * (seats - 1) // 2
