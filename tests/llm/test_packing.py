"""op12 against the library, and the plan's rules."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import packing, queries

with open(public_tokenizers.path(queries.WORDS), encoding="utf-8") as f:
    WORDS = f.read()
LIBRARY = Tokenizer.from_str(WORDS)
LIBRARY.encode_special_tokens = True
CODER = packing.SegmentCoder(WORDS, remembered=500)
D = "/root/testdata/sf0.001"


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet=st.characters(max_codepoint=255)), st.text(), st.text(alphabet="ab'sStrevlLmdt .!1²éÀ\x85\xa0\n")), min_size=1, max_size=6))
def test_ids_are_the_librarys(texts):
    assert [x.tolist() for x in CODER.encode(texts)] == [ids_of(t) for t in texts]


def test_special_tokens_long_words_and_forgetting():
    texts = ["<|endoftext|> a", "a" * 40 + " " + "é" * 17, "x\0y", "", "'s''s it's they'll'd", "Σς İ é"]
    texts += [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(60)]  # more segments than are remembered
    for _ in range(2):
        assert [x.tolist() for x in CODER.encode(texts)] == [ids_of(t) for t in texts]


def used(plan):
    out = Counter()
    for parts, copies in plan.patterns:
        assert sum(parts) <= plan.capacity and copies > 0
        for n in parts:
            out[n] += copies
    return out


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(1, 60), max_size=12))
def test_every_piece_is_used_once(counts):
    plan = packing.Plan(counts, 24)
    assert used(plan) == Counter(counts)
    best_fit = []
    for n in sorted((n for n, k in counts.items() for _ in range(k)), reverse=True):
        fits = [i for i, room in enumerate(best_fit) if room >= n]
        if fits:
            best_fit[min(fits, key=lambda i: best_fit[i])] -= n
        else:
            best_fit.append(24 - n)
    assert plan.sequences <= len(best_fit) + 1


def test_singles_pairs_and_triples_fill_gaps():
    plan = packing.Plan({20: 1, 10: 1, 6: 1, 14: 1, 5: 1, 11: 1, 17: 1, 2: 1, 3: 1, 8: 1}, 30)
    assert used(plan) == Counter([20, 10, 6, 14, 5, 11, 17, 2, 3, 8]) and plan.sequences == -(-96 // 30)
    assert packing.Plan({9: 1, 8: 1, 6: 1, 7: 1}, 30).patterns == [((9, 6, 8, 7), 1)] or packing.Plan({9: 1, 8: 1, 6: 1, 7: 1}, 30).sequences == 1
    assert packing.Plan({}, 30).patterns == []


def test_the_lower_bound_is_met_on_many_pieces():
    rng = np.random.default_rng(3)
    counts = Counter(np.clip(rng.gamma(1.5, 350, 20000).astype(int), 1, 2048).tolist())
    for times in (1, 10**7):
        total = sum(n * k * times for n, k in counts.items())
        plan = packing.Plan({n: k * times for n, k in counts.items()})
        assert plan.sequences <= -(-total // 2048) + 2 and len(plan.patterns) < 6000


def check_packed(rows, texts, capacity):
    """rows: packed rows with ids; texts: all documents' texts by id, repeated ids share a text."""
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        assert r["start"] == r["piece"] * capacity and len(r["ids"]) == 4 * r["length"]
    for held in by_sequence.values():
        held.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in held] == np.cumsum([0, *[r["length"] for r in held]])[:-1].tolist()
        assert sum(r["length"] for r in held) <= capacity
    for doc, text in texts.items():
        whole = np.array([*ids_of(text), 0], "<u4")
        pieces = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["piece"])
        times = len([r for r in pieces if r["piece"] == 0])
        assert times and Counter((r["piece"], bytes(r["ids"])) for r in pieces) == Counter({(i, whole[i * capacity : (i + 1) * capacity].tobytes()): times for i in range(-(-len(whole) // capacity))})
    return len(by_sequence)


def test_pack_small_cases(spark):
    texts = {1: None, 2: "", 3: "one two three " * 30, 4: "it's", 5: "Größe ²", 6: "snow ☃ man"}
    rows = [(k, t, "x", 7) for k, t in texts.items()] + [(4, "it's", "y", 8), (4, "it's", "y", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string, sequence_id long")
    packed = packing.pack(docs, WORDS, capacity=16)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    got = packed.collect()
    n = check_packed(got, texts, 16)
    assert n <= -(-sum(r["length"] for r in got) // 16) + 1
    whole = {r["sequence_id"]: r for r in packing.sequences(packed).collect()}
    for s, r in whole.items():
        held = sorted((x for x in got if x["sequence_id"] == s), key=lambda x: x["offset"])
        assert bytes(r["ids"]) == b"".join(bytes(x["ids"]) for x in held) and r["length"] == sum(x["length"] for x in held) and r["n_pieces"] == len(held)
    assert packing.pack(docs.limit(0), WORDS).collect() == []


def test_query_over_the_whole_table(spark):
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{D}/documents.parquet").to_pylist()}
    rows = queries.op12_packing(spark, D).collect()
    wanted = Counter()
    for doc, text in docs.items():
        whole = np.array([*ids_of(text), 0], "<u4")
        for i in range(-(-len(whole) // 2048)):
            part = whole[i * 2048 : (i + 1) * 2048]
            wanted[doc, i, i * 2048, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == wanted
    assert len({r["sequence_id"] for r in rows}) <= -(-sum(r["length"] for r in rows) // 2048) + 1
    ends = Counter()
    for r in rows:
        ends[r["sequence_id"]] = max(ends[r["sequence_id"]], r["offset"] + r["length"])
    sizes = Counter()
    for r in rows:
        sizes[r["sequence_id"]] += r["length"]
    assert ends == sizes and max(sizes.values()) <= 2048


