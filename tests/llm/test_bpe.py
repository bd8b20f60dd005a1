import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import types as T

from tidemark.llm import bpe
from tidemark.llm.queries import op9_bpe, ranks_file

RANKS = bpe.load_ranks(ranks_file())
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
EDGES = ["", " ", "  ", "a  b", " a", "a \n b", "\n\n x", "x ", "tab\t x", "a  b", "aaaaaaaaaaaaaaaaaaaa" * 20, "<|endoftext|>", "it's we'll I'M", "日本語テキスト 🎉🎉", "　 x", "0123456789" * 9, "é" * 50, "=" * 70 + " " * 70 + "x"]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(RANKS, P.PATTERN)


def ids(encoder, text):
    return np.frombuffer(encoder.encode(text), "<u4").tolist()


@pytest.mark.parametrize("text", EDGES)
def test_edges_as_the_library(encoder, text):
    assert ids(encoder, text) == LIBRARY.encode_ordinary(text)


def test_random_texts_as_the_library(encoder):
    r = random.Random(5)
    letters = "etaoin shrdlu,.\n'\t  ABCé日🎉0123 "
    for _ in range(800):
        text = "".join(r.choice(letters) for _ in range(r.randrange(1, 120)))
        assert ids(encoder, text) == LIBRARY.encode_ordinary(text)


def test_random_bytes_through_the_machine_alone():
    machine, r = bpe.Transducer(RANKS), random.Random(6)
    pool = [t for t in RANKS if len(t) > 2]
    for _ in range(500):
        piece = b"".join(r.choice(pool)[: r.randrange(1, 6)] for _ in range(r.randrange(1, 6)))
        expected = [RANKS[piece]] if piece in RANKS else machine.merged(piece)
        assert machine.encode(piece) == expected


def test_pairs_fit_as_merging_says():
    machine, r = bpe.Transducer(RANKS), random.Random(7)
    pool = [t for t in RANKS if 1 < len(t) < 9]
    for _ in range(3000):
        a, b = r.choice(pool), r.choice(pool)
        assert machine._fit(machine._class(RANKS[a]), RANKS[b]) == (machine.merged(a + b) == [RANKS[a], RANKS[b]])


def test_long_pieces_are_emitted_in_parts(encoder, monkeypatch):
    monkeypatch.setattr(bpe, "EMIT", 20)
    r = random.Random(8)
    for _ in range(60):
        text = "".join(r.choice(["th", "er", "on", "ing", "a", "aaaa", "tion", "zq"]) for _ in range(80))
        assert ids(bpe.Encoder(RANKS, P.PATTERN), text) == LIBRARY.encode_ordinary(text)


def test_a_full_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 5)
    monkeypatch.setattr(bpe, "MAX_REMEMBERED", 3)
    monkeypatch.setattr(bpe, "GROUP", 64)
    small = bpe.Encoder(RANKS, P.PATTERN)
    for text in ("The quick brown fox jumps over unbelievably lazy dogs in Donaudampfschiffe", "zqx" * 90 + " end", *EDGES):
        assert ids(small, text) == LIBRARY.encode_ordinary(text)
        assert len(small.machine.live) < 5 + 40


def test_states_are_met_again():
    machine, r = bpe.Transducer(RANKS), random.Random(9)
    syllables = ["th", "er", "on", "ing", "and", "ent", "is", "o", "re", "at"]
    words = ["".join(r.choice(syllables) for _ in range(r.randrange(2, 7))).encode() for _ in range(4000)]
    machine.encode_all(words[:2000])
    half = machine.arcs
    found, ends = machine.encode_all(words[2000:])
    assert [found[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [machine.encode(w) for w in words[2000:]]
    assert machine.arcs - half < half / 2 and machine.arcs < 4000


def test_another_pattern_splits_whole_texts():
    pattern = r"\S+|\s+"
    text, own = "a  b the\n cats  ", tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=RANKS, special_tokens={})
    assert ids(bpe.Encoder(RANKS, pattern), text) == own.encode_ordinary(text)


def test_utf8_machine_at_every_cut():
    data = "aé日🎉z".encode()
    for i in range(len(data) + 1):
        for j in range(i, len(data) + 1):
            m = bpe.Utf8Machine()
            assert m.feed(data[:i]) + m.feed(data[i:j]) + m.feed(data[j:]) + m.end() == "aé日🎉z"
    r = random.Random(10)
    pool = [0x41, 0x80, 0xA0, 0x90, 0xBF, 0xC0, 0xC3, 0xE0, 0xE6, 0xED, 0xF0, 0xF1, 0xF4, 0xF5]
    for _ in range(20_000):  # malformed bytes as the language's own decoder replaces them
        data, m = bytes(r.choice(pool) for _ in range(r.randrange(7))), bpe.Utf8Machine()
        assert m.feed(data[:3]) + m.feed(data[3:]) + m.end() == data.decode("utf-8", "replace")


def test_decoder_steps_inside_characters(monkeypatch):
    decoder, text = bpe.Decoder(RANKS), "a日本🎉é b" * 9
    ids = np.array(LIBRARY.encode_ordinary(text))
    for step in (1, 2, 7):
        monkeypatch.setattr(bpe, "DECODE_STEP", step)
        assert "".join(decoder.stream(ids)) == text
    r = random.Random(11)
    for _ in range(300):
        some = np.array([r.choice(ids) for _ in range(6)])
        assert "".join(decoder.stream(some)) == LIBRARY.decode_bytes(some.tolist()).decode("utf-8", "replace")


def test_query_against_the_library(spark):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = op9_bpe(spark, d).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        expected = LIBRARY.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(expected) and r.ids_sha256 == hashlib.sha256(np.array(expected, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_encode_and_decode_frames(spark):
    rows = [(i, t, "x") for i, t in enumerate([*EDGES, None, "long " * 50_000])] + [(0, "", "x"), (None, "null id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.encode(docs, ranks_file(), P.PATTERN, digests=True)
    back = bpe.decode(got, ranks_file()).collect()
    assert len(back) == len(rows) and dict(got.dtypes)["n_tokens"] == "bigint"
    for r in back:
        text = r.text or ""
        expected = LIBRARY.encode_ordinary(text)
        assert r.ids == expected and r.n_tokens == len(expected) and r.decoded == text
        assert r.ids_sha256 == hashlib.sha256(np.array(expected, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table(spark):
    docs = spark.createDataFrame([], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))
    assert bpe.encode(docs, ranks_file(), P.PATTERN, digests=True).count() == 0


def test_ranks_file_reads():
    assert bpe.load_ranks(base64.b64encode(b"ab") + b" 7\n\n") == {b"ab": 7}
