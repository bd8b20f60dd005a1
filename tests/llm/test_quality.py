import zlib

import numpy as np

from tidemark.llm import quality
from tidemark.llm.queries import op8_quality

CLEAN = "the quiet river runs past the old mill and the people of the town walk there".split()


def texts(n, seed=0):
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        words = list(r.permutation(CLEAN)) * 3
        good = i % 4 != 0
        out.append((i, " ".join(words if good else [w.upper() + "!!" for w in words]), int(good)))
    return out


def test_features_of_edge_texts():
    assert len(quality.features(None)) == len(quality.features(b"")) == 0
    assert len(quality.features(b"a")) == 1
    long = b"word and more " * 200_000
    assert set(quality.features(b"word and more word")) <= set(quality.features(long)) and len(quality.features(long)) < 200


def test_pieces_of_long_texts_change_nothing(monkeypatch):
    text = b" ".join(f"w{i % 97} x{i % 31}".encode() for i in range(3000))
    whole = quality.features(text)
    monkeypatch.setattr(quality, "STEP", 1000)
    flags = {int(quality._fold(np.array([i], np.uint64), 10)[0]) for i in range(6)}
    assert set(quality.features(text)) - flags == set(whole) - flags


def test_fit_without_both_classes():
    rows = [quality.features(b"some text")]
    sent = list(map(quality.packed, rows))
    assert quality.fit([], np.array([], np.int64)).score(rows[0]) == 0.5
    assert quality.fit(sent, np.array([1])).score(rows[0]) > 0.9 and quality.fit(sent, np.array([0])).score(rows[0]) < 0.1


def test_packed_features_are_bounded():
    for n in (0, 1, 5000, 1 << 15, 1 << quality.BITS):
        found = np.sort(np.random.default_rng(n).permutation(1 << quality.BITS)[:n])
        assert quality.unpacked(quality.packed(found)).tolist() == found.tolist() and len(quality.packed(found)) <= 32_768


def test_dual_descent_meets_the_optimality_conditions():
    data = texts(80)
    rows, y = [quality.features(t.encode()) for _, t, _ in data], np.array([k for _, _, k in data])
    m = quality.fit(list(map(quality.packed, rows)), y)
    p = np.array([m.score(f) >= 0.5 for f in rows])
    assert (p == (y == 1)).all()


def test_frames(spark):
    data = texts(300) + [(1000, None, 1), (1001, "", 0), (None, "null id", 1)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in data] + [(5, data[5][1], "again")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, k) for i, _, k in data] + [(7, None), (8, 1), (8, 1)], "doc_id long, quality int")
    got = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(got) == len(data) + 1
    truth = {i: k for i, _, k in data}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        if r.doc_id is not None and r.doc_id < 1000:
            assert r.predicted == truth[r.doc_id]
    empty = docs.limit(0)
    assert quality.score(empty, quality.train(empty, labels.limit(0))).count() == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = [r for r in op8_quality(spark, d).collect() if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in got]) >= 0.97


def slow_features(text):
    """The same indicators one by one, in plain integers."""
    data, out = (text or "").encode(), set()

    def add(code, kind):
        out.add(((code + (kind << 40)) % 2**64 * 0x9E3779B97F4A7C15 % 2**64) >> (64 - quality.BITS))

    for n in (2, 3, 4):
        for i in range(len(data) - n + 1):
            add(int.from_bytes(data[i : i + n], "big"), n - 1)
    words = [zlib.crc32(w) for w in data.split()]
    for w in words:
        add(w, 8)
    for a, b in zip(words, words[1:]):
        add((a * 31 + b) % 2**64, 9)
    same = sum(a == b for a, b in zip(words, words[1:]))
    for i in range(6):
        if words and same >= 2**i * max(1, len(words) // 256):
            add(i, 10)
    return sorted(out)


def test_query_against_a_plain_model(spark):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect() if r.quality is not None}
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in docs}
    features = {i: slow_features(t) for i, t in docs.items()}
    train = [i for i in sorted(docs) if i in labels and not held[i]]
    assert 10 < len(train) < quality.SAMPLE
    model = quality.fit([quality.packed(np.array(features[i], np.int64)) for i in train], np.array([labels[i] for i in train]))
    got = op8_quality(spark, d).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        margin = sum(float(model.weights[f]) for f in features[r.doc_id]) + model.bias
        score = 1 / (1 + np.exp(-np.clip(model.scale[0] * margin + model.scale[1], -30, 30)))
        assert abs(r.score - score) < 1e-3 and r.held_out == held[r.doc_id] and r.predicted == int(r.score >= 0.5)
