import zlib

import numpy as np
import pytest

from tidemark.llm import toxicity
from tidemark.llm.queries import op4_toxicity

WORDS = [b"ab", b"cde", b"f", "gh日".encode()]


@pytest.mark.parametrize("name", ["h0", "h1", "a", "u", "o", "b", "x0", "x1"])
def test_gradients_against_differences(name):
    net, r = toxicity.Network(1), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask, slope = r.integers(0, 4, (3, toxicity.WINDOW)), np.ones((3, toxicity.WINDOW)), np.array([1.0, -2.0, 0.5])
    mask[0, 5:] = 0
    loss = lambda: float(net.forward(net.inputs(net.vectors(WORDS)), x, mask) @ slope)
    vectors = net.vectors(WORDS)
    _, kept = net.forward(net.inputs(vectors), x, mask, keep=True)
    grad, d_in = net.backward(x, kept, slope)
    if name[0] == "x":
        flat = np.zeros((4, 6 * toxicity.HIDDEN))
        np.add.at(flat, x.ravel(), d_in.reshape(-1, 6 * toxicity.HIDDEN))
        d = int(name[1])
        grad[name] = vectors.T @ flat[:, 3 * toxicity.HIDDEN * d : 3 * toxicity.HIDDEN * (d + 1)]
    at = tuple(n // 2 for n in net.p[name].shape)
    net.p[name][at] += 1e-3
    high = loss()
    net.p[name][at] -= 2e-3
    assert (high - loss()) / 2e-3 == pytest.approx(grad[name][at], rel=2e-3, abs=2e-5)


def test_windows_cover_every_word_and_overlap():
    for n in (0, 1, 31, 32, 33, 56, 57, 500):
        begins = toxicity.starts(n)
        covered = {i for s in begins for i in range(s, min(n, s + toxicity.WINDOW))}
        assert covered == set(range(n)) and all(b - a < toxicity.WINDOW for a, b in zip(begins, begins[1:], strict=False))


def test_scores_of_pieces_equal_those_of_whole_texts(monkeypatch):
    scorer = toxicity.Scorer(toxicity.Network(3))
    texts = [None, b"", b" \n", "é 日本 words".encode(), b"w " * 5000, " ".join(f"w{i}" for i in range(4000)).encode()]
    whole = scorer.largest(texts)
    monkeypatch.setattr(toxicity, "CHUNK", 8)
    monkeypatch.setattr(toxicity, "REMEMBERED", 50)
    small = toxicity.Scorer(toxicity.Network(3)).largest(texts)
    np.testing.assert_allclose(whole[0], small[0], rtol=1e-4, atol=1e-5)
    assert whole[1].tolist() == small[1].tolist()


def texts(n):
    r = np.random.default_rng(0)
    words = "the quiet river runs past an old mill and people of this town walk there".split()
    out = []
    for i in range(n):
        t = list(r.choice(words, r.integers(10, 150)))
        if i % 5 == 0:
            for p in r.integers(0, len(t), 3):
                t[p] = r.choice(["grumble", "snarling"])
        out.append((i, " ".join(t), int(i % 5 == 0)))
    return out


def test_frames(spark):
    data = texts(700) + [(1000, None, 0), (1001, "", 0), (None, "null id", 1)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in data] + [(5, data[5][1], "again")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, k) for i, _, k in data] + [(7, None), (8, 0)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == len(data) + 1
    truth, right = {i: k for i, _, k in data}, []
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        if r.held_out and r.doc_id is not None and r.doc_id < 1000:
            right.append(r.predicted == truth[r.doc_id])
    assert np.mean(right) > 0.97
    empty = docs.limit(0)
    assert toxicity.score(empty, toxicity.train(empty, labels.limit(0))).count() == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = [r for r in op4_toxicity(spark, d).collect() if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in got]) >= 0.95
    assert np.mean([r.predicted for r in got if not truth[r.doc_id]]) <= 0.02


def test_query_against_a_plain_loop(spark):
    """Each document's windows one by one through the network."""
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    net = toxicity.train(docs.select("doc_id", "text"), labels)
    got = {r.doc_id: r for r in op4_toxicity(spark, d).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(got) == sorted(texts)
    for i, text in texts.items():
        words, logits = (text or "").lower().encode().split(), []
        begins = list(range(0, max(1, len(words) - 16), 16))
        for at in begins:
            window = words[at : at + 32]
            x, mask = np.zeros((1, 32), np.int64), np.zeros((1, 32), np.float32)
            x[0, : len(window)], mask[0, : len(window)] = range(len(window)), 1
            table = net.inputs(net.vectors(window or [b"."]))
            logits.append(float(net.forward(table, x, mask)[0]))
        z = net.fit[0] * max(logits) + net.fit[1] * np.log(len(begins)) + net.fit[2]
        assert abs(got[i].score - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 2e-3
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and got[i].predicted == int(got[i].score >= 0.5)
