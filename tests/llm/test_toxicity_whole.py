"""Training looks at all windows of the sampled texts and at whole words."""

import numpy as np

from tidemark.llm import toxicity


def test_a_short_passage_lies_in_one_window_whole():
    half = toxicity.WINDOW // 2
    for n in (32, 100, 555):
        begins = list(toxicity.starts(n))
        assert all(any(s <= at and at + half <= s + toxicity.WINDOW for s in begins) for at in range(n - half + 1))


def test_the_window_of_the_largest_logit_is_found(monkeypatch):
    scorer = toxicity.Scorer(toxicity.Network(3))
    words = [f"w{i}".encode() for i in range(900)]
    x, mask = toxicity._windows(scorer.rows(words))
    logits = scorer.net.forward(scorer.table, x, mask)
    monkeypatch.setattr(toxicity, "CHUNK", 8)
    top, many, where = scorer.largest([b"", b" ".join(words)])
    assert where[1] == toxicity.STRIDE * int(np.argmax(logits)) and many[1] == len(logits) and abs(top[1] - logits.max()) < 1e-4


def test_training_sees_every_part_of_long_texts_and_whole_words(spark, monkeypatch):
    asked = []

    def fit(chosen, known, y, seed=toxicity.SEED):
        net = toxicity.Network(seed, {w: i + 1 for i, w in enumerate(known)})
        asked.extend([known, y, *chosen(None), *chosen(net)])
        return net

    monkeypatch.setattr(toxicity, "fit", fit)
    long = "日" * 300
    docs = [(i, " ".join(f"d{i}w{j}" for j in range(2000)) + f" rareterm {long}", i % 2) for i in range(40)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    net = toxicity.train(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    known, y, _, drawn, labels, best = asked
    # words at the end of all texts are known, uncut; each text's chosen window is the best of all of its windows
    assert known == sorted([b"rareterm", long.encode()]) and len(y) == len(labels) == len(best) and {len(b) for b in drawn} == {toxicity.DRAWN}
    scorer = toxicity.Scorer(net)
    text = {i: t for i, t in ((r.doc_id, r.text.encode()) for r in docs.collect())}
    for bag in best:
        i = int(bag[0].split()[0].split(b"w")[0][1:])
        words = toxicity.words_of(text[i])
        at = scorer.largest([text[i]])[2][0]
        assert bag == [b" ".join(words[at : at + toxicity.WINDOW])]
