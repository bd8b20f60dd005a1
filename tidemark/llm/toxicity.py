"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as a learned vector of the word, if it is frequent in the training sample, plus the sum of
learned vectors of its characters' n-grams (bytes with word ends, hashed) over the root of their number. Two gated recurrent networks read a window of words from either
side; attention pools their states into one logit. All overlapping windows of a text are scored; the
largest logit and the number of windows give the text's score by a logistic fit.

Training takes a bounded sample of labelled texts; a text's label is that of its window with the largest
logit (multiple-instance learning), which tasks look for among all windows of the text before each round.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from copy import copy

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, text_batches
from tidemark.llm.learning import fit_logistic, held_out, labelled_sample

MODULUS, KEPT_OUT = 5, 0
#: Labelled texts that the network is trained on, at most, and windows of each in a round before the network can choose them, drawn anew.
SAMPLE, DRAWN, SEED = 4000, 3, 4
#: Words to a window and from one window's start to the next: half a window, so that what is no longer than that lies in one whole.
WINDOW, STRIDE = 32, 16
WIDTH, HIDDEN, ATTENTION, TABLE_BITS = 16, 12, 8, 15
ROUNDS, BATCH, RATE = (2, 6), 96, 0.05
#: Texts of the sample that a word with a vector of its own occurs in, at least, and such words, at most.
FREQUENT, VOCABULARY = 12, 8192
#: Words whose inputs are remembered, and windows scored at a time.
REMEMBERED, CHUNK = 50_000, 2048
#: Words whose vectors are made at a time.
AT_ONCE = 16_384


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").decode("utf-8", "replace").lower().encode().split()


def starts(n: int) -> range:
    """Starts of the overlapping windows over n words: all words are covered; one window if they fit in it."""
    return range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)


def word_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the words' n-grams in the character table, one word after another, and where each word's begin."""
    joined = b"".join(b"\x01" + w + b"\x02" for w in words)
    b = np.frombuffer(joined + bytes(4), np.uint8).astype(np.uint64)
    n = np.fromiter(map(len, words), np.int64, len(words)) + 2
    first = np.cumsum(n) - n
    three = (b[:-2] << np.uint64(16)) | (b[1:-1] << np.uint64(8)) | b[2:]
    five = (three[:-2] << np.uint64(16)) | (b[3:-1] << np.uint64(8)) | b[4:]
    fold = lambda c, k: ((c + np.uint64(k << 40)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
    threes, fives = fold(three, 1), fold(five, 2)
    # the n-grams inside a word start at its first byte and end with its last
    many3, many5 = n - 2, np.maximum(n - 4, 0)
    many = many3 + many5
    begin = np.cumsum(many) - many
    within = np.arange(int(many.sum())) - np.repeat(begin, many)
    at, of3 = np.repeat(first, many), np.repeat(many3, many)
    grams = np.where(within < of3, threes[np.minimum(at + within, len(threes) - 1)], fives[np.clip(at + within - of3, 0, len(fives) - 1)])
    return grams, begin


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Parameters by name; ``p["words"]`` and ``p["grams"]`` are the input tables, 0 and 1 the two directions.

    ``known`` has the words' rows; row 0 is that of all others and stays zero.
    """

    def __init__(self, seed: int = SEED, known: dict[bytes, int] | None = None):
        r, self.known = np.random.default_rng(seed), known or {}
        normal = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        self.p = {"words": np.zeros((len(self.known) + 1, WIDTH), np.float32), "grams": normal(1 << TABLE_BITS, WIDTH, scale=0.1), "a": normal(2 * HIDDEN, ATTENTION, scale=0.3), "u": normal(ATTENTION, scale=0.3), "o": normal(2 * HIDDEN, scale=0.3), "b": np.zeros(1, np.float32)}
        for d in (0, 1):
            self.p |= {f"x{d}": normal(WIDTH, 3 * HIDDEN, scale=0.25), f"h{d}": normal(HIDDEN, 3 * HIDDEN, scale=0.25), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.sums = {k: np.full(v.shape, 1e-3, np.float32) for k, v in self.p.items()}
        self.fit = np.array([1.0, 0.0, 0.0])

    def own(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter((self.known.get(w, 0) for w in words), np.int64, len(words))

    def vectors(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros((0, WIDTH), np.float32)
        if len(words) > AT_ONCE:  # n-grams take some hundred bytes a word
            return np.concatenate([self.vectors(words[i : i + AT_ONCE]) for i in range(0, len(words), AT_ONCE)])
        own = self.own(words)
        grams, begin = word_grams(words)
        ends = np.append(begin[1:], len(grams))
        return self.p["words"][own] + np.add.reduceat(self.p["grams"][grams], begin, axis=0) / np.sqrt(ends - begin)[:, None].astype(np.float32)

    def inputs(self, vectors: np.ndarray) -> np.ndarray:
        """Both directions' gate inputs of words."""
        return np.concatenate([vectors @ self.p["x0"] + self.p["c0"], vectors @ self.p["x1"] + self.p["c1"]], axis=1)

    def forward(self, table: np.ndarray, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows: x (windows, words) are rows of ``table``, mask is 1 for words and 0 beyond the end."""
        n, length = x.shape
        states, steps = np.zeros((2, length, n, HIDDEN), np.float32), []
        for d in (0, 1):
            h, weights = np.zeros((n, HIDDEN), np.float32), self.p[f"h{d}"]
            for t in range(length) if d == 0 else range(length - 1, -1, -1):
                g = table[x[:, t], 3 * HIDDEN * d : 3 * HIDDEN * (d + 1)]
                m = mask[:, t, None]
                inner = h @ weights
                zr = _sigmoid(g[:, : 2 * HIDDEN] + inner[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(g[:, 2 * HIDDEN :] + r * inner[:, 2 * HIDDEN :])
                new = h + m * (1 - z) * (c - h)
                if keep:
                    steps.append((d, t, h, z, r, c, inner[:, 2 * HIDDEN :], m))
                states[d, t] = h = new
        both = np.concatenate([states[0], states[1]], axis=2)  # (words, windows, 2 * HIDDEN)
        hidden = np.tanh(both @ self.p["a"])
        e = hidden @ self.p["u"] + (mask.T - 1) * 1e4
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        pooled = (w[:, :, None] * both).sum(axis=0)
        logits = pooled @ self.p["o"] + self.p["b"]
        return (logits, (both, hidden, w, pooled, steps)) if keep else logits

    def backward(self, x: np.ndarray, kept: tuple, slope: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters, and of the gate inputs (windows, words, 6 * HIDDEN), from those of the logits."""
        both, hidden, w, pooled, steps = kept
        p, (n, length) = self.p, x.shape
        grad = {k: np.zeros_like(v) for k, v in p.items() if k not in ("words", "grams")}
        grad["o"], grad["b"] = slope @ pooled, np.array([slope.sum()], np.float32)
        d_pooled = slope[:, None] * p["o"][None, :]
        d_both = w[:, :, None] * d_pooled[None]
        d_w = (both * d_pooled[None]).sum(axis=2)
        d_e = w * (d_w - (w * d_w).sum(axis=0))
        d_hidden = d_e[:, :, None] * p["u"] * (1 - hidden**2)
        grad["u"] = (d_e[:, :, None] * hidden).sum(axis=(0, 1))
        grad["a"] = np.einsum("tnk,tna->ka", both, d_hidden)
        d_both += d_hidden @ p["a"].T
        d_in = np.zeros((n, length, 6 * HIDDEN), np.float32)
        d_h = np.zeros((2, n, HIDDEN), np.float32)
        for d, t, h, z, r, c, inner, m in reversed(steps):
            own = d_h[d] + d_both[t, :, HIDDEN * d : HIDDEN * (d + 1)]
            d_new = own * m
            d_c = d_new * (1 - z) * (1 - c**2)
            d_z = -d_new * (c - h) * z * (1 - z)
            d_r = d_c * inner * r * (1 - r)
            d_inner = np.concatenate([d_z, d_r, d_c * r], axis=1)
            d_in[:, t, 3 * HIDDEN * d : 3 * HIDDEN * (d + 1)] = np.concatenate([d_z, d_r, d_c], axis=1)
            grad[f"h{d}"] += h.T @ d_inner
            d_h[d] = own - d_new * (1 - z) + d_inner @ p[f"h{d}"].T
        return grad, d_in

    def step(self, words: list[bytes], x: np.ndarray, mask: np.ndarray, slope_of) -> None:
        """One step of AdaGrad on windows over ``words``; ``slope_of`` maps logits to their gradients."""
        p = self.p
        vectors = self.vectors(words)
        logits, kept = self.forward(self.inputs(vectors), x, mask, keep=True)
        grad, d_in = self.backward(x, kept, slope_of(logits).astype(np.float32))
        flat = np.zeros((len(words), 6 * HIDDEN), np.float32)
        np.add.at(flat, x.ravel(), d_in.reshape(-1, 6 * HIDDEN))
        d_vectors = np.zeros_like(vectors)
        for d in (0, 1):
            part = flat[:, 3 * HIDDEN * d : 3 * HIDDEN * (d + 1)]
            grad[f"x{d}"], grad[f"c{d}"] = vectors.T @ part, part.sum(axis=0)
            d_vectors += part @ p[f"x{d}"].T
        for k, g in grad.items():
            self.sums[k] += g * g
            p[k] -= RATE * g / np.sqrt(self.sums[k])
        own = self.own(words)
        grams, begin = word_grams(words)
        many = np.append(begin[1:], len(grams)) - begin
        for k, rows, g in (("words", own, d_vectors), ("grams", grams, np.repeat(d_vectors / np.sqrt(many)[:, None].astype(np.float32), many, axis=0))):
            used, back = np.unique(rows, return_inverse=True)
            total = np.zeros((len(used), WIDTH), np.float32)
            np.add.at(total, back, g)
            self.sums[k][used] += total * total
            p[k][used] -= RATE * total / np.sqrt(self.sums[k][used])
        p["words"][0] = 0


def _windows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows (rows of words, 0 beyond the end) and mask over a text's words; one empty window if there are none."""
    begins = np.array(starts(len(rows)))
    at = begins[:, None] + np.arange(WINDOW)
    mask = at < len(rows)
    return np.where(mask, rows[np.minimum(at, max(0, len(rows) - 1))] if len(rows) else 0, 0), mask.astype(np.float32)


class Scorer:
    """Scores texts; remembers the gate inputs of words."""

    def __init__(self, network: Network):
        self.net = network
        self._forget()

    def _forget(self) -> None:
        self.row: dict[bytes, int] = {}
        self.table = np.zeros((1, 6 * HIDDEN), np.float32)

    def rows(self, words: list[bytes]) -> np.ndarray:
        fresh = [w for w in dict.fromkeys(words) if w not in self.row]
        if fresh:
            at = len(self.row)
            self.row.update(zip(fresh, range(at, at + len(fresh)), strict=True))
            while len(self.table) < len(self.row):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[at : at + len(fresh)] = self.net.inputs(self.net.vectors(fresh))
        return np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))

    def largest(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: the largest logit of its windows, their number, and the word that window starts at. Windows of many texts are scored together."""
        top, many, where = np.full(len(texts), -np.inf), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        held, size = [], 0

        def flush() -> None:
            nonlocal held, size
            x, mask = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            of = np.repeat([h[0] for h in held], [len(h[1]) for h in held])
            begin = np.concatenate([h[3] + STRIDE * np.arange(len(h[1])) for h in held])
            for i in range(0, len(x), CHUNK):
                logits, o, b = self.net.forward(self.table, x[i : i + CHUNK], mask[i : i + CHUNK]), of[i : i + CHUNK], begin[i : i + CHUNK]
                order = np.lexsort((-b, logits, o))
                best = order[np.append(o[order][1:] != o[order][:-1], True)]
                best = best[logits[best] > top[o[best]]]
                top[o[best]], where[o[best]] = logits[best], b[best]
            held, size = [], 0

        for i, text in enumerate(texts):
            words = words_of(text)
            many[i] = len(starts(len(words)))
            for at in range(0, max(1, len(words)), STRIDE * CHUNK):
                part = words[at : at + STRIDE * CHUNK + WINDOW - STRIDE]
                if at and len(part) <= WINDOW - STRIDE:
                    break
                if len(self.row) > REMEMBERED:
                    if held:
                        flush()
                    self._forget()
                x, mask = _windows(self.rows(part))
                held.append((i, x, mask, at))
                size += len(x)
                if size >= CHUNK:
                    flush()
        if held:
            flush()
        return top, many, where

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        top, many, _ = self.largest(texts)
        x = self.net.fit
        return _sigmoid(np.clip(x[0] * top + x[1] * np.log(many) + x[2], -30, 30))


def packed(windows: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words of some windows, and the windows as rows of them with their mask."""
    number: dict[bytes, int] = {}
    x, mask = np.zeros((len(windows), WINDOW), np.int64), np.zeros((len(windows), WINDOW), np.float32)
    for i, window in enumerate(windows):
        own = [number.setdefault(w, len(number)) for w in window.split()]
        x[i, : len(own)], mask[i, : len(own)] = own, 1
    return list(number) or [b"."], x, mask


def fit(chosen: Callable[[Network | None], tuple[np.ndarray, list[list[bytes]]]], known: list[bytes], y: np.ndarray, seed: int = SEED) -> Network:
    """Train on what ``chosen`` returns before each round: labels, and windows (words joined by spaces) of each text.

    First it is asked for windows without a network, then for those of the largest logit. ``y`` are the
    labels of all texts; without both classes the network says the share of label 1.
    """
    r = np.random.default_rng(seed)
    net = Network(seed, {w: i + 1 for i, w in enumerate(known)})
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.0
        net.fit = np.array([0.0, 0.0, np.log((share + 0.01) / (1.01 - share))])
        return net
    weight = min(4.0, np.sum(y == 0) / np.sum(y == 1))
    for k in range(sum(ROUNDS)):
        labels, bags = chosen(None if k < ROUNDS[0] else net)
        flat = [(w, label) for label, bag in zip(labels, bags, strict=True) for w in bag]
        order = r.permutation(len(flat))
        for at in range(0, len(order), BATCH):
            part = [flat[i] for i in order[at : at + BATCH]]
            goal = np.array([label for _, label in part])
            net.step(*packed([w for w, _ in part]), lambda logits, goal=goal: (_sigmoid(logits) - goal) * np.where(goal == 1, weight, 1.0))
    return net


def calibrate(net: Network, top: np.ndarray, many: np.ndarray, y: np.ndarray) -> None:
    if len(set(y.tolist())) == 2:
        net.fit = fit_logistic(np.column_stack([top, np.log(many)]), y.astype(float), ridge=0.1)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", sample: int = SAMPLE) -> Network:
    """Fit on at most ``sample`` labelled texts whose crc32(doc_id) mod 5 is not 0, on all of their windows.

    Tasks count the texts each word occurs in, draw or choose the windows of a round over whole texts, and
    score the whole texts for the calibration. A round sends the driver the windows it trains on, so that
    no more of a very long text gets there. Null texts are empty; null labels and ids are left out; an id
    with several rows or labels counts once (see ``labelled_sample``); without rows the score is constant.
    """
    text_batches(docs.sparkSession)
    known = labelled_sample(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), labels, label, held_out("doc_id", MODULUS, KEPT_OUT), sample, SEED)
    known = cut(known.select("doc_id", F.least(F.lit(1), F.greatest(F.lit(0), "known_label")).alias("known_label"), F.col("text").cast("binary").alias("text")).repartition(16), "labelled")
    context = docs.sparkSession.sparkContext

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = Counter()
            for data in batch["text"]:
                seen.update(set(words_of(data)))
            yield pd.DataFrame({"word": list(seen.keys()), "n": list(seen.values())})

    frequent = known.mapInPandas(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "word").limit(VOCABULARY)
    asked = 0

    def chosen(net: Network | None) -> tuple[np.ndarray, list[list[bytes]]]:
        nonlocal asked
        asked += 1
        turn, sent = asked, None
        if net is not None:
            light = copy(net)
            light.sums = {}
            sent = context.broadcast(light)

        def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            scorer = Scorer(sent.value) if sent is not None else None
            for batch in batches:
                texts, out = list(batch["text"]), []
                best = scorer.largest(texts)[2] if scorer is not None else None
                for j, (i, data) in enumerate(zip(batch["doc_id"], texts, strict=True)):
                    words = words_of(data)
                    if best is None:
                        begins = np.array(starts(len(words)))
                        at = np.sort(np.random.default_rng([int(i) & 0xFFFFFFFF, turn]).permutation(begins)[:DRAWN])
                    else:
                        at = best[j : j + 1]
                    out.append([b" ".join(words[b : b + WINDOW]) for b in at])
                yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["known_label"], "bag": out})

        rows = sorted((r.doc_id, r.label, [bytes(b) for b in r.bag]) for r in known.mapInPandas(windows, "doc_id long, label int, bag array<binary>").collect())
        if sent is not None:
            sent.unpersist()
        return np.array([k for _, k, _ in rows], np.int64), [bag for _, _, bag in rows]

    y = np.array([r.known_label for r in known.select("known_label").collect()], np.int64)
    net = fit(chosen, [bytes(r.word) for r in frequent.collect()], y)
    net.sums = {}
    sent = context.broadcast(net)

    def largest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(sent.value)
        for batch in batches:
            top, many, _ = scorer.largest(list(batch["text"]))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["known_label"], "top": top, "many": many})

    found = sorted(tuple(r) for r in known.mapInPandas(largest, "doc_id long, label int, top double, many double").collect())
    calibrate(net, np.array([f[2] for f in found]), np.array([f[3] for f in found]), np.array([f[1] for f in found]))
    return net


def score(docs: DataFrame, net: Network, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (columns ``keep``, all by default) with held_out, score (0 to 1) and predicted (1 if score >= 0.5).

    All windows of whole texts are scored, however long they are, ``CHUNK`` at a time; a null or empty text
    is one empty window; repeated rows score alike; of windows with equal logits it doesn't matter which is
    the largest; an empty table gives an empty result. Columns of these names, in any case of letters, are
    replaced. The network, about 2 MB, is broadcast.
    """
    text_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf(T.DoubleType())
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(sent.value)
        for texts in batches:
            yield pd.Series(np.concatenate([scorer.score(list(texts[i : i + 512])) for i in range(0, len(texts), 512)]) if len(texts) else [], dtype=float)

    names = ("held_out", "score", "predicted")
    kept = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep) if c.lower() not in names]
    out = docs.select(*kept, held_out(doc_id, MODULUS, KEPT_OUT).alias("held_out"), of(F.col(text).cast("binary")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
