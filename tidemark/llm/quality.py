"""Quality classifier: naive Bayes support vectors.

Indicators of n-grams (hashed: bytes of length 2 to 4, words, pairs of words, and six of how often both
words of a pair are the same, which tell junk from prose) are scaled by the log ratio of their counts in the two classes; a linear model with hinge loss is
fitted to them by dual coordinate descent, and its margin is calibrated by a logistic fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import text_batches
from tidemark.llm.learning import fit_logistic, held_out, labelled_sample

MODULUS, KEPT_OUT = 3, 1
#: Labelled rows that the model is fitted on, at most.
SAMPLE, SEED = 6000, 3
BITS, ALPHA, COST, ROUNDS = 18, 1.0, 0.02, 12
#: Bytes of a text that are turned into n-grams at a time.
STEP = 1 << 20


def _fold(codes: np.ndarray, kind: int) -> np.ndarray:
    mixed = (codes + np.uint64(kind << 40)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: bytes | None) -> np.ndarray:
    """Sorted distinct feature numbers of a whole text; none for a null or empty one."""
    data, seen = text or b"", np.zeros(1 << BITS, bool)
    for at in range(0, len(data), STEP):
        b = np.frombuffer(data[at : at + STEP + 3], np.uint8).astype(np.uint64)
        code = b
        for n in range(1, 4):
            code = (code[:-1] << np.uint64(8)) | b[n:]
            seen[_fold(code, n)] = True
    words, last = data.split(), None
    for at in range(0, len(words), STEP):
        part = words[at : at + STEP]
        h = np.fromiter(map(crc32, part), np.uint64, len(part))
        seen[_fold(h, 8)] = True
        before = h[:-1] if last is None else np.concatenate([[last], h[:-1]])
        after = h[1:] if last is None else h
        seen[_fold(before * np.uint64(31) + after, 9)] = True
        same = np.count_nonzero(before == after)
        for i, bar in enumerate((1, 2, 4, 8, 16, 32)):
            if same >= bar * max(1, len(part) // 256):
                seen[_fold(np.array([i], np.uint64), 10)] = True
        last = h[-1]
    return np.nonzero(seen)[0]


def packed(found: np.ndarray) -> bytes:
    """Feature numbers as four bytes each, or as a bitmap if that is shorter: 32 KB at most, whatever the text's length."""
    if 4 * len(found) < 1 << BITS - 3:
        return found.astype("<u4").tobytes()
    bits = np.zeros(1 << BITS, np.uint8)
    bits[found] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if len(data) < 1 << BITS - 3:
        return np.frombuffer(data, "<u4")
    return np.nonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little"))[0]


class Model:
    def __init__(self, weights: np.ndarray, bias: float, scale: np.ndarray):
        self.weights, self.bias, self.scale = weights.astype(np.float32), bias, scale

    def score(self, found: np.ndarray) -> float:
        margin = float(self.weights[found].sum()) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.scale[0] * margin + self.scale[1], -30, 30))))


def log_ratios(rows: list[bytes], y: np.ndarray) -> np.ndarray:
    """Log ratio of each feature's smoothed share among the documents of the two classes."""
    counts = [np.full(1 << BITS, ALPHA), np.full(1 << BITS, ALPHA)]
    for data, label in zip(rows, y, strict=True):
        counts[label][unpacked(data)] += 1
    return np.log(counts[1] / (np.sum(y == 1) + 2 * ALPHA)) - np.log(counts[0] / (np.sum(y == 0) + 2 * ALPHA))


def fit(rows: list[bytes], y: np.ndarray, seed: int = SEED) -> Model:
    """Hinge loss with an L2 penalty, by dual coordinate descent over packed rows in random order.

    A row's features are scaled to unit length. Without rows of both classes the score is constant.
    """
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return Model(np.zeros(1 << BITS), 0.0, np.array([0.0, np.log((share + 0.01) / (1.01 - share))]))
    r = log_ratios(rows, y)
    sign = np.where(y == 1, 1.0, -1.0)
    cost = np.where(y == 1, 1.0, np.sum(y == 1) / np.sum(y == 0)) * COST
    w, bias, alpha, order = np.zeros(1 << BITS), 0.0, np.zeros(len(y)), np.random.default_rng(seed)
    norm = np.array([float((r[unpacked(x)] ** 2).sum()) + 1.0 for x in rows])
    for _ in range(ROUNDS):
        for i in order.permutation(len(y)):
            f = unpacked(rows[i])
            x = r[f]
            gradient = sign[i] * (float(w[f] @ x) + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[f] += step * x
                bias += step
                alpha[i] = new
    weights = w * r
    margins = np.array([float(weights[unpacked(x)].sum()) + bias for x in rows])
    return Model(weights, bias, fit_logistic(margins[:, None] / margins.std(), y.astype(float), ridge=1.0) / np.array([margins.std(), 1.0]))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows whose crc32(doc_id) mod 3 is not 1.

    Only packed features and labels reach the driver: 32 KB a row at most, so 6,000 rows are 200 MB at
    most, however long the texts. Null texts are empty; null labels and ids are left out; an id with several
    rows or labels counts once (see ``labelled_sample``); without rows of both classes the score is constant.
    """
    text_batches(docs.sparkSession)
    known = labelled_sample(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), labels, label, held_out("doc_id", MODULUS, KEPT_OUT), sample, SEED)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["known_label"], "found": [packed(features(x)) for x in batch["text"]]})

    found = known.select("doc_id", "known_label", F.col("text").cast("binary").alias("text")).mapInPandas(run, "doc_id long, label int, found binary")
    # partition by partition, so that the sample is in the driver's memory once
    rows = sorted((r.doc_id, r.label, bytes(r.found)) for r in found.coalesce(8).toLocalIterator())
    return fit([f for _, _, f in rows], np.array([min(1, max(0, k)) for _, k, _ in rows], np.int64))


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (columns ``keep``, all by default) with held_out, score (0 to 1) and predicted (1 if score >= 0.5).

    Whole texts are scored, very long ones piece by piece; a null text counts as empty and an empty one has
    the score of no features; repeated rows score alike; an empty table gives an empty result. Columns of
    these names, in any case of letters, are replaced. The model, 2**18 weights, is broadcast.
    """
    text_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([sent.value.score(features(x)) for x in texts], dtype=float)

    names = ("held_out", "score", "predicted")
    kept = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep) if c.lower() not in names]
    out = docs.select(*kept, held_out(doc_id, MODULUS, KEPT_OUT).alias("held_out"), of(F.col(text).cast("binary")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
