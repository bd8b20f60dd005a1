"""What the two classifiers share: the bounded training sample and the calibration of scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import remainder


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, most: int, seed: int) -> DataFrame:
    """(doc_id, text, known_label) from ``docs`` (doc_id, text) for at most ``most`` labelled ids that are not held out, by hash of the id.

    Only (id, label) rows, ``most`` of them at most, are broadcast; the documents are not shuffled. An id
    with several labels keeps the largest, one with several rows the text first in order, so that a much
    repeated id is one row of the sample. Null ids and null labels are left out.
    """
    known = labels.where(~held_out & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most)
    known = known.select(F.col("doc_id").alias("known_id"), F.col("label").alias("known_label"))
    rows = docs.join(F.broadcast(known), F.col("doc_id") == F.col("known_id"))
    return rows.groupBy("doc_id", "known_label").agg(F.min("text").alias("text"))


def held_out(doc_id: str, modulus: int, kept_out: int) -> Column:
    return remainder(doc_id, modulus) == kept_out


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 1e-3) -> np.ndarray:
    """Weights (one more for the intercept) of a logistic regression by Newton's method."""
    a = np.column_stack([x, np.ones(len(y))])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
    return w
