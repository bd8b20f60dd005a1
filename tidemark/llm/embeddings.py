"""Embedding near-duplicates with randomised-rotation binary codes.

Unit vectors are rotated by one random orthogonal matrix. A vector keeps the signs of its rotated
components as a binary code and the inner product f of code and vector as a correction factor. For a
vector with code x and another rotated vector q, <x, q> / f estimates their inner product without bias,
with an error of at most ``confidence`` * sqrt((1 - f*f) / (f*f * (d - 1))) but for a vanishing share of
pairs; q takes part rounded at random to ``QUERY_BITS`` bits, so <x, q> is a few bit counts. Pairs whose
upper bound reaches the threshold are recomputed in double precision, the others are not.

Equal vectors are one class. Classes of a label are listed under their ``PROBES`` nearest of at most
``CENTROIDS`` centroids from a bounded sample; a pair is compared in the first list both are in. The
number of lists grows with the classes: where lists would hold more than ``PER_LIST`` on average, each is
divided again by the ``FINE`` nearest of as many centroids of the sample's residuals, level by level. Long
lists are cut into blocks that meet pairwise. A task returns link counts and a spanning forest, never the
pairs themselves.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut
from tidemark.llm.components import components

THRESHOLD, SEED, QUERY_BITS = 0.98, 5, 4
#: In standard deviations of the estimate's error; at 6 about one pair in 10**9 would be missed.
CONFIDENCE = 6.0
#: Vectors sampled for the index, centroids taken of them at most at each level, and lists that a vector is in by the first level and by each further one.
SAMPLE, CENTROIDS, PROBES, FINE = 4096, 256, 5, 3
#: Classes to a list on average, above which a level is added.
PER_LIST = 4096
#: Cosine above which a sampled vector is too near a centroid to be one: a group of near copies gets one centroid.
APART = 0.9
#: Classes to a block of a list.
BLOCK = 1024


@lru_cache(maxsize=16)
def rotation(d: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same in every process."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


class Codes:
    """Binary codes, correction factors and randomly rounded queries of unit vectors."""

    def __init__(self, unit: np.ndarray, seed: int = SEED):
        n, self.d = unit.shape
        rotated = unit @ rotation(self.d, seed).T
        words = -(-self.d // 64)
        bits = np.zeros((n, words * 64), np.uint8)
        bits[:, : self.d] = rotated > 0
        self.code = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).reshape(n, words)
        self.ones = np.bitwise_count(self.code).sum(axis=1).astype(np.float64)
        self.factor = np.abs(rotated).sum(axis=1) / np.sqrt(self.d)
        low, high = rotated.min(axis=1), rotated.max(axis=1)
        self.low, self.width = low, np.maximum(high - low, 1e-30) / (2**QUERY_BITS - 1)
        # rounded up or down at random, so that the expectation is the component itself
        noise = np.random.default_rng((seed, n)).random((n, self.d))
        level = np.clip(np.floor((rotated - low[:, None]) / self.width[:, None] + noise), 0, 2**QUERY_BITS - 1).astype(np.uint8)
        self.total = level.sum(axis=1).astype(np.float64)
        self.planes = []
        for j in range(QUERY_BITS):
            bits[:, : self.d] = level >> j & 1
            self.planes.append(np.packbits(bits, axis=1, bitorder="little").view(np.uint64).reshape(n, words))

    def upper(self, a: slice, other: Codes, b: slice, confidence: float) -> np.ndarray:
        """Upper bounds of the inner products between own codes ``a`` and the others' queries ``b``."""
        dots = sum((1 << j) * sum(np.bitwise_count(self.code[a, w][:, None] & plane[b, w][None, :]).astype(np.float32) for w in range(plane.shape[1])) for j, plane in enumerate(other.planes))
        # <2 bits - 1, q> / sqrt(d), q = low + width * level
        ones, low, width, total = self.ones[a][:, None], other.low[b][None, :], other.width[b][None, :], other.total[b][None, :]
        product = (2 * (low * ones + width * dots) - (low * self.d + width * total)) / np.sqrt(self.d)
        f = self.factor[a][:, None]
        error = np.sqrt(np.maximum(0, 1 - f * f) / (f * f * max(1, self.d - 1))) + width / (2 * f)
        return product / f + confidence * error


def _pairs(x: dict, y: dict | None, cell: int, threshold: float, confidence: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of linked pairs between two blocks, or within one, that this list is the first to hold."""
    own = y is None
    y = x if own else y
    out_a, out_b = [], []
    for i in range(0, len(x["ids"]), 256):
        part = slice(i, i + 256)
        may = x["codes"].upper(part, y["codes"], slice(None), confidence) >= threshold
        if own:
            may &= np.arange(len(y["ids"]))[None, :] > np.arange(i, min(i + 256, len(x["ids"])))[:, None]
        a, b = np.nonzero(may)
        a += i
        for j in range(0, len(a), 65536):
            aa, bb = a[j : j + 65536], b[j : j + 65536]
            cosine = (x["v"][aa] * y["v"][bb]).sum(axis=1) / (x["norm"][aa] * y["norm"][bb])
            aa, bb = aa[cosine >= threshold], bb[cosine >= threshold]
            shared = x["cells"][aa][:, :, None] == y["cells"][bb][:, None, :]
            first = np.where(shared.any(axis=2), x["cells"][aa], np.iinfo(np.int64).max).min(axis=1) if len(aa) else np.empty(0)
            out_a.append(aa[first == cell])
            out_b.append(bb[first == cell])
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.empty(0, int), np.empty(0, int))


def _forest(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from the members of each component to its first member, over indices into ``ids``."""
    label = np.arange(len(ids))
    while len(a):
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if np.array_equal(before, label):
            break
    tied = label != np.arange(len(ids))
    return ids[label[tied]], ids[tied]


def _meet(key: tuple, rows: pd.DataFrame, threshold: float, confidence: float, seed: int) -> pd.DataFrame:
    """Two blocks of a list (or one): rows (a, b, links), an edge if b is not null, else b's count of links."""
    _, cell, low, high = key
    blocks = []
    for which in dict.fromkeys((low, high)):
        own = rows[rows["block"] == which]
        v = np.stack(own["v"].to_numpy()).astype(np.float64) if len(own) else np.zeros((0, 1))
        norm = np.sqrt((v * v).sum(axis=1))
        ids = own["id"].to_numpy(np.int64)
        unit = v / norm[:, None] if len(own) else v
        blocks.append({"ids": ids, "n": own["n"].to_numpy(np.int64), "v": v, "norm": norm, "cells": np.stack(own["cells"].to_numpy()).astype(np.int64) if len(own) else np.zeros((0, 1), np.int64), "codes": Codes(unit, seed)})
    x, y = blocks[0], blocks[-1]
    a, b = _pairs(x, y if low != high else None, cell, threshold, confidence)
    shift = 0 if low == high else len(x["ids"])
    ids = x["ids"] if low == high else np.concatenate([x["ids"], y["ids"]])
    n = x["n"] if low == high else np.concatenate([x["n"], y["n"]])
    links = np.bincount(a, n[b + shift], len(ids)) + np.bincount(b + shift, n[a], len(ids))
    has = np.nonzero(links)[0]
    ea, eb = _forest(ids, a, b + shift)
    return pd.DataFrame({"a": np.concatenate([ids[has], ea]), "b": np.concatenate([np.zeros(len(has), np.int64), eb]), "edge": np.repeat([False, True], [len(has), len(ea)]), "links": np.concatenate([links[has].astype(np.int64), np.zeros(len(ea), np.int64)])})


def spread(sample: np.ndarray, most: int) -> np.ndarray:
    """Vectors of a sample of unit vectors, in turn, that are not too near one taken before."""
    unit = sample
    taken, near = [], np.zeros(len(unit), bool)
    for i in range(len(unit)):
        if not near[i] and len(taken) < most:
            taken.append(i)
            near |= unit @ unit[i] > APART
    return unit[taken]


def index(sample: np.ndarray, most: int, levels: int) -> list[np.ndarray]:
    """Centroids of each level: of the sample's unit vectors, then of the directions that those before leave."""
    out, left = [], sample / np.sqrt((sample * sample).sum(axis=1))[:, None]
    for _ in range(levels):
        out.append(spread(left, most))
        nearest = out[-1][np.argmax(left @ out[-1].T, axis=1)]
        left = left - (left * nearest).sum(axis=1, keepdims=True) * nearest
        size = np.sqrt((left * left).sum(axis=1))
        left = left[size > 1e-9] / size[size > 1e-9, None]
        if not len(left):
            break
    return out


def cells(unit: np.ndarray, centroids: list[np.ndarray], probes: int) -> np.ndarray:
    """Numbers of the lists that each vector is in, one row a vector."""
    found = np.argsort(-(unit @ centroids[0].T), axis=1, kind="stable")[:, :probes].astype(np.int64)

    def beside(v: np.ndarray, centroid: np.ndarray) -> np.ndarray:
        """Direction of what of ``v`` is at right angles to the centroid."""
        v = v - (v * centroid).sum(axis=-1, keepdims=True) * centroid
        return v / np.maximum(np.sqrt((v * v).sum(axis=-1, keepdims=True)), 1e-300)

    left = beside(unit[:, None, :], centroids[0][found])
    for level in centroids[1:]:
        near = np.argsort(-(left @ level.T), axis=2, kind="stable")[:, :, :FINE]
        left = beside(left[:, :, None, :], level[near]).reshape(len(unit), -1, unit.shape[1])
        found = (found[:, :, None] * (len(level) + 1) + near).reshape(len(unit), -1)
    return found


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, confidence: float = CONFIDENCE, centroids: int = CENTROIDS, probes: int = PROBES, per_list: int = PER_LIST, seed: int = SEED) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Rows of one label, not null, link if their cosine is at least ``threshold``. Vectors that are null,
    empty or zero, or hold null or non-finite components, link with nothing, nor do vectors of different
    length or rows without an id. A row counts its links to other rows, equal vectors included;
    component_id is the smallest id reachable. An empty table gives an empty result. Links are found
    where two vectors share a list: tested against brute force. A length of vectors that the sample misses
    is one list, cut into blocks like any other.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"), F.col(label).alias("label"))
    good = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    # floats stay floats on the way: they take half the room, and tasks compute with them in double precision
    kind = "float" if dict(rows.dtypes)["v"] == "array<float>" else "double"
    rows = cut(rows.withColumn("v", F.when(good, F.transform("v", lambda x: x.cast(kind) + F.lit(0.0).cast(kind)))), "vectors")
    classes = rows.where("v is not null").groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
    classes = cut(classes.withColumn("d", F.size("v")), "classes")

    # the sample: the vectors of smallest id hash, so many at most; independent of partitioning
    sample: dict[int, list] = {}
    for r in classes.select("d", "v", F.xxhash64(F.lit(seed), "id").alias("h")).orderBy("h").limit(SAMPLE).collect():
        sample.setdefault(r.d, []).append(r.v)
    lists = -(-classes.count() // max(1, per_list))
    levels = 1
    while centroids > 1 and centroids**levels < lists:
        levels += 1
    held = {d: index(np.array(v, np.float64), centroids, levels) for d, v in sample.items()}
    sent = rows.sparkSession.sparkContext.broadcast(held)

    @F.pandas_udf("array<long>")
    def nearest(vs: pd.Series) -> pd.Series:
        out = []
        for i in range(0, len(vs), 1024):
            part = vs.iloc[i : i + 1024]
            lengths = part.map(len)
            found = pd.Series([None] * len(part), index=part.index, dtype=object)
            for d in lengths.unique():
                own = part[lengths == d]
                unit = np.stack(own.to_numpy()).astype(np.float64)
                unit = unit / np.maximum(np.sqrt((unit * unit).sum(axis=1)), 1e-300)[:, None]
                near = np.zeros((len(own), 1), np.int64) if d not in sent.value else cells(unit, sent.value[d], probes)
                found[lengths == d] = pd.Series(list(near), index=own.index, dtype=object)
            out.append(found)
        return pd.concat(out) if out else pd.Series([], dtype=object)

    listed = cut(classes.select("label", "d", "id", "n", "v", nearest("v").alias("cells")), "listed")
    entry = listed.select("label", "d", "id", F.explode("cells").alias("cell"))
    sizes = entry.groupBy("label", "d", "cell").agg(F.count("*").alias("size")).where("size > 1").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("long"))
    posted = listed.withColumn("cell", F.explode("cells")).join(sizes, ["label", "d", "cell"])
    posted = posted.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    # a block meets itself and every other once
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    met = posted.select("*", other).select(F.xxhash64("label", "d").alias("kind"), "cell", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "n", "v", "cells")

    def meet(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        return _meet(key, found, threshold, confidence, seed)

    found = cut(met.groupBy("kind", "cell", "low", "high").applyInPandas(meet, "a long, b long, edge boolean, links long"), "links")
    links = found.where("not edge").groupBy("a").agg(F.sum("links").alias("links"))
    roots = components(found.where("edge").select("a", "b"))
    known = classes.join(links, classes.id == links.a, "left").join(roots, classes.id == roots.node, "left")
    known = known.select(F.col("label").alias("label2"), F.col("v").alias("v2"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.join(known, (F.col("label") == F.col("label2")) & (F.col("v") == F.col("v2")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
