"""SimHash near-duplicates through an inverted index on byte positions with count filtering.

Two fingerprints that differ in at most ``MAX_BITS`` bits differ in at most that many of their eight
bytes, so they share at least ``8 - MAX_BITS`` positional bytes: the guaranteed minimum of matches.
Entries of the index are (position, byte). A list of one entry would hold 1/256 of the corpus, so the
entries are dealt by routes first: of any ``4 + MAX_BITS`` positions a qualifying pair shares at least
four, and each distinct fingerprint goes to the routes of four of the first six positions (15 of them).
In a route the entries of the other four positions make the lists. Every list adds one to the tally of
each pair in it; pairs whose tally, with the route's four, reaches the minimum are retained and verified.

A route holds about N / 2**32 fingerprints, but a large group of near copies may put many into one. Routes
of more than ``HOT`` are dealt again by the remaining positions: those that a qualifying pair still has to
share are fixed as well (six choices of two), which leaves two bytes and at most 65,536 fingerprints.

Tasks return a spanning forest, so groups of thousands of near copies make no quadratic output.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, free_name, text_batches
from tidemark.llm.components import components

SHINGLE_WORDS, SEED, MAX_BITS = 3, 42, 2
#: Fingerprints in a route above which it is dealt again; pairs tallied at a time; fingerprints posted by one task.
HOT, PAIRS, SPREAD = 1024, 1 << 22, 20_000


def fingerprint(text: bytes | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of a text; 0 if it has no words (null, empty, only white space)."""
    found = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only, as the contract has it
    if not found:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(found)
    if len(found) <= words:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    total, n = np.zeros(64, np.int64), len(found) - words + 1
    for i in range(0, n, 65536):  # bounded memory for very long texts
        spans = zip(starts[i : min(i + 65536, n)].tolist(), ends[i + words - 1 : min(i + 65536, n) + words - 1].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], np.uint64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(text: Column) -> Column:
    """The fingerprint of a string column as a signed long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(x) for x in texts], np.uint64).view(np.int64))

    return of(text.cast("binary"))


def _mask(positions: tuple[int, ...]) -> int:
    """Signed mask of some byte positions; position 0 is the lowest byte."""
    m = sum(0xFF << 8 * p for p in positions)
    return m - (1 << 64) if m >> 63 else m


def routes(max_bits: int) -> list[tuple[int, ...]]:
    """Choices of four of the first ``4 + max_bits`` positions: a pair within ``max_bits`` bits shares one of them at least."""
    if not 0 <= max_bits <= 3:
        raise ValueError("routes of four positions leave a count to tally for at most 3 bits")
    return list(combinations(range(4 + max_bits), 4))


def _rest(route: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(p for p in range(8) if p not in route)


def tallies(lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows (a < b) that are in a common list, and in how many.

    ``lists`` has the number of the list of each row (axis 0) at each position (axis 1).
    """
    n, pairs = len(lists), []
    for own in lists.T:
        order = np.argsort(own, kind="stable")
        ordered = own[order]
        first = np.concatenate(([0], np.nonzero(np.diff(ordered))[0] + 1)) if n else np.zeros(0, np.int64)
        start = np.repeat(first, np.diff(np.append(first, n)))
        earlier = np.arange(n) - start  # a row meets those before it in its list
        right = np.repeat(np.arange(n), earlier)
        left = np.arange(len(right)) - np.repeat(np.cumsum(earlier) - earlier, earlier) + start[right]
        pairs.append(order[left] * n + order[right])  # a stable order keeps the smaller row left
    met, count = np.unique(np.concatenate(pairs), return_counts=True)
    return met // max(1, n), met % max(1, n), count


def counted_links(values: np.ndarray, group: np.ndarray, route: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked rows (a < b) of ``values`` within groups; ``route`` is the number of each row's route."""
    rest = np.array([_rest(r) for r in routes(max_bits)])[route]
    data = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    entries = (group[:, None] << 8) | np.take_along_axis(data, rest, axis=1)
    a, b, count = tallies(entries)
    enough = count >= 8 - max_bits - 4
    a, b = a[enough], b[enough]
    near = np.bitwise_count(values[a] ^ values[b]) <= max_bits
    return a[near], b[near]


def _first_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Index of the first member of each row's component over links a-b."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def _near(free: np.ndarray, max_bits: int) -> np.ndarray:
    """Bit patterns of at most ``max_bits`` of the bits set in ``free``, without zero."""
    bits = [1 << i for i in range(64) if int(free) >> i & 1]
    return np.array([sum(c) for k in range(1, max_bits + 1) for c in combinations(bits, k)], np.uint64)


def forest(values: np.ndarray, max_bits: int) -> np.ndarray:
    """For distinct fingerprints (uint64), the index of the first member of each one's component.

    Looks up the neighbour patterns in the bits that vary within the list: 136 for two free bytes.
    """
    n = len(values)
    order = np.argsort(values)
    ordered = values[order]
    pairs_a, pairs_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for pattern in _near(np.bitwise_or.reduce(ordered ^ ordered[0]), max_bits):
        other = ordered ^ pattern
        at = np.minimum(np.searchsorted(ordered, other), n - 1)
        hit = np.nonzero(ordered[at] == other)[0]
        pairs_a.append(hit)
        pairs_b.append(at[hit])
    label = _first_of(n, np.concatenate(pairs_a), np.concatenate(pairs_b))
    out = np.empty(n, np.int64)
    out[order] = order[label]
    return out


def links(prints: DataFrame, max_bits: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """Distinct fingerprints (column fp, long) to edges (a, b) that join all within ``max_bits`` bits, directly or in steps."""
    chosen = routes(max_bits)
    post = [F.struct(F.lit(i).cast("int").alias("route"), F.col("fp").bitwiseAND(F.lit(_mask(r))).alias("shared")) for i, r in enumerate(chosen)]
    # spread by a given number before the rows multiply: a narrow table would come in a task or two
    spread = prints.repartition(prints.count() // SPREAD + 1, "fp")
    posted = spread.select("fp", F.explode(F.array(*post)).alias("at")).select("fp", "at.route", "at.shared")
    size = F.count("*").over(Window.partitionBy("route", "shared"))
    met = cut(posted.withColumn("size", size).where("size > 1"), "routes")
    usual = met.where(F.col("size") <= hot).groupBy("route", "shared").agg(F.collect_list("fp").alias("members")).select("route", "members")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["members"].map(len).to_numpy(np.int64)
            volume = np.cumsum(sizes * sizes) // PAIRS  # so many pairs at a time
            for part in range(int(volume[-1]) + 1 if len(volume) else 0):
                own = np.nonzero(volume == part)[0]
                if not len(own):
                    continue
                signed = np.concatenate([np.asarray(m, np.int64) for m in batch["members"].iloc[own]])
                a, b = counted_links(signed.view(np.uint64), np.repeat(np.arange(len(own)), sizes[own]), np.repeat(batch["route"].to_numpy(np.int64)[own], sizes[own]), max_bits)
                first = _first_of(len(signed), a, b)
                tied = first != np.arange(len(signed))
                yield pd.DataFrame({"a": signed[first[tied]], "b": signed[tied]})

    found = usual.mapInPandas(verify, "a long, b long")
    # hot routes: what a pair still has to share is fixed, too, so that the count is reached by all in a list
    deal = []
    for i, r in enumerate(chosen):
        more = [F.struct(F.lit(j).alias("choice"), F.col("fp").bitwiseAND(F.lit(_mask(r + c))).alias("all_shared")) for j, c in enumerate(combinations(_rest(r), 8 - max_bits - 4))]
        deal.append(met.where((F.col("size") > hot) & (F.col("route") == i)).select("fp", "route", F.explode(F.array(*more)).alias("at")))
    dealt = reduce(DataFrame.union, deal).groupBy("route", "at.choice", "at.all_shared").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1).select("members")

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for members in batch["members"]:
                signed = np.asarray(members, np.int64)
                first = forest(signed.view(np.uint64), max_bits)
                tied = first != np.arange(len(first))
                yield pd.DataFrame({"a": signed[first[tied]], "b": signed[tied]})

    if met.where(F.col("size") > hot).limit(1).count():
        found = found.union(dealt.mapInPandas(look_up, "a long, b long"))
    return found


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` and ``group`` for every row of ``docs``.

    component_id is the smallest doc_id among all documents reachable over links of at most
    ``max_bits`` bits, itself included. Null and empty texts have fingerprint zero and link like any
    other. Rows may repeat or share a doc_id; a null doc_id is never the smallest unless all are null.
    ``group`` names the group by a fingerprint in it. An empty table gives an empty result.
    """
    text_batches(docs.sparkSession)
    prints = cut(docs.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text)).alias("fp")), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(classes.select("fp"), max_bits))
    grouped = classes.join(found, classes.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("group"))
    lowest = grouped.groupBy("group").agg(F.min("least").alias("component_id"))
    by_print = grouped.select("fp", "group").join(lowest, "group")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return prints.join(by_print, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id", "group")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest doc_id, ties by a hash of the row.

    Groups are decided on narrow rows (id, fingerprint, row hash); texts are not shuffled but for rows
    that repeat in full.
    """
    text_batches(docs.sparkSession)
    row = free_name("row_hash", docs)
    hashed = docs.withColumn(row, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    prints = cut(hashed.select(F.col(doc_id).alias("id"), F.col(row).alias("row"), fingerprints(F.col(text)).alias("fp")), "fingerprints")
    found = components(links(prints.select("fp").distinct(), max_bits))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first")
    by_print = prints.groupBy("fp").agg(first)
    chosen = by_print.join(found, by_print.fp == found.node, "left").groupBy(F.coalesce("component", "fp").alias("group")).agg(F.min("first").alias("first"))
    chosen = chosen.select(F.col("first.id").alias("id"), F.col("first.row").alias("row"))
    counts = prints.join(chosen.withColumnRenamed("id", "id2").withColumnRenamed("row", "row2"), F.col("id").eqNullSafe(F.col("id2")) & (F.col("row") == F.col("row2")))
    kept = cut(counts.groupBy("id", "row").agg(F.count("*").alias("n")), "kept")
    own = free_name("row_values", hashed)
    out = hashed.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(own), F.col(doc_id).alias("doc"), F.col(row).alias("hash"))
    out = out.join(kept, F.col("doc").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("row")))
    single, repeated = out.where("n = 1"), out.where("n > 1").dropDuplicates(["id", "row"])
    return single.union(repeated).select(f"{own}.*")
