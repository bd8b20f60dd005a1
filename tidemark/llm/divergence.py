"""Source divergence audit by systolic rotation.

Within each language every source is compared with every other source and with the language as a whole, term by
term, in exact integers. Sources sit in a fixed number of seats; the kept terms of a language are dealt into
slices. The counts of a seat's sources in a slice are one compressed row, which stays where its partition is,
while those of the other seats travel: in each round of a round-robin tournament a seat meets one other, and
both directions of every pair are evaluated there. So the rows that travel are a fixed multiple of the counts,
however many sources there are, and a task holds two seats of one slice at a time.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, text_batches

#: Maximal runs of letters and of everything beyond ASCII, in UTF-8 bytes.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
TOP, MIN_DOCS, SEATS, SLICE = 200, 3, 8, 8192
SCALE = 1_000_000_000
#: Entries that a task tallies, and terms that its heaps hold, before it hands them on.
HELD = 400_000
#: Tables with a row a language or a group are broadcast up to so many rows, and joined by shuffle beyond.
SMALL = 100_000

TALLY = "lang string, source string, term string, n long, docs long"


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term in each group, added up within the task."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            terms, k = list(n), len(n)
            columns = [pa.repeat(pa.scalar(lang, pa.string()), k), pa.repeat(pa.scalar(source, pa.string()), k), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([n[t] for t in terms], pa.int64()), pa.array([docs[t] for t in terms], pa.int64())]
            yield from pa.Table.from_arrays(columns, names=["lang", "source", "term", "n", "docs"]).to_batches(50_000)
        groups.clear()

    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            terms = TERM.findall(text.lower())  # bytes: only A-Z change
            if terms:
                n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
                n.update(terms)
                docs.update(set(terms))
        if sum(len(n) for n, _ in groups.values()) > HELD:
            yield from rows()
    yield from rows()


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, total (occurrences in the language) and by (source, n) of the terms in at least ``min_docs`` documents of the language."""
    parts = docs.mapInArrow(_tally, TALLY).repartition("lang", "term")  # both groupings below follow this partitioning
    by_source = parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("by"))
    return terms.where(F.col("docs") >= min_docs).select("lang", "term", "total", "by")


def _packed(columns: dict[str, pa.Array]) -> bytes:
    batch = pa.RecordBatch.from_pydict(columns)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


BLOCKS = "lang string, slice long, seat int, size long, data binary"


def _blocks(seats: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        """One row a seat: the counts of its sources in this slice; and one, of seat -1, of the language's own.

        The rows of a group come in any order, another one in each run; sorted, places mean the same terms in all.
        """
        rows = rows.sort_by("term").combine_chunks()
        by = rows.column("by").combine_chunks()
        at = np.repeat(np.arange(rows.num_rows), np.diff(by.offsets.to_numpy()))
        inner = by.flatten()
        named = inner.field("source").dictionary_encode()
        code, names, n = named.indices.to_numpy(), named.dictionary.to_pylist(), inner.field("n").to_numpy()
        order = np.lexsort((at, code))
        edges = np.searchsorted(code[order], np.arange(len(names) + 1))
        seat_of = np.array([zlib.crc32(s.encode()) % seats for s in names], np.int64)
        out = [(-1, _packed({"term": rows.column("term").combine_chunks(), "total": rows.column("total").combine_chunks()}))]
        for seat in range(seats):
            own = np.flatnonzero(seat_of == seat)
            picks = [order[edges[i] : edges[i + 1]] for i in own]
            flat = np.concatenate(picks) if picks else np.zeros(0, np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in picks])]).astype(np.int32))
            out.append((seat, _packed({"source": pa.array([names[i] for i in own], pa.string()), "at": pa.ListArray.from_arrays(offsets, pa.array(at[flat].astype(np.uint32))), "n": pa.ListArray.from_arrays(offsets, pa.array(n[flat]))})))
        k = len(out)
        lang, part = (x.as_py() for x in key)
        return pa.table({"lang": pa.array([lang] * k, pa.string()), "slice": pa.array([part] * k, pa.int64()), "seat": pa.array([s for s, _ in out], pa.int32()), "size": pa.array([rows.num_rows] * k, pa.int64()), "data": pa.array([d for _, d in out], pa.binary())})

    return run


def _ratio(n, total, v):
    """The scaled share of a term that occurs ``n`` times among ``total``, of ``v`` terms."""
    return 1 + SCALE * (n + 1) // (total + v) if np.ndim(n) else 1 + SCALE * (int(n) + 1) // int(total + v)


def _apart(p, q):
    d = p - q
    return d * d // q


class _Side:
    """A seat's sources in a slice: shares where a source has the term, and the share where it hasn't."""

    def __init__(self, data: bytes | None, members: list[dict], v: int):
        self.names = [m["source"] for m in members]
        total = np.array([m["total"] for m in members], np.int64)
        self.none = _ratio(np.zeros(len(total), np.int64), total, v) if v else np.ones(len(total), np.int64)
        place = {s: i for i, s in enumerate(self.names)}
        held = _unpacked(data) if data else None
        self.at, self.p = [np.zeros(0, np.int64)] * len(members), [np.zeros(0, np.int64)] * len(members)
        if held is not None:
            edges = held.column("at").offsets.to_numpy()
            at, n = held.column("at").flatten().to_numpy().astype(np.int64), held.column("n").flatten().to_numpy()
            for k, s in enumerate(held.column("source").to_pylist()):
                i = place[s]
                self.at[i] = at[edges[k] : edges[k + 1]]
                self.p[i] = _ratio(n[edges[k] : edges[k + 1]], total[i], v)
        self.flat_at, self.flat_p = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.at, self.p))
        self.owner = np.repeat(np.arange(len(members)), [len(x) for x in self.at])

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Exact sums of values of ``flat_at`` by source."""
        out = np.zeros(len(self.names), np.int64)
        np.add.at(out, self.owner, values)
        return out


def _meet(size: int, a: _Side, b: _Side) -> tuple[np.ndarray, np.ndarray]:
    """Summed divergence over the slice of each source of ``a`` from each of ``b``, and of each of ``b`` from each of ``a``.

    Where neither has a term, all terms are alike; where only one has it, few values occur; so each source
    of ``a`` takes one pass over what ``b`` has.
    """
    there, back = np.zeros((len(a.names), len(b.names)), np.int64), np.zeros((len(a.names), len(b.names)), np.int64)
    base = b.none[b.owner]
    for i in range(len(a.names)):
        dense = np.full(size, a.none[i], np.int64)
        dense[a.at[i]] = a.p[i]
        mine = dense[b.flat_at]
        values, times = np.unique(a.p[i], return_counts=True)
        values, times = values[:, None], times[:, None]
        plain, plain_back = _apart(a.none[i], b.none), _apart(b.none, a.none[i])
        there[i] = size * plain + b.sums(_apart(mine, b.flat_p) - _apart(mine, base)) + ((_apart(values, b.none[None, :]) - plain) * times).sum(0)
        back[i] = size * plain_back + b.sums(_apart(b.flat_p, mine) - _apart(base, mine)) + ((_apart(b.none[None, :], values) - plain_back) * times).sum(0)
    return there, back


SUMS = "lang string, source string, item string, value long"


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            a, b = _Side(r["data"], r["members"], r["v"]), _Side(r["peer_data"], r["peer_members"], r["v"])
            there, back = _meet(r["size"], a, b)
            i, j = (x.ravel() for x in np.indices(there.shape))
            names, peers = np.array(a.names, object), np.array(b.names, object)
            source, item, value = [names[i]], [peers[j]], [there.ravel()]
            if r["seat"] != r["peer_seat"]:  # within a seat one direction has all ordered pairs
                source, item, value = source + [peers[j]], item + [names[i]], value + [back.ravel()]
            source, item, value = np.concatenate(source), np.concatenate(item), np.concatenate(value)
            own = source != item
            k = int(own.sum())
            yield pa.RecordBatch.from_arrays([pa.array([r["lang"]] * k, pa.string()), pa.array(source[own].tolist(), pa.string()), pa.array(item[own].tolist(), pa.string()), pa.array(value[own])], names=["lang", "source", "item", "value"])


def _heaps(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ``top`` terms that set a source apart from its language, of all slices that the task meets."""
        held: dict[tuple[str, str], tuple[np.ndarray, np.ndarray]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), (terms, values) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms.tolist(), pa.string()), pa.array(values)], names=["lang", "source", "item", "value"])
            held.clear()

        for batch in batches:
            for r in batch.to_pylist():
                side, own = _Side(r["data"], r["members"], r["v"]), _unpacked(r["peer_data"])
                terms = np.array(own.column("term").to_pylist(), object)
                q = _ratio(own.column("total").to_numpy(), r["total"], r["v"])
                for source, at, p in zip(side.names, side.at, side.p):
                    at, p = at[p > q[at]], p[p > q[at]]
                    if len(at):
                        before = held.get((r["lang"], source), (np.zeros(0, object), np.zeros(0, np.int64)))
                        words, values = np.concatenate([before[0], terms[at]]), np.concatenate([before[1], _apart(p, q[at])])
                        if len(values) > top:  # what is below the top-th value can't be among them; its ties go by term
                            bar = np.partition(values, len(values) - top)[len(values) - top]
                            words, values = words[values >= bar], values[values >= bar]
                            best = sorted(range(len(values)), key=lambda i: (-values[i], words[i]))[:top]
                            words, values = words[best], values[best]
                        held[r["lang"], source] = (words, values)
                if sum(len(v) for _, v in held.values()) > HELD:
                    yield from rows()
        yield from rows()

    return run


def tournament(seats: int) -> list[list[tuple[int, int]]]:
    """Rounds of (home, visitor): in each, every seat meets one other; all meet once. Seats are even in number."""
    n = seats - 1
    out = []
    for r in range(n):
        pairs = [(n, r), *(((r + i) % n, (r - i) % n) for i in range(1, seats // 2))]
        out.append([p if (r + i) % 2 else p[::-1] for i, p in enumerate(pairs)])
    return out


def _sent(df: DataFrame, small: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``small`` rows: a join by language alone would put a whole language in one task."""
    return F.broadcast(df) if df.limit(small + 1).count() <= small else df


def audit(docs: DataFrame, top: int = TOP, min_docs: int = MIN_DOCS, seats: int = SEATS, slice_terms: int = SLICE, small: int = SMALL) -> DataFrame:
    """How far each source of a language is from each other source, and which terms set it apart from the language.

    ``docs`` needs lang, source, text (null: empty); other columns are ignored. Terms are runs of letters and
    of characters beyond ASCII, A-Z lowered; a language keeps those in at least ``min_docs`` of its documents.
    Columns: lang, source, part (pair or term), item, value, rank. Part pair ranks the other sources of the
    language by the sum over all kept terms of floor((p-q)^2/q), q being the other's share; part term the
    ``top`` terms whose share is above the language's. Ties go to the smaller item in UTF-8 order. Groups
    without terms take part; a language of one source has no pairs; without kept terms pairs are 0; repeated
    rows count each; a text of any length is one row of a task; an empty table gives no rows.
    """
    if seats % 2:
        raise ValueError("seats must be even")
    spark = docs.sparkSession
    text_batches(spark)
    docs = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    terms = cut(kept_terms(docs, min_docs), "terms")
    sizes = _sent(cut(terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("total")), "sizes"), small)
    sums = terms.select("lang", F.explode("by").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("total"))
    groups = docs.select("lang", "source").distinct()
    members = groups.join(sums, ["lang", "source"], "left").select("lang", (F.crc32(F.col("source").cast("binary")) % seats).cast("int").alias("seat"), F.struct("source", F.coalesce("total", F.lit(0)).alias("total")).alias("m"))
    held = cut(members.groupBy("lang", "seat").agg(F.sort_array(F.collect_list("m")).alias("members")), "members")
    members = F.broadcast(held) if (held.agg(F.sum(F.size("members"))).first()[0] or 0) <= small else held
    # slices of about slice_terms terms each; one more, without terms, lets sources meet where a language keeps none
    dealt = terms.join(sizes.select("lang", F.ceil(F.col("v") / slice_terms).alias("slices")), "lang").withColumn("slice", F.pmod(F.xxhash64("term"), F.col("slices")))
    blocks = dealt.select("lang", "slice", "term", "total", "by").groupBy("lang", "slice").applyInArrow(_blocks(seats), BLOCKS)
    none = held.select("lang", F.lit(-1).cast("long").alias("slice"), "seat", F.lit(0).cast("long").alias("size"), F.lit(None).cast("binary").alias("data"))
    # the language's own rows have no members; seats without any are dropped
    seated = blocks.unionByName(none).join(members, ["lang", "seat"], "left").where("seat < 0 or members is not null").join(sizes, "lang", "left")
    vectors = cut(seated.select("lang", "slice", "seat", "size", "data", "members", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("total", F.lit(0)).alias("total")), "vectors")
    here = ["lang", "slice", "seat"]
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    residents = vectors.where("seat >= 0").repartition(partitions, *here).persist(StorageLevel.MEMORY_AND_DISK)
    travel = vectors.select("lang", "slice", F.col("seat").alias("peer_seat"), F.col("data").alias("peer_data"), F.col("members").alias("peer_members"))
    try:
        met = []
        for pairs in [[(s, s) for s in range(seats)], *tournament(seats)]:
            to = F.create_map(*[F.lit(x).cast("int") for home, visitor in pairs for x in (visitor, home)])
            visitors = travel.withColumn("seat", to[F.col("peer_seat")]).where("seat is not null").repartition(partitions, *here)
            met.append(residents.join(visitors, here).drop("total").mapInArrow(_meetings, SUMS))
        pairs = cut(reduce(DataFrame.unionByName, met).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "pairs")
        everywhere = travel.where("peer_seat < 0").withColumn("seat", F.explode(F.array(*[F.lit(s).cast("int") for s in range(seats)]))).repartition(partitions, *here)
        apart = cut(residents.join(everywhere, here).drop("peer_members").mapInArrow(_heaps(top), SUMS), "apart")
    finally:
        residents.unpersist()
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    best = apart.select("lang", "source", F.lit("term").alias("part"), "item", "value", rank.alias("rank")).where(F.col("rank") <= top)
    return out.unionByName(best)
