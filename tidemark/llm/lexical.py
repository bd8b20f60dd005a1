"""Ranked lexical search over a tiered index, exact in integers.

Documents lie in shards of bounded size. Within a shard each term's postings are sorted by impact and dealt
into tiers, the highest impacts first; with each tier goes the term's residual bound, the best impact that
lower tiers still hold. A pass reads the first tiers of a shard and knows for each item which documents are
scored in full and how far any other could still reach. Where that is below the item's k-th best score so far,
the shard is proven for the item; all other pairs of shard and item fall through to the next tier, the last of
which leaves nothing unread. No cut is made without that proof.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, shared_dir, text_batches

#: Maximal runs of digits, letters and everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
K = 50
#: Postings of a term in each tier of a shard but the last, which has the rest.
TIERS = (64, 512)
#: A shard is closed at this many documents or postings.
SHARD_DOCS, SHARD_POSTINGS = 8192, 2_000_000
#: Up to so many different terms of the items are sent to the tasks, so that only they are indexed; beyond, all terms are.
WANTED = 1 << 18
#: Terms of the items that are searched together.
BLOCK_TERMS = 1 << 16


def terms_of(text: F.Column) -> F.Column:
    """All terms of a text, repeats included; only A-Z are lowered."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))


def _ints(values, kind) -> bytes:
    return np.asarray(values, kind).tobytes()


TALLIES = "shard long, n binary, documents long, occurrences long, terms array<string>, counts binary, at binary, tf binary"


def _tallies(wanted: frozenset[bytes] | None, shard_docs: int, shard_postings: int, schema: pa.Schema):
    """Documents to shards: per term the documents that hold it and how often."""
    find = re.compile(TERM.encode()).findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids, n, codes, at, tf, known = [], [], [], [], [], {}

        def closed() -> pa.RecordBatch:
            nonlocal ids, n, codes, at, tf, known, number
            code = np.array(codes, np.int64)
            order = np.argsort(code, kind="stable")
            counts = np.bincount(code, minlength=len(known))
            terms = pa.array([t.decode() for t in known], pa.string())
            row = [ids, _ints(n, np.int64), sum(x > 0 for x in n), sum(n), counts]
            values = [
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(row[0], schema.field("docs").type.value_type)),
                pa.array([(part << 32) + number], pa.int64()),
                pa.array([row[1]], pa.binary()),
                pa.array([row[2]], pa.int64()),
                pa.array([row[3]], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), terms),
                pa.array([_ints(counts, np.int32)], pa.binary()),
                pa.array([_ints(np.array(at, np.int32)[order], np.int32)], pa.binary()),
                pa.array([_ints(np.array(tf, np.int32)[order], np.int32)], pa.binary()),
            ]
            ids, n, codes, at, tf, known, number = [], [], [], [], [], {}, number + 1
            return pa.RecordBatch.from_arrays(values, schema=schema)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = find(text.lower()) if text else []  # bytes: only A-Z change
                held = Counter(words if wanted is None else filter(wanted.__contains__, words))
                at.extend([len(ids)] * len(held))
                ids.append(doc)
                n.append(len(words))
                for term, times in held.items():
                    codes.append(known.setdefault(term, len(known)))
                    tf.append(times)
                if len(ids) >= shard_docs or len(at) >= shard_postings:
                    yield closed()
        if ids:
            yield closed()

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def rows() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["term", "df"])
        held.clear()
        return out

    for batch in batches:
        for terms, counts in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist()):
            held.update(dict(zip(terms, np.frombuffer(counts, np.int32).tolist())))
            if len(held) > 500_000:
                yield rows()
    yield rows()


TIERED = "shard long, tier int, terms array<string>, counts binary, at binary, impact binary, residual binary"


def _tiered(documents: int, occurrences: int, tiers: tuple[int, ...], schema: pa.Schema):
    """A shard's postings by impact, tier by tier; its documents go with the first tier."""
    edges = [0, *np.cumsum(tiers).tolist(), 1 << 40]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                get = lambda c, kind: np.frombuffer(row.column(c)[0].as_py(), kind)
                counts, at, tf, n = get("counts", np.int32).astype(np.int64), get("at", np.int32), get("tf", np.int32).astype(np.int64), get("n", np.int64)
                m = 100 - 50 + (50 * n * documents) // max(occurrences, 1)
                impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[at])
                code = np.repeat(np.arange(len(counts)), counts)
                order = np.lexsort((at, -impact, code))
                at, impact = at[order], impact[order]
                first = np.cumsum(counts) - counts
                place = np.arange(len(at)) - first[code]
                terms = row.column("terms").combine_chunks() if isinstance(row.column("terms"), pa.ChunkedArray) else row.column("terms")
                words = terms.flatten()
                for tier, (low, high) in enumerate(zip(edges, edges[1:])):
                    here = np.flatnonzero(counts > low)
                    if tier and not len(here):
                        continue
                    pick = (place >= low) & (place < high)
                    after = first[here] + high
                    more = counts[here] > high
                    residual = np.zeros(len(here), np.int64)
                    residual[more] = impact[after[more]]
                    docs = row.column("docs") if tier == 0 else pa.nulls(1, schema.field("docs").type)
                    own = words.take(pa.array(here))
                    values = [docs, row.column("shard"), pa.array([tier], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)]
                    values += [pa.array([_ints(x, kind)], pa.binary()) for x, kind in ((np.minimum(counts[here], high) - low, np.int32), (at[pick], np.int32), (impact[pick], np.int32), (residual, np.int64))]
                    yield pa.RecordBatch.from_arrays(values, schema=schema)

    return run


@dataclass(frozen=True)
class Index:
    """``tiered``: a row for each shard and tier; ``frequencies``: term and df; ``last``: the number of the last tier."""

    tiered: DataFrame
    frequencies: DataFrame
    documents: int
    occurrences: int
    last: int


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def build(docs: DataFrame, wanted: frozenset[str] | None = None, tiers: tuple[int, ...] = TIERS, shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS) -> Index:
    """The index of all of ``docs`` (doc_id, text), of the terms ``wanted`` or of all.

    A narrow pass makes shards within tasks, another one deals them into tiers once the corpus counts are
    known; only those counts and document frequencies are added up over tasks.
    """
    spark = docs.sparkSession
    text_batches(spark)
    of = T.StructType([T.StructField("docs", T.ArrayType(docs.schema["doc_id"].dataType))])
    schema = T.StructType([*of, *T._parse_datatype_string(TALLIES)])
    terms = None if wanted is None else frozenset(t.encode() for t in wanted)
    tallied = cut(docs.select("doc_id", "text").mapInArrow(_tallies(terms, shard_docs, shard_postings, _arrow(schema)), schema), "tallies")
    documents, occurrences = (x or 0 for x in tallied.agg(F.sum("documents"), F.sum("occurrences")).first())
    frequencies = tallied.select("terms", "counts").mapInArrow(_frequencies, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
    out = T.StructType([*of, *T._parse_datatype_string(TIERED)])
    path = f"{shared_dir(spark)}/tidemark/tiers-{uuid.uuid4().hex}"
    tallied.mapInArrow(_tiered(documents, occurrences, tiers, _arrow(out)), out).write.partitionBy("tier").parquet(path)
    return Index(spark.read.schema(out).parquet(path), frequencies, documents, occurrences, len(tiers))


FOUND = "shard long, q long, reach long, scores array<long>, lows array<long>"


class _Searcher:
    """Scores a block's items in a shard from its first tiers."""

    def __init__(self, items: list[tuple[int, list[str], list[int]]], bars: dict[int, int], k: int, schema: pa.Schema):
        self.items, self.bars, self.k, self.schema = {q: (terms, weights) for q, terms, weights in items}, bars, k, schema

    def search(self, tiers: list[dict], asked: list[int] | None) -> pa.RecordBatch:
        docs = tiers[0]["docs"]
        lists: list[dict[str, tuple]] = []
        for t in tiers:
            ends = np.cumsum(np.frombuffer(t["counts"], np.int32)).tolist()
            lists.append({"at": np.frombuffer(t["at"], np.int32), "impact": np.frombuffer(t["impact"], np.int32), "of": {w: (a, b, r) for w, a, b, r in zip(t["terms"], [0, *ends], ends, np.frombuffer(t["residual"], np.int64).tolist())}})
        rows = []
        for q in self.items if asked is None else asked:
            found = self.one(docs, lists, *self.items[q], max(self.bars.get(q, 1), 1))
            if found is not None:
                rows.append((q, *found))
        q, ids, reach, scores, lows = zip(*rows) if rows else ([], [], [], [], [])
        values = {"docs": ids, "shard": [tiers[0]["shard"]] * len(rows), "q": q, "reach": reach, "scores": scores, "lows": lows}
        return pa.RecordBatch.from_arrays([pa.array(list(values[f.name]), f.type) for f in self.schema], schema=self.schema)

    def one(self, docs: list, lists: list[dict], terms: list[str], weights: list[int], bar: int) -> tuple | None:
        score, reached = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
        open_ = 0
        for term, w in zip(terms, weights):
            rest = 0
            held = []
            for x in lists:
                if (found := x["of"].get(term)) is None:
                    break
                a, b, rest = found
                held.append((x["at"][a:b], x["impact"][a:b].astype(np.int64)))
            for at, impact in held:
                score[at] += w * impact
                reached[at] += w * (impact - rest)
            open_ += w * rest
        reached += open_  # the most a document can have: what it lacks counts its term's residual bound
        exact = reached == score
        reach = int(reached[~exact].max()) if not exact.all() else 0
        lows = score[score >= bar]
        if len(lows) > self.k:
            lows = np.partition(lows, len(lows) - self.k)[len(lows) - self.k :]
        best = np.flatnonzero(exact & (score >= bar))
        if len(best) > self.k:
            least = np.partition(score[best], len(best) - self.k)[len(best) - self.k]
            best = best[score[best] >= least]
        order = sorted(best.tolist(), key=lambda i: (-score[i], docs[i] is None, docs[i]))[: self.k]
        if reach < bar and not order:
            return None
        return [docs[i] for i in order], reach, score[order].tolist(), lows.tolist()


def _first(searcher: _Searcher):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield searcher.search([row], None)

    return run


def _deeper(searcher: _Searcher):
    def run(rows: pa.Table) -> pa.Table:
        tiers = sorted(rows.to_pylist(), key=lambda r: r["tier"])
        return pa.Table.from_batches([searcher.search(tiers, sorted(tiers[0]["asked"]))])

    return run


def _bars(found: DataFrame, k: int) -> dict[int, int]:
    """The k-th best score that documents are known to have at least, for items that have so many."""
    lows = found.select("q", F.explode("lows").alias("low"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("low")))
    return {r["q"]: r["low"] for r in lows.withColumn("rank", rank).where(F.col("rank") <= k).where(F.col("rank") == k).collect()}


def _search_block(index: Index, items: list[tuple[int, list[str], list[int]]], k: int) -> list[DataFrame]:
    """Tables of found documents (q, docs, scores), each with the pairs of shard and item that one pass proved."""
    spark = index.tiered.sparkSession
    out = T.StructType([T.StructField("docs", index.tiered.schema["docs"].dataType), *T._parse_datatype_string(FOUND)])
    bars: dict[int, int] = {}
    proven: list[DataFrame] = []
    asked = None
    for last in range(index.last + 1):
        searcher = _Searcher(items, bars, k, _arrow(out))
        if asked is None:
            found = index.tiered.where("tier = 0").mapInArrow(_first(searcher), out)
        else:
            rows = index.tiered.where(F.col("tier") <= last).join(asked, "shard")
            found = rows.groupBy("shard").applyInArrow(_deeper(searcher), out)
        found = cut(found, "found")
        bars |= _bars(reduce(DataFrame.unionByName, [*proven, found]), k)
        limits = spark.createDataFrame([(q, bars.get(q, 1)) for q, _, _ in items], "q long, bar long")
        judged = found.join(limits, "q")
        proven.append(judged.where("reach < bar").drop("bar"))
        asked = cut(judged.where("reach >= bar").groupBy("shard").agg(F.collect_list("q").alias("asked")), "asked")
        if last == index.last or asked.isEmpty():
            break
    return proven


def search(index: Index, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The ``k`` best documents of each row of ``items`` (item_id, text): item_id, rank, doc_id, score.

    Only scores above 0 count; equal ones go by ascending doc_id, null last. Rows of ``items`` are items each,
    also with equal ids; items without terms, or whose terms no document has, give no rows. Items are searched
    in blocks of about ``block_terms`` terms; the driver holds one block's terms and weights at a time.
    """
    given = items.select("item_id", F.array_distinct(terms_of(F.coalesce(F.col("text"), F.lit("")))).alias("terms"))
    given = cut(given.withColumn("q", F.monotonically_increasing_id()), "items")
    share = F.lit(float(2 * index.documents + 2)) / (F.lit(2.0) * F.col("df") + 1)
    weights = index.frequencies.select("term", F.floor(1000 * F.log(share)).cast("long").alias("w"))
    held = given.select("q", F.explode("terms").alias("term")).join(weights, "term").where("w > 0")
    total = given.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-total // block_terms))
    weighed = cut(held.groupBy("q").agg(F.collect_list(F.struct("term", "w")).alias("terms")).withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks))), "weighed")
    found = []
    for b in range(blocks):
        block = [(r["q"], [t["term"] for t in r["terms"]], [t["w"] for t in r["terms"]]) for r in weighed.where(F.col("block") == b).collect()]
        if block:
            found += [x.select("q", "docs", "scores") for x in _search_block(index, block, k)]
    of = index.tiered.schema["docs"].dataType.elementType
    if not found:
        return given.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(None).cast(of).alias("doc_id"), F.lit(0).cast("long").alias("score"))
    rows = reduce(DataFrame.unionByName, found).select("q", F.explode(F.arrays_zip("docs", "scores")).alias("x")).select("q", F.col("x.docs").alias("doc_id"), F.col("x.scores").alias("score"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = rows.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(given.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = K, wanted_most: int = WANTED, **options) -> DataFrame:
    """``search`` over an index of ``docs`` made for it.

    Up to ``wanted_most`` different terms of the items are sent to the tasks that index, which leave out all
    others; beyond, all terms are indexed and items pick theirs. Null and wordless texts are never found;
    repeated rows of ``docs`` are documents each; texts of any length are read whole; columns other than
    doc_id, text, item_id are ignored; empty tables give no rows.
    """
    terms = items.select(F.explode(terms_of(F.coalesce(F.col("text"), F.lit("")))).alias("term")).distinct()
    few = terms.limit(wanted_most + 1).collect()
    wanted = frozenset(r["term"] for r in few) if len(few) <= wanted_most else None
    return search(build(docs, wanted, **options), items, k)
