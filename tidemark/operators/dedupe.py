"""Duplicate status of items in order of publication (N9, N10), staged so that each stage sees the survivors of the one before."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.sources.shared import cut, shared_dir

#: SimHash bits that may differ, and characters of normalised text below which nothing is compared.
MAX_BITS, MIN_CHARS = 3, 12
#: Parts that a key's rows are dealt into where they look up what their key repeats.
SALTS = 64
#: Fixed value: canonical URLs of a community's own discussion pages, which are no shared links.
OWN_PAGES = r"^[a-z][a-z0-9+.-]*://(reddit\.com/r/|news\.ycombinator\.com/item)"


def _first(rows: DataFrame, key: str, *more: str) -> DataFrame:
    """A row for each ``key`` that isn't null: ``key`` and ``first``, a struct of the earliest row's published_at, doc_id and ``more``."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct("published_at", "doc_id", *more)).alias("first"))


def _later(rows: DataFrame, key: str) -> DataFrame:
    """(doc_id) of the rows with a ``key`` that aren't the first of theirs. Only first rows are looked up, so a hot key is no task's load."""
    return rows.where(F.col(key).isNotNull()).select("doc_id").join(_first(rows, key).select(F.col("first.doc_id").alias("doc_id")), "doc_id", "left_anti")


def narrow(items: DataFrame, *more) -> DataFrame:
    """(doc_id, published_at, community, canon, text_key) and ``more`` of the items; text_key is null for texts that aren't compared."""
    norm = X.normalised(F.col("text"))
    canon = X.canonical_url(F.col("url"))
    return items.select("doc_id", "published_at", "community", F.when(~canon.rlike(OWN_PAGES), canon).alias("canon"), F.when(F.char_length(norm) >= MIN_CHARS, F.sha2(norm.cast("binary"), 256)).alias("text_key"), *more)


def fingerprint() -> Column:
    return X.simhash(F.col("text")).alias("fp")


def _written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a table of the shared folder, so that texts are read and hashed once, however often their keys are."""
    return rows.sparkSession.read.schema(rows.schema).parquet(cut(rows, name))


def _exact(rows: DataFrame) -> DataFrame:
    """(doc_id, status) of the items that stages one and two find, from narrow rows."""
    firsts = _first(rows, "canon", "community").select(F.col("canon").alias("of"), "first")
    seen = rows.join(firsts, F.col("canon") == F.col("of")).where(F.col("doc_id") != F.col("first.doc_id"))
    seen = seen.select("doc_id", F.when(F.col("first.community").eqNullSafe(F.col("community")), "duplicate_url").otherwise("crosspost").alias("status"))
    alive = rows.join(seen.select("doc_id"), "doc_id", "left_anti")
    return seen.union(_later(alive, "text_key").select("doc_id", F.lit("duplicate_exact").alias("status")))


def exact_statuses(items: DataFrame) -> DataFrame:
    """Stages one and two: (doc_id, published_at, url, community, text, ...) with ``status``; doc_id is unique.

    An external canonical URL seen before makes a duplicate_url in the community it was first seen in, a
    crosspost elsewhere; links to a community's own discussion pages don't count. Of the others, normalised texts of at least 12 characters seen before are
    duplicate_exact. Items without a URL or with a short text pass the stage.
    """
    return items.join(_exact(_written(narrow(items), "narrow")), "doc_id", "left")


def candidate_pairs(items: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): b came after a and their SimHashes differ in at most ``max_bits`` bits.

    Of ``2 * max_bits`` parts of a fingerprint such a pair has ``max_bits`` equal at least, by the pigeonhole
    principle: 20 keys of about 32 bits for 3 bits, so that hardly any others meet. Equal fingerprints are
    one node, so hot texts make no quadratic output. A side's estimated size misses the 20 rows that each
    becomes, so the join is a merge whatever that size: sent to all, a side would not fit the driver.
    """
    parts = 2 * max_bits
    edge = [64 * i // parts for i in range(parts + 1)]
    masks = [reduce(lambda m, p: m | (1 << edge[p + 1]) - (1 << edge[p]), chosen, 0) for chosen in combinations(range(parts), max_bits)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("choice", "key")
    left = items.select("fp", keys)
    right = left.toDF("fp2", "choice2", "key2")
    on = (F.col("choice") == F.col("choice2")) & (F.col("key") == F.col("key2")) & (F.col("fp") != F.col("fp2"))
    return left.join(right.hint("merge"), on).where(X.hamming(F.col("fp"), F.col("fp2")) <= max_bits).select("fp", "fp2").distinct()


def dropped(edges: DataFrame) -> DataFrame:
    """(fp) of the fingerprints that repeat a retained one; (fp, fp2) are all those near, fp2 being the earlier.

    Each round retains the fingerprints that wait for none, drops what they hit, and forgets the edges of what
    is dropped; the rest is checkpointed. The earliest open one always waits for none, so rounds go on until
    no edge is left, however deep a chain is.
    """
    gone = edges.select("fp").limit(0)
    rounds = 0
    while not edges.isEmpty():
        free = edges.select(F.col("fp2").alias("free")).distinct().join(edges.select("fp").distinct(), F.col("free") == F.col("fp"), "left_anti")
        hit = edges.join(free, F.col("fp2") == F.col("free"), "left_semi").select("fp").distinct().checkpoint()
        gone = gone.union(hit)
        rounds += 1
        if rounds % 16 == 0:  # keeps the plan short
            gone = gone.checkpoint()
        edges = edges.join(hit, "fp", "left_anti").join(hit.select(F.col("fp").alias("fp2")), "fp2", "left_anti").select("fp", "fp2").checkpoint()
    return gone


class _Stages(NamedTuple):
    """What the stages leave: narrow rows; (doc_id, status) of the first two; the rows that reach the third; the first row
    of each fingerprint there; near fingerprints, the later as fp; fingerprints that repeat a retained one."""

    rows: DataFrame
    exact: DataFrame
    open: DataFrame
    nodes: DataFrame
    edges: DataFrame
    gone: DataFrame


def _staged(items: DataFrame, max_bits: int) -> _Stages:
    shared_dir(items.sparkSession)  # sets a checkpoint folder where there is none
    rows = _written(narrow(items, "author_hash", fingerprint()), "narrow")
    exact = _exact(rows).checkpoint()
    open_ = rows.where(F.col("text_key").isNotNull()).select("doc_id", "published_at", "fp").join(exact, "doc_id", "left_anti").checkpoint()
    nodes = _first(open_, "fp").select("fp", "first.*")
    when = lambda *names: nodes.select(F.col("fp").alias(names[0]), F.col("published_at").alias(names[1]), F.col("doc_id").alias(names[2]))
    edges = candidate_pairs(nodes.select("fp"), max_bits).join(when("fp", "t", "d"), "fp").join(when("fp2", "t2", "d2"), "fp2")
    edges = edges.where((F.col("t2") < F.col("t")) | ((F.col("t2") == F.col("t")) & (F.col("d2") < F.col("d")))).select("fp", "fp2").checkpoint()
    return _Stages(rows, exact, open_, nodes, edges, dropped(edges))


def statuses(items: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """All three stages and the bot flag: (doc_id, status, author_hash).

    An item is a near_duplicate only of a retained one, so whether it is retained depends on those before
    it. An author's second and later exact or near duplicate is a bot_repeat.
    """
    return _statuses(_staged(items, max_bits))


def _statuses(s: _Stages) -> DataFrame:
    rows, exact, open_, nodes = s.rows, s.exact, s.open, s.nodes
    # a fingerprint seen before repeats a retained item, or what that repeats
    kept = nodes.join(s.gone, "fp", "left_anti").select("doc_id")
    near = open_.select("doc_id").join(kept, "doc_id", "left_anti").select("doc_id", F.lit("near_duplicate").alias("status"))
    found = exact.union(near)
    x = rows.select("doc_id", "published_at", "author_hash").join(found, "doc_id", "left").checkpoint()
    flagged = x.where(F.col("status").isin("duplicate_exact", "near_duplicate"))
    bots = _later(flagged, "author_hash").select("doc_id", F.lit("bot_repeat").alias("bot"))
    return x.join(bots, "doc_id", "left").select("doc_id", F.coalesce("bot", "status", F.lit("unique")).alias("status"), "author_hash")


def _looked_up(rows: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """(doc_id, ...) of ``rows`` with what ``table`` has for their ``key``.

    A key may be that of a third of all rows: each is met in ``SALTS`` parts, and the table only goes to the
    parts that exist, so that a hot key sends it that many rows and no task all of its own.
    """
    salted = rows.select("doc_id", key, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"))
    parts = salted.groupBy(key, "salt").agg(F.lit(1).alias("one")).drop("one").join(table, key)
    return salted.join(parts, [key, "salt"]).drop(key, "salt")


def originals(items: DataFrame, near: bool = True, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, status, duplicate_of, retained): what each duplicate repeats; both null for the unique.

    ``duplicate_of`` is the item that the stage met first: the first with the URL, the first with the text
    among those that pass the first stage, the earliest retained one with a near fingerprint. That may be a
    duplicate itself in the first two stages; ``retained`` is the unique item at the end of the chain, never
    more than three steps away. Without ``near`` the third stage and the bot flag are left out.
    """
    if near:
        s = _staged(items, max_bits)
        rows, exact, status = s.rows, s.exact, _statuses(s).select("doc_id", "status")
        kept = s.nodes.join(s.gone, "fp", "left_anti").select(F.col("fp").alias("fp2"), F.struct("published_at", "doc_id").alias("first"))
        nearest = s.edges.join(s.gone, "fp", "left_semi").join(kept, "fp2").groupBy("fp").agg(F.min("first")["doc_id"].alias("of"))
        by_print = nearest.union(kept.select("fp2", "first.doc_id"))  # of the same fingerprint the first, where it is retained
        third = _looked_up(s.open, "fp", by_print).where(F.col("doc_id") != F.col("of")).checkpoint()
    else:
        rows = _written(narrow(items), "narrow")
        exact = _exact(rows).checkpoint()
        status = rows.select("doc_id").join(exact, "doc_id", "left").select("doc_id", F.coalesce("status", F.lit("unique")).alias("status"))
        third = rows.select("doc_id", F.col("doc_id").alias("of")).limit(0)

    def traced(firsts: DataFrame, key: str, later: DataFrame) -> DataFrame:
        """The first row of each key and where its own chain ends; a first row stands for one key, so none is hot."""
        ends = later.select(F.col("doc_id").alias("of"), F.col("of").alias("end"))
        return firsts.select(key, F.col("first.doc_id").alias("of")).join(ends, "of", "left").select(key, "of", F.coalesce("end", "of").alias("retained"))

    is_url = F.col("status").isin("duplicate_url", "crosspost")
    alive = rows.join(exact.where(is_url), "doc_id", "left_anti")
    second = _looked_up(alive.where(F.col("text_key").isNotNull()), "text_key", traced(_first(alive, "text_key"), "text_key", third)).where(F.col("doc_id") != F.col("of")).checkpoint()
    third = third.withColumn("retained", F.col("of"))
    ends = second.union(third).select("doc_id", F.col("retained").alias("of"))
    first = _looked_up(rows.where(F.col("canon").isNotNull()), "canon", traced(_first(rows, "canon"), "canon", ends)).where(F.col("doc_id") != F.col("of"))
    found = first.union(second).union(third).withColumnRenamed("of", "duplicate_of")
    return status.join(found, "doc_id", "left").select("doc_id", "status", "duplicate_of", "retained")
