"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame operations only.

Each source's documents are laid out in hash order and their words cut into blocks of ``block_words``.
A source's target is met by whole passes over its blocks, then a draw of permuted blocks without
replacement, then the first words of one more block, so that the words taken equal the target rounded.
The blocks each source owes (its quota) are divided among output shards by a binary tree: every node
splits its vector of quotas by a multivariate-hypergeometric draw, so that shards have equal numbers of
blocks and each is a fair sample of the mix. So a node's quotas and offsets say which blocks a shard
holds: the next ones of each source's permuted order, disjoint from those of other shards. It shuffles
them locally. Every run of words taken carries its shard and its block's place in it.

All randomness is a hash of the seed and of what is drawn, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD_PATTERN, cut, free_name

WEIGHTS, MAX_REPEATS, BLOCK_WORDS, SHARD_BLOCKS, SEED = (5, 2, 1), 3, 2048, 512, 7
#: Documents to a bucket of the layout's prefix sums, on average, and buckets to one of the sums above them.
BUCKET_DOCS, FAN = 512, 1024
#: Multipliers of the block permutation: primes, of which at least one is coprime to any block count below their product.
PRIMES = (1_000_003, 998_244_353)


def words_in(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, size) to (sx, source, n_docs with words, source_size, weight, target), a row for each source, null being one.

    Sources in code point order, null last, have the weights in turn and share 100% of all sizes; a
    target stops at ``max_repeats`` times its source's size, and the excess goes to the others by weight.
    Sorted by cap over weight, the capped sources come first: one is capped if its cap is not above
    what it would get with all before it capped. No words at all: targets 0. Windows here span one row
    for each source.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.row_number().over(order) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))
    rows = totals.select(turn.alias("sx"), "source", "n_docs", "source_size", w.cast("long").alias("weight"), (F.col("source_size") * max_repeats).alias("cap"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "sx").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    rows = rows.withColumns({"total": F.sum("source_size").over(every), "all_weight": F.sum("weight").over(every), "caps": F.coalesce(F.sum("cap").over(by_ratio), F.lit(0)), "weights": F.coalesce(F.sum("weight").over(by_ratio), F.lit(0))})
    rows = rows.withColumn("capped", F.col("cap") / F.col("weight") <= (F.col("total") - F.col("caps")) / (F.col("all_weight") - F.col("weights")))
    spent = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(every)
    left = F.sum(F.when(~F.col("capped"), F.col("weight")).otherwise(0)).over(every)
    share = (F.col("total") - spent) * F.col("weight") / F.nullif(left, F.lit(0))
    return rows.select("sx", "source", "n_docs", "source_size", "weight", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share.cast("double")).alias("target"))


def _ln_gamma(x: str) -> str:
    """ln of gamma for x >= 1: Stirling's series at x + 8, stepped down."""
    y = f"(({x}) + 8)"
    steps = " * ".join(f"(({x}) + {i})" for i in range(8))
    return f"(({y} - 0.5D) * ln({y}) - {y} + 0.9189385332046727D + 1D / (12 * {y}) - 1D / (360 * pow({y}, 3)) + 1D / (1260 * pow({y}, 5)) - ln(cast({steps} as double)))"


def _ln_choose(n: str, k: str) -> str:
    n, k = f"cast({n} as double)", f"cast({k} as double)"
    return f"({_ln_gamma(f'{n} + 1')} - {_ln_gamma(f'{k} + 1')} - {_ln_gamma(f'{n} - {k} + 1')})"


def hypergeometric(good: str, total: str, drawn: str, uniform: str) -> str:
    """SQL for a draw from the hypergeometric distribution by inversion, outwards from the mode.

    ``good`` of ``total`` items count, ``drawn`` are drawn without replacement; ``uniform`` is in (0, 1).
    The steps reach twelve standard deviations and twelve items more.
    """
    v = f"struct(cast({good} as bigint) as k, cast({total} as bigint) as t, cast({drawn} as bigint) as n, {uniform} as u)"
    low, high = "greatest(0L, v.n - (v.t - v.k))", "least(v.k, v.n)"
    mode = f"least({high}, greatest({low}, cast(floor((v.n + 1D) * (v.k + 1D) / (v.t + 2D)) as bigint)))"
    spread = "sqrt(v.n * (v.k / greatest(v.t, 1L)) * (1 - v.k / greatest(v.t, 1L)) * ((v.t - v.n) / greatest(v.t - 1, 1L)))"
    first = f"exp({_ln_choose('x.k', 'x.m')} + {_ln_choose('x.t - x.k', 'x.n - x.m')} - {_ln_choose('x.t', 'x.n')})"
    up = "if(x.m + j <= x.high, s.up * (x.k - x.m - j + 1D) * (x.n - x.m - j + 1D) / ((x.m + j) * (x.t - x.k - x.n + x.m + j + 0D)), 0D)"
    down = "if(x.m - j >= x.low, s.down * (x.m - j + 1D) * (x.t - x.k - x.n + x.m - j + 1D) / ((x.k - x.m + j + 0D) * (x.n - x.m + j)), 0D)"
    step = (
        "if(s.done, s, transform(array(struct(" + up + " as pu, " + down + " as pd)), p -> "
        "struct(s.rest - p.pu - p.pd as rest, p.pu as up, p.pd as down, "
        "if(s.rest < p.pu, x.m + j, if(s.rest < p.pu + p.pd, x.m - j, s.at)) as at, s.rest < p.pu + p.pd as done))[0])"
    )
    start = "transform(array(" + first + "), p -> struct(x.u - p as rest, p as up, p as down, x.m as at, x.u < p as done))[0]"
    walk = f"aggregate(sequence(1L, x.span), {start}, (s, j) -> {step}, s -> s.at)"
    bound = f"transform(array({v}), v -> struct(v.k as k, v.t as t, v.n as n, v.u as u, {mode} as m, {low} as low, {high} as high, cast(ceil(12 * {spread}) as bigint) + 12 as span))"
    return f"transform({bound}, x -> {walk})[0]"


def splitting_tree(quotas: DataFrame, levels: int, seed: int = SEED) -> DataFrame:
    """(sx, quota) to (shard, sx, offset, quota): ``2**levels`` shards, each source's offsets following one another.

    A node's vector of quotas is split by drawing half its blocks (rounded down) for the left child.
    The vector has one number for each source.
    """
    node = quotas.agg(F.transform(F.array_sort(F.collect_list(F.struct("sx", "quota"))), lambda x: F.struct(x.sx.alias("sx"), F.lit(0).cast("long").alias("offset"), x.quota.alias("quota"))).alias("parts")).select(F.lit(0).cast("long").alias("shard"), "parts")
    for level in range(levels):
        u = f"(pmod(xxhash64({seed}, {level}, shard, q.sx), 9007199254740992L) + 0.5D) / 9007199254740992D"
        draw = hypergeometric("q.quota", "acc.total", "acc.n", u)
        total = "aggregate(parts, 0L, (a, q) -> a + q.quota)"
        left = (
            f"aggregate(parts, struct(cast(floor({total} / 2) as bigint) as n, {total} as total, cast(array() as array<bigint>) as drawn), "
            f"(acc, q) -> transform(array({draw}), d -> struct(acc.n - d as n, acc.total - q.quota as total, concat(acc.drawn, array(d)) as drawn))[0], acc -> acc.drawn)"
        )
        node = node.withColumn("left", F.expr(left)).select(
            "shard",
            F.posexplode(
                F.array(
                    F.expr("transform(parts, (q, i) -> struct(q.sx as sx, q.offset as offset, left[i] as quota))"),
                    F.expr("transform(parts, (q, i) -> struct(q.sx as sx, q.offset + left[i] as offset, q.quota - left[i] as quota))"),
                )
            ).alias("side", "parts"),
        )
        node = node.select((F.col("shard") * 2 + F.col("side")).alias("shard"), "parts")
        if level % 6 == 5:
            node = node.repartition("shard")
    return node.select("shard", F.explode("parts").alias("p")).select("shard", "p.sx", "p.offset", "p.quota")


def sized_rows(docs: DataFrame, carry: list[str], text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """(row, doc_id, source, size, content, carried struct) of every row of ``docs``, written once so that row numbers stay.

    ``content`` is a hash of doc_id, source and text; row numbers only tell rows apart.
    """
    carried = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []
    content = F.xxhash64(F.col(doc_id), F.col(source), F.col(text)).alias("content")
    return cut(docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words_in(F.col(text)).alias("size"), content, *carried), "sized")


def _before(value: str, keys: list[str], order: str) -> Column:
    """Sum of ``value`` over the rows before, in ``order``, of those with the same keys."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``copy``, which numbers rows of one ``content`` from 0, so that no two have one key.

    Rows that repeat in full are interchangeable, so any order among them gives the same mix. They are
    numbered partition by partition and by sums over these: one content may be a third of all rows.
    """
    if not rows.groupBy("content").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        return rows.withColumn("copy", F.lit(0).cast("long"))
    inner = F.row_number().over(Window.partitionBy("content", "part").orderBy("row")) - 1
    split = rows.withColumn("part", F.shiftright("row", 33)).withColumn("inner", inner)
    heads = split.groupBy("content", "part").agg(F.count("*").alias("held")).withColumn("head", _before("held", ["content"], "part"))
    return split.join(heads.drop("held"), ["content", "part"]).withColumn("copy", F.col("inner") + F.col("head")).drop("part", "inner", "head")


def layout(rows: DataFrame, sources: DataFrame, seed: int = SEED) -> DataFrame:
    """(row, doc_id, sx, size, start): where each row with words starts in its source's run of words, in hash order.

    Sums go over the rows of a bucket, the buckets below one number above, and those; none of them grows
    with a source but the last, by one row for about ``BUCKET_DOCS * FAN`` documents.
    """
    keyed = rows.where("size > 0").join(sources.select("sx", F.col("source").alias("of"), "n_docs"), F.col("source").eqNullSafe(F.col("of")))
    keyed = numbered(keyed).withColumn("key", F.xxhash64(F.lit(seed), "content", "copy"))
    keyed = keyed.withColumn("bucket", F.pmod("key", F.greatest(F.lit(1), F.floor(F.col("n_docs") / BUCKET_DOCS)))).select("row", "doc_id", "sx", "size", "key", "content", "copy", "bucket")
    held = keyed.groupBy("sx", "bucket").agg(F.sum("size").alias("held")).withColumn("above", F.floor(F.col("bucket") / FAN))
    tops = held.groupBy("sx", "above").agg(F.sum("held").alias("held")).withColumn("top", _before("held", ["sx"], "above")).drop("held")
    heads = held.withColumn("head", _before("held", ["sx", "above"], "bucket")).join(tops, ["sx", "above"]).select("sx", "bucket", (F.col("head") + F.col("top")).alias("head"))
    inside = Window.partitionBy("sx", "bucket").orderBy("key", "content", "copy", "row").rowsBetween(Window.unboundedPreceding, -1)
    laid = keyed.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(heads, ["sx", "bucket"])
    return laid.select("row", "doc_id", "sx", "size", (F.col("start") + F.col("head")).alias("start"))


def draw(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED, tree_seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    """From ``sized_rows``: the sources (sx, source, n_docs, source_size, weight, target) and the mix.

    The mix has a row for each run of words taken: shard, place (of the block in its shard), sx, block,
    pass (0, 1, ...), row, doc_id, from_word (from 0), n_words.
    """
    narrow = rows.select("row", "doc_id", "source", "size", "content")
    sources = cut(source_targets(narrow, weights, max_repeats), "sources")
    want = F.floor(F.col("target") + 0.5).cast("long")
    plan = sources.where("source_size > 0").withColumns({"want": want, "full": F.floor(F.col("source_size") / block_words).cast("long"), "blocks": F.ceil(F.col("source_size") / block_words).cast("long")})
    plan = plan.withColumn("passes", F.floor(F.col("want") / F.col("source_size")).cast("long")).withColumn("need", F.col("want") - F.col("passes") * F.col("source_size"))
    plan = plan.withColumn("quota", F.col("passes") * F.col("blocks") + F.ceil(F.col("need") / block_words).cast("long"))
    plan = plan.withColumn("step", F.when(F.col("full") % PRIMES[0] == 0, PRIMES[1]).otherwise(PRIMES[0]).cast("long"))
    plan = plan.select("sx", "source_size", "full", "blocks", "passes", "need", "quota", "step")
    owed = plan.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    levels = max(0, (max(1, -(-owed // shard_blocks)) - 1).bit_length())

    # a table of its own: the draws of all levels are large expressions to plan, and are planned once
    tree = cut(splitting_tree(plan.select("sx", "quota"), levels, seed if tree_seed is None else tree_seed).where("quota > 0"), "tree")
    # merge joins: what is exploded from a few rows looks small to the optimizer, which would broadcast it
    owing = tree.join(plan.drop("quota").hint("merge"), "sx")
    drawn = owing.select("shard", F.explode(F.sequence(F.col("offset"), F.col("offset") + F.col("quota") - 1)).alias("seq"), *[c for c in plan.columns if c != "quota"])
    drawn = drawn.withColumn("pass", F.floor(F.col("seq") / F.col("blocks")).cast("long")).withColumn("rank", F.col("seq") % F.col("blocks"))
    # the place of rank r among the full blocks is (step * r + shift) mod full; a short last block keeps the last rank
    place = (F.col("rank") * F.col("step") + F.pmod(F.xxhash64(F.lit(seed), "sx", "pass"), F.col("full"))) % F.col("full")
    block = F.when(F.col("rank") < F.col("full"), place).otherwise(F.col("full"))
    limit = F.when(F.col("pass") < F.col("passes"), F.lit(block_words)).otherwise(F.least(F.lit(block_words), F.col("need") - F.col("rank") * block_words))
    drawn = drawn.select("shard", "sx", "seq", "pass", block.alias("block"), limit.cast("long").alias("limit"))
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "sx", "seq"), "sx", "seq")
    drawn = drawn.withColumn("place", F.row_number().over(local))

    laid = layout(narrow, sources, seed)
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    laid = laid.select("row", "doc_id", "sx", "start", "size", F.explode(F.sequence(first, last)).alias("block"))

    taken = drawn.join(laid.hint("merge"), ["sx", "block"])
    low = F.greatest(F.col("start"), F.col("block") * block_words)
    high = F.least(F.col("start") + F.col("size"), F.col("block") * block_words + F.col("limit"))
    taken = taken.where(low < high).select("shard", "place", "sx", "block", "pass", "row", "doc_id", (low - F.col("start")).alias("from_word"), (high - low).alias("n_words"))
    return sources, taken


def mix_report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken, runs) for every row of ``docs``.

    ``runs`` is where the words taken went: shard, place of the block in the shard, pass, from_word (from
    0), n_words. A null text has size 0 and is never taken; a null source is a source of its own, the
    last; rows with one doc_id, or that repeat in full, are separate documents; a text of any length is
    cut into blocks; an empty table gives an empty result.
    """
    rows = sized_rows(docs, [], text, doc_id, source)
    sources, taken = draw(rows, **options)
    runs = taken.groupBy("row").agg(F.sum("n_words").alias("taken"), F.array_sort(F.collect_list(F.struct("shard", "place", "pass", "from_word", "n_words"))).alias("runs"))
    named = rows.join(sources.select(F.col("source").alias("of"), "source_size", "target"), F.col("source").eqNullSafe(F.col("of")))
    none = F.array().cast(runs.schema["runs"].dataType)
    return named.join(runs, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("runs", none).alias("runs"))


def mixed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The mix as rows of ``docs``: one for each run of words that a block takes of a row.

    A shard is in one partition, its rows in order of their blocks' places. A row taken whole keeps its
    text; of others the text is the words taken, joined by spaces. The column n_chars, if there is one,
    is counted again. Nulls, repeats and empty tables are as in ``mix_report``.
    """
    rows = sized_rows(docs, docs.columns, text, doc_id, source)
    _, taken = draw(rows, **options)
    runs = taken.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("shard", "place", "from_word", "n_words"))).alias("runs"))
    shard, place, start, own = (free_name(f"mix_{c}", docs) for c in ("shard", "place", "start", "text"))
    whole = F.col(f"carried.`{text}`")

    def cut_out(words: Column | None) -> Column:
        some = lambda r: whole if words is None else F.when(r.n_words == F.col("size"), whole).otherwise(F.array_join(F.slice(words, (r.from_word + 1).cast("int"), r.n_words.cast("int")), " "))
        return F.transform("runs", lambda r: F.struct(r.shard.alias("shard"), r.place.alias("place"), r.from_word.alias("from_word"), some(r).alias("text")))

    # the words of a text are bound to a name, so that they are found once and not for each run
    pieces = F.when(F.forall("runs", lambda r: r.n_words == F.col("size")), cut_out(None)).otherwise(F.transform(F.array(F.regexp_extract_all(whole, F.lit(WORD_PATTERN), F.lit(0))), cut_out)[0])
    out = rows.select("row", "size", "carried").join(runs, "row").select("carried", F.explode(pieces).alias("piece"))
    out = out.select(F.col("piece.shard").alias(shard), F.col("piece.place").alias(place), F.col("piece.from_word").alias(start), F.col("piece.text").alias(own), "carried.*")
    out = out.repartition(shard).sortWithinPartitions(shard, place, start)
    out = out.withColumn(text, F.col(own))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length(F.col(own)).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
