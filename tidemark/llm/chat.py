"""Chat formatting over reply trees, in DataFrame operations only.

Root-to-leaf paths are enumerated by self-joins that double the distance they look up (1, 2, 4, ...
replies), so a thread of n turns takes log2(n) joins. Branches are ranked by score, and each chosen path
becomes one conversation with a loss mask over its assistant texts.

The template marks a turn by ``<s>`` and ``</s>``; user texts stand in ``[INST] `` and `` [/INST]``,
system texts in ``<<SYS>>`` and ``<</SYS>>``, assistant texts plainly, and any other role is named in
``[ROLE]`` and ``[/ROLE]`` before its text. Control strings inside texts and roles get a backslash after
their first character, one more if they have some already, and reading removes one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut

#: What follows the first character (and backslashes) of a control string.
REST = r"(/?s>|/?INST\]|/?ROLE\]|</?SYS>>)"
HEADS = {"user": "<s>[INST] ", "assistant": "<s>", "system": "<s><<SYS>>"}
TAILS = {"user": " [/INST]", "assistant": "", "system": "<</SYS>>"}
OTHER, NAMED, END = "<s>[ROLE]", "[/ROLE]", "</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + REST, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + REST, r"$1$2$3")


def paths(nodes: DataFrame, top_k: int | None = 1) -> DataFrame:
    """(tree, node, parent, score) to (tree, leaf, branch, score, depth, node, place): the chosen root-to-leaf paths.

    A node whose parent is null or not in its tree is a root. A branch's score is the mean of its nodes'
    scores (null and NaN: 0); branches rank by score, then depth, both descending, then leaf id. ``top_k`` None
    keeps every branch. ``place`` counts from 1 at the root. tree may be null, a tree of its own; rows
    without a node id are in no path, nor are nodes on a cycle, which no root reaches. Node ids are
    unique in a tree; of rows that repeat one, the smallest is kept. The leaves of one tree are ranked in
    one task. An empty table gives an empty result.
    """
    own = nodes.where("node is not null").groupBy("tree", "node").agg(F.min(F.struct("parent", "score")).alias("p")).select("tree", "node", F.col("p.parent").alias("parent"), F.coalesce(F.nanvl(F.col("p.score").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("score"))
    own = cut(own, "nodes")
    above = own.select(F.col("tree").alias("tree2"), F.col("node").alias("node2"))
    near = own.join(above, F.col("tree").eqNullSafe(F.col("tree2")) & (F.col("parent") == F.col("node2")), "left")
    state = cut(near.select("tree", "node", F.col("node2").alias("up"), "score", F.lit(1).cast("long").alias("depth")), "lift")
    # lifts[j]: nodes with their ancestor 2**j above; ended: nodes whose root is reached, with the branch's sums
    lifts, ended = [state.where("up is not null")], state.where("up is null")
    most = max(1, own.count()).bit_length() + 1  # a cycle would go on for ever
    while len(lifts) < most and not lifts[-1].isEmpty():
        whole = lifts[-1].union(ended).toDF("tree2", "node2", "up2", "score2", "depth2")
        on = F.col("tree").eqNullSafe(F.col("tree2")) & (F.col("up") == F.col("node2"))
        state = cut(lifts[-1].join(whole, on).select("tree", "node", F.col("up2").alias("up"), (F.col("score") + F.col("score2")).alias("score"), (F.col("depth") + F.col("depth2")).alias("depth")), "lift")
        lifts.append(state.where("up is not null"))
        ended = ended.union(state.where("up is null"))

    replied = lifts[0].select(F.col("tree").alias("tree2"), F.col("up").alias("node2")).distinct()
    leaves = ended.join(replied, F.col("tree").eqNullSafe(F.col("tree2")) & (F.col("node") == F.col("node2")), "left_anti")
    leaves = leaves.select("tree", F.col("node").alias("leaf"), (F.col("score") / F.col("depth")).alias("score"), "depth")
    leaves = leaves.withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("depth"), "leaf")))
    if top_k is not None:
        leaves = leaves.where(F.col("branch") <= top_k)

    found = cut(leaves.withColumn("node", F.col("leaf")).withColumn("back", F.lit(0).cast("long")), "paths")
    for level in range(len(lifts) - 1, -1, -1):
        step = lifts[level].select(F.col("tree").alias("tree2"), F.col("node").alias("node2"), "up")
        farther = found.join(step, F.col("tree").eqNullSafe(F.col("tree2")) & (F.col("node") == F.col("node2")))
        farther = farther.withColumn("node", F.col("up")).withColumn("back", F.col("back") + (1 << level)).select(*found.columns)
        found = cut(found.union(farther), "paths")
    return found.select("tree", "leaf", "branch", "score", "depth", "node", (F.col("depth") - F.col("back")).alias("place"))


def format_trees(nodes: DataFrame, top_k: int | None = 1) -> DataFrame:
    """(tree, node, parent, role, text, score) to one row for each chosen path, see ``paths``.

    Columns: tree, leaf, branch, score, formatted, turn_starts (offset of each turn), loss_spans (of each
    turn, start and end of its text if it is the assistant's, else null). Offsets count code points from
    0. Null roles and texts are empty; other columns are ignored.
    """
    said = nodes.where("node is not null").groupBy("tree", "node").agg(F.min(F.struct("parent", "score", "role", "text")).alias("p"))
    said = said.select(F.col("tree").alias("tree2"), F.col("node").alias("node2"), F.coalesce("p.role", F.lit("")).alias("role"), F.coalesce("p.text", F.lit("")).alias("text"))
    rows = paths(nodes, top_k).join(said, F.col("tree").eqNullSafe(F.col("tree2")) & (F.col("node") == F.col("node2")))
    head = F.concat(F.lit(OTHER), escape(F.col("role")), F.lit(NAMED))
    tail = F.lit("")
    for role in HEADS:
        head = F.when(F.col("role") == role, HEADS[role]).otherwise(head)
        tail = F.when(F.col("role") == role, TAILS[role]).otherwise(tail)
    rows = rows.withColumns({"head": head, "body": escape(F.col("text")), "tail": F.concat(tail, F.lit(END))})
    rows = rows.withColumn("turn", F.concat("head", "body", "tail"))
    before = Window.partitionBy("tree", "leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.char_length("turn")).over(before), F.lit(0)))
    from_ = F.col("start") + F.char_length("head")
    span = F.when(F.col("role") == "assistant", F.struct(from_.alias("start"), (from_ + F.char_length("body")).alias("end")))
    turns = rows.groupBy("tree", "leaf", "branch", "score").agg(F.array_sort(F.collect_list(F.struct("place", "turn", "start", span.alias("span")))).alias("t"))
    return turns.select("tree", "leaf", "branch", "score", F.array_join(F.col("t.turn"), "").alias("formatted"), F.col("t.start").alias("turn_starts"), F.col("t.span").alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` (array of role, text) and ``loss_texts``, both read from the formatted text.

    A loss text is what its span covers, unescaped.
    """
    pieces = F.transform(F.filter(F.split("formatted", END), lambda p: p != ""), lambda p: p)

    def inside(p: Column, head: str, tail: str) -> Column:
        return F.substring(p, F.lit(len(head) + 1), F.char_length(p) - (len(head) + len(tail)))

    def turn(p: Column) -> Column:
        named = F.substring_index(p, NAMED, 1)
        out = F.struct(F.lit("assistant").alias("role"), unescape(inside(p, HEADS["assistant"], "")).alias("text"))
        other = F.struct(unescape(inside(named, OTHER, "")).alias("role"), unescape(F.substring(p, F.char_length(named) + (len(NAMED) + 1), F.char_length(p))).alias("text"))
        out = F.when(p.startswith(OTHER), other).otherwise(out)
        for role in ("user", "system"):
            out = F.when(p.startswith(HEADS[role]), F.struct(F.lit(role).alias("role"), unescape(inside(p, HEADS[role], TAILS[role])).alias("text"))).otherwise(out)
        return out

    marked = F.filter(F.zip_with(F.arrays_zip("pieces", "turn_starts"), F.col("loss_spans"), lambda z, s: F.when(s.isNotNull(), F.struct(z.pieces.alias("piece"), (s.start - z.turn_starts).cast("int").alias("at"), (s.end - s.start).cast("int").alias("n")))), lambda m: m.isNotNull())
    out = formatted.withColumn("pieces", pieces)
    out = out.withColumn("loss_texts", F.transform(marked, lambda m: unescape(F.substring(m.piece, m["at"] + 1, m.n))))
    return out.withColumn("turns", F.transform("pieces", turn)).drop("pieces")
