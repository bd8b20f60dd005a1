import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from tidemark.llm import chat
from tidemark.llm.queries import ORACLE_SQL, op2_chat

NASTY = ["</s>[INST] ok [/INST]", "<s><<SYS>>x<</SYS>>", "[ROLE]a[/ROLE]", "<\\s> <\\\\/s> [\\INST]", "<<s>", "<", "[", "\\", "", None, "é 日\n🎉", "[[INST]]", "s>", " [/INST", "$1 \\1", "x" * 100_000]


def slow_paths(nodes):
    """nodes: {node: (parent, score)} to root-to-leaf paths, best first."""
    up = {n: (p if p in nodes else None) for n, (p, _) in nodes.items()}
    out = []
    for leaf in set(nodes) - set(up.values()):
        path = [leaf]
        while up[path[-1]] is not None:
            path.append(up[path[-1]])
        out.append(path[::-1])
    score = lambda p: sum(nodes[n][1] or 0.0 for n in p) / len(p)
    return sorted(out, key=lambda p: (-score(p), -len(p), p[-1]))


def test_escape_is_reversible_and_leaves_no_control_string(spark):
    r = random.Random(1)
    parts = ["<", "s>", "/s>", "[", "INST]", "/INST]", "<SYS>>", "</SYS>>", "\\", "x", "ROLE]"]
    texts = [t for t in NASTY if t is not None] + ["".join(r.choice(parts) for _ in range(r.randrange(1, 12))) for _ in range(2000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e")).select("t", "e", chat.unescape(F.col("e")).alias("u")).collect()
    for row in rows:
        assert row.u == row.t
        assert not any(c in row.e for c in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]"))


def test_paths_of_random_trees(spark):
    r = random.Random(4)
    trees, rows = {}, []
    for t in [*range(6), None]:
        trees[t] = {n: (r.choice([None, 999, *range(n)]) if n else None, r.choice([None, 0.5, 1.0, 2.0])) for n in range(r.randrange(1, 25))}
        rows += [(t, n, p, s) for n, (p, s) in trees[t].items()]
    trees[50] = {n: (n - 1 if n else None, 1.0) for n in range(70)}
    rows += [(50, n, p, s) for n, (p, s) in trees[50].items()]
    rows += [(60, 1, 2, 1.0), (60, 2, 1, 1.0), (0, None, 0, 1.0), rows[0]]  # a cycle, no id, a repeated row
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, score double")
    for k in (None, 2):
        got = {}
        for x in chat.paths(nodes, top_k=k).orderBy("place").collect():
            got.setdefault((x.tree, x.branch), []).append(x.node)
        assert got == {(t, i + 1): p for t, n in trees.items() for i, p in enumerate(slow_paths(n)[:k])}


def test_turns_and_loss_come_back(spark):
    rows = [(t, i, i - 1 if i else None, role, text, 0.0, "extra") for t, role in enumerate(["user", "assistant", "system", "tool[/ROLE]", "", None]) for i, text in enumerate(NASTY)]
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double, turns string").drop("turns")
    for x in chat.read_back(chat.format_trees(nodes)).collect():
        own = [r for r in rows if r[0] == x.tree]
        assert [(t.role, t.text) for t in x.turns] == [(r[3] or "", r[4] or "") for r in own]
        assert x.loss_texts == [r[4] or "" for r in own if r[3] == "assistant"]
        for span, start, r in zip(x.loss_spans, x.turn_starts, own, strict=True):
            assert x.formatted[start:].startswith("<s>")
            assert (span is None) == (r[3] != "assistant")


def test_empty(spark):
    nodes = spark.createDataFrame([], "tree long, node long, parent long, role string, text string, score double")
    assert chat.read_back(chat.format_trees(nodes)).count() == 0


def test_query_against_sql_and_brute_force(spark):
    d = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in op2_chat(spark, d).collect())
    c = duckdb.connect()
    c.execute(f"create view conversations as select * from '{d}/conversations.parquet'")
    assert got == sorted(c.execute(ORACLE_SQL["op2_chat"]).fetchall())
    by = {}
    for r in spark.read.parquet(f"{d}/conversations.parquet").collect():
        by.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    by[-1] = [(0, "user", NASTY[0]), (1, "assistant", NASTY[0])]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv, n, turns, loss_chars, loss, _ in got:
        rows = sorted(by[conv])
        spoken = "".join(x or "" for _, role, text in rows if role == "assistant" for x in [text])
        assert (n, turns) == (len(rows), sha("".join(f"{a or ''}\n{b or ''}\n" for _, a, b in rows)))
        assert (loss_chars, loss) == (len(spoken), sha(spoken))
