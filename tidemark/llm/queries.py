"""Thin queries ``opN_<name>``: each applies its operator to the whole of its table and derives the digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, divergence, embeddings, html, lexical, mixing, packing, quality, simhash, topk, toxicity, warc
from tidemark.llm.common import read

#: The ranks file of op9 and of the pipeline.
RANKS = "byte_bpe_50k.tiktoken"
#: The vocabulary of op12.
WORDS = "word_bpe_49k.json"


def ranks_file(name: str = RANKS) -> bytes:
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fingerprint", "component_id")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a tree without branches: rows by turn (ties by role and text), each replying to the one before.

    Rows of a conversation -1 that is there already and those planted are one conversation, as in the SQL.
    """
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    planted = spark.range(2).select(F.lit(-1).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(said))
    rows = rows.union(planted.toDF(*rows.columns))
    node = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    nodes = rows.select(F.col("conv_id").alias("tree"), node.alias("node"), "role", "text").withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))
    formatted = chat.format_trees(nodes.withColumn("score", F.lit(0.0)), top_k=1)
    back = chat.read_back(formatted)
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


CONTROL_SQL = r"([<\[])(\\*)(/?s>|/?INST\]|/?ROLE\]|</?SYS>>)"
OP2_SQL = rf"""
with c as (
  select conv_id, turn, role, text from conversations union all
  select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (
  select conv_id, turn, role as r0, text as t0, coalesce(role, '') as role, coalesce(text, '') as text,
    length(regexp_replace(coalesce(text, ''), '{CONTROL_SQL}', '\1#\2\3', 'g'))
    + case role when 'user' then 22 when 'assistant' then 7 when 'system' then 22
      else 20 + length(regexp_replace(coalesce(role, ''), '{CONTROL_SQL}', '\1#\2\3', 'g')) end as chars
  from c),
g as (
  select conv_id, count(*) as n_turns,
    string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, r0 nulls first, t0 nulls first) as turns,
    coalesce(string_agg(text, '' order by turn nulls first, r0 nulls first, t0 nulls first) filter (where role = 'assistant'), '') as loss,
    sum(chars)::bigint as formatted_chars
  from e group by conv_id)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256, formatted_chars from g
"""


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    net = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, net, keep=["doc_id"])


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


OP6_SQL = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
n as (select *, sqrt(list_dot_product(e, e)) as norm from v),
l as materialized (
  select a.vec_id as a, b.vec_id as b from n a join n b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
r as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from r join l on r.b = l.a)
select e.vec_id, (select count(*) from l where l.a = e.vec_id) as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e join (select a, min(b) as component_id from r group by a) c on c.a = e.vec_id
"""


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % topk.EVERY == 0)


OP7_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 100 = 0),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model, keep=["doc_id"])


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), ranks_file(), public_tokenizers.PATTERN, digests=True, keep=["doc_id"])
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
with p as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by payload_digest)
select p.page_id, p.payload_bytes, p.payload_digest,
  case when f.first is not null and p.page_id is distinct from f.first then 'revisit' else 'response' end as record_type,
  case when f.first is not null and p.page_id is distinct from f.first then f.first end as refers_to
from p left join f using (payload_digest)
"""


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text"))


LOWERED = f"translate({{}}, '{lexical.UPPER}', '{lexical.LOWER}')"
OP11_SQL = rf"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all({LOWERED.format("text")}, '{lexical.TERM}') as ts from documents where text is not null),
c as (select count(*) as n_all, sum(len(ts))::bigint as l_all from d where len(ts) > 0),
i as (select distinct i, item_id, term from (
  select i, item_id, unnest(regexp_extract_all({LOWERED.format("text")}, '{lexical.TERM}')) as term from (select row_number() over () as i, * from benchmark))),
t as (select r, doc_id, len(ts) as n, unnest(ts) as term from d),
f as (select r, doc_id, n, term, count(*) as tf from t where term in (select term from i) group by all),
w as (select term, floor(1000 * ln((2 * n_all + 2)::double / (2 * count(*) + 1)::double))::bigint as w from f, c group by term, n_all),
s as (select i, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_all) // l_all))))::bigint as score
  from i join f using (term) join w using (term), c group by i, item_id, r, doc_id),
o as (select i, item_id, row_number() over (partition by i order by score desc, doc_id)::int as rank, doc_id, score from s where score > 0)
select item_id, rank, doc_id, score from o where rank <= 50
"""


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path(WORDS), encoding="utf-8") as f:
        packed = packing.pack(read(spark, sf_dir, "documents").select("doc_id", "text"), f.read())
    return packed.select("doc_id", F.col("piece").cast("int"), "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents").select("lang", "source", "text"))


OP13_SQL = rf"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, {LOWERED.format("coalesce(text, '')")} as t from documents),
w as (select r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
k as (select lang, term, count(*) as total from w group by all having count(distinct r) >= 3),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from w join k using (lang, term) group by all),
v as (select l.lang, count(k.term) as v, coalesce(sum(k.total), 0)::bigint as total from (select distinct lang from g) l left join k using (lang) group by l.lang),
gn as (select g.lang, g.source, coalesce(sum(c.n), 0)::bigint as total from g left join c using (lang, source) group by all),
p as (select gn.lang, gn.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (gn.total + v.v) as p
  from gn join v using (lang) join k using (lang) left join c on c.lang = gn.lang and c.source = gn.source and c.term = k.term),
q as (select k.lang, k.term, 1 + (1000000000 * (k.total + 1)) // (v.total + v.v) as q from k join v using (lang)),
pr as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0)::bigint as value
  from gn a join gn b on a.lang = b.lang and a.source <> b.source
  left join p x on x.lang = a.lang and x.source = a.source left join p y on y.lang = b.lang and y.source = b.source and y.term = x.term group by all),
te as (select p.lang, p.source, 'term' as part, p.term as item, ((p - q) * (p - q)) // q as value from p join q using (lang, term) where n > 0 and p > q),
o as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (select * from pr union all select * from te))
select lang, source, part, item, value, rank from o where part = 'pair' or rank <= 200
"""

QUERIES = {"op1_simhash": op1_simhash, "op2_chat": op2_chat, "op3_mixing": op3_mixing, "op4_toxicity": op4_toxicity, "op5_html": op5_html, "op6_embeddings": op6_embeddings, "op7_topk": op7_topk, "op8_quality": op8_quality, "op9_bpe": op9_bpe, "op10_warc": op10_warc, "op11_search": op11_search, "op12_packing": op12_packing, "op13_divergence": op13_divergence}
ORACLE_SQL: dict[str, str] = {"op2_chat": OP2_SQL, "op6_embeddings": OP6_SQL, "op7_topk": OP7_SQL, "op10_warc": OP10_SQL, "op11_search": OP11_SQL, "op13_divergence": OP13_SQL}
