import numpy as np
import tiktoken

import corpus_pipeline
from tidemark.llm import bpe, simhash
from tidemark.llm.queries import ranks_file
from test_mixing import slow_targets, words
from test_simhash import slow_components, slow_print


def test_stages_against_brute_force(spark, tmp_path):
    d = "/root/testdata/sf0.01"
    docs, out = spark.read.parquet(f"{d}/documents.parquet"), {}
    columns, now = docs.columns, docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, d).write.parquet(f"{tmp_path}/{i}")
        out[name] = now = spark.read.parquet(f"{tmp_path}/{i}")
        if name != "bpe":
            assert now.columns == columns
    labels = {r.doc_id: r for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    ids = {n: [r.doc_id for r in f.select("doc_id").collect()] for n, f in out.items()}
    every = {r.doc_id for r in docs.select("doc_id").collect()}
    dropped = every - set(ids["toxicity"])
    assert np.mean([labels[i].toxic for i in dropped if i in labels]) > 0.8
    assert np.mean([labels[i].toxic for i in ids["toxicity"] if i in labels]) < 0.04
    dropped = set(ids["toxicity"]) - set(ids["quality"])
    assert np.mean([labels[i].quality for i in dropped if i in labels]) < 0.1
    assert np.mean([labels[i].quality for i in ids["quality"] if i in labels]) > 0.97
    rows = [(r.doc_id, slow_print(r.text)) for r in out["quality"].collect()]
    assert sorted(ids["simhash"]) == sorted(set(slow_components(rows)))
    sizes, taken = {}, {}
    for r in out["simhash"].collect():
        sizes[r.source] = sizes.get(r.source, 0) + words(r.text)
    for r in out["mixing"].collect():
        taken[r.source] = taken.get(r.source, 0) + words(r.text)
    for s, target in slow_targets(sizes).items():
        assert abs(taken.get(s, 0) - target) <= 1
    import public_tokenizers

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(ranks_file()), special_tokens={})
    expected = sorted((r.doc_id, library.encode_ordinary(r.text)) for r in out["mixing"].collect())
    assert sorted((r.doc_id, r.ids) for r in out["bpe"].collect()) == expected


def test_stages_on_odd_tables(spark):
    rows = [(1, None, None, None, None, "x"), (None, "", "en", "a", 0, None), (2, "same text here", "en", "a", 14, "y"), (2, "same text here", "en", "a", 14, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    for _, stage in corpus_pipeline.STAGES[:4]:
        for table in (docs, docs.limit(0)):
            assert stage(spark, table, "/root/testdata/sf0.001").columns == docs.columns
    assert simhash.keep_one(docs).count() == 2
    assert corpus_pipeline.STAGES[4][1](spark, docs, "").count() == 4
