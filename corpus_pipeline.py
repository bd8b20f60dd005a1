"""Documents to tokens: filter, deduplicate, mix and encode a training corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next
one's docs. Labels come from the table ``labels`` beside the documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, mixing, quality, simhash, toxicity
from tidemark.llm.common import cut, free_name, read
from tidemark.llm.queries import ranks_file


def _judged(spark: SparkSession, docs: DataFrame, sf_dir: str, classifier, keep: int) -> DataFrame:
    """Rows of ``docs`` that the classifier, trained on the labelled ones among them, predicts ``keep`` for."""
    model = classifier.train(docs, read(spark, sf_dir, "labels"))
    own = free_name("row_values", docs)
    scored = classifier.score(docs.select("doc_id", "text", F.struct("*").alias(own)), model, keep=[own])
    return scored.where(F.col("predicted") == keep).select(f"{own}.*")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network doesn't call toxic, in all their columns.

    Null and empty texts are scored as one empty window; a score of just 0.5 goes; repeated rows stay or go
    alike; all windows of a very long text are scored; an empty table stays empty.
    """
    return _judged(spark, docs, sf_dir, toxicity, 0)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier calls good, in all their columns.

    Null and empty texts have the score of no features; a score of just 0.5 stays; repeated rows stay or go
    alike; very long texts are read piece by piece, whole; an empty table stays empty.
    """
    return _judged(spark, docs, sf_dir, quality, 1)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates: that of the smallest doc_id, null last, ties by a hash of the row.

    Null and empty texts are one group; of rows that repeat in full one stays; whole texts enter the
    fingerprint; an empty table stays empty.
    """
    return simhash.keep_one(docs)


def mixed_by_weight(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by target weights: a row for each run of words that a block takes of a document, by shard in order of place.

    Null and wordless texts are never taken; a null source is one of its own, the last; repeated rows are
    documents each; a long text is cut at block borders; an empty table stays empty.
    """
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with digests of the ids and of what they decode to.

    A null text is empty; repeated rows are coded each; a text of any length is coded whole; an empty table
    stays empty.
    """
    return bpe.encode(docs.select("doc_id", "source", "text"), ranks_file(), public_tokenizers.PATTERN, digests=True, keep=["doc_id", "source"])


STAGES = [
    ("toxicity", without_toxic),
    ("quality", good_quality),
    ("simhash", one_of_each_group),
    ("mixing", mixed_by_weight),
    ("bpe", encoded),
]

#: Trained scores and hash draws are not expressible in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each but the last is written to the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, f"stage-{name}")
    return docs
