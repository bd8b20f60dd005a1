"""The chained document pipeline (N18): clean, language, duplicates, entities, classification, daily metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import classify, dedupe, resolve


def processed(docs: DataFrame, entities: list[resolve.Entity], lists: resolve.ContextWords) -> DataFrame:
    """(doc_id, source, community, author_hash, published_at, score, comments, lang, status, matches, text) of raw documents.

    ``docs``: doc_id, source, title, body, url, community, author_hash, published_at, score, comments. All
    documents are cleaned and take part in the search for duplicates; entities are not looked for in
    other languages.
    """
    clean = docs.withColumns({"title": X.clean_text(F.coalesce("title", F.lit(""))), "body": X.clean_text(F.coalesce("body", F.lit("")))})
    clean = clean.withColumn("text", F.concat_ws(" ", "title", "body")).withColumn("lang", X.language(F.col("text"))["lang"])
    found = dedupe.statuses(clean.select("doc_id", "url", "community", "author_hash", "text", "published_at")).select("doc_id", "status")
    clean = clean.join(found, "doc_id")
    matched = F.when(F.col("lang") != "other", resolve.resolve(F.col("title"), F.col("body"), entities, lists))
    own = F.when(F.col("title") != "", F.concat_ws("\n", "title", "body")).otherwise(F.col("body"))
    return clean.withColumn("matches", matched).withColumn("text", own).drop("title", "body", "url")


def mentions(docs: DataFrame, classifier: classify.Classifier) -> DataFrame:
    """Rows as ``metrics.daily_text_metrics`` takes them, one for each mention of ``processed`` documents; only unique ones are classified."""
    found = resolve.mentions(docs.where(F.col("matches").isNotNull()).select("doc_id", "matches"))
    x = docs.drop("matches").join(found, "doc_id")
    said = F.when(F.col("status") == "unique", classify.classify(F.col("text"), F.col("offsets"), classifier))
    x = x.withColumn("said", said)
    return x.select(
        "doc_id", "entity", "source", F.col("published_at").cast("date").alias("date"), F.col("author_hash").alias("author"), "community", "status", "ambiguous", "relevance", "score", "comments", "reasons", "texts",
        F.col("said.score").alias("polarity"), F.col("said.label").alias("label"), F.col("said.aspect").alias("aspect"), F.col("said.confidence").alias("confidence"), F.col("said.direction").alias("direction"),
    )
