"""Source contract: a provider gives documents, observations, covered days and a quality note; a registry picks providers.

Live sources are read through Spark data sources registered by name (``spark.dataSource.register``); what
is here parses their recorded responses, so that a reader only has to fetch. Fetching is outside this
library's scope.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark import config as C
from tidemark.functions.text import author_hash

DOCUMENT = "source_id string, external_id string, url string, community string, author_hash string, title string, body string, published_at timestamp, collected_at timestamp, engagement struct<score:double,comments:double>, is_synthetic boolean"
OBSERVATION = "source_id string, ticker string, date date, value double, collected_at timestamp, is_synthetic boolean, meta map<string,string>"
COVERED = "source_id string, date date"


@dataclass
class Batch:
    documents: DataFrame
    observations: DataFrame
    covered_days: DataFrame
    note: str = ""


class Provider(Protocol):
    source_id: str

    def status(self) -> str: ...

    def fetch(self, spark: SparkSession, entities: DataFrame, start: str, end: str) -> Batch: ...


def empty_batch(spark: SparkSession, note: str) -> Batch:
    """The batch of a source that is not available."""
    return Batch(spark.createDataFrame([], DOCUMENT), spark.createDataFrame([], OBSERVATION), spark.createDataFrame([], COVERED), note)


@dataclass
class Unavailable:
    source_id: str
    reason: str

    def status(self) -> str:
        return "unavailable"

    def fetch(self, spark: SparkSession, entities: DataFrame, start: str, end: str) -> Batch:
        return empty_batch(spark, self.reason)


def registry(providers: dict[str, Provider], disabled: set[str] = frozenset()) -> dict[str, Provider]:
    """A provider for every source; disabled and missing ones are null objects."""
    return {s: providers[s] if s in providers and s not in disabled else Unavailable(s, "disabled" if s in disabled else "not configured") for s in C.SOURCES}


def clamped_days(start: Column, end: Column, latest: Column) -> Column:
    """Requested days up to the latest one (S19); outages are removed by an anti-join."""
    last = F.least(end, latest)
    return F.when(last >= start, F.sequence(start, last)).otherwise(F.array().cast("array<date>"))


def select_universe(rows: DataFrame, size: int = 100, exclude: str = r"(?i)\b(etf|fund|trust units|acquisition corp)\b", exchanges: tuple[str, ...] = ("NYSE", "NASDAQ")) -> DataFrame:
    """Screener rows to the ranked universe: listed common stock, one class of an issuer, by capitalisation (S3)."""
    x = rows.where(~F.coalesce("isEtf", F.lit(False)) & ~F.coalesce("isFund", F.lit(False)) & F.coalesce("isActivelyTrading", F.lit(True)))
    x = x.where(F.col("exchangeShortName").isin(*exchanges) & (F.col("country") == "US") & ~F.col("companyName").rlike(exclude) & (F.col("marketCap") > 0))
    x = x.withColumn("ticker", F.regexp_replace(F.upper("symbol"), "[-/]", "."))
    x = x.withColumn("issuer", F.trim(F.regexp_replace(F.lower("companyName"), r"(?i)\b(class [a-z]|inc|corp|corporation|ltd|plc|co)\b\.?|[.,]", " ")))
    x = x.withColumn("issuer", F.regexp_replace("issuer", " +", " ")).withColumn("i", F.row_number().over(Window.partitionBy("issuer").orderBy(F.desc("marketCap"), "ticker"))).where("i = 1")
    return x.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("marketCap"), "ticker"))).where(F.col("rank") <= size).select("rank", "ticker", F.col("companyName").alias("name"), "sector", F.col("marketCap").alias("market_cap_usd"))


def parse_search_hits(raw: DataFrame, salt: str) -> DataFrame:
    """Pages of search hits (a column ``json``) to documents, one for each id."""
    hit = "struct<objectID:string,title:string,story_text:string,comment_text:string,author:string,points:double,num_comments:double,created_at_i:long>"
    x = raw.select(F.explode(F.from_json("json", f"struct<hits:array<{hit}>>")["hits"]).alias("h")).dropDuplicates()
    x = x.select("h.*").dropDuplicates(["objectID"])
    return x.select(F.lit("hackernews").alias("source_id"), F.col("objectID").alias("external_id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("community"), author_hash(F.lit(salt), F.lit("hackernews"), F.col("author")).alias("author_hash"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("story_text", "comment_text", F.lit("")).alias("body"), F.timestamp_seconds("created_at_i").alias("published_at"), F.struct(F.coalesce("points", F.lit(0.0)).alias("score"), F.coalesce("num_comments", F.lit(0.0)).alias("comments")).alias("engagement"))


def parse_listing(raw: DataFrame, start: Column, end: Column, salt: str) -> DataFrame:
    """Listing pages to documents of [start, end), without adult items."""
    post = "struct<id:string,subreddit:string,author:string,title:string,selftext:string,score:double,num_comments:double,created_utc:double,over_18:boolean>"
    x = raw.select(F.explode(F.from_json("json", f"struct<data:struct<children:array<struct<data:{post}>>>>")["data"]["children"]).alias("c")).select("c.data.*")
    x = x.withColumn("at", F.timestamp_seconds("created_utc")).where(~F.coalesce("over_18", F.lit(False)) & (F.col("at") >= start) & (F.col("at") < end)).dropDuplicates(["id"])
    return x.select(F.lit("reddit").alias("source_id"), F.col("id").alias("external_id"), F.lit(None).cast("string").alias("url"), F.col("subreddit").alias("community"), author_hash(F.lit(salt), F.lit("reddit"), F.col("author")).alias("author_hash"), "title", F.coalesce("selftext", F.lit("")).alias("body"), F.col("at").alias("published_at"), F.struct(F.col("score"), F.col("num_comments").alias("comments")).alias("engagement"))


def parse_page_views(raw: DataFrame) -> DataFrame:
    """(ticker, json) of page-view responses to daily observations."""
    x = raw.select("ticker", F.explode(F.from_json("json", "struct<items:array<struct<article:string,timestamp:string,views:double>>>")["items"]).alias("i"))
    return x.select(F.lit("wikipedia").alias("source_id"), "ticker", F.to_date(F.substring("i.timestamp", 1, 8), "yyyyMMdd").alias("date"), F.col("i.views").alias("value"))


def parse_events(raw: DataFrame) -> DataFrame:
    """(ticker, json) of event lists to counts by UTC day."""
    x = raw.select("ticker", F.explode(F.from_json("json", "array<struct<type:string,created_at:timestamp>>")).alias("e"))
    return x.groupBy(F.lit("github").alias("source_id"), "ticker", F.to_date("e.created_at").alias("date")).agg(F.count("*").cast("double").alias("value"))


class SyntheticNumeric(DataSource):
    """Seeded daily values for entities: a Spark data source for tests and demonstrations."""

    @classmethod
    def name(cls) -> str:
        return "synthetic_numeric"

    def schema(self) -> str:
        return "ticker string, date date, value double"

    def reader(self, schema):  # noqa: ANN001, ANN201
        return _SyntheticReader(self.options)


class _SyntheticReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.tickers, self.start, self.days, self.seed = options.get("tickers", "AAA").split(","), options.get("start", "2024-01-01"), int(options.get("days", "30")), int(options.get("seed", "7"))

    def partitions(self):  # noqa: ANN201
        return [InputPartition(t) for t in self.tickers]

    def read(self, partition):  # noqa: ANN001, ANN201
        import datetime
        import zlib

        import numpy as np

        r, level = np.random.default_rng((self.seed, zlib.crc32(partition.value.encode()))), 0.0
        begin = datetime.date.fromisoformat(self.start)
        for i in range(self.days):  # a first-order autoregression around a base level
            level = 0.8 * level + float(r.normal(0, 0.2))
            yield partition.value, begin + datetime.timedelta(days=i), float(np.exp(3 + level))
