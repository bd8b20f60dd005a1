"""Adapter from the star-schema tables to the model: items, observations, covered days, prices, universe.

An item is a line of an order: its entity the supplier's nation, its sector the region, its source the
order's priority, its day the ship date. Two sources are of text, with polarity, status, community and
author; the others are numeric.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config as C

PRIORITIES = {"1-URGENT": "reddit", "2-HIGH": "hackernews", "3-MEDIUM": "wikipedia", "4-NOT SPECIFIED": "search", "5-LOW": "github"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(key: Column, values: dict) -> Column:
    return F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in values.items()])


def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the latest order date."""
    return table(spark, sf_dir, "orders").agg(F.max("o_orderdate").cast("date").alias("as_of"))


def last_day(spark: SparkSession, sf_dir: str) -> datetime.date | None:
    """``as_of`` as a value, so that scans can be filtered by it; None without orders."""
    return as_of(spark, sf_dir).first().as_of


def between(time: str, kind: str, first: datetime.date, last: datetime.date) -> Column:
    """Whether a time lies on the days from ``first`` to ``last``: the bare column against literals of its type, which the scan takes over."""
    return (F.col(time) >= F.lit(str(first)).cast(kind)) & (F.col(time) < F.lit(str(last + datetime.timedelta(1))).cast(kind))


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, sector, cap, rank): nations by the sum of their customers' balances, largest first."""
    from pyspark.sql import Window

    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    cap = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("cap"))
    rows = nation.join(region, nation.n_regionkey == region.r_regionkey).join(cap, nation.n_nationkey == cap.c_nationkey, "left")
    rows = rows.select(F.col("n_name").alias("entity"), F.col("r_name").alias("sector"), F.coalesce("cap", F.lit(0.0)).alias("cap"))
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("cap", 2)), "entity")))


def items(spark: SparkSession, sf_dir: str, days: int = C.HISTORY_DAYS + C.LOOKBACK_DAYS) -> DataFrame:
    """Items of the last ``days`` days up to ``as_of``. Orders and parts are joined on their keys; small tables are broadcast by size."""
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    supplier, nation, region, part = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region", "part"))
    last = last_day(spark, sf_dir)
    day = F.col("l_shipdate").cast("date")
    rows = line.where(F.lit(False) if last is None else between("l_shipdate", dict(line.dtypes)["l_shipdate"], last - datetime.timedelta(days - 1), last))
    rows = rows.join(orders, rows.l_orderkey == orders.o_orderkey).join(supplier, rows.l_suppkey == supplier.s_suppkey).join(nation, supplier.s_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey).join(part, rows.l_partkey == part.p_partkey)
    status = F.when(F.col("l_tax") > 0.065, "near_duplicate").when(F.col("l_tax") < 0.005, "bot_repeat").otherwise("unique")
    polarity = (0.05 - F.col("l_discount")) * 20
    aspect = F.element_at(F.array(*map(F.lit, ("investment", "product", "reputation", "general"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    label = F.when(polarity > 0.3, "positive").when(polarity < -0.3, "negative").otherwise("uncertain")
    return rows.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("doc_id"),
        F.col("n_name").alias("entity"),
        F.col("r_name").alias("sector"),
        _case(F.col("o_orderpriority"), PRIORITIES).alias("source"),
        day.alias("date"),
        F.col("o_custkey").alias("author"),
        F.col("p_brand").alias("community"),
        status.alias("status"),
        (F.col("l_linestatus") == "O").alias("ambiguous"),
        F.lit(0.8).alias("relevance"),
        F.col("l_quantity").alias("score"),
        F.col("l_linenumber").cast("double").alias("comments"),
        polarity.alias("polarity"),
        label.alias("label"),
        aspect.alias("aspect"),
        (0.5 + F.col("l_linenumber") / 20.0).alias("confidence"),
    )


def covered_days(rows: DataFrame) -> DataFrame:
    """(source, date): days on which a source has any item; others are uncollected."""
    return rows.select("source", "date").distinct()


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, date, close): mean unit price by supplier nation and weekday."""
    line, supplier, nation = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation"))
    rows = line.join(supplier, line.l_suppkey == supplier.s_suppkey).join(nation, supplier.s_nationkey == nation.n_nationkey)
    rows = rows.select(F.col("n_name").alias("entity"), F.col("l_shipdate").cast("date").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"))
    return rows.where(F.weekday("date") < 5).groupBy("entity", "date").agg(F.avg("unit").alias("close"))
