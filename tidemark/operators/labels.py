"""Forward-return labels: entry at the first trading day strictly after the signal's date, exit h rows later."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config as C


def forward_returns(prices: DataFrame, dates: DataFrame, horizons: tuple[int, ...] = C.HORIZONS) -> DataFrame:
    """(entity, date, horizon, entry_date, exit_date, ret) for (entity, date) of ``dates``; none past the last price.

    The as-of lookup is one pass: signal dates and prices are sorted together, and the next price row is
    found by a running window over the entity.
    """
    own = Window.partitionBy("entity").orderBy("date")
    priced = prices.select("entity", "date", "close", F.array(*[F.struct(F.lit(h).alias("horizon"), F.lead("date", h).over(own).alias("exit_date"), F.lead("close", h).over(own).alias("exit_close")) for h in horizons]).alias("exits"))
    both = priced.select("entity", "date", F.struct("date", "close", "exits").alias("price"), F.lit(False).alias("asks")).unionByName(dates.select("entity", "date").distinct().withColumn("asks", F.lit(True)), allowMissingColumns=True)
    # from the last date back, the last price row before a question is the first one after it; on one date the question
    # sorts before the price row, so that what it finds is strictly later. The frame only grows, so a row costs the same everywhere
    after = Window.partitionBy("entity").orderBy(F.desc("date"), F.desc("asks")).rowsBetween(Window.unboundedPreceding, -1)
    asked = both.withColumn("entry", F.last("price", ignorenulls=True).over(after)).where("asks and entry is not null")
    rows = asked.select("entity", "date", F.col("entry.date").alias("entry_date"), F.col("entry.close").alias("entry_close"), F.explode("entry.exits").alias("x"))
    return rows.where("x.exit_close is not null and entry_close > 0").select("entity", "date", F.col("x.horizon").alias("horizon"), "entry_date", F.col("x.exit_date").alias("exit_date"), (F.col("x.exit_close") / F.col("entry_close") - 1).alias("ret"))
