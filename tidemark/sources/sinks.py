"""Sinks: merge, range replace, insert-ignore, run log, CSV, key-value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def merged(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Upsert: rows replace those of the target with their key (K1); of rows with one key the largest in the order of their columns stays."""
    others = [c for c in rows.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max(F.struct(*others)).alias("last")).select(*key, *[F.col("last")[c].alias(c) for c in others]) if others else rows.distinct()
    return target.join(last.select(*key), key, "left_anti").unionByName(last.select(*rows.columns))


def insert_ignore(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key the target doesn't have, one of each (K4)."""
    return rows.dropDuplicates(key).join(target.select(*key), key, "left_anti")


def replace_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Overwrite only the partitions that ``rows`` has, so a refresh of some days leaves the others (K3, R1). Small partitions are written by one task each, large ones by as many as their size asks for."""
    rows.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def replace_all(rows: DataFrame, path: str) -> None:
    """K2."""
    rows.write.mode("overwrite").parquet(path)


def append_run(rows: DataFrame, path: str) -> None:
    """Run log and quality events are appended as JSON lines (K5, K7)."""
    rows.write.mode("append").json(path)


def retained(items: DataFrame, end: Column, days: int, floor: float) -> DataFrame:
    """Items of the last ``days`` days with a mention of at least ``floor`` relevance; texts cut for preview."""
    from tidemark.functions.text import preview

    kept = items.where((F.col("date") > F.date_sub(end, days)) & F.exists("mentions", lambda m: m.relevance >= floor))
    return kept.withColumn("title", preview(F.col("title"), 300)).withColumn("body", preview(F.col("body"), 500))


def csv_cell(value: Column, kind: T.DataType) -> Column:
    """Text of a cell: arrays joined by ;, formulas guarded by a quote, quoted if it holds a quote, comma or line feed (K8)."""
    text = F.array_join(value.cast("array<string>"), ";") if isinstance(kind, T.ArrayType) else value.cast("string")
    text = F.coalesce(text, F.lit(""))
    risky = text.rlike(r"^[=+\-@]") & ~text.rlike(r"^-\d+(\.\d+)?$")
    text = F.when(risky, F.concat(F.lit("'"), text)).otherwise(text)
    return F.when(text.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(df: DataFrame) -> DataFrame:
    """One column ``line``; write it as text, with header and preamble in a file of their own or in front."""
    cells = [csv_cell(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    return df.select(reduce(lambda a, b: F.concat(a, F.lit(","), b), cells).alias("line"))


def csv_head(df: DataFrame, preamble: list[str]) -> list[str]:
    return [f"# {p}" for p in preamble] + [",".join(df.columns)]
