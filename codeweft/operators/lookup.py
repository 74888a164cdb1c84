"""Lookups, searches and pages over the graph's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def named(spark: SparkSession, *values: str, column: str = "fqn") -> DataFrame:
    """Some values as a table, made without Python workers."""
    return spark.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(column))


def equal(df: DataFrame, **wanted: object) -> DataFrame:
    """Rows that match every given key; keys given as ``None`` are no condition."""
    tests = [F.col(k) == F.lit(v) for k, v in wanted.items() if v is not None]
    return df.where(reduce(Column.__and__, tests)) if tests else df


def contains_any(df: DataFrame, pattern: str, columns: list[str], order: list[str], limit: int = 100) -> DataFrame:
    """Rows where a column contains the pattern, ASCII case ignored, in a total order."""
    hit = reduce(Column.__or__, [F.col(c).ilike(f"%{pattern}%") for c in columns])
    return df.where(hit).orderBy(*order).limit(limit)


def page(df: DataFrame, key: str, prefix: str = "", limit: int = 20, offset: int = 0) -> DataFrame:
    return df.where(F.col(key).startswith(prefix)).orderBy(key).offset(offset).limit(limit)


def keyword_search(symbols: DataFrame, summaries: DataFrame, entries: DataFrame, query: str, n: int) -> DataFrame:
    """Symbols by name or FQN with a text and the number of entry points; every hit scores 0.5."""
    hits = contains_any(symbols, query, ["name", "fqn"], ["fqn"], n)
    text = F.coalesce("summary", F.concat("kind", F.lit(": "), "name"))
    counted = entries.groupBy(F.col("symbol_fqn").alias("fqn")).agg(F.count("*").alias("n_entries"))
    joined = hits.join(summaries.select(F.col("target_fqn").alias("fqn"), "summary"), "fqn", "left").join(counted, "fqn", "left")
    return joined.select("fqn", "kind", text.alias("text"), F.coalesce("n_entries", F.lit(0)).cast("long").alias("n_entries"), F.lit(0.5).alias("score"))


def symbol_detail(symbols: DataFrame, summaries: DataFrame, entries: DataFrame) -> DataFrame:
    """Every symbol with its summary and its first entry point by type."""
    first = entries.groupBy(F.col("symbol_fqn").alias("fqn")).agg(F.min(F.struct("entry_type", "http_path")).alias("e"))
    joined = symbols.join(summaries.select(F.col("target_fqn").alias("fqn"), "summary"), "fqn", "left").join(first, "fqn", "left")
    return joined.select("fqn", "kind", "name", "summary", F.col("e.entry_type").alias("entry_type"), F.col("e.http_path").alias("http_path"))


def resolve_entry(entries: DataFrame, path: str) -> DataFrame:
    """The entry point of an HTTP path: an exact match, else the first whose path is a prefix."""
    stem = F.regexp_replace("http_path", "/+$", "")
    rank = F.when(F.col("http_path") == path, 0).when(F.lit(path).startswith(stem), 1)
    return entries.withColumn("rank", rank).where("rank is not null").orderBy("rank", "symbol_fqn").limit(1)
