"""Searches of glossary and symbols that attach what is known of each hit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.operators.lookup import keyword_search
from codeweft.operators.vectors import top_k


def glossary_search(glossary: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Terms that begin with the query, then others whose meaning contains it, taken literally; each in order by term."""
    order = F.col("code_term")
    begins = glossary.where(order.startswith(query)).orderBy(order).limit(limit).withColumn("__tag", F.lit(0))
    means = glossary.where(F.lower("business_meaning").contains(query.lower())).orderBy(order).limit(limit).withColumn("__tag", F.lit(1))
    first = Window.partitionBy("code_term").orderBy("__tag")
    once = begins.unionByName(means).withColumn("__n", F.row_number().over(first)).where("__n = 1")
    return once.orderBy("__tag", order).limit(limit).drop("__tag", "__n")


def page_with_total(df: DataFrame, key: str, prefix: str = "", limit: int = 20, offset: int = 0) -> DataFrame:
    """A page in order of ``key``, each row with the number of all rows that have the prefix."""
    some = df.where(F.col(key).startswith(prefix))
    return some.orderBy(key).offset(offset).limit(limit).withColumn("total", F.lit(some.count()).cast("long"))


def attached(hits: DataFrame, symbols: DataFrame, summaries: DataFrame, entries: DataFrame) -> DataFrame:
    """``hits`` (``fqn`` and others) with kind and name, summary, and all entry points as a list, empty if there are none.

    What is no symbol is left out.
    """
    points = entries.join(hits.select(F.col("fqn").alias("symbol_fqn")).distinct(), "symbol_fqn", "left_semi")
    points = points.groupBy(F.col("symbol_fqn").alias("fqn")).agg(F.sort_array(F.collect_list(F.struct("entry_type", "http_path"))).alias("entry_points"))
    said = summaries.select(F.col("target_fqn").alias("fqn"), "summary")
    out = hits.join(symbols.select("fqn", "kind", "name"), "fqn").join(said, "fqn", "left").join(points, "fqn", "left")
    none = F.array().cast(out.schema["entry_points"].dataType)
    return out.withColumn("entry_points", F.coalesce("entry_points", none))


def semantic_search(vectors: DataFrame, symbols: DataFrame, summaries: DataFrame, entries: DataFrame, query: list[float] | None, text: str, *, n: int = 10, where: Column | None = None, metric: str = "l2sq") -> DataFrame:
    """``fqn, kind, text, n_entries, score`` of the nearest vectors whose ``id`` is a symbol.

    Without a query vector (where embedding has failed), or if nothing is found, symbols are searched by keyword.
    """
    if query is not None:
        near = top_k(vectors, query, k=n, metric=metric, where=where).select(F.col("id").alias("fqn"), "score")
        found = attached(near, symbols, summaries, entries)
        shown = found.select("fqn", "kind", F.coalesce("summary", F.concat("kind", F.lit(": "), "name")).alias("text"), F.size("entry_points").cast("long").alias("n_entries"), "score")
        if not near.isEmpty():
            return shown
    return keyword_search(symbols, summaries, entries, text, n)
