"""Joins and integrity checks between symbols, edges and their satellites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def related(symbols: DataFrame, edges: DataFrame, fqn: str, direction: str = "both", relation: str | None = None) -> DataFrame:
    """Symbols one edge away from ``fqn``; duplicate edges give duplicate rows."""
    if direction not in ("outgoing", "incoming", "both"):
        raise ValueError(f"unknown direction {direction!r}")
    edges = edges if relation is None else edges.where(F.col("relation") == relation)
    out = edges.where(F.col("from_fqn") == fqn).select(F.col("to_fqn").alias("fqn"), "relation", F.lit("outgoing").alias("direction"))
    into = edges.where(F.col("to_fqn") == fqn).select(F.col("from_fqn").alias("fqn"), "relation", F.lit("incoming").alias("direction"))
    both = {"outgoing": out, "incoming": into, "both": out.unionByName(into)}[direction]
    return both.join(symbols.select("fqn", "kind", "name"), "fqn")


def orphan_edges(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Edge ends that name no symbol: ``side, fqn, n``."""
    known = symbols.select("fqn").distinct()
    ends = edges.select(F.explode(F.array(F.struct(F.lit("from").alias("side"), F.col("from_fqn").alias("fqn")), F.struct(F.lit("to").alias("side"), F.col("to_fqn").alias("fqn")))).alias("e")).select("e.*")
    # Counted first, so that an end of very many edges is one row in the join.
    counted = ends.where("fqn is not null").groupBy("side", "fqn").agg(F.count("*").alias("n"))
    return counted.join(known, "fqn", "left_anti").select("side", "fqn", "n")


def orphans(symbols: DataFrame, satellites: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """How many rows of each table point at no symbol: ``table_name, orphans``."""
    known, out = symbols.select(F.col("fqn").alias("__fqn")).distinct(), None
    for name, (df, column) in satellites.items():
        counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__fqn")).agg(F.count("*").alias("n"))
        lost = counted.join(known, "__fqn", "left_anti")
        row = lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphans")).select(F.lit(name).alias("table_name"), "orphans")
        out = row if out is None else out.unionByName(row)
    return out


def unique_dependencies(dependencies: DataFrame) -> DataFrame:
    return dependencies.dropDuplicates(["caller_fqn", "dependency_type", "target"])


def delete_by_file(symbols: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols and edges without those of the files in ``file_path``."""
    gone = symbols.join(paths.select("file_path").distinct(), "file_path", "left_semi").select("fqn")
    left = symbols.join(gone, "fqn", "left_anti")
    for end in ("from_fqn", "to_fqn"):
        edges = edges.join(gone.withColumnRenamed("fqn", end), end, "left_anti")
    return left, edges


def stale_by_file(symbols: DataFrame, summaries: DataFrame, paths: DataFrame) -> DataFrame:
    """Summaries with those of the files' symbols and of these symbols' parents marked stale."""
    hit = symbols.join(paths.select("file_path").distinct(), "file_path", "left_semi")
    touched = hit.select("fqn").unionByName(hit.where("parent_fqn is not null").select(F.col("parent_fqn").alias("fqn"))).distinct()
    marked = summaries.join(touched.select(F.col("fqn").alias("target_fqn"), F.lit(True).alias("__hit")), "target_fqn", "left")
    return marked.withColumn("is_stale", F.col("is_stale") | F.col("__hit").isNotNull()).drop("__hit")


def one_hop(edges: DataFrame, fqns: DataFrame, direction: str = "callers") -> DataFrame:
    """``fqn, other``: those that call the symbols in ``fqns.fqn``, or are called by them, each pair once."""
    if direction not in ("callers", "callees"):
        raise ValueError(f"unknown direction {direction!r}")
    near, far = ("to_fqn", "from_fqn") if direction == "callers" else ("from_fqn", "to_fqn")
    calls = edges.where("relation = 'calls'").select(F.col(near).alias("fqn"), F.col(far).alias("other"))
    return calls.join(fqns.select("fqn").distinct(), "fqn", "left_semi").distinct()


def member_counts(symbols: DataFrame) -> DataFrame:
    """``fqn, n_methods, n_fields, first_method``: how many members each class has, and its first method by name."""
    method, field = F.col("kind") == "method", F.col("kind") == "field"
    inside = symbols.where((method | field) & F.col("parent_fqn").isNotNull()).groupBy(F.col("parent_fqn").alias("fqn"))
    counts = inside.agg(F.count_if(method).alias("m"), F.count_if(field).alias("f"), F.min(F.when(method, F.col("name"))).alias("first_method"))
    zero = F.lit(0).cast("long")
    classes = symbols.where("kind in ('class', 'interface')").select("fqn")
    return classes.join(counts, "fqn", "left").select("fqn", F.coalesce("m", zero).alias("n_methods"), F.coalesce("f", zero).alias("n_fields"), "first_method")


def members(symbols: DataFrame) -> DataFrame:
    """``fqn, methods, fields``: names of the members of each class, in order; a class without any has empty lists."""
    inside = symbols.where("kind in ('method', 'field') and parent_fqn is not null").groupBy(F.col("parent_fqn").alias("fqn"))
    lists = inside.agg(*(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("name")))).alias(f"{kind}s") for kind in ("method", "field")))
    none = F.array().cast("array<string>")
    classes = symbols.where("kind in ('class', 'interface')").select("fqn")
    return classes.join(lists, "fqn", "left").select("fqn", F.coalesce("methods", none).alias("methods"), F.coalesce("fields", none).alias("fields"))
