"""Bounded traversal by frontier joins, one or many sources at a time.

Rows are ``source, depth, from_fqn, to_fqn``; depths run from 0 to ``max_depth`` and an edge reached at two
depths is two rows.  What comes at the next depth depends only on the set of nodes at this one, so nodes alone are
walked, each once a level, and their edges are fetched for all levels at the end: the rows are those of a recursive
union without its paths.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.functions.scalars import chain_layer, layer, trace_line
from codeweft.operators.lookup import named, resolve_entry
from codeweft.scratch import cut_counted, sized

#: Sources up to which edges are joined as they are; with more of them duplicate edges are taken out first.
FEW = 1000
#: FQNs up to which edges or symbols are matched with them where they stand.
FEW_FQNS = 500_000


def links_of(edges: DataFrame, *, reverse: bool, relation: str | None, symbols: DataFrame | None = None) -> DataFrame:
    """Distinct ``from_fqn, to_fqn`` of one relation; with ``symbols`` only those whose far end is one of them."""
    far = "from_fqn" if reverse else "to_fqn"
    if relation is not None:
        edges = edges.where(F.col("relation") == relation)
    links = edges.select("from_fqn", "to_fqn").distinct()
    if symbols is not None:
        links = links.join(symbols.select(F.col("fqn").alias(far)).distinct(), far, "left_semi")
    return links.select("from_fqn", "to_fqn")


def traverse(edges: DataFrame, sources: DataFrame, *, max_depth: int = 10, reverse: bool = False, relation: str | None = "calls", symbols: DataFrame | None = None) -> DataFrame:
    """Edges reachable from the nodes in ``sources.fqn``, forwards or in reverse.

    With ``symbols`` an edge whose far end is not a symbol is dropped and ends the walk there.
    """
    near, far = ("to_fqn", "from_fqn") if reverse else ("from_fqn", "to_fqn")
    starts, n = cut_counted(sources.select("fqn").distinct())
    if symbols is None and n <= FEW:
        links = edges if relation is None else edges.where(F.col("relation") == relation)
    else:
        links, _ = cut_counted(links_of(edges, reverse=reverse, relation=relation, symbols=symbols))
    links = links.select("from_fqn", "to_fqn")
    level, levels, total = starts.select(F.col("fqn").alias("source"), F.col("fqn").alias(near)), [], 0
    for depth in range(max_depth + 1):
        levels.append(level.select("source", F.lit(depth).alias("depth"), near))
        total += n
        if depth == max_depth or not n:
            break
        level, n = cut_counted(sized(level, n).join(links, near).select("source", F.col(far).alias(near)).distinct())
    nodes = reduce(DataFrame.unionByName, levels)
    return sized(nodes, total).join(links, near).select("source", "depth", "from_fqn", "to_fqn").distinct()


def neighbourhood(edges: DataFrame, symbols: DataFrame, start: str, *, direction: str = "both", relation: str = "calls", depth: int = 3, limit: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and totals around ``start``.

    For each direction the first ``2 * limit`` edges by depth and ends are taken, one after the other; nodes are the symbols at
    their ends and ``start``, at most ``limit`` by FQN.  The totals are one row: ``max_depth, total_nodes,
    total_edges, truncated``, with the nodes counted before they are cut.
    """
    if direction not in ("outgoing", "incoming", "both"):
        raise ValueError(f"unknown direction {direction!r}")
    source = named(edges.sparkSession, start)
    walks = []
    for name in ("outgoing", "incoming"):
        if direction in (name, "both"):
            walk = traverse(edges, source, max_depth=depth, reverse=name == "incoming", relation=relation)
            walks.append(walk.orderBy("depth", "from_fqn", "to_fqn").limit(2 * limit).select(F.lit(name).alias("direction"), "depth", "from_fqn", "to_fqn", F.lit(relation).alias("relation")))
    found, n_edges = cut_counted(reduce(DataFrame.unionByName, walks))
    ends = found.select(F.explode(F.array("from_fqn", "to_fqn")).alias("fqn")).unionByName(source).distinct()
    nodes, n_nodes = cut_counted(symbols.join(ends, "fqn", "left_semi"))
    totals = edges.sparkSession.range(1).select(F.lit(depth).alias("max_depth"), F.lit(n_nodes).cast("long").alias("total_nodes"), F.lit(n_edges).cast("long").alias("total_edges"), F.lit(n_nodes > limit).alias("truncated"))
    return node_rows(nodes).orderBy("fqn").limit(limit), found, totals


def node_rows(symbols: DataFrame) -> DataFrame:
    """Symbols as nodes of a graph: ``fqn, kind, name, layer, file_path`` and what else is known of them in ``metadata``."""
    extra = [c for c in ("modifiers", "signature") if c in symbols.columns]
    shown = symbols.select("fqn", "kind", "name", layer(F.col("kind"), F.col("annotations")).alias("layer"), "file_path", *extra)
    return shown.withColumn("metadata", F.struct(*extra)).drop(*extra) if extra else shown


def affected(symbols: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """The changed symbols, their callers and their parents."""
    fqns = sized(*cut_counted(changed.select("fqn").distinct()), FEW_FQNS)
    callers = edges.where("relation = 'calls'").join(fqns.withColumnRenamed("fqn", "to_fqn"), "to_fqn", "left_semi").select(F.col("from_fqn").alias("fqn"))
    above = symbols.join(fqns, "fqn", "left_semi").where("parent_fqn is not null").select(F.col("parent_fqn").alias("fqn"))
    return fqns.unionByName(callers).unionByName(above).distinct()


def parents(symbols: DataFrame, fqns: DataFrame) -> DataFrame:
    """``fqn, parent_fqn`` of those symbols in ``fqns.fqn`` that have a parent."""
    return symbols.join(fqns.select("fqn").distinct(), "fqn", "left_semi").where("parent_fqn is not null").select("fqn", "parent_fqn")


def with_layers(chain: DataFrame, symbols: DataFrame) -> DataFrame:
    """A chain with the layer of each called symbol; what is no symbol has a layer by its FQN."""
    ends, n = cut_counted(chain.select("to_fqn").distinct())
    known = symbols.select(F.col("fqn").alias("to_fqn"), "name", "annotations").join(sized(ends, n, FEW_FQNS), "to_fqn", "left_semi")
    known = sized(*cut_counted(known))
    return chain.join(known, "to_fqn", "left").withColumn("layer", chain_layer(F.col("annotations"), F.col("name"), F.col("to_fqn"))).drop("name", "annotations")


def chain_dependencies(chain: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Dependencies of all symbols in a chain, one for each ``target``: the first by caller and type."""
    members = sized(*cut_counted(chain.select(F.explode(F.array("from_fqn", "to_fqn")).alias("caller_fqn")).distinct()), FEW_FQNS)
    first = F.min(F.struct("caller_fqn", "dependency_type", "strength")).alias("d")
    return dependencies.join(members, "caller_fqn", "left_semi").groupBy("target").agg(first).select("d.*", "target")


def max_depth(chain: DataFrame) -> DataFrame:
    """The depth of a chain as one row, 0 if it is empty."""
    return chain.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("depth"))


def trace(symbols: DataFrame, edges: DataFrame, dependencies: DataFrame, fqn: str, *, depth: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The call chain of a symbol with layers, its dependencies and its depth."""
    chain, _ = cut_counted(traverse(edges, named(edges.sparkSession, fqn), max_depth=depth))
    return with_layers(chain, symbols), chain_dependencies(chain, dependencies), max_depth(chain)


def trace_entry(symbols: DataFrame, edges: DataFrame, dependencies: DataFrame, entries: DataFrame, path: str, *, depth: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``trace`` of the entry point that answers an HTTP path; an error if there is none."""
    entry = resolve_entry(entries, path).first()
    if entry is None:
        raise ValueError(f"no entry point for {path!r}")
    return trace(symbols, edges, dependencies, entry["symbol_fqn"], depth=depth)


def rendered(chain: DataFrame) -> DataFrame:
    """``depth, from_fqn, to_fqn, line``: a layered chain as indented lines."""
    return chain.select("depth", "from_fqn", "to_fqn", trace_line(F.col("depth"), F.col("to_fqn"), F.col("layer")).alias("line"))
