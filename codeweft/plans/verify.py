"""Whether an index is fit to replace another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.operators.relations import orphan_edges, orphans


def verify(symbols: DataFrame, edges: DataFrame, satellites: dict[str, tuple[DataFrame, str]] | None = None, *, strict: bool = True) -> DataFrame:
    """One row: symbols, edges, orphan edge ends, orphan rows of the satellites, repeated FQNs, and ``ok``.

    An index is ok if it has symbols, none of them twice, and no orphans; where ``strict`` is false orphan edge ends,
    which edges to external types leave, don't count.
    """
    n_symbols, n_repeated = symbols.agg(F.count("*"), F.count("*") - F.countDistinct("fqn")).first()
    n_edges = edges.count()
    n_ends = orphan_edges(symbols, edges).agg(F.sum("n")).first()[0] or 0
    n_rows = orphans(symbols, satellites).agg(F.sum("orphans")).first()[0] if satellites else 0
    fit = n_symbols > 0 and not n_repeated and not n_rows and not (strict and n_ends)
    return symbols.sparkSession.createDataFrame([(n_symbols, n_edges, n_ends, n_rows, n_repeated, fit)], "n_symbols long, n_edges long, n_orphan_ends long, n_orphan_rows long, n_repeated long, ok boolean")
