"""Vector top-k with an optional metadata filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def distance(a: Column, b: Column, metric: str = "l2sq") -> Column:
    a, b = a.cast("array<double>"), b.cast("array<double>")
    dot = _total(F.zip_with(a, b, lambda x, y: x * y))
    if metric == "l2sq":
        return _total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))
    if metric == "ip":
        return -dot
    if metric == "cosine":
        return 1 - dot / F.sqrt(_total(F.transform(a, lambda x: x * x)) * _total(F.transform(b, lambda x: x * x)))
    raise ValueError(f"unknown metric {metric!r}")


def top_k(vectors: DataFrame, query: list[float], *, k: int = 10, metric: str = "l2sq", where: Column | None = None) -> DataFrame:
    """The ``k`` nearest rows of ``id, embedding``, ties by id; ``score`` is one minus the distance."""
    rows = vectors if where is None else vectors.where(where)
    far = rows.withColumn("distance", distance(F.col("embedding"), F.array(*map(F.lit, query)), metric))
    return far.orderBy("distance", "id").limit(k).withColumn("score", 1 - F.col("distance"))
