"""Calls to other systems, detected in nested class metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.functions.scalars import client_type, is_mapper_call


def detect_dependencies(classes: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``caller_fqn, dependency_type, target, strength``, each once.

    Calls flagged as base mapper calls and calls of mappers by name are strong mysql dependencies; other targets go by
    the list of clients, where http is weak.  Raw calls are read, so targets that are no edges are seen too.
    """
    calls = classes.select(*carry, F.explode("methods").alias("m")).select(*carry, F.col("m.fqn").alias("caller_fqn"), F.explode("m.calls").alias("c"))
    target = F.col("c.toFqn")
    flagged = F.coalesce(F.col("c.isMybatisBaseMapperCall"), F.lit(False))
    kind = F.when(flagged | is_mapper_call(target), "mysql").otherwise(client_type(target))
    found = calls.select(*carry, "caller_fqn", kind.alias("dependency_type"), target.alias("target")).where("dependency_type is not null").distinct()
    return found.withColumn("strength", F.when(F.col("dependency_type") == "http", "weak").otherwise("strong"))
