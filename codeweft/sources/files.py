"""Java source files as frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Source roots in the order in which a later one wins.
ROOTS = ("src/main/java/", "src/java/", "src/")


def read_sources(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    """``path, modified, content`` of all Java files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.java").load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), *([F.decode("content", "UTF-8").alias("content")] if content else []))


def changed_files(files: DataFrame, since: object) -> DataFrame:
    """``path`` of the files that were modified after a time."""
    return files.where(F.col("modified") > F.lit(since)).select("path")


def source_index(files: DataFrame) -> DataFrame:
    """``fqn, file_path``: the class that each file under a source root is named for; of several the last root's."""
    found = [F.when(F.col("path").contains(root), F.struct(F.lit(k).alias("rank"), F.substring_index("path", root, -1).alias("rest"))) for k, root in enumerate(ROOTS)]
    rows = files.select("path", F.coalesce(*found).alias("r")).where("r is not null")
    fqn = F.regexp_replace(F.regexp_replace("r.rest", r"\.java$", ""), "/", ".")
    return rows.groupBy(fqn.alias("fqn")).agg(F.max(F.struct("r.rank", "path"))["path"].alias("file_path"))
