"""Cutting lineage through the folder that the cluster shares."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application in the session's ``spark.checkpoint.dir``.

    Only a local session that has none gets a temporary folder; on a cluster that would split the data over
    machines, so it is an error there.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR"))
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return f"{folder}/{context.applicationId}"


def clear(spark: SparkSession) -> None:
    """Deletes what this application has written to the shared folder; frames cut there can't be read after that."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` there and reads it back: no recomputation after a loss, and true sizes for the planner."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``cut`` and the number of rows, counted while they are written."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]


#: Rows up to which a table is sent to every executor.
SMALL_ROWS = 200_000


def sized(df: DataFrame, n: int, rows: int = SMALL_ROWS) -> DataFrame:
    """Marks a narrow table of at most ``n`` rows for broadcast if that is few."""
    return F.broadcast(df) if n <= rows else df


def cut_small(df: DataFrame) -> DataFrame:
    """``cut`` of a narrow table, marked for broadcast if few rows were written; nothing is computed twice."""
    return sized(*cut_counted(df))


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Marks a narrow table for broadcast if a count shows it has at most ``rows`` rows; else Spark shuffles it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def listed(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder of any file system that Spark reads, in order; none if there is no such folder."""
    files, place = _file_system(spark, path)
    return sorted(status.getPath().getName() for status in files.listStatus(place)) if files.exists(place) else []


def delete(spark: SparkSession, path: str) -> None:
    files, place = _file_system(spark, path)
    files.delete(place, True)


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a small file if there is none of this name; of several writers at one time one is told that it has.

    That is left to the file system, whose making of a new file must be exclusive, as it is on HDFS.
    """
    files, place = _file_system(spark, path)
    local = files.getScheme() == "file"
    if local:  # Hadoop's local files look first and make then
        files.mkdirs(place.getParent())
        if not spark._jvm.java.io.File(place.toUri().getPath()).createNewFile():
            return False
    try:
        out = files.create(place, local)
    except Py4JJavaError as error:
        if files.exists(place):
            return False
        raise error
    out.write(text.encode())
    out.close()
    return True


def read_small(spark: SparkSession, path: str) -> str:
    """A small file as text."""
    files, place = _file_system(spark, path)
    stream = files.open(place)
    try:
        return bytes(stream.readNBytes(1 << 20)).decode()
    finally:
        stream.close()


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, what was cut within it; results must have been written elsewhere by then."""
    before = set(listed(spark, shared_folder(spark)))
    try:
        yield
    finally:
        for name in listed(spark, shared_folder(spark)):
            if name.startswith("cut-") and name not in before:
                delete(spark, f"{shared_folder(spark)}/{name}")
