"""Totals of a stream of nested classes, and its lines that are no class, kept where a restarted stream finds them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from codeweft.scratch import listed, shared_folder
from codeweft.sources.classes import totals
from codeweft.sources.modules import broken_rows

_COUNTS = ("n_classes", "n_methods", "n_calls", "n_errors")


def stream_totals(classes: DataFrame, report: Callable[[dict], None] | None, expected: int, folder: str | None = None) -> DataStreamWriter:
    """A writer that notes each micro-batch's totals and errors under ``folder``, which all machines share.

    Without a folder they are in one of this session, and so don't outlive it.

    A batch's note is a partition of its own and replaces that of an earlier attempt, so a batch that is tried again
    counts once and a stream that is restarted from its checkpoint goes on where it was.  ``report``, if given, gets an
    event for each batch as ``events`` has it; a batch may be reported twice where it was tried twice.  The stream's
    options, such as ``maxFilesPerTrigger``, set the size of a batch.
    """

    folder = folder or f"{shared_folder(classes.sparkSession)}/progress-{uuid.uuid4().hex}"

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        errors = broken_rows(df).withColumn("batch", F.lit(number))
        own = totals(df.where("fqn is not null")).select(*[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _COUNTS[:3]])
        noted = own.withColumn("n_errors", F.lit(errors.count()).cast("long")).withColumn("batch", F.lit(number))
        for name, rows in (("errors", errors), ("batches", noted)):  # the totals last, as they end a batch
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{folder}/{name}")
        if report is not None:
            for row in events(spark, folder, expected).where((F.col("batch") == number) & (F.col("event") == "progress")).collect():
                report(row.asDict())

    return classes.writeStream.foreachBatch(batch)


def batches(spark: SparkSession, folder: str) -> DataFrame:
    """``batch, n_classes, n_methods, n_calls, n_errors`` of the batches that are done."""
    schema = ", ".join([*(f"{c} long" for c in _COUNTS), "batch long"])
    if not listed(spark, f"{folder}/batches"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/batches")


def events(spark: SparkSession, folder: str, expected: int) -> DataFrame:
    """``event, batch``, the batch's counts, those so far, and the percentage of ``expected`` classes, rounded down.

    The events are a ``start``, a ``progress`` for each batch with classes or errors, and a ``complete`` once all expected
    classes are in; there is one row for each batch, and batches are few, so they are put in order by one task.
    """
    some = batches(spark, folder).where("n_classes > 0 or n_errors > 0")
    so_far = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    sums = {f"total_{c[2:]}": F.sum(c).over(so_far) for c in _COUNTS}
    share = F.least(F.floor(100 * F.col("total_classes") / F.lit(max(1, expected))), F.lit(100)).cast("int")
    progress = some.withColumns(sums).withColumn("percentage", share).withColumn("event", F.lit("progress"))
    nothing = [F.lit(0).cast("long").alias(c) for c in [*_COUNTS, *sums]]
    start = spark.range(1).select(F.lit("start").alias("event"), F.lit(-1).cast("long").alias("batch"), *nothing, F.lit(0).alias("percentage"))
    done = progress.where(F.col("total_classes") >= expected).groupBy().agg(F.min("batch").alias("batch")).where("batch is not null")
    complete = progress.join(done, "batch").withColumn("event", F.lit("complete"))
    return start.unionByName(progress.select(start.columns)).unionByName(complete.select(start.columns))


def errors(spark: SparkSession, folder: str) -> DataFrame:
    """``batch, module, error`` of the lines that were no class."""
    if not any(name.startswith("batch=") for name in listed(spark, f"{folder}/errors")):
        return spark.createDataFrame([], "batch long, module string, error string")
    return spark.read.schema("module string, error string, batch long").parquet(f"{folder}/errors").select("batch", "module", "error")
