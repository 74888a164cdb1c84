"""The job table: newest and oldest jobs, new jobs and their progress."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from codeweft.operators.mutations import set_where
from codeweft.scratch import create_new, listed


def pending(jobs: DataFrame) -> DataFrame:
    """The oldest pending job, of equal ones the first by id."""
    return jobs.where("status = 'pending'").orderBy("created_at", "job_id").limit(1)


def running(jobs: DataFrame) -> DataFrame:
    """A running job: the first by id."""
    return jobs.where("status = 'running'").orderBy("job_id").limit(1)


def newest(jobs: DataFrame, status: str | None = None, limit: int = 50) -> DataFrame:
    some = jobs if status is None else jobs.where(F.col("status") == status)
    return some.orderBy(F.desc("created_at"), "job_id").limit(limit)


def create(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """``jobs`` with new pending ones (``job_id``, ``mode`` and so on), created now; a known id is an error."""
    if not new.join(jobs.select("job_id"), "job_id", "left_semi").isEmpty():
        raise ValueError("a job id is taken")
    fresh = new.withColumns({"status": F.lit("pending"), "created_at": F.current_timestamp()})
    return jobs.unionByName(fresh.select([c for c in fresh.columns if c in jobs.columns]), allowMissingColumns=True)


def advance(jobs: DataFrame, job_id: str, *, status: str | None = None, progress: int | None = None, processed_files: int | None = None, error_message: str | None = None) -> DataFrame:
    """``jobs`` with what is given set in one job; running stamps its start, complete and failed its end."""
    given = {"status": status, "progress": progress, "processed_files": processed_files, "error_message": error_message}
    values = {k: F.lit(v).cast(jobs.schema[k].dataType) for k, v in given.items() if v is not None and k in jobs.columns}
    stamp = {"running": "started_at", "complete": "completed_at", "failed": "completed_at"}.get(status or "")
    if stamp in jobs.columns:
        values[stamp] = F.current_timestamp()
    wanted = jobs.sparkSession.createDataFrame([(job_id,)], "id string")
    return set_where(jobs, "job_id", wanted, **values) if values else jobs


class Board:
    """Jobs that several drivers take from: a table, and in ``folder``, which all of them share, what became of its jobs.

    A job is taken by making a file named for it, which succeeds once; what happens to it is appended as events.
    """

    EVENT = "job_id string, status string, progress int, error_message string, at timestamp, place int"

    def __init__(self, jobs: DataFrame, folder: str):
        self.table, self.folder, self.spark = jobs, folder.rstrip("/"), jobs.sparkSession

    def _note(self, job_id: str, status: str, place: int, progress: int | None = None, error: str | None = None) -> None:
        values = (F.lit(job_id), F.lit(status), F.lit(progress).cast("int"), F.lit(error).cast("string"), F.current_timestamp(), F.lit(place))
        names = [field.split()[0] for field in self.EVENT.split(", ")]
        self.spark.range(1).select(*(v.alias(n) for v, n in zip(values, names, strict=True))).write.parquet(f"{self.folder}/events/{uuid.uuid4().hex}")

    def jobs(self) -> DataFrame:
        """The table with each job's last status, and what else of progress, error and times it has columns for."""
        parts = listed(self.spark, f"{self.folder}/events")
        if not parts:
            return self.table
        events = self.spark.read.schema(self.EVENT).parquet(*(f"{self.folder}/events/{p}" for p in parts))
        ends = F.col("status").isin("complete", "failed")
        last = F.max_by(F.struct("status", "progress", "error_message"), F.struct("place", "at")).alias("last")
        own = events.groupBy(F.col("job_id").alias("__job")).agg(last, F.min(F.when(F.col("status") == "running", F.col("at"))).alias("started_at"), F.max(F.when(ends, F.col("at"))).alias("completed_at"))
        joined = self.table.alias("t").join(own.alias("e"), F.col("t.job_id") == F.col("e.__job"), "left")
        known = {"status": F.col("e.last.status"), "progress": F.col("e.last.progress"), "error_message": F.col("e.last.error_message"), "started_at": F.col("e.started_at"), "completed_at": F.col("e.completed_at")}
        return joined.select(*[F.coalesce(known[c].cast(f.dataType), F.col(f"t.{c}")).alias(c) if c in known else F.col(f"t.{c}") for c, f in zip(self.table.columns, self.table.schema, strict=True)])

    def take(self, job_id: str) -> Row | None:
        """The job, now running, if it was pending and nobody has taken it; else nothing.  An unknown job is an error."""
        row = self.table.where(F.col("job_id") == job_id).first()
        if row is None:
            raise ValueError(f"no job {job_id!r}")
        if row["status"] != "pending" or not create_new(self.spark, f"{self.folder}/taken/{hashlib.sha256(job_id.encode()).hexdigest()}", f"{job_id}\n"):
            return None
        self._note(job_id, "running", 0)
        return Row(**(row.asDict() | {"status": "running"}))

    @contextmanager
    def acquire(self, job_id: str) -> Iterator[Row]:
        """The job, to be worked on within; it is complete at the end, or failed with the error, which is raised again.

        One that is taken, or wasn't pending, is an error.
        """
        row = self.take(job_id)
        if row is None:
            raise ValueError(f"job {job_id!r} isn't available")
        try:
            yield row
        except BaseException as error:
            self._note(job_id, "failed", 1, error=str(error))
            raise
        self._note(job_id, "complete", 1, progress=100)

    def take_next(self) -> Row | None:
        """The oldest pending job that nobody else takes first; nothing if there is none."""
        taken = set(listed(self.spark, f"{self.folder}/taken"))
        free = self.table.where("status = 'pending'").where(~F.sha2("job_id", 256).isin(*taken)) if taken else self.table.where("status = 'pending'")
        for row in free.orderBy("created_at", "job_id").select("job_id").toLocalIterator():
            job = self.take(row["job_id"])
            if job is not None:
                return job
        return None


def paths_of(jobs: DataFrame, column: str = "target_paths") -> DataFrame:
    """``jobs`` with a column of paths parted by commas as a list, empty where there are none."""
    none = F.array().cast("array<string>")
    parts = F.filter(F.transform(F.split(column, ","), lambda p: F.trim(p)), lambda p: p != "")
    return jobs.withColumn(column, F.coalesce(parts, none))
