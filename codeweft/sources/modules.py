"""A project's modules: what changed is extracted again, what didn't is left alone, and what is broken stays by itself.

Tables are folders with a partition for each module and the hash that it was extracted at; a module's rows count
while its hash is the one in ``hashes``, which is written last.  So a module whose extraction stops halfway keeps its
old rows, and one that loses all rows of a table has none there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codeweft.plans.rebuild import extracted
from codeweft.scratch import cut, cut_counted, delete, listed, small
from codeweft.sources.classes import SCHEMA, stale_modules

# Where build tools put compiled classes of a module.
CLASS_FOLDERS = ("target/classes/", "build/classes/java/main/")
TABLES = ("symbols", "edges", "entry_points", "dependencies")
#: Parts into which a module's listing is hashed before the parts are.
PARTS = 256
#: Classes that a task extracts.
CLASSES = 25_000


def class_files(files: DataFrame) -> DataFrame:
    """``module, path, modified, size`` of compiled classes in a listing: a module is the folder that holds the build's.

    ``files`` has ``path, modificationTime, length`` as Spark's binary file source gives them.
    """
    path, module = F.col("path"), F.lit(None).cast("string")
    for folder in reversed(CLASS_FOLDERS):
        found = F.regexp_extract(path, f"([^/]+)/{folder}.*[.]class$", 1)
        module = F.when(found != "", found).otherwise(module)
    return files.select(module.alias("module"), "path", F.col("modificationTime").alias("modified"), F.col("length").alias("size")).where("module is not null")


def read_class_files(spark: SparkSession, path: str) -> DataFrame:
    """``class_files`` under a project's folder; their content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.class").load(path)
    return class_files(files.select("path", "modificationTime", "length"))


def first_files(listing: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` files of each module, by path."""
    by_path = Window.partitionBy("module").orderBy("path")
    return listing.withColumn("__n", F.row_number().over(by_path)).where(F.col("__n") <= limit).drop("__n")


def module_hashes(listing: DataFrame) -> DataFrame:
    """``module, hash``: a SHA-256 of each module's files in order, by name, time and size.

    Files are dealt to parts by a hash of their path, each part is hashed, and then the parts' hashes are, so that no
    row holds a module's whole listing.
    """
    when = F.col("modified")
    when = F.unix_micros(when) if listing.schema["modified"].dataType.simpleString() == "timestamp" else when
    line = F.concat_ws("\t", "path", when.cast("string"), F.col("size").cast("string"))
    part = F.pmod(F.crc32(F.col("path").cast("binary")), F.lit(PARTS))

    def digest(lines: Column) -> Column:
        return F.sha2(F.array_join(F.sort_array(F.collect_list(lines)), "\n").cast("binary"), 256)

    parts = listing.groupBy("module", part.alias("part")).agg(digest(line).alias("hash"))
    return parts.groupBy("module").agg(digest(F.concat_ws("\t", F.lpad(F.col("part").cast("string"), 4, "0"), "hash")).alias("hash"))


def read_modules(spark: SparkSession, path: str) -> DataFrame:
    """Nested classes from JSON lines in folders ``module=<name>``; a line that is no class has its text in ``_broken``."""
    schema = StructType.fromDDL(f"{SCHEMA}, module string, _broken string")
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)


def broken_rows(classes: DataFrame) -> DataFrame:
    """``module, error`` for each line that is no class."""
    text = F.col("_broken") if "_broken" in classes.columns else F.lit(None).cast("string")
    module = F.col("module") if "module" in classes.columns else F.lit(None).cast("string").alias("module")
    error = F.when(text.isNotNull(), F.concat(F.lit("no JSON: "), F.left(text, F.lit(200)))).when(F.col("fqn").isNull(), "a class without a name")
    return classes.select(module, error.alias("error")).where("error is not null")


class Modules:
    """The extracted tables of a project's modules, in a folder that all machines share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def hashes(self) -> DataFrame:
        """``module, hash`` of what was extracted."""
        if not listed(self.spark, f"{self.root}/hashes"):
            return self.spark.createDataFrame([], "module string, hash string")
        return self.spark.read.schema("hash string, module string").parquet(f"{self.root}/hashes").select("module", "hash")

    def read(self, name: str) -> DataFrame:
        """One of the tables, with ``module``."""
        empty = self.spark.createDataFrame([], StructType.fromDDL(SCHEMA))
        schema = StructType([*extracted(empty, None)[name].schema, *StructType.fromDDL("module string, hash string")])
        if not listed(self.spark, f"{self.root}/{name}"):
            return self.spark.createDataFrame([], schema).drop("hash")
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        return rows.join(small(self.hashes()), ["module", "hash"], "left_semi").drop("hash")

    def extract(self, classes: DataFrame, sources: DataFrame | None, listing: DataFrame) -> DataFrame:
        """Extracts the modules whose files differ from what was extracted: ``module, status, hash, error, n_symbols,
        n_edges, n_entry_points, n_dependencies``, a row for each module of ``listing``.

        ``classes`` are nested classes with their ``module`` (see ``read_modules``), ``sources`` gives their files.  A
        module is ``skipped`` (nothing is counted), ``extracted``, or has an ``error`` and keeps what it had.  Modules that
        are no longer listed lose their rows.
        """
        now = cut(module_hashes(listing))
        stored = cut(self.hashes())
        stale = cut(stale_modules(now, stored))
        errors = cut(broken_rows(classes.join(small(stale.select("module")), "module", "left_semi")).groupBy("module").agg(F.max("error").alias("error"), F.count("*").alias("n_broken")))
        good = cut(stale.join(errors, "module", "left_anti"))
        todo, n = cut_counted(classes.join(small(good), "module").where("fqn is not null"))
        todo = todo.repartition(n // CLASSES + 1)  # what a task sorts by module doesn't grow with the project
        for name, rows in extracted(todo, sources, ("module", "hash")).items():
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("module", "hash").parquet(f"{self.root}/{name}")
        good.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("module").parquet(f"{self.root}/hashes")
        for row in stored.join(now, "module", "left_anti").select("module").collect():  # modules, not their files
            delete(self.spark, f"{self.root}/hashes/module={_escaped(self.spark, row['module'])}")
        return self._report(now, good, errors)

    def _report(self, now: DataFrame, good: DataFrame, errors: DataFrame) -> DataFrame:
        out = now.join(errors.select("module", "error"), "module", "left").join(good.select("module", F.lit(True).alias("__new")), "module", "left")
        status = F.when(F.col("error").isNotNull(), "error").when(F.col("__new"), "extracted").otherwise("skipped")
        out = out.select("module", status.alias("status"), "hash", "error")
        for name in TABLES:
            counted = self.read(name).join(small(good.select("module")), "module", "left_semi").groupBy("module").agg(F.count("*").alias(f"n_{name}"))
            out = out.join(counted, "module", "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)).cast("long"))
        return out

    def sweep(self) -> int:
        """Deletes the partitions that no hash names any more, and gives their number."""
        known = {(r["module"], r["hash"]) for r in self.hashes().collect()}
        names = {f"module={_escaped(self.spark, m)}/hash={h}" for m, h in known}
        gone = 0
        for table in TABLES:
            for module in listed(self.spark, f"{self.root}/{table}"):
                for part in listed(self.spark, f"{self.root}/{table}/{module}") if module.startswith("module=") else ():
                    if f"{module}/{part}" not in names:
                        delete(self.spark, f"{self.root}/{table}/{module}/{part}")
                        gone += 1
        return gone


def _escaped(spark: SparkSession, value: str) -> str:
    """A value as it stands in a partition's folder name."""
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)


def project_result(report: DataFrame) -> DataFrame:
    """One row for a project: whether no module failed, its modules, what was extracted, and the errors in order."""
    sums = [F.coalesce(F.sum(f"n_{name}"), F.lit(0)).alias(f"total_{name}") for name in TABLES]
    errors = F.sort_array(F.collect_list(F.when(F.col("error").isNotNull(), F.concat("module", F.lit(": "), "error"))))
    return report.agg((F.count_if(F.col("status") == "error") == 0).alias("success"), F.count("*").alias("modules"), *sums, errors.alias("errors"))
