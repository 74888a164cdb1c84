"""Tests of source files, found by path among known files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.functions.scalars import is_test_file, sibling_test_paths, test_methods, test_paths
from codeweft.scratch import cut_small


def mapping(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """``fqn, place, test_file, test_pattern, test_exists, methods`` for each symbol and candidate test.

    ``files`` has ``path`` and, where methods are wanted, ``content``.  ``test_pattern`` is the file's name.  Symbols
    without a file, and files outside a main source folder, have no candidates.
    """
    sought = symbols.where("file_path is not null").select("fqn", F.posexplode(test_paths(F.col("file_path"))).alias("place", "test_file"))
    content = F.col("content") if "content" in files.columns else F.lit(None).cast("string")
    there = files.select(F.col("path").alias("test_file"), F.lit(True).alias("test_exists"), test_methods(F.coalesce(content, F.lit(""))).alias("methods"))
    joined = sought.join(there, "test_file", "left")
    none = F.array().cast("array<string>")
    return joined.select("fqn", "place", "test_file", F.substring_index("test_file", "/", -1).alias("test_pattern"), F.coalesce("test_exists", F.lit(False)).alias("test_exists"), F.coalesce("methods", none).alias("methods"))


def mapping_summary(targets: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """One row for a list of ``targets.fqn``: how many there are, have a file, and have a test that exists."""
    known = targets.select("fqn").distinct().join(symbols.select("fqn", "file_path"), "fqn", "left")
    tested = mapping(symbols.join(cut_small(targets.select("fqn").distinct()), "fqn", "left_semi"), files).where("test_exists").select("fqn", F.lit(True).alias("tested")).distinct()
    return known.join(tested, "fqn", "left").agg(F.count("*").alias("total"), F.count_if(F.col("file_path").isNotNull()).alias("found"), F.count_if(F.col("tested")).alias("with_tests"))


def found_tests(sources: DataFrame, files: DataFrame) -> DataFrame:
    """``file_path, place, path``: the tests of each file in ``sources.file_path`` that exist, in order of ``place``.

    A file outside a main source folder is looked up in the folder ``test`` beside its parent's, if any known file is in
    there.
    """
    aside = F.concat(F.regexp_extract("file_path", r"^(.*)/[^/]+/[^/]+$", 1), F.lit("/test"))
    folders = files.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder")).distinct()
    known = sources.where("file_path is not null").select("file_path").distinct().withColumn("folder", aside).join(folders.withColumn("there", F.lit(True)), "folder", "left")
    sought = known.select("file_path", F.posexplode(sibling_test_paths(F.col("file_path"), F.coalesce("there", F.lit(False)))).alias("place", "path"))
    return sought.join(files.select("path").distinct(), "path", "left_semi").select("file_path", "place", "path")


def first_tests(found: DataFrame) -> DataFrame:
    """``file_path, path, n_more``: the first of each file's found tests, and how many others there are."""
    return found.groupBy("file_path").agg(F.min_by("path", "place").alias("path"), (F.count("*") - 1).alias("n_more"))


def covered_counts(sources: DataFrame, found: DataFrame) -> DataFrame:
    """``file_path, path, n_covered, n_more``: ``first_tests`` with how many different symbols (``fqn``) each covers."""
    own = sources.where("file_path is not null").select("file_path", "fqn").distinct().groupBy("file_path").agg(F.count("*").alias("n_covered"))
    return first_tests(found).join(own, "file_path").select("file_path", "path", "n_covered", "n_more")


def uncovered(sources: DataFrame, found: DataFrame) -> DataFrame:
    """``fqn`` of the symbols in ``sources`` that are in no file with a found test, each once."""
    rows = sources.select("fqn", "file_path").distinct()
    covered = rows.join(found.select("file_path").distinct(), "file_path", "left_semi").select("fqn")
    return rows.select("fqn").distinct().join(covered, "fqn", "left_anti")


def tests_of_files(sources: DataFrame, files: DataFrame) -> DataFrame:
    """``file_path, path, covers, additional_tests``: the first test of each source file that exists, and the others.

    ``sources`` has ``file_path`` and ``fqn``; files without a test are left out (see ``found_tests``).  A row lists all
    symbols of a file; where only counts or rows are wanted, ``covered_counts`` and ``uncovered`` go without lists.
    """
    found = found_tests(sources, files)
    covers = sources.where("file_path is not null").groupBy("file_path").agg(F.sort_array(F.collect_set("fqn")).alias("covers"))
    paths = F.transform(F.sort_array(F.collect_list(F.struct("place", "path"))), lambda x: x["path"])
    first = found.groupBy("file_path").agg(paths.alias("paths")).join(covers, "file_path")
    return first.select("file_path", F.col("paths")[0].alias("path"), "covers", F.expr("slice(paths, 2, size(paths))").alias("additional_tests"))


def missing_coverage(callers: DataFrame, found: DataFrame) -> DataFrame:
    """Callers (``fqn``) that no test in ``tests_of_files`` covers."""
    covered = found.select(F.explode("covers").alias("fqn")).distinct()
    return callers.join(covered, "fqn", "left_anti")


def tests_of_package(symbols: DataFrame, files: DataFrame, package: str) -> DataFrame:
    """``path, source_package``: all tests of the files of a package, by prefix, each once.

    A test that is itself one of these files isn't given again.
    """
    own = symbols.where(F.col("fqn").startswith(package)).select("fqn", "file_path")
    found = found_tests(own, files).select("path").distinct()
    return found.join(own.select(F.col("file_path").alias("path")).distinct(), "path", "left_anti").withColumn("source_package", F.lit(package))


def coverage_of(targets: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """``fqn, total_callers, tested_callers, coverage_percentage, warnings`` for each target; 0 where nothing calls it.

    Callers by any relation count; each that isn't in a test file is a warning.
    """
    asked = targets.select("fqn").distinct()
    into = edges.join(cut_small(asked).withColumnRenamed("fqn", "to_fqn"), "to_fqn", "left_semi").select(F.col("to_fqn").alias("target"), F.col("from_fqn").alias("fqn")).distinct()
    test = is_test_file(F.col("file_path"))
    counts = into.join(symbols.select("fqn", "file_path"), "fqn").groupBy(F.col("target").alias("fqn")).agg(F.count("*").alias("total"), F.count_if(test).alias("tested"))
    zero = F.lit(0).cast("long")
    out = asked.join(counts, "fqn", "left").select("fqn", F.coalesce("total", zero).alias("total_callers"), F.coalesce("tested", zero).alias("tested_callers"))
    share = F.when(F.col("total_callers") > 0, F.round(100.0 * F.col("tested_callers") / F.col("total_callers"), 2)).otherwise(F.lit(0.0))
    return out.withColumn("coverage_percentage", share).withColumn("warnings", F.col("total_callers") - F.col("tested_callers"))


def coverage_batch(targets: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: targets, the mean of their rounded percentages, and all warnings."""
    own = coverage_of(targets, symbols, edges)
    return own.agg(F.count("*").alias("total"), F.avg("coverage_percentage").alias("average_coverage"), F.sum("warnings").alias("total_warnings"))
