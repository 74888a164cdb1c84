"""Change impact of many targets at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.functions.scalars import confidence, is_test_file, risk_level, risk_rank, risk_score, test_paths
from codeweft.scratch import cut, cut_counted, cut_small, sized


def _numbered(symbols: DataFrame, edges: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Numbers for symbols and targets, ``fqn, id, is_symbol``, and the distinct call links and the targets by them.

    A walk from targets to callers that are symbols meets nothing else.  Pairs of numbers are a quarter of pairs of FQNs,
    and all that is walked, made distinct and counted are pairs.
    """
    known = symbols.select("fqn", F.lit(True).alias("is_symbol")).unionByName(targets.select("fqn", F.lit(False).alias("is_symbol")))
    known = known.where("fqn is not null").groupBy("fqn").agg(F.max("is_symbol").alias("is_symbol"))
    names, n = cut_counted(known.withColumn("id", F.monotonically_increasing_id()))
    callers = sized(names.where("is_symbol").select(F.col("fqn").alias("from_fqn"), F.col("id").alias("from_id")), n)
    called = sized(names.select(F.col("fqn").alias("to_fqn"), F.col("id").alias("to_id")), n)
    calls = edges.where("relation = 'calls'").select("from_fqn", "to_fqn")
    pairs = calls.join(callers, "from_fqn").join(called, "to_fqn").select("to_fqn", "from_id", "to_id").distinct()  # where the join left them
    links = cut(pairs.select("from_id", "to_id"))
    return names, links, cut(targets.select("fqn").distinct().join(names, "fqn").select("id"))


def _walk(links: DataFrame, targets: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """``source, depth, id`` of the nodes whose callers count at each depth, and ``source, id`` of all callers, dealt by ``id``.

    Only nodes are carried from level to level, not the edges between them: what is counted of edges depends on the
    node that they lead to.
    """
    level, n = cut_counted(targets.select(F.col("id").alias("source"), "id"))
    levels, callers = [], []
    for k in range(depth + 1):
        levels.append(level.select("source", F.lit(k).alias("depth"), "id"))
        above = sized(level, n).join(links.select(F.col("to_id").alias("id"), "from_id"), "id").select("source", F.col("from_id").alias("id")).distinct()
        level, n = cut_counted(above)
        callers.append(level)
        if not n:
            break
    return reduce(DataFrame.unionByName, levels), reduce(DataFrame.unionByName, callers).repartition("id").distinct()


def tested_files(symbols: DataFrame) -> DataFrame:
    """``file_path, test_path``: main files and those of their candidate tests that are among the symbols' files."""
    files = symbols.where("file_path is not null").select("file_path").distinct()
    found = files.select("file_path", F.explode(test_paths(F.col("file_path"))).alias("test_path"))
    return found.join(files.withColumnRenamed("file_path", "test_path"), "test_path", "left_semi")


def impact(symbols: DataFrame, edges: DataFrame, entries: DataFrame, targets: DataFrame, *, depth: int = 5) -> DataFrame:
    """For every target: callers (rows of depth and edge), entry points that reach it, callers' files that have a
    test among the symbols' files, caller rows without such a test, risk and confidence.  Targets without callers
    are given too.
    """
    names, links, starts = _numbered(symbols, edges, targets)
    levels, callers = _walk(links, starts, depth)
    files = tested_files(symbols).select("file_path").distinct()
    covered = symbols.join(files, "file_path", "left_semi").select("fqn", "file_path").distinct()
    covered = cut(covered.join(names, "fqn").select("id", "file_path"))
    ends = links.join(covered.select(F.col("id").alias("from_id"), F.lit(1).alias("covered")).distinct(), "from_id", "left")
    degrees = ends.groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("callers"), F.count_if(F.col("covered").isNull()).alias("untested"))
    counts = levels.join(degrees, "id").groupBy("source").agg(F.sum("callers").alias("n_callers"), F.sum("untested").alias("n_untested"))
    marks = _points(names, entries).join(covered.groupBy("id").agg(F.collect_set("file_path").alias("files")), "id", "full")
    files = F.array_distinct(F.flatten(F.collect_set("files")))
    hits = callers.join(marks, "id").groupBy("source").agg(F.size(files).cast("long").alias("n_tests"), F.sum("n_points").alias("n_entries"))
    return _judged(names, targets, (counts, hits))


def impact_by_own_files(symbols: DataFrame, edges: DataFrame, entries: DataFrame, targets: DataFrame, *, depth: int = 5) -> DataFrame:
    """As ``impact``, but tests are the distinct callers in test files, and untested the distinct callers outside of them."""
    names, links, starts = _numbered(symbols, edges, targets)
    levels, callers = _walk(links, starts, depth)
    degrees = links.groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("callers"))
    counts = levels.join(degrees, "id").groupBy("source").agg(F.sum("callers").alias("n_callers"))
    test = is_test_file(F.col("file_path"))
    known = symbols.select("fqn", test.alias("test")).join(names, "fqn").groupBy("id").agg(F.count_if("test").alias("n_in"), F.count_if(~F.col("test")).alias("n_out"))
    marks = known.join(_points(names, entries), "id", "full")
    sums = [F.sum(c).alias(name) for c, name in (("n_in", "n_tests"), ("n_out", "n_untested"), ("n_points", "n_entries"))]
    return _judged(names, targets, (counts, callers.join(cut(marks), "id").groupBy("source").agg(*sums)))


def _points(names: DataFrame, entries: DataFrame) -> DataFrame:
    """``id, n_points``: symbols with their number of entry points."""
    return entries.select(F.col("symbol_fqn").alias("fqn")).join(names, "fqn").groupBy("id").agg(F.count("*").alias("n_points"))


def _judged(names: DataFrame, targets: DataFrame, parts: tuple[DataFrame, ...]) -> DataFrame:
    joined = targets.select("fqn").distinct().join(names, "fqn", "left").select(F.col("fqn").alias("name"), F.col("id").alias("source"))
    for part in parts:
        joined = joined.join(part, "source", "left")
    zero = F.lit(0).cast("long")
    joined = joined.select(F.col("name").alias("source"), *[F.coalesce(c, zero).alias(c) for c in ("n_callers", "n_entries", "n_tests", "n_untested")])
    score = risk_score(F.col("n_callers"), F.col("n_entries"), F.col("n_untested"))
    return joined.withColumn("risk_score", score).withColumn("risk_level", risk_level(score)).withColumn("confidence", confidence(F.col("n_callers"), F.col("n_tests")))


def gated(judged: DataFrame, threshold: str = "low") -> DataFrame:
    """Impact as it is reported: below the threshold nothing is listed and the level is low, only the confidence stays."""
    below = risk_rank(F.col("risk_level")) < risk_rank(F.lit(threshold))

    def shown(name: str) -> Column:
        return F.when(below, F.lit(0).cast("long")).otherwise(F.col(name)).alias(name)

    return judged.select("source", *map(shown, ("n_callers", "n_entries", "n_tests", "n_untested")), F.when(below, "low").otherwise(F.lower("risk_level")).alias("risk_level"), "confidence")


def impact_of_known(symbols: DataFrame, edges: DataFrame, entries: DataFrame, targets: DataFrame, *, depth: int = 5, threshold: str = "low") -> DataFrame:
    """``gated`` impact of the targets that are symbols, with their kind and name; a depth outside 1 to 20 is an error."""
    if not 1 <= depth <= 20:
        raise ValueError("depth must be from 1 to 20")
    known = symbols.select("fqn", "kind", "name").join(cut_small(targets.select("fqn").distinct()), "fqn", "left_semi")
    found = gated(impact(symbols, edges, entries, known, depth=depth), threshold)
    return found.join(known.withColumnRenamed("fqn", "source"), "source")
