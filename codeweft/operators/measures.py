"""Counts, coverage, request metrics and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions.scalars import is_test_file
from codeweft.scratch import small

#: Edges of a partition in which callers are made distinct.
ROWS = 1_000_000


def coverage(symbols: DataFrame, edges: DataFrame, relation: str | None = None) -> DataFrame:
    """For every called symbol its distinct callers, those in test files, and their share in percent."""
    edges = edges if relation is None else edges.where(F.col("relation") == relation)
    pairs = edges.select(F.col("to_fqn").alias("target"), F.col("from_fqn").alias("fqn")).where("fqn is not null")
    known = symbols.select("fqn", is_test_file(F.col("file_path")).alias("test"))
    parts = max(edges.count() // ROWS + 1, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    callers = pairs.repartition(parts, "fqn").distinct().join(known.hint("shuffle_hash"), "fqn")  # one shuffle for both
    tested = F.sum(F.when(F.col("test"), 1).otherwise(0))
    out = callers.groupBy("target").agg(F.count("*").alias("total_callers"), tested.alias("tested_callers"))
    return out.withColumn("coverage_percentage", F.round(100.0 * F.col("tested_callers") / F.col("total_callers"), 2))


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def request_metrics(requests: DataFrame, *keys: str, last: int = 1000) -> DataFrame:
    """Count, mean and error rate over all requests; p95 and p99 over the last ``last`` by time.

    A percentile is element ``min(int(n * q), n - 1)`` of the sorted durations, counted from 0.
    """
    everything = requests.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("duration_ms").alias("mean_ms"), F.avg(F.when(F.col("status") >= 400, 1.0).otherwise(0.0)).alias("error_rate"))
    newest = Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("request_id"))
    recent = requests.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= last)
    sorted_ms = recent.groupBy(*keys).agg(F.sort_array(F.collect_list("duration_ms")).alias("d"))

    def at(q: float) -> Column:
        n = F.size("d")
        return F.element_at("d", F.least(F.floor(n * F.lit(q)), n - 1).cast("int") + 1)

    tails = sorted_ms.select(*keys, at(0.95).alias("p95_ms"), at(0.99).alias("p99_ms"))
    return everything.join(tails, list(keys))


def sliding_count(requests: DataFrame, seconds: int) -> DataFrame:
    """Requests of the same client in the ``seconds`` before each request, itself not counted."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    frame = Window.partitionBy("client").orderBy(micros).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return requests.select("request_id", "client", (F.count("*").over(frame) - 1).alias("n_before"))


def cost_rollup(usage: DataFrame, rates: DataFrame, default: float = 0.001) -> DataFrame:
    """Requests, tokens and cost for each model and, with a null model, in all; where it is known (``cached``) also how many
    requests were answered from a cache."""
    rated = usage.join(small(rates), "model", "left").withColumn("usd", F.col("tokens") / 1000 * F.coalesce("rate", F.lit(default)))
    cached = [F.count_if("cached").alias("n_cached")] if "cached" in usage.columns else []
    return rated.rollup("model").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.sum("usd").alias("usd"), *cached)


def usage_report(usage: DataFrame, rates: DataFrame, default: float = 0.001) -> DataFrame:
    """``model, line``: a line of text for all models (null) and for each."""
    rolled = cost_rollup(usage, rates, default)
    line = F.format_string("%s: %,d requests, %,d tokens, $%.4f", F.coalesce("model", F.lit("all")), "n", "tokens", F.round("usd", 4))
    return rolled.select("model", line.alias("line"))


def success_counts(results: DataFrame, ok: Column) -> DataFrame:
    """One row: how many results there are, how many failed, and how many didn't."""
    good = F.coalesce(ok, F.lit(False))
    return results.agg(F.count("*").alias("total"), F.count_if(~good).alias("failed"), F.count_if(good).alias("success"))


def job_metrics(jobs: DataFrame) -> DataFrame:
    """One row: jobs in all and by outcome."""
    return jobs.agg(F.count("*").alias("n_jobs"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("pending", "running", "complete", "failed")])
