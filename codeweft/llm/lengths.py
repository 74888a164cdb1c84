"""Exact token length histogram (operator 2)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.llm import kernels
from codeweft.llm.encoding import byte_encoding
from codeweft.llm.frames import cut

#: Lengths that share one block of the two-level suffix sums.
BLOCK = 1024


def histogram(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``length, n_docs``: how many texts encode to so many tokens; null and empty texts have length 0.

    ``tokenizer`` is a file of byte-level ranks.  Each task counts its own rows, so what is shuffled is one row for
    each length and task.  The histogram is written, so that no text is encoded again for each of its uses.  Texts of
    any length are encoded whole, repeated rows and equal lengths count as often as they occur, other columns are
    ignored, and an empty table gives an empty histogram.
    """

    @kernels.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_encoding(tokenizer).encode_ordinary
        counts: Counter[int] = Counter()
        for batch in batches:
            counts.update(len(encode(text.as_py() or "")) for text in batch.column(0))
        yield pa.record_batch([pa.array(counts.keys(), pa.int64()), pa.array(counts.values(), pa.int64())], names=["length", "n"])

    counted = docs.select("text").mapInArrow(run, "length long, n long")
    return cut(counted.groupBy("length").agg(F.sum("n").alias("n_docs")))


def answers(hist: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """For every length that occurs, and every one in ``limits.length``, as a context limit: totals, suffix sums,
    truncated totals and ranks.

    Suffix sums go in two levels, within blocks of ``BLOCK`` lengths and over the blocks' totals, so no task
    sorts the whole histogram.  ``truncated_tokens`` is the total when every document is cut to ``length``
    tokens; ``docs_up_to`` is the rank that answers quantiles.  An empty histogram without limits gives no rows.
    """
    if limits is not None:
        asked = limits.select(F.col("length").cast("long").alias("length"), F.lit(0).cast("long").alias("n_docs"))
        hist = hist.unionByName(asked).groupBy("length").agg(F.sum("n_docs").alias("n_docs"))
    own = hist.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"), F.floor(F.col("length") / BLOCK).alias("block"))
    blocks = own.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    beyond = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(later), zero).alias("later_docs"),
        F.coalesce(F.sum("t").over(later), zero).alias("later_tokens"),
        F.sum("d").over(everything).alias("total_docs"),
        F.sum("t").over(everything).alias("total_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    sums = own.withColumns({"docs_from": F.sum("n_docs").over(inside), "tokens_from": F.sum("n_tokens").over(inside)}).join(beyond, "block")
    docs_from, tokens_from = F.col("docs_from") + F.col("later_docs"), F.col("tokens_from") + F.col("later_tokens")
    return sums.select(
        "length",
        "n_docs",
        "n_tokens",
        docs_from.alias("docs_from"),
        tokens_from.alias("tokens_from"),
        (F.col("total_tokens") - tokens_from + F.col("length") * docs_from).alias("truncated_tokens"),
        (F.col("total_docs") - docs_from + F.col("n_docs")).alias("docs_up_to"),
        "total_docs",
        "total_tokens",
    )


def quantile(table: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least a share ``q`` of the documents don't exceed, as one row."""
    return table.where(F.col("docs_up_to") >= F.lit(q) * F.col("total_docs")).agg(F.min("length").alias("length"))
