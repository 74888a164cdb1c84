"""Exact deduplication by a persistent index of digests (operator 11).

The index is a table of every distinct text's SHA-256, bucketed and sorted by digest, with a partition for each
batch of documents.  A new batch is reduced to its distinct digests, these are held against the index by a
sort-merge anti-join, for which the index is read bucket by bucket without a shuffle, and what is new is appended
as the batch's partition.  All of it is DataFrame and SQL expressions.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.llm.frames import columns, cut, cut_counted, unused

#: Groups of more than one in so many rows are joined by broadcast; there are fewer of them than that.
HOT_GROUPS = 1000


@dataclass(frozen=True)
class Index:
    """An open index: the name of its table, ``digest, keep_id, batch``, in this session."""

    name: str


def open_index(spark: SparkSession, folder: str, *, buckets: int | None = None, id_type: str = "bigint") -> Index:
    """The index in ``folder``, which all machines must share; an empty one is made if there is none.

    A new index has ``buckets`` buckets, as many as the session's shuffle partitions unless given, as Spark then
    shuffles nothing but the new digests; an old one keeps its own, and its type of ids.
    """
    name = f"digests_{hashlib.md5(folder.encode()).hexdigest()}"
    place = folder.replace("\\", "\\\\").replace("'", "\\'")
    try:
        buckets, id_type = spark.read.parquet(f"{folder}/shape").first()
        old = True
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        buckets, old = buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), False
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id {id_type}, batch STRING) USING parquet "
        f"PARTITIONED BY (batch) CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{place}/entries'"
    )
    if old:
        spark.catalog.recoverPartitions(name)
    else:  # the shape is written last, so an index that has one has its folder too
        spark.sql(f"INSERT INTO {name} SELECT * FROM {name} WHERE false")
        spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit(id_type).alias("id_type")).write.mode("overwrite").parquet(f"{folder}/shape")
    return Index(name)


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, digest``: the SHA-256 of each whole text in UTF-8; null counts as empty."""
    return docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("digest"))


def add(index: Index, docs: DataFrame, batch: str) -> DataFrame:
    """Adds the texts of ``docs`` to the index and tells what became of each row, dropped or not.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256``.  Of a batch's equal texts the row with the largest
    ``doc_id`` stays, of several such rows one; a null id is smaller than all others.  None stays whose text is in the
    index from another batch; ``keep_id`` is then that batch's.  ``group_size`` counts the batch's rows with the
    text.  Null, empty and blank texts: null and empty are equal, blank ones only to themselves.  Texts of any length
    are hashed whole, other columns are ignored, an empty table gives no rows.

    A batch that is added again under its name, say after a lost driver, adds what its first attempt didn't and gives
    the same rows.
    """
    entries = docs.sparkSession.table(index.name)
    rows, total = cut_counted(digests(docs).withColumn("row", F.monotonically_increasing_id()))
    best = F.max(F.struct("doc_id", "row"))
    groups = cut(rows.groupBy("digest").agg(F.count("*").alias("group_size"), best.alias("best")))

    fresh = groups.join(entries.select("digest").hint("merge"), "digest", "left_anti")
    fresh.select("digest", F.col("best.doc_id").alias("keep_id"), F.lit(batch).alias("batch")).write.insertInto(index.name)

    known = groups.join(entries.hint("merge"), "digest")
    own = F.when(F.col("batch") == batch, F.col("best.row"))
    answers = cut(known.select("digest", "keep_id", "group_size", own.alias("keep_row")))
    # A group of very many copies would be one key of the last join, so such groups are sent to the rows instead.
    hot = F.col("group_size") * HOT_GROUPS > total
    many = F.broadcast(answers.where(hot))
    answered = rows.join(many, "digest").unionByName(rows.join(many.select("digest"), "digest", "left_anti").join(answers.where(~hot), "digest"))
    kept = F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False))
    return answered.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicated(index: Index, docs: DataFrame, batch: str) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns; of rows equal in text and ``doc_id`` the greatest by all
    columns that can be ordered.  Otherwise as ``add``."""
    digest, keep = unused(docs, "digest"), unused(docs, "keep_id")
    stay = add(index, docs, batch).where("kept").select(F.unhex("text_sha256").alias(digest), F.col("keep_id").alias(keep))
    whole = docs.withColumn(digest, F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)))
    same = whole.join(stay, digest).where(F.col("doc_id").eqNullSafe(F.col(keep)))
    ordered = [c for c, f in zip(columns(docs), docs.schema, strict=True) if not f.dataType.simpleString().startswith(("map", "variant"))]
    one = same.groupBy(digest).agg(F.max_by(F.struct(*columns(docs)), F.struct(*ordered)).alias("row"))
    return one.select("row.*")
