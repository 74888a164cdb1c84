"""A training corpus pipeline: quality, rules, near-duplicates, source mix, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.llm import mixing, near_dedup, packing, quality_rules, resampling
from codeweft.llm.frames import shared_folder, table
from codeweft.llm.queries import WORD_VOCABULARY
from codeweft.scratch import delete, tidied

#: Words in a block of the mix: long enough that most documents stay whole.
MIX_BLOCK_WORDS = 256


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose key reaches the sample's last; see ``resampling.resample``.  Null and empty texts weigh 0 and are
    judged like others, of tied keys such as those of repeated rows all stay or go, columns stay as they are, and an empty
    table stays empty."""
    weighed, least = resampling.resample(docs, table(spark, sf_dir, "labels"))
    return weighed.where(F.col("gumbel_key") >= least).select(docs.columns)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither fail a rule nor stand under a host that does; see ``quality_rules.judge``.  Null and empty
    texts fail, repeated rows are judged each, columns stay as they are, and an empty table stays empty."""
    return quality_rules.judge(docs).where("kept").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates; see ``near_dedup.one_of_each``.  Null texts stay, repeated rows are cut
    to one, rows that differ only in where a null stands are different, and an empty table stays empty."""
    return near_dedup.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of documents by their sources' targets; see ``mixing.mixed_documents``.  Documents without words go, a null
    source is one of its own, repeated rows take part each, and an empty table stays empty."""
    return mixing.mixed_documents(docs, block_words=MIX_BLOCK_WORDS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids; see ``packing.pack``.  Null and empty texts are the end id, repeated rows are packed
    each, and an empty table gives no rows."""
    return packing.pack(docs, WORD_VOCABULARY)


STAGES = [("quality classifier", quality), ("quality rules", rules), ("near-duplicates", near_duplicates), ("source mix", mix), ("packing", pack)]

#: No SQL expresses the importance weights, the signatures or the tokenizer; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of ``documents``.

    What a stage has read and cut is deleted once its result is written.
    """
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        with tidied(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        if number:
            delete(spark, f"{folder}/{number - 1}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
