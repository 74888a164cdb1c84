"""Changes of tables as new frames: merges, appends, updates and deletes with their cascade."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.scratch import cut_small


def last_of_each(new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row for each key: the one with the greatest ``order``, of equal ones the greatest by all columns."""
    best = F.max(F.struct(F.col(order).alias("__order"), F.struct(*[F.col(c) for c in new.columns]).alias("row"))).alias("best")
    return new.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(best).select("best.row.*")


def merge(old: DataFrame, new: DataFrame, keys: Sequence[str], *, keep: Sequence[str] = (), order: str | None = None, stamp: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` merged in by ``keys``, in the columns of ``old``.

    Columns in ``keep`` hold their old value where the key is known; a column that ``new`` lacks does too, and is null
    in new rows.  Of rows in ``new`` with one key the last by ``order`` counts; without ``order`` the greatest by all
    columns.  ``stamp`` is set to now in rows that are changed.  A null is a key like any other.
    """
    columns = old.columns
    order = order or keys[0]
    once = last_of_each(new, keys, order)
    same = None
    for k in keys:
        test = F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
        same = test if same is None else same & test
    joined = old.withColumn("__old", F.lit(True)).alias("o").join(once.withColumn("__new", F.lit(True)).alias("n"), same, "full")
    is_old, is_new = F.col("__old").isNotNull(), F.col("__new").isNotNull()

    def value(name: str) -> Column:
        if name == stamp:
            return F.when(is_new, F.current_timestamp()).otherwise(F.col(f"o.{name}"))
        if name not in once.columns or name in keep and name not in keys:
            fresh = F.col(f"n.{name}") if name in once.columns else F.lit(None).cast(old.schema[name].dataType)
            return F.when(is_old, F.col(f"o.{name}")).otherwise(fresh)
        return F.when(is_new, F.col(f"n.{name}")).otherwise(F.col(f"o.{name}"))

    return joined.select([value(c).alias(c) for c in columns])


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` and all rows of ``new``, duplicates too; columns that ``new`` lacks are null."""
    return old.unionByName(new, allowMissingColumns=True).select(old.columns)


def upsert_symbols(old: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """Symbols by ``fqn``: ``created_at`` stays, ``updated_at`` is now."""
    return merge(old, new, ["fqn"], keep=("created_at",), order=order, stamp="updated_at" if "updated_at" in old.columns else None)


def upsert_entries(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entry points by symbol and type, as one method may have several."""
    return merge(old, new, ["symbol_fqn", "entry_type"])


def upsert_summaries(old: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """Summaries by target; a known one keeps its level and creation time."""
    return merge(old, new, ["target_fqn"], keep=("level", "created_at"), order=order)


def upsert_glossary(old: DataFrame, new: DataFrame) -> DataFrame:
    return merge(old, new, ["code_term"], keep=("created_at", "vector_id"))


def upsert_constraints(old: DataFrame, new: DataFrame) -> DataFrame:
    return merge(old, new, ["name"], keep=("created_at", "vector_id"))


def set_where(df: DataFrame, key: str, wanted: DataFrame, **values: Column) -> DataFrame:
    """``df`` with columns set in the rows whose ``key`` is in the one column of ``wanted``."""
    hits = wanted.select(F.col(wanted.columns[0]).alias("__key"), F.lit(True).alias("__hit")).distinct()
    marked = df.join(cut_small(hits), F.col(key) == F.col("__key"), "left")
    return marked.select(*[F.when(F.col("__hit"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def mark_stale(summaries: DataFrame, fqns: DataFrame) -> DataFrame:
    return set_where(summaries, "target_fqn", fqns, is_stale=F.lit(True))


def mark_stale_by_prefix(summaries: DataFrame, symbols: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """Summaries of symbols whose file is under one of the path prefixes are stale."""
    under = F.lit(False)
    for prefix in prefixes:
        under = under | F.col("file_path").startswith(prefix)
    return mark_stale(summaries, symbols.where(under).select("fqn"))


def set_vector_ids(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """``vector_id`` from ``ids`` (``key, vector_id``); a summary that gets one is no longer stale."""
    given = ids.groupBy(F.col(key).alias("__key")).agg(F.max("vector_id").alias("__id"))
    old = F.col("vector_id") if "vector_id" in df.columns else F.lit(None).cast(ids.schema["vector_id"].dataType)
    out = df.join(given, F.col(key) == F.col("__key"), "left").withColumn("vector_id", F.coalesce("__id", old))
    if "is_stale" in df.columns:
        out = out.withColumn("is_stale", F.when(F.col("__id").isNotNull(), False).otherwise(F.col("is_stale")))
    return out.drop("__key", "__id")


#: What becomes of the rows that point at a deleted symbol, by table and column.
CASCADE = {
    "edges": {"from_fqn": "delete", "to_fqn": "delete"},
    "entry_points": {"symbol_fqn": "delete"},
    "dependencies": {"caller_fqn": "delete"},
    "anti_patterns": {"from_fqn": "delete", "to_fqn": "null"},
    "summaries": {"target_fqn": "delete"},
    "glossary": {"source_fqn": "null"},
    "constraints": {"source_fqn": "null"},
}


def cascade_delete(frames: dict[str, DataFrame], fqns: DataFrame) -> dict[str, DataFrame]:
    """The tables without the symbols in ``fqns.fqn`` and without, or with nulls for, what points at them."""
    gone = cut_small(fqns.select("fqn").distinct())
    out = dict(frames)
    if "symbols" in frames:
        out["symbols"] = frames["symbols"].join(gone, "fqn", "left_anti")
    for name, rules in CASCADE.items():
        if name in frames:
            for column, rule in rules.items():
                if rule == "delete":
                    out[name] = out[name].join(gone.withColumnRenamed("fqn", column), column, "left_anti").select(frames[name].columns)
                else:
                    kind = frames[name].schema[column].dataType
                    out[name] = set_where(out[name], column, fqns.select("fqn"), **{column: F.lit(None).cast(kind)})
    return out


def delete_files(frames: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """``cascade_delete`` of all symbols of the files in ``paths.file_path``."""
    gone = frames["symbols"].join(paths.select("file_path").distinct(), "file_path", "left_semi").select("fqn")
    return cascade_delete(frames, gone)


def counts_of(frames: dict[str, DataFrame]) -> DataFrame:
    """``table_name, n`` of several tables, as it is taken before they are emptied."""
    out = None
    for name, df in frames.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def delete_keys(df: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """``df`` without the rows whose ``key`` is in the one column of ``gone``; vectors are deleted so."""
    return df.join(gone.select(F.col(gone.columns[0]).alias(key)).distinct(), key, "left_anti").select(df.columns)


def with_vectors(summaries: DataFrame, vectors: DataFrame, new: DataFrame, embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Summaries and vectors with new ones merged in, to be stored together.

    ``new`` has the columns of summaries by ``target_fqn``; ``embeddings`` (``target_fqn, embedding``) gives some of them a
    vector, whose ``id`` is the target and which ``vector_id`` then names.  New summaries without one keep the vector
    that they had only if their text is the old one.  An embedding without a new summary is left out.
    """
    given = embeddings.join(new.select("target_fqn").distinct(), "target_fqn", "left_semi")
    given = last_of_each(given, ["target_fqn"], "target_fqn")
    merged = upsert_summaries(summaries, new)
    old = summaries.groupBy(F.col("target_fqn").alias("__key")).agg(F.max("summary").alias("__was"))
    fresh = given.select(F.col("target_fqn").alias("__id")).distinct()
    joined = merged.join(old, F.col("target_fqn") == F.col("__key"), "left").join(fresh, F.col("target_fqn") == F.col("__id"), "left")
    kept = F.when(F.col("summary").eqNullSafe(F.col("__was")), F.col("vector_id"))
    out = joined.withColumn("vector_id", F.coalesce("__id", kept)).select(merged.columns)
    dropped = summaries.where("vector_id is not null").select("vector_id").join(out.select("vector_id"), "vector_id", "left_anti")
    left = delete_keys(vectors, "id", dropped.unionByName(given.select(F.col("target_fqn").alias("vector_id"))))
    return out, left.unionByName(given.select(F.col("target_fqn").alias("id"), F.col("embedding").cast(vectors.schema["embedding"].dataType).alias("embedding")), allowMissingColumns=True)


def without_summaries(summaries: DataFrame, vectors: DataFrame, fqns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Summaries and vectors without those of the symbols in ``fqns.fqn``."""
    wanted = fqns.select(F.col("fqn").alias("target_fqn")).distinct()
    gone = summaries.join(wanted, "target_fqn", "left_semi").where("vector_id is not null").select("vector_id")
    return summaries.join(wanted, "target_fqn", "left_anti").select(summaries.columns), delete_keys(vectors, "id", gone)


def put_metadata(metadata: DataFrame, new: DataFrame) -> DataFrame:
    """``key, value`` rows, those with a known key replaced."""
    return merge(metadata, new, ["key"])
