"""Rebuilding an index: whole, or from the files that changed, with the same tables as a result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.operators.graph import FEW_FQNS
from codeweft.plans.dependencies import detect_dependencies
from codeweft.plans.verify import verify
from codeweft.scratch import cut, cut_counted, cut_small, sized
from codeweft.sources.classes import entry_points, flatten_edges, flatten_symbols, outer_name
from codeweft.sources.versions import Versions, publish_checked

#: The extracted tables, with the column that says which symbol a row belongs to.
OWNED = {"edges": "from_fqn", "entry_points": "symbol_fqn", "dependencies": "caller_fqn"}


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``file_path, change``: what differs between two listings (``file_path`` and any columns that both have, such as
    time and size, or a digest): ``added``, ``changed`` or ``removed``.  Files that are alike are left out."""
    marks = [c for c in old.columns if c in new.columns and c != "file_path"]
    before, after = (df.select("file_path", F.struct(*marks, F.lit(1).alias("__there")).alias(name)) for df, name in ((old, "was"), (new, "now")))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    differs = ~F.col("was").eqNullSafe(F.col("now"))
    return before.join(after, "file_path", "full").where(differs).select("file_path", F.coalesce(change, F.lit("changed")).alias("change"))


def java_only(changed: DataFrame) -> DataFrame:
    return changed.where(F.col("file_path").endswith(".java"))


def extracted(classes: DataFrame, sources: DataFrame | None, carry: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The tables of nested classes; ``sources`` (``fqn, file_path``) gives their files, ``carry`` names columns to keep."""
    return {"symbols": flatten_symbols(classes, sources, carry), "edges": flatten_edges(classes, carry=carry), "entry_points": entry_points(classes, carry), "dependencies": detect_dependencies(classes, carry)}


def classes_of_files(classes: DataFrame, sources: DataFrame, paths: DataFrame) -> DataFrame:
    """The classes of the files in ``paths.file_path``, inner ones too."""
    wanted = sources.join(paths.select("file_path").distinct(), "file_path", "left_semi").select(F.col("fqn").alias("__outer")).distinct()
    return classes.withColumn("__outer", outer_name(F.col("fqn"))).join(wanted, "__outer", "left_semi").drop("__outer")


def incremental(tables: dict[str, DataFrame], changed: DataFrame, classes: DataFrame, sources: DataFrame) -> dict[str, DataFrame]:
    """``tables`` after the changes of files (``file_path, change``), as a rebuild of all ``classes`` would give them.

    Rows of changed and removed files go by the symbol that they belong to, and those of changed and added files are
    extracted anew; all other rows stay as they are and nothing is extracted for them.  An edge from an untouched file
    stays though its end may be gone, as it would in a rebuild.  Where there are ``summaries``, those of symbols that
    are gone go too, and those of changed files are marked stale; glossary and constraints keep their rows, and lose a
    source that is gone.
    """
    touched = cut(changed.where("change <> 'added'").select("file_path").distinct())
    old = cut(tables["symbols"].join(touched, "file_path", "left_semi").select("fqn").distinct())
    fresh = extracted(cut(classes_of_files(classes, sources, changed.where("change <> 'removed'"))), sources)
    out = dict(tables)
    out["symbols"] = tables["symbols"].join(touched, "file_path", "left_anti").select(tables["symbols"].columns).unionByName(fresh["symbols"].select(tables["symbols"].columns))
    for name, owner in OWNED.items():
        if name in tables:
            kept = tables[name].join(old.withColumnRenamed("fqn", owner), owner, "left_anti").select(tables[name].columns)
            out[name] = kept.unionByName(fresh[name].select(tables[name].columns))
    gone = cut(old.join(fresh["symbols"].select("fqn"), "fqn", "left_anti"))
    if "summaries" in tables:
        kept = tables["summaries"].join(gone.withColumnRenamed("fqn", "target_fqn"), "target_fqn", "left_anti")
        marked = kept.join(old.select(F.col("fqn").alias("target_fqn"), F.lit(True).alias("__old")), "target_fqn", "left")
        out["summaries"] = marked.withColumn("is_stale", F.col("is_stale") | F.col("__old").isNotNull()).select(tables["summaries"].columns)
    for name in ("glossary", "constraints"):
        if name in tables:
            lost = gone.select(F.col("fqn").alias("source_fqn"), F.lit(True).alias("__gone"))
            rows = tables[name].join(lost, "source_fqn", "left").withColumn("source_fqn", F.when(F.col("__gone").isNull(), F.col("source_fqn")))
            out[name] = rows.select(tables[name].columns)
    return out


def fit(tables: dict[str, DataFrame]) -> DataFrame:
    """One row of ``verify``: whether tables may replace an index; ends outside of it are no fault."""
    owned = {name: (tables[name], owner) for name, owner in OWNED.items() if name in tables and name != "edges"}
    return verify(tables["symbols"], tables["edges"], owned, strict=False)


def rebuild_full(versions: Versions, classes: DataFrame, sources: DataFrame, listing: DataFrame) -> dict:
    """Publishes the index of all classes with its listing of files; an unfit one is an error and leaves the old one."""
    tables = extracted(classes, sources) | {"files": listing}
    number = publish_checked(versions, tables, fit)
    return {"status": "success", "type": "full", "version": number}


def rebuild_incremental(versions: Versions, classes: DataFrame, sources: DataFrame, listing: DataFrame, *, force: bool = False) -> dict:
    """Publishes the index as the files that differ from its listing change it.

    Without changed Java files nothing is published unless ``force`` is set.  Tables beyond the extracted ones, such as
    summaries, are carried over.
    """
    number = versions.current()
    names = tuple(x for x in ("symbols", "edges", "entry_points", "dependencies", "summaries", "glossary", "constraints", "files") if x in versions.tables(number))
    tables = dict(zip(names, versions.read(*names, number=number), strict=True))
    found = cut(changes(tables.pop("files"), listing))
    n = java_only(found).count()
    if not n and not force:
        return {"status": "skipped", "reason": "no_changes" if found.isEmpty() else "no_java_files", "version": number}
    after = incremental(tables, java_only(found), classes, sources) | {"files": listing}
    return {"status": "success", "type": "incremental", "changed_files": n, "version": publish_checked(versions, after, fit, after=number)}


def clean_plan(frames: dict[str, DataFrame], rules: dict[str, dict[str, str]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """``frames`` without orphans, and the plan by which they lost them: ``step, table_name, column_name, rule, n_rows``.

    ``rules`` say for each table and column that points at symbols whether an orphan is deleted or its column set to
    null (see ``mutations.CASCADE``).  Deleting symbols makes new orphans, so steps are repeated until one finds none;
    the plan alone is a dry run, as no frame is written.  Only the first step looks for all symbols: after it a row is an
    orphan only if it points at a symbol that the step before deleted.
    """
    out, plan, step = dict(frames), None, 0
    gone = None
    known = out["symbols"].select("fqn").where("fqn is not null").distinct()
    while True:
        step += 1
        found = _lost(out, rules, known, gone)
        sums = found.groupBy("table_name", "column_name", "rule").agg(F.sum("n").alias("n_rows")).where("n_rows > 0")
        own = cut(sums.select(F.lit(step).alias("step"), "table_name", "column_name", "rule", "n_rows"))
        plan = own if plan is None else plan.unionByName(own)
        counts = own.collect()  # a row for each table and column
        if not counts:
            return out, plan
        before, values = out["symbols"], {}
        for name in {row["table_name"] for row in counts}:
            rows = out[name]
            for row in (r for r in counts if r["table_name"] == name):
                column = row["column_name"]
                lost = found.where((F.col("table_name") == name) & (F.col("column_name") == column)).select(F.col("fqn").alias("__lost"))
                lost, n = cut_counted(lost)
                lost = values[name, column] = sized(lost, n, FEW_FQNS)
                if row["rule"] == "delete":
                    rows = rows.join(lost, F.col(column) == F.col("__lost"), "left_anti")
                else:
                    marked = rows.join(lost, F.col(column) == F.col("__lost"), "left")
                    rows = marked.withColumn(column, F.when(F.col("__lost").isNull(), F.col(column))).drop("__lost")
            out[name] = cut(rows.select(out[name].columns))
        removed = [before.join(lost, F.col(column) == F.col("__lost"), "left_semi").select("fqn") for (name, column), lost in values.items() if name == "symbols" and rules[name][column] == "delete"]
        if not removed:
            return out, plan
        deleted = sized(*cut_counted(reduce(DataFrame.unionByName, removed).where("fqn is not null").distinct()), FEW_FQNS)
        left = cut_small(out["symbols"].select("fqn").join(deleted, "fqn", "left_semi").distinct())
        gone = sized(*cut_counted(deleted.join(left, "fqn", "left_anti")), FEW_FQNS)


def _lost(frames: dict[str, DataFrame], rules: dict[str, dict[str, str]], known: DataFrame, gone: DataFrame | None) -> DataFrame:
    """``table_name, column_name, rule, fqn, n``: what the tables' rows point at that is not among the ``known`` symbols or,
    if these are given, is among those that are ``gone``, with the rows that do."""
    parts = []
    for name, columns in rules.items():
        for column, rule in columns.items() if name in frames else ():
            ends = frames[name].select(F.col(column).alias("fqn")).where("fqn is not null")
            if gone is not None:
                lost = ends.join(gone, "fqn", "left_semi").groupBy("fqn").agg(F.count("*").alias("n"))
            else:
                lost = ends.groupBy("fqn").agg(F.count("*").alias("n")).join(known, "fqn", "left_anti")
            parts.append(lost.select(F.lit(name).alias("table_name"), F.lit(column).alias("column_name"), F.lit(rule).alias("rule"), "fqn", "n"))
    return cut(reduce(DataFrame.unionByName, parts))


def cleared(frames: dict[str, DataFrame], names: tuple[str, ...] = ("edges", "symbols", "metadata")) -> dict[str, DataFrame]:
    """``frames`` with some tables emptied."""
    return {name: df.limit(0) if name in names else df for name, df in frames.items()}
