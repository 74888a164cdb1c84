"""Queries over changes: rebuilds, modules, cleaning, pairs of tables, models' calls, and what is left of small functions."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.fixtures import frame, wired_classes
from codeweft.functions import descriptors, scalars
from codeweft.operators import jobs, mutations
from codeweft.plans import business, handlers, rebuild
from codeweft.queries import query, simple
from codeweft.scratch import cut, shared_folder
from codeweft.sources.modules import Modules, broken_rows, class_files, first_files, module_hashes, project_result
from codeweft.sources.versions import Versions

_K = "keys AS (SELECT CAST(c_custkey AS BIGINT) AS k FROM customer)"


def key_of(df: DataFrame, column: str = "fqn") -> DataFrame:
    """``df`` with the number of its class as ``k``."""
    return df.withColumn("k", F.regexp_extract(column, r"app[.](?:C|New)([0-9]+)", 1).cast("long"))


def sources_of(classes: DataFrame) -> DataFrame:
    return classes.select("fqn", F.concat(F.lit("src/main/java/"), F.replace("fqn", F.lit("."), F.lit("/")), F.lit(".java")).alias("file_path"))


def changed_classes(classes: DataFrame) -> DataFrame:
    """The fixture's classes after a change: every tenth is gone, the next of each ten is changed, and some are new."""
    rows = key_of(classes)
    none = {c: F.lit(None).cast(classes.schema[c].dataType) for c in ("inheritance", "fields", "methods")}
    new = rows.where("k % 10 = 2").withColumn("fqn", F.concat(F.lit("app.New"), F.col("k").cast("string"))).withColumns(none)
    other = F.array(F.struct(F.lit("app.Changed").alias("fqn"), F.lit("extends").alias("kind")))
    extra = F.array(F.struct(F.lit("extra").alias("name"), F.lit("int").alias("type"), F.array(F.lit("private")).alias("modifiers"), F.array().cast("array<string>").alias("annotations")))
    changed = F.col("k") % 10 == 1
    after = rows.where("k % 10 <> 0").withColumn("inheritance", F.when(changed, other).otherwise(F.col("inheritance"))).withColumn("fields", F.when(changed, F.concat("fields", extra)).otherwise(F.col("fields")))
    return after.unionByName(new).drop("k")


def _listing(classes: DataFrame, after: bool) -> DataFrame:
    """``file_path, size`` of the classes' files; a changed one has another size."""
    size = F.when((F.col("k") % 10 == 1) & F.lit(after) & F.col("fqn").startswith("app.C"), 2).otherwise(1)
    return key_of(classes).join(sources_of(classes), "fqn").select("file_path", size.alias("size"))


def _after_change(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The index of the fixture's classes, published, and then brought up to date from the changed files only."""
    before = wired_classes(spark, d)
    after = changed_classes(before)
    versions = Versions(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    rebuild.rebuild_full(versions, before, sources_of(before), _listing(before, False))
    done = rebuild.rebuild_incremental(versions, after, sources_of(after), _listing(after, True))
    if done["status"] != "success":
        raise RuntimeError(str(done))
    names = ("symbols", "edges", "entry_points", "dependencies")
    return dict(zip(names, versions.read(*names), strict=True))


_STATE = f"""WITH {_K},
kept AS (SELECT k, 'app.C' || k AS fqn, k % 10 = 1 AS changed FROM keys WHERE k % 10 <> 0),
members AS (SELECT k, fqn, changed, fqn || '.' || CASE WHEN k % 7 = 0 THEN 'c' || 4 * (k % 5 + 1) ELSE 'dep' END AS member, 'field' AS kind FROM kept UNION ALL SELECT k, fqn, changed, fqn || '.count', 'field' FROM kept UNION ALL SELECT k, fqn, changed, fqn || '.extra', 'field' FROM kept WHERE changed
  UNION ALL SELECT k, fqn, changed, fqn || m, 'method' FROM kept, (VALUES ('.<init>(..)'), ('.make(..)'), ('.execute(..)')) v(m))"""


@query("i13_incremental_symbols", f"{_STATE} SELECT fqn, 'class' AS kind, NULL AS parent_fqn, 'src/main/java/app/C' || k || '.java' AS file_path FROM kept UNION ALL SELECT 'app.New' || k, 'class', NULL, 'src/main/java/app/New' || k || '.java' FROM keys WHERE k % 10 = 2 UNION ALL SELECT member, kind, fqn, 'src/main/java/app/C' || k || '.java' FROM members")
def incremental_symbols(spark: SparkSession, d: str) -> DataFrame:
    """The symbols after an incremental rebuild; the SQL gives those of a full one."""
    return _after_change(spark, d)["symbols"].select("fqn", "kind", "parent_fqn", "file_path")


@query("i13_incremental_edges", f"{_STATE} SELECT fqn AS from_fqn, 'app.Changed' AS to_fqn, 'inherits' AS relation FROM kept WHERE changed UNION ALL SELECT fqn, 'app.C' || k // 3, 'inherits' FROM kept WHERE NOT changed AND k % 3 = 0 UNION ALL SELECT fqn, 'app.I' || k % 8 // 4, 'implements' FROM kept WHERE NOT changed AND k % 4 = 0 UNION ALL SELECT fqn, 'org.quartz.Job', 'implements' FROM kept WHERE NOT changed AND k % 11 = 0")
def incremental_edges(spark: SparkSession, d: str) -> DataFrame:
    return _after_change(spark, d)["edges"].select("from_fqn", "to_fqn", "relation")


@query("a20_changed_files", f"WITH {_K} SELECT 'src/main/java/app/C' || k || '.java' AS file_path, CASE k % 10 WHEN 0 THEN 'removed' ELSE 'changed' END AS change FROM keys WHERE k % 10 < 2 UNION ALL SELECT 'src/main/java/app/New' || k || '.java', 'added' FROM keys WHERE k % 10 = 2")
def changed_files(spark: SparkSession, d: str) -> DataFrame:
    before = wired_classes(spark, d)
    return rebuild.changes(_listing(before, False), _listing(changed_classes(before), True))


# Modules: the fixture's classes are dealt to 20 of them.
def in_modules(classes: DataFrame, broken: bool = False) -> DataFrame:
    rows = key_of(classes).withColumn("module", F.concat(F.lit("m"), (F.col("k") % 20).cast("string"))).withColumn("_broken", F.lit(None).cast("string"))
    if broken:
        rows = rows.withColumn("_broken", F.when(F.col("k") == 5, "{no")).withColumn("fqn", F.when(F.col("k") == 5, None).otherwise(F.col("fqn")))
    return rows.drop("k")


def module_files(classes: DataFrame, after: bool) -> DataFrame:
    """A file for each class; in the later listing those of two modules have another time, and one module is gone."""
    rows = key_of(classes).withColumn("m", F.col("k") % 20)
    moved = F.col("m").isin(3, 5) & F.lit(after)
    rows = rows.where(~(F.lit(after) & (F.col("m") == 7)))
    return rows.select(F.concat(F.lit("m"), F.col("m").cast("string")).alias("module"), F.concat("fqn", F.lit(".class")).alias("path"), (F.col("k") + F.when(moved, 1).otherwise(0)).alias("modified"), F.lit(100).alias("size"))


def _twice(spark: SparkSession, d: str) -> tuple[Modules, DataFrame]:
    """The modules after two extractions, the second of changed ones of which one is broken, and its report."""
    before = wired_classes(spark, d)
    modules = Modules(spark, f"{shared_folder(spark)}/modules-{uuid.uuid4().hex}")
    modules.extract(in_modules(before), sources_of(before), module_files(before, False))
    later = key_of(before).where("k % 20 <> 7").withColumn("fields", F.when(F.col("k") % 20 == 3, None).otherwise(F.col("fields"))).drop("k")
    return modules, modules.extract(in_modules(later, broken=True), sources_of(later), module_files(before, True))


@query("i9_module_report", f"WITH {_K}, own AS (SELECT k % 20 AS m, count(*) AS n, count(*) FILTER (k % 3 = 0) + count(*) FILTER (k % 4 = 0) + count(*) FILTER (k % 11 = 0) AS n_edges FROM keys GROUP BY 1) SELECT 'm' || m AS module, CASE m WHEN 3 THEN 'extracted' WHEN 5 THEN 'error' ELSE 'skipped' END AS status, CASE m WHEN 5 THEN 'no JSON: {{no' END AS error, CASE m WHEN 3 THEN 4 * n ELSE 0 END AS n_symbols, CASE m WHEN 3 THEN n_edges ELSE 0 END AS n_edges FROM own WHERE m <> 7")
def module_report(spark: SparkSession, d: str) -> DataFrame:
    return _twice(spark, d)[1].select("module", "status", "error", "n_symbols", "n_edges")


@query("i9_module_symbols", f"WITH {_K} SELECT 'm' || k % 20 AS module, CASE WHEN k % 20 = 3 THEN 4 ELSE 6 END * count(*) AS n_symbols FROM keys WHERE k % 20 <> 7 GROUP BY k % 20")
def module_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols by module after the second extraction: those of the broken module are as they were."""
    return _twice(spark, d)[0].read("symbols").groupBy("module").agg(F.count("*").alias("n_symbols"))


@query("i10_project", f"WITH {_K} SELECT false AS success, count(DISTINCT k % 20) AS modules, CAST(4 * count(*) FILTER (k % 20 = 3) AS BIGINT) AS total_symbols, 'm5: no JSON: {{no' AS errors FROM keys WHERE k % 20 <> 7")
def project(spark: SparkSession, d: str) -> DataFrame:
    out = project_result(_twice(spark, d)[1])
    return out.select("success", "modules", "total_symbols", F.array_join("errors", ";").alias("errors"))


@query("g34_module_hashes", f"WITH {_K}, own AS (SELECT 'm' || k % 20 AS module, 'app.C' || k || '.class' || chr(9) || k || chr(9) || 100 AS line, 'app.C' || k || '.class' AS path FROM keys) SELECT module, count(*) AS n_files, min(line) AS first_line FROM own GROUP BY module")
def hashes(spark: SparkSession, d: str) -> DataFrame:
    """Modules with their listing's size and first line, where their hash is one of a listing in another order too."""
    listing = module_files(wired_classes(spark, d), False)
    line = F.concat_ws("\t", "path", F.col("modified").cast("string"), F.col("size").cast("string"))
    counts = listing.groupBy("module").agg(F.count("*").alias("n_files"), F.min(line).alias("first_line"))
    once, again = module_hashes(listing), module_hashes(listing.repartition(7).select("size", "modified", "path", "module"))
    return counts.join(once.join(again, ["module", "hash"]).select("module"), "module", "left_semi")


def built_files(spark: SparkSession, d: str) -> DataFrame:
    """A listing of build folders: two of three files are compiled classes of a module."""
    key = F.col("c_custkey").cast("string")
    folder = F.when(F.col("c_custkey") % 3 == 0, "target/classes/").when(F.col("c_custkey") % 3 == 1, "build/classes/java/main/").otherwise("src/main/java/")
    path = F.concat(F.lit("/work/m"), (F.col("c_custkey") % 4).cast("string"), F.lit("/"), folder, F.lit("app/C"), key, F.when(F.col("c_custkey") % 3 == 2, ".java").otherwise(".class"))
    rows = spark.read.parquet(f"{d}/customer.parquet")
    return rows.select(path.alias("path"), F.col("c_custkey").cast("long").alias("modificationTime"), F.lit(10).cast("long").alias("length"))


_BUILT = f"WITH {_K}, files AS (SELECT 'm' || k % 4 AS module, '/work/m' || k % 4 || CASE k % 3 WHEN 0 THEN '/target/classes/' ELSE '/build/classes/java/main/' END || 'app/C' || k || '.class' AS path FROM keys WHERE k % 3 < 2)"


@query("a2_class_files", f"{_BUILT} SELECT module, path FROM files")
def class_files_found(spark: SparkSession, d: str) -> DataFrame:
    return class_files(built_files(spark, d)).select("module", "path")


@query("a3_first_files", f"{_BUILT} SELECT module, path FROM files QUALIFY row_number() OVER (PARTITION BY module ORDER BY path) <= 5")
def first_class_files(spark: SparkSession, d: str) -> DataFrame:
    return first_files(class_files(built_files(spark, d)), 5).select("module", "path")


@query("a9_broken_rows", f"WITH {_K} SELECT 'm' || k % 20 AS module, CASE k % 3 WHEN 0 THEN 'no JSON: <' || k || '>' ELSE 'a class without a name' END AS error FROM keys WHERE k % 3 < 2")
def file_errors(spark: SparkSession, d: str) -> DataFrame:
    """Every third line is no JSON, and every third has no name."""
    rows = key_of(in_modules(wired_classes(spark, d)))
    text = F.when(F.col("k") % 3 == 0, F.concat(F.lit("<"), F.col("k").cast("string"), F.lit(">")))
    return broken_rows(rows.withColumn("_broken", text).withColumn("fqn", F.when(F.col("k") % 3 == 2, F.col("fqn"))))


@query("i12_full_rebuild", f"WITH {_K} SELECT 'symbols' AS table_name, 6 * count(*) AS n FROM keys UNION ALL SELECT 'edges', count(*) FILTER (k % 3 = 0) + count(*) FILTER (k % 4 = 0) + count(*) FILTER (k % 11 = 0) FROM keys UNION ALL SELECT 'files', count(*) FROM keys")
def full_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """The tables of an index that was built, checked and published."""
    classes = wired_classes(spark, d)
    versions = Versions(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    rebuild.rebuild_full(versions, classes, sources_of(classes), _listing(classes, False))
    names = ("symbols", "edges", "files")
    return mutations.counts_of(dict(zip(names, versions.read(*names), strict=True)))


@query("a19_kept_versions", f"WITH {_K} SELECT k % 10 AS digit, count(*) AS n FROM keys WHERE k % 10 BETWEEN 3 AND 5 GROUP BY 1")
def kept_versions(spark: SparkSession, d: str) -> DataFrame:
    """Six versions of which two are kept before the newest; each holds the keys with its last digit."""
    keys = spark.read.parquet(f"{d}/customer.parquet").select((F.col("c_custkey") % 10).cast("long").alias("digit"))
    versions = Versions(spark, f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}")
    for digit in range(6):
        versions.publish({"keys": keys.where(F.col("digit") == digit)})
    versions.retain(2)
    out = None
    for number in versions.marks():
        (rows,) = versions.read("keys", number=number)
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("digit").agg(F.count("*").alias("n"))


@query("h20_taken_jobs", "WITH free AS (SELECT job_id, row_number() OVER (ORDER BY created_at, job_id) AS place FROM jobs WHERE status = 'pending') SELECT CASE WHEN place <= 2 THEN 'complete' WHEN place = 3 THEN 'failed' WHEN place = 4 THEN 'running' ELSE status END AS status, count(*) AS n FROM jobs LEFT JOIN free USING (job_id) GROUP BY 1")
def taken_jobs(spark: SparkSession, d: str) -> DataFrame:
    """The oldest pending jobs taken one after the other: two end well, one fails and one is still running."""
    own = jobs.Board(cut(frame(spark, d, "jobs")), f"{shared_folder(spark)}/board-{uuid.uuid4().hex}")
    oldest = [r["job_id"] for r in own.table.where("status = 'pending'").orderBy("created_at", "job_id").limit(3).collect()]
    for place, job_id in enumerate(oldest):
        try:
            with own.acquire(job_id):
                if place == 2:
                    raise ArithmeticError("no result")
        except ArithmeticError:
            pass
    own.take_next()
    return own.jobs().groupBy("status").agg(F.count("*").alias("n"))


_annotation = "CASE p_size % 7 WHEN 0 THEN '@Select' WHEN 1 THEN '@InsertProvider' WHEN 2 THEN '@Lcom/baomidou/mybatisplus/annotation/TableName;' WHEN 3 THEN '@GetMapping(\"/' || p_partkey || '\")' WHEN 4 THEN '@org.x.DeleteMapping' WHEN 5 THEN '@RequestMapping' ELSE '@Options' END"


@query("g46_mapper_operations", f"SELECT p_partkey, {_annotation} AS annotation, CASE p_size % 7 WHEN 0 THEN 'select' WHEN 1 THEN 'insert' WHEN 2 THEN 'mybatis_plus' WHEN 4 THEN 'delete' ELSE 'other' END AS operation, CASE p_size % 7 WHEN 3 THEN 'GET' WHEN 4 THEN 'DELETE' WHEN 5 THEN 'ALL' ELSE '' END AS http_method FROM part")
def mapper_operations(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.expr(_annotation).alias("annotation"))
    return rows.select("p_partkey", "annotation", handlers.mapper_operation(F.col("annotation")).alias("operation"), handlers.http_method(F.col("annotation")).alias("http_method"))


# Cleaning, clearing and storing.
RULES = mutations.CASCADE | {"symbols": {"parent_fqn": "delete"}}


def _frames(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {v: frame(spark, d, v) for v in ("symbols", "edges", "entry_points", "dependencies", "anti_patterns", "summaries", "constraints")} | {"glossary": frame(spark, d, "glossary_source")}


_CLEAN = """WITH known AS (SELECT fqn FROM symbols), lost AS (SELECT fqn FROM symbols WHERE parent_fqn IS NOT NULL AND parent_fqn NOT IN (SELECT fqn FROM known)),
later AS (SELECT fqn FROM known WHERE fqn NOT IN (SELECT fqn FROM lost)), sound AS (SELECT * FROM edges WHERE from_fqn IN (SELECT fqn FROM known) AND to_fqn IN (SELECT fqn FROM known)),
found AS (SELECT 1 AS step, 'symbols' AS table_name, 'parent_fqn' AS column_name, 'delete' AS rule, (SELECT count(*) FROM lost) AS n_rows
  UNION ALL SELECT 1, 'edges', 'from_fqn', 'delete', (SELECT count(*) FROM edges WHERE from_fqn NOT IN (SELECT fqn FROM known))
  UNION ALL SELECT 1, 'edges', 'to_fqn', 'delete', (SELECT count(*) FROM edges WHERE to_fqn NOT IN (SELECT fqn FROM known))
  UNION ALL SELECT 1, 'anti_patterns', 'from_fqn', 'delete', (SELECT count(*) FROM anti_patterns WHERE from_fqn NOT IN (SELECT fqn FROM known))
  UNION ALL SELECT 1, 'anti_patterns', 'to_fqn', 'null', (SELECT count(*) FROM anti_patterns WHERE to_fqn NOT IN (SELECT fqn FROM known))
  UNION ALL SELECT 2, 'edges', 'from_fqn', 'delete', (SELECT count(*) FROM sound WHERE from_fqn NOT IN (SELECT fqn FROM later))
  UNION ALL SELECT 2, 'edges', 'to_fqn', 'delete', (SELECT count(*) FROM sound WHERE to_fqn NOT IN (SELECT fqn FROM later))
  UNION ALL SELECT 2, 'symbols', 'parent_fqn', 'delete', (SELECT count(*) FROM symbols WHERE fqn IN (SELECT fqn FROM later) AND parent_fqn IN (SELECT fqn FROM lost)))"""


@query("h18_clean_plan", f"{_CLEAN} SELECT CAST(step AS INT) AS step, table_name, column_name, rule, n_rows FROM found WHERE n_rows > 0")
def clean_plan(spark: SparkSession, d: str) -> DataFrame:
    return rebuild.clean_plan(_frames(spark, d), RULES)[1]


@query("h18_cleaned", f"{_CLEAN} SELECT 'symbols' AS table_name, count(*) AS n FROM later UNION ALL SELECT 'edges', count(*) FROM sound WHERE from_fqn IN (SELECT fqn FROM later) AND to_fqn IN (SELECT fqn FROM later) UNION ALL SELECT 'anti_patterns', count(*) FROM anti_patterns WHERE from_fqn IN (SELECT fqn FROM later)")
def cleaned(spark: SparkSession, d: str) -> DataFrame:
    after = rebuild.clean_plan(_frames(spark, d), RULES)[0]
    return mutations.counts_of({name: after[name] for name in ("symbols", "edges", "anti_patterns")})


@query("h16_cleared", "SELECT 'edges' AS table_name, 0 AS n UNION ALL SELECT 'symbols', 0 UNION ALL SELECT 'summaries', count(*) FROM summaries")
def cleared(spark: SparkSession, d: str) -> DataFrame:
    return mutations.counts_of(rebuild.cleared({v: frame(spark, d, v) for v in ("edges", "symbols", "summaries")}))


@query("h14_put_metadata", "SELECT key, CASE WHEN CAST(value AS INT) < 2 THEN 'v' || value ELSE value END AS value FROM metadata UNION ALL SELECT 'new-' || key, value FROM metadata WHERE value = '4'")
def put_metadata(spark: SparkSession, d: str) -> DataFrame:
    old = frame(spark, d, "metadata")
    new = old.where("cast(value as int) < 2").withColumn("value", F.concat(F.lit("v"), "value"))
    return mutations.put_metadata(old, new.unionByName(old.where("value = '4'").withColumn("key", F.concat(F.lit("new-"), "key"))))


@query("h19_created_jobs", "SELECT status, count(*) AS n FROM (SELECT status FROM jobs UNION ALL SELECT 'pending' FROM jobs WHERE mode = 'full') GROUP BY status")
def created_jobs(spark: SparkSession, d: str) -> DataFrame:
    old = frame(spark, d, "jobs")
    return jobs.create(old, old.where("mode = 'full'").select(F.concat(F.lit("new-"), "job_id").alias("job_id"), "mode")).groupBy("status").agg(F.count("*").alias("n"))


_pair = "WITH own AS (SELECT target_fqn, summary, p_size, p_size % 3 = 0 AS is_new, p_size % 2 = 0 AS had, p_size % 6 = 0 AS embedded FROM summaries JOIN part_method ON fqn = target_fqn)"


def _stored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Summaries and vectors of a version into which new ones were written; every third is new, half of those have a vector."""
    rows = frame(spark, d, "part_method").select(F.col("fqn").alias("target_fqn"), F.col("p_name").alias("summary"), "p_size")
    had = F.when(F.col("p_size") % 2 == 0, F.col("target_fqn"))
    old = rows.select("target_fqn", F.lit("method").alias("level"), "summary", F.lit(False).alias("is_stale"), had.alias("vector_id"))
    vectors = rows.where("p_size % 2 = 0").select(F.col("target_fqn").alias("id"), F.array(F.lit(0.5)).alias("embedding"))
    new = rows.where("p_size % 3 = 0")
    said = new.select("target_fqn", F.lit("method").alias("level"), F.lit("again").alias("summary"), F.lit(False).alias("is_stale"))
    embeddings = new.where("p_size % 6 = 0").select("target_fqn", F.array(F.lit(1.0)).alias("embedding"))
    versions = Versions(spark, f"{shared_folder(spark)}/pair-{uuid.uuid4().hex}")
    versions.publish({"summaries": old, "vectors": vectors})
    versions.change(("summaries", "vectors"), lambda s, v: dict(zip(("summaries", "vectors"), mutations.with_vectors(s, v, said, embeddings), strict=True)))
    summaries, vectors = versions.read("summaries", "vectors")
    return summaries, vectors


@query("h21_stored_summaries", f"{_pair} SELECT target_fqn, CASE WHEN is_new THEN 'again' ELSE summary END AS summary, CASE WHEN embedded OR (had AND NOT is_new) THEN target_fqn END AS vector_id FROM own")
def stored_summaries(spark: SparkSession, d: str) -> DataFrame:
    return _stored(spark, d)[0].select("target_fqn", "summary", "vector_id")


@query("h21_stored_vectors", f"{_pair} SELECT target_fqn AS id, CASE WHEN embedded THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS first FROM own WHERE embedded OR (had AND NOT is_new)")
def stored_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _stored(spark, d)[1].select("id", F.col("embedding")[0].cast("double").alias("first"))


@query("h22_deleted_vectors", f"{_pair} SELECT target_fqn AS id FROM own WHERE (embedded OR (had AND NOT is_new)) AND p_size % 5 <> 0")
def deleted_vectors(spark: SparkSession, d: str) -> DataFrame:
    summaries, vectors = _stored(spark, d)
    gone = frame(spark, d, "part_method").where("p_size % 5 = 0").select("fqn")
    return mutations.without_summaries(summaries, vectors, gone)[1].select("id")


# Models' calls.
def unsure(texts: pd.Series) -> pd.Series:
    """A stand-in for a model that fails for some."""
    if texts.str.contains("11").any():
        raise ValueError("no answer")
    return "said " + texts


@query("j10_responses", "SELECT fqn, CASE WHEN contains(fqn, '11') THEN NULL ELSE 'said ' || fqn END AS answer, contains(fqn, '11') AS failed FROM part_method")
def model_responses(spark: SparkSession, d: str) -> DataFrame:
    rows = business.spread(frame(spark, d, "part_method").select("fqn"))
    said = rows.withColumn("said", business.responses(F.col("fqn"), unsure, business.Calls(together=20, threads=4)))
    return said.select("fqn", "said.answer", "said.failed")


@query("d23_call_counts", "SELECT count(*) AS total, count(*) FILTER (NOT contains(fqn, '11')) AS success, count(*) FILTER (contains(fqn, '11')) AS failed FROM part_method")
def call_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = business.spread(frame(spark, d, "part_method").select("fqn")).select(business.responses(F.col("fqn"), unsure, business.Calls(together=20, threads=4)).alias("said"))
    return business.call_counts(cut(rows)).select("total", "success", "failed")


def measured(texts: pd.Series) -> pd.Series:
    """A stand-in for an embedding model."""
    return texts.map(lambda t: [float(len(t)), float(t.count(" "))])


@query("j12_embedded", "SELECT fqn AS id, CAST(length(p_name) AS DOUBLE) AS first, CAST(length(p_name) - length(replace(p_name, ' ', '')) AS DOUBLE) AS second FROM part_method")
def embedded(spark: SparkSession, d: str) -> DataFrame:
    out = business.embedded(frame(spark, d, "part_method").select(F.col("fqn").alias("id"), F.col("p_name").alias("text")), measured, together=16)
    return out.select("id", F.col("embedding")[0].cast("double").alias("first"), F.col("embedding")[1].cast("double").alias("second"))


@query("j8_annotated_constraints", "SELECT 'validation' AS constraint_type, count(*) AS n FROM part_method WHERE p_size % 3 < 2 UNION ALL SELECT 'business_rule', count(*) FROM sources UNION ALL SELECT 'implicit', count(*) FROM part_method WHERE p_size % 10 = 0")
def annotated_constraints(spark: SparkSession, d: str) -> DataFrame:
    """Constraints of annotations, of assertions, and those that a model is taken to have found."""
    rows = frame(spark, d, "part_method").select("fqn", F.lit("method").alias("kind"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"), "p_size")
    marks = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("@Min(1)"), F.lit("@Deprecated"))).when(F.col("p_size") % 3 == 1, F.array(F.lit("@NotNull")))
    found = rows.where("p_size % 10 = 0").select("name", F.lit("found").alias("description"), F.col("fqn").alias("source_fqn"), F.lit("implicit").alias("constraint_type"))
    out = business.constraints(rows.withColumn("annotations", marks).drop("p_size"), frame(spark, d, "sources"), found)
    return out.groupBy("constraint_type").agg(F.count("*").alias("n"))


@query("g33_class_prompts", "SELECT c.fqn, 'class: ' || c.fqn || chr(10) || 'kind: class' || chr(10) || 'parts:' || chr(10) || string_agg('- ' || m.name, chr(10) ORDER BY m.name) AS prompt FROM symbols c JOIN symbols m ON m.parent_fqn = c.fqn AND m.kind = 'method' WHERE c.kind = 'class' AND c.fqn LIKE 'dao.%' GROUP BY c.fqn")
def class_prompts(spark: SparkSession, d: str) -> DataFrame:
    symbols = frame(spark, d, "symbols").where("fqn like 'dao.%'")
    inside = symbols.where("kind = 'method'").groupBy(F.col("parent_fqn").alias("fqn")).agg(F.sort_array(F.collect_list("name")).alias("names"))
    return symbols.where("kind = 'class'").join(inside, "fqn").select("fqn", scalars.level_prompt("class", F.col("fqn"), F.col("names"), kind=F.col("kind")).alias("prompt"))


# Small functions.
simple("g42_names", "symbols", lambda s: s.where("kind = 'class'").select("fqn", descriptors.internal(F.col("fqn")).alias("internal"), descriptors.dotted(descriptors.internal(F.col("fqn"))).alias("dotted"), descriptors.package_name(F.col("fqn")).alias("package")), "SELECT fqn, replace(fqn, '.', '/') AS internal, fqn AS dotted, regexp_extract(fqn, '^(.*)[.][^.]*$', 1) AS package FROM symbols WHERE kind = 'class'")
simple("g49_entry_fqns", "entry_points", lambda e: e.select("symbol_fqn", scalars.entry_fqn(F.when(F.col("entry_type") == "http_api", F.col("symbol_fqn")), F.when(F.col("entry_type") == "scheduled", F.lit("other"))).alias("fqn")), "SELECT symbol_fqn, CASE entry_type WHEN 'http_api' THEN symbol_fqn WHEN 'scheduled' THEN 'other' ELSE '' END AS fqn FROM entry_points")
simple("g52_job_paths", "jobs", lambda j: jobs.paths_of(j.select("job_id", F.when(F.col("progress") % 2 == 0, F.concat(F.lit("a/"), "job_id", F.lit(", b,,"))).alias("target_paths"))).select("job_id", F.array_join("target_paths", "|").alias("paths")), "SELECT job_id, CASE WHEN progress % 2 = 0 THEN 'a/' || job_id || '|b' ELSE '' END AS paths FROM jobs")


@query("g41_plain_types", f"WITH {_K} SELECT 'app.C' || k AS class_fqn, 'count' AS name, true AS plain FROM keys UNION ALL SELECT 'app.C' || k, CASE WHEN k % 7 = 0 THEN 'c' || 4 * (k % 5 + 1) ELSE 'dep' END, false FROM keys")
def plain_types(spark: SparkSession, d: str) -> DataFrame:
    rows = wired_classes(spark, d).select(F.col("fqn").alias("class_fqn"), F.explode("fields").alias("f"))
    return rows.select("class_fqn", "f.name", descriptors.is_plain(F.col("f.type")).alias("plain"))
