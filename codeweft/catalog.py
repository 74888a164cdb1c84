"""All registered queries of the engine: those of ``queries`` and the ones below, each with DuckDB SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft import change_catalog, ingest_catalog  # noqa: F401  these register their queries
from codeweft.fixtures import frame, nested_classes
from codeweft.functions import scalars
from codeweft.operators import graph, jobs, lookup, measures, mutations, relations, search, testmap, vectors
from codeweft.plans import business, dependencies, rules, verify
from codeweft.plans.impact import gated, impact, tested_files
from codeweft.queries import QUERIES, SQL, SYMBOL, _IMPACT_TESTS, _nation, _symbol, _walk, query, simple
from codeweft.sources import classes

__all__ = ["QUERIES", "SQL"]

_BRAND = "dao.Brand_4Mapper"
_PART = "dao.Brand_4Mapper.p2()"
_BRAND_FILE = "src/main/java/dao/Brand_4Mapper.java"


def parts(spark: SparkSession, d: str, *views: str) -> list[DataFrame]:
    return [frame(spark, d, v) for v in views]


# Lookups and filters.
simple("a1_entry_points", "entry_points", lambda e: lookup.equal(e, entry_type="http_api"), "SELECT * FROM entry_points WHERE entry_type = 'http_api'")
simple("b8_anti_patterns", "anti_patterns", lambda a: lookup.equal(a, rule_id="circular-type", severity="warning"), "SELECT * FROM anti_patterns WHERE rule_id = 'circular-type' AND severity = 'warning'")
simple("b11_summaries_by_level", "summaries", lambda s: lookup.equal(s, level="method"), "SELECT * FROM summaries WHERE level = 'method'")
simple("b12_glossary_term", "glossary", lambda g: lookup.equal(g, code_term="STANDARD"), "SELECT * FROM glossary WHERE code_term = 'STANDARD'")
simple("b14_glossary_by_source", "glossary_source", lambda g: lookup.equal(g, source_fqn="dao.Brand_10Mapper"), "SELECT * FROM glossary_source WHERE source_fqn = 'dao.Brand_10Mapper'")
simple("b15_constraint", "constraints", lambda c: lookup.equal(c, name="F-1-URGENT"), "SELECT * FROM constraints WHERE name = 'F-1-URGENT'")
simple("b16_constraints_by_source", "constraints", lambda c: lookup.equal(c, source_fqn="svc.P2Service"), "SELECT * FROM constraints WHERE source_fqn = 'svc.P2Service'")
simple("b18_search_constraints", "constraints", lambda c: lookup.contains_any(c, "high", ["name", "source_fqn"], ["name"]), "SELECT * FROM constraints WHERE name ILIKE '%high%' OR source_fqn ILIKE '%high%' ORDER BY name LIMIT 100")
simple("b19_metadata", "metadata", lambda m: lookup.equal(m, key="ASIA"), "SELECT * FROM metadata WHERE key = 'ASIA'")
simple("b21_filtered_findings", "anti_patterns", lambda a: rules.filtered(a, "GEO.nation_1", "warning"), "SELECT * FROM anti_patterns WHERE lower(from_fqn) LIKE 'geo.nation\\_1%' ESCAPE '\\' AND severity = 'warning'")
simple("b25_glossary_page_total", "glossary", lambda g: search.page_with_total(g, "code_term", "S", 5, 1), "SELECT *, (SELECT count(*) FROM glossary WHERE starts_with(code_term, 'S')) AS total FROM glossary WHERE starts_with(code_term, 'S') ORDER BY code_term LIMIT 5 OFFSET 1")
simple("g50_entries_of_symbol", "entry_points", lambda e: lookup.equal(e, symbol_fqn="geo.NATION_10Controller.c4()"), "SELECT * FROM entry_points WHERE symbol_fqn = 'geo.NATION_10Controller.c4()'")
simple("f8_glossary_search", "glossary", lambda g: search.glossary_search(g, "S", 8), "WITH tagged AS (SELECT * FROM (SELECT *, 0 AS tag FROM glossary WHERE starts_with(code_term, 'S') ORDER BY code_term LIMIT 8) UNION ALL SELECT * FROM (SELECT *, 1 AS tag FROM glossary WHERE contains(lower(business_meaning), 's') ORDER BY code_term LIMIT 8)), once AS (SELECT * FROM tagged QUALIFY row_number() OVER (PARTITION BY code_term ORDER BY tag) = 1) SELECT * EXCLUDE (tag) FROM once ORDER BY tag, code_term LIMIT 8")

# Jobs and requests.
simple("f4_pending_job", "jobs", jobs.pending, "SELECT * FROM jobs WHERE status = 'pending' ORDER BY created_at, job_id LIMIT 1")
simple("f5_running_job", "jobs", jobs.running, "SELECT * FROM jobs WHERE status = 'running' ORDER BY job_id LIMIT 1")
simple("f6_newest_jobs", "jobs", lambda j: jobs.newest(j, "failed", 50), "SELECT * FROM jobs WHERE status = 'failed' ORDER BY created_at DESC, job_id LIMIT 50")
simple("f7_job", "jobs", lambda j: lookup.equal(j, job_id="job-7"), "SELECT * FROM jobs WHERE job_id = 'job-7'")
simple("h19_job_progress", "jobs", lambda j: jobs.advance(j, "job-7", status="running", progress=50).where("job_id in ('job-7', 'job-8')"), "SELECT job_id, mode, CASE WHEN job_id = 'job-7' THEN 'running' ELSE status END AS status, CAST(CASE WHEN job_id = 'job-7' THEN 50 ELSE progress END AS INT) AS progress, created_at FROM jobs WHERE job_id IN ('job-7', 'job-8')")
simple("d19_job_metrics", "jobs", measures.job_metrics, "SELECT count(*) AS n_jobs, count(*) FILTER (status = 'pending') AS n_pending, count(*) FILTER (status = 'running') AS n_running, count(*) FILTER (status = 'complete') AS n_complete, count(*) FILTER (status = 'failed') AS n_failed FROM jobs")
simple("d22_success_counts", "jobs", lambda j: measures.success_counts(j, F.col("status") != "failed"), "SELECT count(*) AS total, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status <> 'failed') AS success FROM jobs")
simple("d17_endpoint_metrics", "requests", lambda r: measures.request_metrics(r.withColumn("endpoint", F.concat(F.lit("GET "), "path")), "endpoint").select("endpoint", "n", "p95_ms", "p99_ms"), "WITH recent AS (SELECT 'GET ' || path AS endpoint, ts, request_id, duration_ms FROM requests QUALIFY row_number() OVER (PARTITION BY path ORDER BY ts DESC, request_id DESC) <= 1000), tails AS (SELECT endpoint, list_sort(list(duration_ms)) AS d FROM recent GROUP BY endpoint) SELECT endpoint, n, d[least(CAST(floor(len(d) * 0.95) AS INT), len(d) - 1) + 1] AS p95_ms, d[least(CAST(floor(len(d) * 0.99) AS INT), len(d) - 1) + 1] AS p99_ms FROM (SELECT 'GET ' || path AS endpoint, count(*) AS n FROM requests GROUP BY path) JOIN tails USING (endpoint)")
simple("s4_client_keys", "requests", lambda r: r.select("request_id", scalars.client_key(F.when(F.col("client") % 3 == 0, F.concat(F.lit(" 10.0.0."), F.col("client").cast("string"), F.lit(" , proxy"))), F.when(F.col("client") % 3 == 1, F.concat(F.lit("host"), F.col("client").cast("string")))).alias("client")), "SELECT request_id, CASE client % 3 WHEN 0 THEN '10.0.0.' || client WHEN 1 THEN 'host' || client ELSE 'localhost' END AS client FROM requests")

_RATES = [("click", 0.002), ("error", 0.03), ("view", 0.0005)]
_rated = "(SELECT model, tokens, tokens / 1000.0::DOUBLE * CASE model WHEN 'click' THEN 0.002::DOUBLE WHEN 'error' THEN 0.03::DOUBLE WHEN 'view' THEN 0.0005::DOUBLE ELSE 0.001::DOUBLE END AS usd FROM llm_usage)"


@query("d20_cost_rollup", f"SELECT model, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(usd), 6) AS usd FROM {_rated} GROUP BY ROLLUP (model)")
def cost_rollup(spark: SparkSession, d: str) -> DataFrame:
    rates = spark.createDataFrame(_RATES, "model string, rate double")
    return measures.cost_rollup(frame(spark, d, "llm_usage"), rates).withColumn("usd", F.round("usd", 6)).drop("n_cached")


@query("d20_cached_requests", "SELECT model, count(*) AS n, count(*) FILTER (cached) AS n_cached FROM llm_usage GROUP BY ROLLUP (model)")
def cached_requests(spark: SparkSession, d: str) -> DataFrame:
    rates = spark.createDataFrame(_RATES, "model string, rate double")
    return measures.cost_rollup(frame(spark, d, "llm_usage"), rates).select("model", "n", "n_cached")


@query("d21_usage_report", f"SELECT model, coalesce(model, 'all') || ': ' || format('{{:,}}', count(*)) || ' requests, ' || format('{{:,}}', CAST(sum(tokens) AS BIGINT)) || ' tokens, $' || printf('%.4f', round(sum(usd), 4)) AS line FROM {_rated} GROUP BY ROLLUP (model)")
def usage_report(spark: SparkSession, d: str) -> DataFrame:
    return measures.usage_report(frame(spark, d, "llm_usage"), spark.createDataFrame(_RATES, "model string, rate double"))


# Counts.
for _name, _view in (("d3_entry_count", "entry_points"), ("d4_dependency_count", "dependencies")):
    simple(_name, _view, lambda df: df.agg(F.count("*").alias("n")), f"SELECT count(*) AS n FROM {_view}")


@query("d5_layer_counts", " UNION ALL ".join(f"SELECT '{v}' AS table_name, count(*) AS n FROM {v}" for v in ("summaries", "glossary", "constraints")))
def layer_counts(spark: SparkSession, d: str) -> DataFrame:
    return mutations.counts_of({v: frame(spark, d, v) for v in ("summaries", "glossary", "constraints")})


@query("d25_counts_before_delete", " UNION ALL ".join(f"SELECT '{v}' AS table_name, count(*) AS n FROM {v}" for v in ("edges", "symbols", "metadata")))
def counts_before_delete(spark: SparkSession, d: str) -> DataFrame:
    return mutations.counts_of({v: frame(spark, d, v) for v in ("edges", "symbols", "metadata")})


@query("d6_vector_counts", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def vector_counts(spark: SparkSession, d: str) -> DataFrame:
    return measures.counts_by(spark.read.parquet(f"{d}/embeddings.parquet"), "label")


simple("d13_severity_tallies", "anti_patterns", rules.tallies, "SELECT count(*) AS n, count(*) FILTER (severity = 'error') AS n_error, count(*) FILTER (severity = 'warning') AS n_warning, count(*) FILTER (severity = 'info') AS n_info, count(*) FILTER (severity = 'error') > 0 AS failed FROM anti_patterns")
simple("f11_suggestions", "anti_patterns", rules.suggestions, "SELECT DISTINCT CASE WHEN rule_id LIKE '%dao%' THEN 'Consider introducing a Service layer between ' || from_fqn || ' and ' || to_fqn WHEN rule_id LIKE '%circular%' THEN 'Break circular dependency between ' || from_fqn || ' and ' || to_fqn || ' by introducing an interface' ELSE 'Add @Transactional annotation to ' || from_fqn END AS suggestion FROM anti_patterns")


@query("i1_findings", "SELECT 'controller-dao' AS rule_id, from_fqn, to_fqn, 'error' AS severity, 'controller calls data access without a service: ' || from_fqn || ' -> ' || to_fqn AS message FROM edges e WHERE relation = 'calls' AND from_fqn IN (SELECT m.fqn FROM symbols m JOIN symbols c ON m.parent_fqn = c.fqn WHERE m.kind = 'method' AND c.kind = 'class' AND (c.annotation LIKE '%Controller%' OR c.name LIKE '%Controller%')) AND (regexp_matches(regexp_extract(split_part(to_fqn, '(', 1), '([^.]*)[.][^.]*$', 1), '(Mapper|Dao|Repository)') OR EXISTS (SELECT 1 FROM symbols s WHERE s.kind = 'class' AND s.fqn = regexp_extract(split_part(e.to_fqn, '(', 1), '^(.*)[.]', 1) AND (s.annotation LIKE '%Repository%' OR s.annotation LIKE '%Mapper%'))) AND NOT starts_with(regexp_extract(split_part(to_fqn, '(', 1), '([^.]*)[.][^.]*$', 1), 'Base')")
def findings(spark: SparkSession, d: str) -> DataFrame:
    return rules.detect(*parts(spark, d, "symbols", "edges"), "controller-dao")


@query("i3_live_check", f"SELECT *, severity = 'error' AS blocking FROM anti_patterns WHERE from_fqn IN ('{_nation}', '{_PART}') OR to_fqn IN ('{_nation}', '{_PART}')")
def live_check(spark: SparkSession, d: str) -> DataFrame:
    return rules.check(frame(spark, d, "anti_patterns"), lookup.named(spark, _nation, _PART))


_HANDLERS = [("web", "Controller", 93), ("core", "Rest", 100), ("store", "Repository", 75), ("bean", "Service", 75)]


@query("m2_annotation_handlers", "SELECT fqn, annotation, CASE WHEN annotation LIKE '%Rest%' THEN 'core' WHEN annotation LIKE '%Controller%' THEN 'web' WHEN annotation LIKE '%Service%' THEN 'bean' WHEN annotation LIKE '%Repository%' THEN 'store' END AS handler FROM symbols WHERE annotation IS NOT NULL")
def annotation_handlers(spark: SparkSession, d: str) -> DataFrame:
    rows = frame(spark, d, "symbols").select("fqn", F.explode("annotations").alias("annotation"))
    return rows.withColumn("handler", rules.handler_of(F.col("annotation"), _HANDLERS))


# Joins.
@query("c5_symbols_of", f"SELECT {_symbol} FROM symbols WHERE fqn IN (SELECT target_fqn FROM summaries WHERE is_stale)")
def symbols_of(spark: SparkSession, d: str) -> DataFrame:
    wanted = frame(spark, d, "summaries").where("is_stale").select(F.col("target_fqn").alias("fqn"))
    return frame(spark, d, "symbols").join(wanted, "fqn", "left_semi").select(SYMBOL)


@query("c6_attached", "SELECT s.fqn, s.kind, s.name, m.summary, (SELECT count(*) FROM entry_points e WHERE e.symbol_fqn = s.fqn) AS n_entries FROM symbols s LEFT JOIN summaries m ON m.target_fqn = s.fqn WHERE s.name LIKE '%1%'")
def attached(spark: SparkSession, d: str) -> DataFrame:
    symbols, summaries, entries = parts(spark, d, "symbols", "summaries", "entry_points")
    out = search.attached(symbols.where("name like '%1%'").select("fqn"), symbols, summaries, entries)
    return out.select("fqn", "kind", "name", "summary", F.size("entry_points").cast("long").alias("n_entries"))


@query("c13_parents", "SELECT fqn, parent_fqn FROM symbols WHERE file_path LIKE '%Brand_1%' AND parent_fqn IS NOT NULL")
def parents_of(spark: SparkSession, d: str) -> DataFrame:
    symbols = frame(spark, d, "symbols")
    return graph.parents(symbols, symbols.where("file_path like '%Brand_1%'"))


@query("c15_callers", f"SELECT DISTINCT to_fqn AS fqn, from_fqn AS other FROM edges WHERE relation = 'calls' AND to_fqn IN (SELECT fqn FROM symbols WHERE parent_fqn = '{_BRAND}')")
def callers_of(spark: SparkSession, d: str) -> DataFrame:
    return relations.one_hop(frame(spark, d, "edges"), frame(spark, d, "symbols").where(F.col("parent_fqn") == _BRAND))


@query("c15_callees", f"SELECT DISTINCT from_fqn AS fqn, to_fqn AS other FROM edges WHERE relation = 'calls' AND from_fqn IN (SELECT fqn FROM symbols WHERE parent_fqn = '{_BRAND}')")
def callees_of(spark: SparkSession, d: str) -> DataFrame:
    return relations.one_hop(frame(spark, d, "edges"), frame(spark, d, "symbols").where(F.col("parent_fqn") == _BRAND), "callees")


@query("c17_members", "SELECT c.fqn, count(m.fqn) AS n_methods, min(m.name) AS first_method FROM symbols c LEFT JOIN symbols m ON m.parent_fqn = c.fqn AND m.kind = 'method' WHERE c.kind = 'class' GROUP BY c.fqn")
def members(spark: SparkSession, d: str) -> DataFrame:
    return relations.member_counts(frame(spark, d, "symbols")).drop("n_fields")


@query("c18_by_prefix", "SELECT DISTINCT c.fqn, s.target_fqn FROM symbols c JOIN summaries s ON starts_with(s.target_fqn, c.fqn) WHERE c.kind = 'class' AND s.target_fqn <> c.fqn")
def by_prefix(spark: SparkSession, d: str) -> DataFrame:
    return business.by_prefix(frame(spark, d, "symbols").where("kind = 'class'"), frame(spark, d, "summaries"))


# Traversal.
_C1 = "(SELECT fqn FROM customer_method WHERE c_custkey = 1)"


def first_customer(spark: SparkSession, d: str) -> str:
    return frame(spark, d, "customer_method").where("c_custkey = 1").first()["fqn"]


def _inner(sql: str) -> str:
    """A recursive query as a part of another one."""
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _around(reverse: bool) -> str:
    name = "incoming" if reverse else "outgoing"
    return f"SELECT '{name}' AS direction, depth, from_fqn, to_fqn, 'calls' AS relation FROM ({_inner(_walk(repr(_PART), 2, reverse))}) ORDER BY depth, from_fqn, to_fqn LIMIT 40"


for _name, _direction in (("e4_outgoing", "outgoing"), ("e5_incoming", "incoming"), ("e6_both", "both")):
    _sql = " UNION ALL ".join(f"SELECT * FROM ({_around(r)})" for r, n in ((False, "outgoing"), (True, "incoming")) if _direction in (n, "both"))
    query(f"{_name}_edges", _sql, recursive=True)(lambda spark, d, way=_direction: graph.neighbourhood(*parts(spark, d, "edges", "symbols"), _PART, direction=way, depth=2, limit=20)[1])

_around_ends = f"(SELECT from_fqn AS fqn FROM ({_around(False)}) UNION SELECT to_fqn FROM ({_around(False)}) UNION SELECT from_fqn FROM ({_around(True)}) UNION SELECT to_fqn FROM ({_around(True)}) UNION SELECT '{_PART}')"


@query("e6_nodes", f"SELECT fqn, kind, name, CASE WHEN annotation LIKE '%Controller%' THEN 'controller' WHEN annotation LIKE '%Service%' THEN 'service' WHEN annotation LIKE '%Repository%' THEN 'repository' WHEN kind = 'class' THEN 'domain' END AS layer, file_path FROM symbols WHERE fqn IN {_around_ends} ORDER BY fqn LIMIT 20", recursive=True)
def around_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbourhood(*parts(spark, d, "edges", "symbols"), _PART, depth=2, limit=20)[0]


@query("e6_totals", f"SELECT CAST(2 AS INT) AS max_depth, (SELECT count(*) FROM symbols WHERE fqn IN {_around_ends}) AS total_nodes, (SELECT count(*) FROM ({_around(False)})) + (SELECT count(*) FROM ({_around(True)})) AS total_edges, (SELECT count(*) FROM symbols WHERE fqn IN {_around_ends}) > 20 AS truncated", recursive=True)
def around_totals(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbourhood(*parts(spark, d, "edges", "symbols"), _PART, depth=2, limit=20)[2]


_layer = "CASE WHEN annotation LIKE '%Controller%' THEN 'controller' WHEN annotation LIKE '%Service%' THEN 'service' WHEN annotation LIKE '%Repository%' OR annotation LIKE '%Mapper%' THEN 'repository' WHEN name LIKE '%Controller%' THEN 'controller' WHEN name LIKE '%Service%' THEN 'service' WHEN name LIKE '%Mapper%' OR name LIKE '%Dao%' OR name LIKE '%Repository%' THEN 'repository' WHEN to_fqn LIKE '%Controller%' THEN 'controller' WHEN to_fqn LIKE '%Service%' THEN 'service' WHEN to_fqn LIKE '%Mapper%' OR to_fqn LIKE '%Dao%' OR to_fqn LIKE '%Repository%' THEN 'repository' ELSE 'unknown' END"
_entry = "(SELECT symbol_fqn FROM entry_points WHERE http_path IS NOT NULL ORDER BY symbol_fqn LIMIT 1)"


@query("e7_trace_entry", f"SELECT source, depth, from_fqn, to_fqn, {_layer} AS layer FROM ({_inner(_walk(_entry, 10, False))}) LEFT JOIN symbols s ON s.fqn = to_fqn", recursive=True)
def trace_entry(spark: SparkSession, d: str) -> DataFrame:
    entries = frame(spark, d, "entry_points")
    path = entries.where("http_path is not null").orderBy("symbol_fqn").first()["http_path"]
    return graph.trace_entry(*parts(spark, d, "symbols", "edges", "dependencies"), entries, path)[0]


@query("e8_trace", f"SELECT source, depth, from_fqn, to_fqn, {_layer} AS layer FROM ({_inner(_walk(_C1, 10, False))}) LEFT JOIN symbols s ON s.fqn = to_fqn", recursive=True)
def trace(spark: SparkSession, d: str) -> DataFrame:
    return graph.trace(*parts(spark, d, "symbols", "edges", "dependencies"), first_customer(spark, d))[0]


@query("c11_chain_dependencies", f"WITH chain AS ({_inner(_walk(_C1, 10, False))}), ends AS (SELECT from_fqn AS fqn FROM chain UNION SELECT to_fqn FROM chain) SELECT caller_fqn, dependency_type, target, strength FROM dependencies WHERE caller_fqn IN (SELECT fqn FROM ends) QUALIFY row_number() OVER (PARTITION BY target ORDER BY caller_fqn, dependency_type, strength) = 1", recursive=True)
def chain_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return graph.trace(*parts(spark, d, "symbols", "edges", "dependencies"), first_customer(spark, d))[1]


@query("d10_max_depth", f"SELECT coalesce(max(depth), 0) AS depth FROM ({_inner(_walk(_C1, 10, False))})", recursive=True)
def max_depth(spark: SparkSession, d: str) -> DataFrame:
    return graph.trace(*parts(spark, d, "symbols", "edges", "dependencies"), first_customer(spark, d))[2]


@query("g54_rendered_trace", f"SELECT depth, from_fqn, to_fqn, repeat('  ', depth) || '-> ' || to_fqn || ' [' || {_layer} || ']' AS line FROM ({_inner(_walk(_C1, 10, False))}) LEFT JOIN symbols s ON s.fqn = to_fqn", recursive=True)
def rendered(spark: SparkSession, d: str) -> DataFrame:
    return graph.rendered(trace(spark, d))


@query("d26_affected_total", f"SELECT count(*) AS n FROM (SELECT fqn FROM symbols WHERE parent_fqn = '{_BRAND}' UNION SELECT from_fqn FROM edges WHERE relation = 'calls' AND to_fqn IN (SELECT fqn FROM symbols WHERE parent_fqn = '{_BRAND}') UNION SELECT '{_BRAND}')")
def affected_total(spark: SparkSession, d: str) -> DataFrame:
    symbols, edges = parts(spark, d, "symbols", "edges")
    return graph.affected(symbols, edges, symbols.where(F.col("parent_fqn") == _BRAND)).agg(F.count("*").alias("n"))


@query("i7_gated_impact", f"SELECT source, CASE WHEN ok THEN n_callers ELSE 0 END AS n_callers, CASE WHEN ok THEN n_entries ELSE 0 END AS n_entries, CASE WHEN ok THEN n_tests ELSE 0 END AS n_tests, CASE WHEN ok THEN n_untested ELSE 0 END AS n_untested, CASE WHEN ok THEN lower(risk_level) ELSE 'low' END AS risk_level, confidence FROM (SELECT *, risk_level IN ('HIGH', 'CRITICAL') AS ok FROM ({_inner(_IMPACT_TESTS)}))", recursive=True)
def gated_impact(spark: SparkSession, d: str) -> DataFrame:
    out = impact(*parts(spark, d, "symbols", "edges", "entry_points"), frame(spark, d, "part_method").select("fqn"))
    return gated(out, "high").withColumn("confidence", F.round("confidence", 6))


# Tests of files.
_tests_sql = "SELECT s.fqn, CAST(t.place AS INT) AS place, regexp_replace(replace(s.file_path, '/main/java/', '/test/java/'), '\\.java$', '') || t.suffix || '.java' AS test_file FROM symbols s, (VALUES (0, 'Test'), (1, 'Tests'), (2, 'IT')) t(place, suffix) WHERE contains(s.file_path, '/main/java/')"


@query("g8_test_mapping", f"SELECT fqn, place, test_file, regexp_extract(test_file, '([^/]*)$', 1) AS test_pattern, test_file IN (SELECT path FROM java_files) AS test_exists FROM ({_tests_sql})")
def test_mapping(spark: SparkSession, d: str) -> DataFrame:
    return testmap.mapping(*parts(spark, d, "symbols", "java_files")).drop("methods")


@query("d9_mapping_summary", f"WITH asked AS (SELECT DISTINCT parent_fqn AS fqn FROM symbols WHERE parent_fqn IS NOT NULL) SELECT count(*) AS total, count(file_path) AS found, count(*) FILTER (fqn IN (SELECT fqn FROM ({_tests_sql}) WHERE test_file IN (SELECT path FROM java_files))) AS with_tests FROM asked LEFT JOIN symbols USING (fqn)")
def mapping_summary(spark: SparkSession, d: str) -> DataFrame:
    symbols, files = parts(spark, d, "symbols", "java_files")
    return testmap.mapping_summary(symbols.where("parent_fqn is not null").select(F.col("parent_fqn").alias("fqn")), symbols, files)


simple("g9_test_methods", "test_sources", lambda t: t.select("p_partkey", F.array_join(scalars.test_methods(F.col("content")), ",").alias("methods")), "SELECT p_partkey, array_to_string(['checks' || p_partkey, 'testTwice', 'testSize' || p_size], ',') AS methods FROM part")
simple("g7_sibling_paths", "java_files", lambda f: f.select("path", F.explode(scalars.sibling_test_paths(F.col("path"), F.lit(True))).alias("test_path")), "SELECT path, CASE WHEN contains(path, '/main/java/') THEN regexp_replace(replace(path, '/main/java/', '/test/java/'), '\\.java$', '') ELSE regexp_extract(path, '^(.*)/[^/]+/[^/]+$', 1) || '/test/' || regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.java$', '') END || suffix || '.java' AS test_path FROM java_files, (VALUES ('Test'), ('Tests'), ('IT'), ('')) t(suffix)")

_found_tests = "WITH own AS (SELECT file_path, count(DISTINCT fqn) AS n_covered FROM symbols WHERE contains(file_path, '/main/java/') GROUP BY file_path), sought AS (SELECT o.*, place, regexp_replace(replace(file_path, '/main/java/', '/test/java/'), '\\.java$', '') || suffix || '.java' AS path FROM own o, (VALUES (0, 'Test'), (1, 'Tests'), (2, 'IT'), (3, '')) t(place, suffix)) SELECT file_path, arg_min(path, place) AS path, any_value(n_covered) AS n_covered, count(DISTINCT path) - 1 AS n_more FROM sought WHERE path IN (SELECT path FROM java_files) GROUP BY file_path"


@query("g10_tests_of_files", _found_tests)
def tests_of_files(spark: SparkSession, d: str) -> DataFrame:
    some = frame(spark, d, "symbols").where("file_path like '%/main/java/%'")
    return testmap.covered_counts(some, testmap.found_tests(some, frame(spark, d, "java_files")))


@query("g11_related_tests", "WITH callers AS (SELECT DISTINCT s.fqn, s.file_path FROM symbols s JOIN edges e ON e.from_fqn = s.fqn WHERE e.relation = 'calls' AND e.to_fqn LIKE 'dao.%' AND contains(s.file_path, '/main/java/')), own AS (SELECT file_path, count(*) AS n_covered FROM callers GROUP BY file_path), sought AS (SELECT o.*, place, regexp_replace(replace(file_path, '/main/java/', '/test/java/'), '\\.java$', '') || suffix || '.java' AS path FROM own o, (VALUES (0, 'Test'), (1, 'Tests'), (2, 'IT'), (3, '')) t(place, suffix)) SELECT file_path, arg_min(path, place) AS path, any_value(n_covered) AS n_covered FROM sought WHERE path IN (SELECT path FROM java_files) GROUP BY file_path")
def related_tests(spark: SparkSession, d: str) -> DataFrame:
    """The first test of each file that has callers of parts, with the callers that it covers."""
    symbols, edges = parts(spark, d, "symbols", "edges")
    called = symbols.where("fqn like 'dao.%'").select("fqn")
    callers = relations.one_hop(edges, called).select(F.col("other").alias("fqn")).distinct()
    some = symbols.where("file_path like '%/main/java/%'").join(callers, "fqn", "left_semi")
    return testmap.covered_counts(some, testmap.found_tests(some, frame(spark, d, "java_files"))).drop("n_more")


@query("f12_missing_coverage", f"SELECT DISTINCT fqn FROM symbols WHERE contains(file_path, '/main/java/') AND file_path NOT IN (SELECT file_path FROM ({_found_tests}))")
def missing_coverage(spark: SparkSession, d: str) -> DataFrame:
    some = frame(spark, d, "symbols").where("file_path like '%/main/java/%'")
    return testmap.uncovered(some, testmap.found_tests(some, frame(spark, d, "java_files")))


@query("g12_tests_of_package", "SELECT DISTINCT path, 'geo.' AS source_package FROM java_files WHERE path IN (SELECT regexp_replace(replace(file_path, '/main/java/', '/test/java/'), '\\.java$', '') || suffix || '.java' FROM symbols, (VALUES ('Test'), ('Tests'), ('IT'), ('')) t(suffix) WHERE starts_with(fqn, 'geo.') AND file_path IS NOT NULL)")
def tests_of_package(spark: SparkSession, d: str) -> DataFrame:
    return testmap.tests_of_package(*parts(spark, d, "symbols", "java_files"), "geo.")


_covered = "WITH asked AS (SELECT fqn FROM part_method UNION SELECT 'no.such()'), callers AS (SELECT DISTINCT to_fqn AS target, from_fqn AS fqn FROM edges), counts AS (SELECT target AS fqn, count(*) AS total, count(*) FILTER (contains(lower(coalesce(file_path, '')), '/test/') OR regexp_matches(coalesce(file_path, ''), '(^|/)Test[^/]*$') OR regexp_matches(coalesce(file_path, ''), '(Test|Tests|IT)\\.java$')) AS tested FROM callers JOIN symbols USING (fqn) GROUP BY target), own AS (SELECT fqn, coalesce(total, 0) AS total_callers, coalesce(tested, 0) AS tested_callers, CASE WHEN total > 0 THEN round(100.0::DOUBLE * tested / total, 2) ELSE 0.0 END AS coverage_percentage, coalesce(total, 0) - coalesce(tested, 0) AS warnings FROM asked LEFT JOIN counts USING (fqn))"


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "part_method").select("fqn").unionByName(lookup.named(spark, "no.such()"))


@query("d7_coverage_of", f"{_covered} SELECT * FROM own")
def coverage_of(spark: SparkSession, d: str) -> DataFrame:
    return testmap.coverage_of(_asked(spark, d), *parts(spark, d, "symbols", "edges"))


@query("d8_coverage_batch", f"{_covered} SELECT count(*) AS total, round(avg(coverage_percentage), 6) AS average_coverage, CAST(sum(warnings) AS BIGINT) AS total_warnings FROM own")
def coverage_batch(spark: SparkSession, d: str) -> DataFrame:
    return testmap.coverage_batch(_asked(spark, d), *parts(spark, d, "symbols", "edges")).withColumn("average_coverage", F.round("average_coverage", 6))


# Scalar functions.
simple("f13_by_layer", "symbols", lambda s: s.where("kind = 'class'").select("fqn", scalars.layer_priority(scalars.layer(F.col("kind"), F.col("annotations"))).alias("priority")), "SELECT fqn, CAST(CASE WHEN annotation LIKE '%Controller%' THEN 0 WHEN annotation LIKE '%Service%' THEN 1 WHEN annotation LIKE '%Repository%' THEN 2 ELSE 3 END AS INT) AS priority FROM symbols WHERE kind = 'class'")
simple("g4_controllers", "symbols", lambda s: s.where(scalars.layer(F.col("kind"), F.col("annotations")) == "controller").select("fqn"), "SELECT fqn FROM symbols WHERE annotation LIKE '%Controller%'")
simple("g13_http_paths", "entry_points", lambda e: e.select("symbol_fqn", scalars.http_path(F.lit("/seg/"), F.col("http_path")).alias("a"), scalars.http_path(F.lit("/api/"), F.col("http_path")).alias("b")), "SELECT symbol_fqn, CASE WHEN http_path IS NULL THEN '/seg/' ELSE http_path END AS a, CASE WHEN http_path IS NULL THEN '/api/' ELSE '/api/' || ltrim(http_path, '/') END AS b FROM entry_points")
simple("g14_api_paths", "entry_points", lambda e: e.select("symbol_fqn", scalars.api_path(F.concat(F.lit("x//"), "http_path")).alias("path")), "SELECT symbol_fqn, CASE WHEN http_path IS NULL THEN '/' ELSE regexp_replace('/x//' || http_path, '/+', '/', 'g') END AS path FROM entry_points")
simple("g15_like_literals", "part_method", lambda p: p.select("fqn", scalars.like_literal(F.concat("p_brand", F.lit("_100%\\"))).alias("pattern")), "SELECT fqn, replace(replace(replace(p_brand || '_100%\\', '\\', '\\\\'), '%', '\\%'), '_', '\\_') AS pattern FROM part_method")
simple("g16_synonyms", "raw_terms", lambda t: t.select("id", F.array_join(scalars.string_array(F.col("synonyms")), ",").alias("synonyms")), "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 4 = 0 THEN 'a,' || n_name ELSE '' END AS synonyms FROM nation")
simple("g18_mapper_calls", "edges", lambda e: e.where("relation = 'calls'").select("to_fqn", scalars.is_mapper_call(F.col("to_fqn")).alias("is_mapper")), "SELECT to_fqn, regexp_matches(split_part(to_fqn, '(', 1), '(Mapper|Dao|Repository)[.][^.]*$') AND NOT regexp_matches(split_part(to_fqn, '(', 1), '(^|[.])Base[^.]*[.][^.]*$') AS is_mapper FROM edges WHERE relation = 'calls'")
_PREFIXES = [p for prefixes in scalars.CLIENTS.values() for p in prefixes]
simple("g19_client_types", "part_method", lambda p: p.select("fqn", scalars.client_type(F.concat(F.element_at(F.array(*map(F.lit, [*_PREFIXES, "com.own.Client"])), (F.col("p_partkey") % (len(_PREFIXES) + 1) + 1).cast("int")), F.lit(".call()"))).alias("kind")), f"SELECT fqn, CASE WHEN p_partkey % {len(_PREFIXES) + 1} < 9 THEN 'redis' WHEN p_partkey % {len(_PREFIXES) + 1} < 14 THEN 'mq' WHEN p_partkey % {len(_PREFIXES) + 1} < 19 THEN 'http' WHEN p_partkey % {len(_PREFIXES) + 1} < 22 THEN 'rpc' END AS kind FROM part_method")
simple("g25_class_terms", "symbols", lambda s: s.where("kind = 'class'").select("fqn", scalars.class_term(F.col("name")).alias("term")), "SELECT fqn, CASE WHEN length(base) >= 3 THEN base END AS term FROM (SELECT fqn, regexp_replace(name, '(Service|Controller)$', '') AS base FROM symbols WHERE kind = 'class')")
simple("g26_domain_methods", "part_method", lambda p: p.select("fqn", scalars.is_domain_method(F.concat(F.element_at(F.array(*map(F.lit, ("get", "preSave", "set", "create", "run"))), (F.col("p_partkey") % 5 + 1).cast("int")), F.lit("Part"))).alias("is_domain")), "SELECT fqn, p_partkey % 5 IN (1, 3) AS is_domain FROM part_method")
simple("g30_scrubbed", "sources", lambda s: s.select("fqn", scalars.scrubbed(F.col("content")).alias("content")), "SELECT fqn, trim(CASE WHEN p_size % 2 = 0 THEN regexp_replace(content, ' // key.*$', '') ELSE content END) AS content FROM sources JOIN part_method USING (fqn)")
simple("g31_clean_summaries", "summaries", lambda s: s.select("target_fqn", scalars.clean_summary(F.concat(F.lit(" 摘要: 功能:"), "summary")).alias("summary")), "SELECT target_fqn, summary FROM summaries")
simple("g32_fallback_summaries", "part_method", lambda p: p.select("fqn", scalars.fallback_summary(F.concat(F.lit("a.B."), F.element_at(F.array(*map(F.lit, ("getX", "setX", "run", "isX"))), (F.col("p_partkey") % 4 + 1).cast("int"))), F.lit("void x()"), F.when(F.col("p_size") % 2 == 0, F.array(F.lit("static")))).alias("summary")), "SELECT fqn, CASE p_partkey % 4 WHEN 0 THEN 'N/A (getter/accessor)' WHEN 1 THEN 'N/A (setter/mutator)' WHEN 3 THEN 'N/A (getter/accessor)' ELSE CASE WHEN p_size % 2 = 0 THEN 'Static method: run' ELSE 'Method: run' END END AS summary FROM part_method")
simple("g33_prompts", "sources", lambda s: s.select("fqn", scalars.prompt(F.col("content"), class_name=F.lit("C"), method_name=F.col("name"), signature=F.lit("")).alias("prompt")), "SELECT fqn, 'class name: C' || chr(10) || 'method name: ' || name || chr(10) || chr(10) || '```java' || chr(10) || trim(CASE WHEN p_size % 2 = 0 THEN regexp_replace(content, ' // key.*$', '') ELSE content END) || chr(10) || '```' AS prompt FROM sources JOIN part_method USING (fqn)")
simple("g38_config_keys", "part_method", lambda p: p.select("fqn", scalars.config_key(F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("${a."), "p_brand", F.lit(":x}"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("${a."), "p_brand", F.lit("}"))).otherwise("plain")).alias("key")), "SELECT fqn, CASE WHEN p_size % 3 < 2 THEN 'a.' || p_brand END AS key FROM part_method")
simple("g39_bean_names", "symbols", lambda s: s.where("kind = 'class'").select("fqn", scalars.bean_name(F.col("name")).alias("bean")), "SELECT fqn, CASE WHEN regexp_matches(name, '^[A-Z]{2}') THEN name ELSE lower(name[1:1]) || name[2:] END AS bean FROM symbols WHERE kind = 'class'")
simple("g48_nodes", "symbols", lambda s: graph.node_rows(s), "SELECT fqn, kind, name, CASE WHEN annotation LIKE '%Controller%' THEN 'controller' WHEN annotation LIKE '%Service%' THEN 'service' WHEN annotation LIKE '%Repository%' THEN 'repository' WHEN kind = 'class' THEN 'domain' END AS layer, file_path FROM symbols")


# Vectors and search.
def _near(where: str) -> str:
    gap = "list_sum(list_transform(list_zip(embedding::DOUBLE[], q.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"
    return f"WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0) SELECT vec_id AS id, round(1 - {gap}, 6) AS score FROM embeddings, q WHERE {where} ORDER BY {gap}, vec_id LIMIT 10"


def nearest(spark: SparkSession, d: str, where: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/embeddings.parquet").withColumnRenamed("vec_id", "id")
    start = [float(x) for x in rows.where("id = 0").first()["embedding"]]
    return vectors.top_k(rows, start, where=F.expr(where)).select("id", F.round("score", 6).alias("score"))


query("f2_glossary_top_k", _near("label = 1"))(lambda spark, d: nearest(spark, d, "label = 1"))
query("f3_constraint_top_k", _near("label = 2"))(lambda spark, d: nearest(spark, d, "label = 2"))
query("g23_similarity", _near("true"))(lambda spark, d: nearest(spark, d, "true"))


@query("k1_semantic_search", f"SELECT p.fqn, 'method' AS kind, coalesce(m.summary, '') AS text, (SELECT count(*) FROM entry_points e WHERE e.symbol_fqn = p.fqn) AS n_entries, score FROM ({_near('label = 3 AND vec_id < (SELECT count(*) FROM part)')}) JOIN part_method p ON p.p_partkey = id + 1 LEFT JOIN summaries m ON m.target_fqn = p.fqn")
def semantic_search(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    start = [float(x) for x in rows.where("vec_id = 0").first()["embedding"]]
    named = rows.join(frame(spark, d, "part_method").select((F.col("p_partkey") - 1).alias("vec_id"), F.col("fqn").alias("id")), "vec_id").select("vec_id", "id", "embedding", "label")
    return search.semantic_search(named, *parts(spark, d, "symbols", "summaries", "entry_points"), start, "p1", where=F.col("label") == 3).withColumn("score", F.round("score", 6))


@query("k2_search_without_vectors", "WITH hits AS (SELECT * FROM symbols WHERE name ILIKE '%p1%' OR fqn ILIKE '%p1%' ORDER BY fqn LIMIT 15) SELECT h.fqn, h.kind, coalesce(s.summary, h.kind || ': ' || h.name) AS text, (SELECT count(*) FROM entry_points e WHERE e.symbol_fqn = h.fqn) AS n_entries, CAST(0.5 AS DOUBLE) AS score FROM hits h LEFT JOIN summaries s ON s.target_fqn = h.fqn")
def search_without_vectors(spark: SparkSession, d: str) -> DataFrame:
    return search.semantic_search(None, *parts(spark, d, "symbols", "summaries", "entry_points"), None, "p1", n=15)


# Ingest.
_calls = "(SELECT from_fqn, to_fqn FROM edges WHERE relation = 'calls' AND from_fqn LIKE 'geo.%Controller.%')"


@query("i8_flat_symbols", "SELECT n.fqn, 'class' AS kind, n.name, CAST(NULL AS STRING) AS parent_fqn, CAST(1 AS INT) AS line_number, n.file_path FROM nation_class n UNION ALL SELECT fqn, 'method', 'c' || c_custkey, parent_fqn, CAST(c_custkey AS INT), file_path FROM customer_method UNION ALL SELECT fqn || '.orderService', 'field', 'orderService', fqn, NULL, file_path FROM nation_class")
def flat_symbols(spark: SparkSession, d: str) -> DataFrame:
    sources = frame(spark, d, "nation_class").select("fqn", "file_path")
    flat = classes.flatten_symbols(nested_classes(spark, d), sources).drop("modifiers", "annotations", "signature")
    some = frame(spark, d, "customer_method").select("fqn")
    return flat.where("kind <> 'method'").unionByName(flat.join(some, "fqn", "left_semi")).select("fqn", "kind", "name", "parent_fqn", "line_number", "file_path")


@query("i8_flat_edges", f"SELECT from_fqn, to_fqn, relation FROM edges WHERE relation <> 'calls' UNION ALL SELECT from_fqn, to_fqn, 'calls' FROM {_calls} UNION ALL SELECT fqn, 'dao.BaseMapper.selectById(java.lang.Long)', 'calls' FROM customer_method WHERE c_custkey % 7 = 0")
def flat_edges(spark: SparkSession, d: str) -> DataFrame:
    return classes.flatten_edges(nested_classes(spark, d)).drop("metadata")


@query("i4_entries", "SELECT fqn AS symbol_fqn, CASE c_mktsegment WHEN 'BUILDING' THEN 'http_api' WHEN 'MACHINERY' THEN 'scheduled' ELSE 'mq_consumer' END AS entry_type, CASE WHEN c_mktsegment = 'BUILDING' THEN 'GET' END AS http_method, CASE WHEN c_mktsegment = 'BUILDING' THEN '/api/seg/BUILDING/' || c_custkey END AS http_path, CASE WHEN c_mktsegment = 'MACHINERY' THEN '0 0 * * *' END AS cron_expression, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN c_mktsegment END AS mq_queue FROM customer_method WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')")
def entries_of_classes(spark: SparkSession, d: str) -> DataFrame:
    return classes.entry_points(nested_classes(spark, d))


@query("i5_dependencies", f"SELECT DISTINCT from_fqn AS caller_fqn, 'mysql' AS dependency_type, to_fqn AS target, 'strong' AS strength FROM {_calls} WHERE to_fqn LIKE 'dao.%Mapper.%' UNION ALL SELECT fqn, 'mysql', 'dao.BaseMapper.selectById(java.lang.Long)', 'strong' FROM customer_method WHERE c_custkey % 7 = 0 UNION ALL SELECT fqn, 'redis', 'org.springframework.data.redis.core.RedisTemplate.opsForValue()', 'strong' FROM customer_method WHERE c_custkey % 3 = 0 UNION ALL SELECT fqn, 'http', 'org.springframework.web.client.RestTemplate.getForObject(java.lang.String)', 'weak' FROM customer_method WHERE c_custkey % 5 = 0")
def detected_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return dependencies.detect_dependencies(nested_classes(spark, d))


_outline = "SELECT c.fqn, c.kind AS type, count(DISTINCT m.fqn) AS n_methods, count(e.to_fqn) AS n_calls FROM symbols c LEFT JOIN symbols m ON m.parent_fqn = c.fqn AND m.kind = 'method' LEFT JOIN edges e ON e.from_fqn = m.fqn AND e.relation = 'calls' WHERE c.kind = 'class' GROUP BY c.fqn, c.kind"


@query("a10_nested_classes", "SELECT m.parent_fqn AS fqn, m.fqn AS method, count(e.to_fqn) AS n_calls, min(e.to_fqn) AS first_call FROM symbols m JOIN symbols c ON m.parent_fqn = c.fqn AND c.kind = 'class' LEFT JOIN edges e ON e.from_fqn = m.fqn AND e.relation = 'calls' WHERE m.kind = 'method' GROUP BY m.parent_fqn, m.fqn")
def nested(spark: SparkSession, d: str) -> DataFrame:
    rows = classes.nest(*parts(spark, d, "symbols", "edges")).select("fqn", "part", F.explode("methods").alias("m"))
    flat = rows.select("fqn", "part", F.col("m.fqn").alias("method"), F.size("m.calls").alias("n"), F.get("m.calls", F.lit(0)).alias("first"))
    # By part too, so that nothing is shuffled: a method that is given twice counts its calls twice, and so does the SQL.
    return flat.groupBy("fqn", "part", "method").agg(F.sum("n").alias("n_calls"), F.min("first").alias("first_call")).drop("part")


@query("a13_light_index", _outline)
def light_index(spark: SparkSession, d: str) -> DataFrame:
    return classes.light_index(classes.outline(*parts(spark, d, "symbols", "edges")))


@query("a14_light_index_batch", "WITH own AS (SELECT file_path, count(*) AS n FROM symbols WHERE kind IN ('class', 'interface') GROUP BY file_path) SELECT DISTINCT path AS file_path, n IS NOT NULL AS success, coalesce(n, 0) AS n_classes, CASE WHEN n IS NULL THEN 'no class found' END AS error FROM java_files LEFT JOIN own ON file_path = path")
def light_index_batch(spark: SparkSession, d: str) -> DataFrame:
    return classes.light_index_batch(frame(spark, d, "java_files").withColumnRenamed("path", "file_path"), frame(spark, d, "symbols"))


@query("d24_totals", f"SELECT count(*) AS n_classes, CAST(sum(n_methods) AS BIGINT) AS n_methods, CAST(sum(n_calls) AS BIGINT) AS n_calls FROM ({_outline})")
def totals(spark: SparkSession, d: str) -> DataFrame:
    return classes.totals(classes.outline(*parts(spark, d, "symbols", "edges")))


@query("d14_progress", f"WITH own AS (SELECT length(fqn) % 4 AS batch, count(*) AS n_classes, CAST(sum(n_methods) AS BIGINT) AS n_methods, CAST(sum(n_calls) AS BIGINT) AS n_calls FROM ({_outline}) GROUP BY 1) SELECT CAST(batch AS INT) AS batch, n_classes, n_methods, n_calls, CAST(sum(n_classes) OVER w AS BIGINT) AS total_classes, CAST(sum(n_methods) OVER w AS BIGINT) AS total_methods, CAST(sum(n_calls) OVER w AS BIGINT) AS total_calls, CAST(100 * sum(n_classes) OVER w // sum(n_classes) OVER () AS INT) AS percentage FROM own WINDOW w AS (ORDER BY batch ROWS UNBOUNDED PRECEDING)")
def progress(spark: SparkSession, d: str) -> DataFrame:
    return classes.progress(classes.outline(*parts(spark, d, "symbols", "edges")).withColumn("batch", F.length("fqn") % 4), "batch")


@query("i11_verified", "WITH ends AS (SELECT from_fqn AS fqn FROM edges UNION ALL SELECT to_fqn FROM edges) SELECT (SELECT count(*) FROM symbols) AS n_symbols, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM ends WHERE fqn NOT IN (SELECT fqn FROM symbols)) AS n_orphan_ends, (SELECT count(*) FROM summaries WHERE target_fqn NOT IN (SELECT fqn FROM symbols)) AS n_orphan_rows, (SELECT count(*) - count(DISTINCT fqn) FROM symbols) AS n_repeated, false AS ok")
def verified(spark: SparkSession, d: str) -> DataFrame:
    return verify.verify(*parts(spark, d, "symbols", "edges"), {"summaries": (frame(spark, d, "summaries"), "target_fqn")})


@query("g35_stale_modules", "SELECT r_name AS module, md5(r_name || '2') AS hash FROM region WHERE r_regionkey > 2 UNION ALL SELECT r_name, md5(r_name || '1') FROM region WHERE r_regionkey = 0")
def stale_modules(spark: SparkSession, d: str) -> DataFrame:
    regions = frame(spark, d, "metadata")
    number = F.col("value").cast("int")
    now = regions.select(F.col("key").alias("module"), F.md5(F.concat("key", F.when(number > 2, "2").otherwise("1"))).alias("hash"))
    return classes.stale_modules(now, regions.where(number > 0).select(F.col("key").alias("module"), F.md5(F.concat("key", F.lit("1"))).alias("hash")))


# Mutations.
@query("h1_upsert_symbols", "SELECT fqn, CASE WHEN kind = 'class' THEN 'renamed' ELSE name END AS name, kind, 1 AS created FROM symbols UNION ALL SELECT 'new.Class', 'second', 'class', 2")
def upsert_symbols(spark: SparkSession, d: str) -> DataFrame:
    old = frame(spark, d, "symbols").select("fqn", "name", "kind", F.lit(1).alias("created_at"))
    fresh = spark.createDataFrame([("new.Class", "first", "class", 2, 1), ("new.Class", "second", "class", 2, 2)], "fqn string, name string, kind string, created_at int, at int")
    new = old.where("kind = 'class'").select("fqn", F.lit("renamed").alias("name"), "kind", F.lit(2).alias("created_at"), F.lit(1).alias("at")).unionByName(fresh)
    return mutations.upsert_symbols(old, new, order="at").withColumnRenamed("created_at", "created")


@query("h2_append_edges", "SELECT relation, count(*) * 2 AS n FROM edges GROUP BY relation")
def append_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = frame(spark, d, "edges")
    return measures.counts_by(mutations.append(edges, edges), "relation")


@query("h3_upsert_entries", "SELECT symbol_fqn, entry_type, CASE WHEN entry_type = 'http_api' THEN '/new' ELSE http_path END AS http_path FROM entry_points UNION ALL SELECT symbol_fqn, 'scheduled', NULL FROM entry_points WHERE entry_type = 'http_api'")
def upsert_entries(spark: SparkSession, d: str) -> DataFrame:
    old = frame(spark, d, "entry_points")
    web = old.where("entry_type = 'http_api'")
    new = web.withColumn("http_path", F.lit("/new")).unionByName(web.withColumn("entry_type", F.lit("scheduled")).withColumn("http_path", F.lit(None).cast("string")))
    return mutations.upsert_entries(old, new)


@query("h4_append_dependencies", "SELECT dependency_type, count(*) + CASE WHEN dependency_type = 'http' THEN 1 ELSE 0 END AS n FROM dependencies GROUP BY dependency_type")
def append_dependencies(spark: SparkSession, d: str) -> DataFrame:
    new = spark.createDataFrame([("a.b()", "http", "c.d()")], "caller_fqn string, dependency_type string, target string")
    return measures.counts_by(mutations.append(frame(spark, d, "dependencies"), new), "dependency_type")


@query("h5_append_findings", "SELECT severity, count(*) * 2 AS n FROM anti_patterns GROUP BY severity")
def append_findings(spark: SparkSession, d: str) -> DataFrame:
    found = frame(spark, d, "anti_patterns")
    return measures.counts_by(mutations.append(found, found), "severity")


@query("h8_mark_stale", f"SELECT target_fqn, level, summary, is_stale OR target_fqn IN (SELECT fqn FROM symbols WHERE parent_fqn = '{_BRAND}') AS is_stale FROM summaries")
def mark_stale(spark: SparkSession, d: str) -> DataFrame:
    return mutations.mark_stale(frame(spark, d, "summaries"), frame(spark, d, "symbols").where(F.col("parent_fqn") == _BRAND).select("fqn"))


@query("h10_mark_stale_by_prefix", "SELECT target_fqn, level, summary, is_stale OR target_fqn IN (SELECT fqn FROM symbols WHERE starts_with(file_path, 'src/main/java/dao/Brand_1')) AS is_stale FROM summaries")
def mark_stale_by_prefix(spark: SparkSession, d: str) -> DataFrame:
    return mutations.mark_stale_by_prefix(*parts(spark, d, "summaries", "symbols"), ["src/main/java/dao/Brand_1"])


@query("h11_vector_ids", "SELECT target_fqn, level, summary, false AS is_stale, CASE WHEN is_stale THEN 'v-' || target_fqn END AS vector_id FROM summaries")
def vector_ids(spark: SparkSession, d: str) -> DataFrame:
    old = frame(spark, d, "summaries")
    ids = old.where("is_stale").select("target_fqn", F.concat(F.lit("v-"), "target_fqn").alias("vector_id"))
    return mutations.set_vector_ids(old, "target_fqn", ids).withColumn("is_stale", F.coalesce("is_stale", F.lit(False)))


@query("h12_upsert_glossary", "SELECT code_term, CASE WHEN starts_with(code_term, 'S') THEN 'changed' ELSE business_meaning END AS business_meaning FROM glossary UNION ALL SELECT 'a new term', 'new'")
def upsert_glossary(spark: SparkSession, d: str) -> DataFrame:
    old = frame(spark, d, "glossary").select("code_term", "business_meaning")
    new = old.where("code_term like 'S%'").withColumn("business_meaning", F.lit("changed"))
    return mutations.upsert_glossary(old, new.unionByName(spark.createDataFrame([("a new term", "new")], "code_term string, business_meaning string")))


@query("h13_upsert_constraints", "SELECT name, source_fqn, CASE WHEN constraint_type = 'F' THEN 'X' ELSE constraint_type END AS constraint_type FROM constraints")
def upsert_constraints(spark: SparkSession, d: str) -> DataFrame:
    old = frame(spark, d, "constraints")
    new = old.where("constraint_type = 'F'").withColumn("constraint_type", F.lit("X"))
    return mutations.upsert_constraints(old, new.unionByName(new))


_gone = f"(SELECT fqn FROM symbols WHERE file_path = '{_BRAND_FILE}')"


def _cascaded(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    frames = {v: frame(spark, d, v) for v in ("symbols", "edges", "entry_points", "dependencies", "anti_patterns", "summaries", "constraints")} | {"glossary": frame(spark, d, "glossary_source")}
    return mutations.delete_files(frames, lookup.named(spark, _BRAND_FILE, column="file_path"))


@query("h17_cascade_counts", " UNION ALL ".join([f"SELECT 'symbols' AS table_name, count(*) AS n FROM symbols WHERE fqn NOT IN {_gone}", f"SELECT 'edges', count(*) FROM edges WHERE from_fqn NOT IN {_gone} AND to_fqn NOT IN {_gone}", *(f"SELECT '{v}', count(*) FROM {v} WHERE {c} NOT IN {_gone}" for v, c in (("entry_points", "symbol_fqn"), ("dependencies", "caller_fqn"), ("anti_patterns", "from_fqn"), ("summaries", "target_fqn"))), "SELECT 'constraints', count(*) FROM constraints", "SELECT 'glossary', count(*) FROM glossary_source"]))
def cascade_counts(spark: SparkSession, d: str) -> DataFrame:
    return mutations.counts_of(_cascaded(spark, d))


@query("h24_cascade_nulls", f"SELECT rule_id, from_fqn, CASE WHEN to_fqn NOT IN {_gone} THEN to_fqn END AS to_fqn, severity FROM anti_patterns WHERE from_fqn NOT IN {_gone}")
def cascade_nulls(spark: SparkSession, d: str) -> DataFrame:
    return _cascaded(spark, d)["anti_patterns"]


@query("h23_vector_changes", "SELECT vec_id, CASE WHEN vec_id % 10 = 1 THEN -1 ELSE label END AS label FROM embeddings WHERE vec_id % 10 <> 0")
def vector_changes(spark: SparkSession, d: str) -> DataFrame:
    old = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label")
    changed = mutations.merge(old, old.where("vec_id % 10 = 1").withColumn("label", F.lit(-1)), ["vec_id"])
    return mutations.delete_keys(changed, "vec_id", old.where("vec_id % 10 = 0").select("vec_id"))


# The business layer.
@query("j6_terms", "WITH classes AS (SELECT fqn, name, regexp_replace(name, '(Service|Controller)$', '') AS term FROM symbols WHERE kind = 'class'), found AS (SELECT term AS code_term, fqn AS class_fqn, 0 AS rank, fqn AS source_fqn FROM classes WHERE length(term) >= 3) SELECT code_term, source_fqn FROM found QUALIFY row_number() OVER (PARTITION BY code_term ORDER BY class_fqn, rank, source_fqn) = 1")
def terms(spark: SparkSession, d: str) -> DataFrame:
    return business.terms(frame(spark, d, "symbols"))


def shout(texts: pd.Series) -> pd.Series:
    """A stand-in for a model."""
    if texts.str.contains("Mapper").any():
        raise ValueError("no answer")
    return '{"business_meaning": "' + texts.str.upper() + '", "synonyms": ["x"]}'


@query("j7_glossary", "WITH found AS (SELECT regexp_replace(name, '(Service|Controller)$', '') AS code_term, min(fqn) AS source_fqn FROM symbols WHERE kind = 'class' GROUP BY 1 HAVING length(code_term) >= 3) SELECT code_term, source_fqn, CASE WHEN contains(code_term, 'Mapper') THEN NULL ELSE 'TERM: ' || upper(code_term) END AS business_meaning, CASE WHEN contains(code_term, 'Mapper') THEN 0 ELSE 1 END AS n_synonyms FROM found")
def built_glossary(spark: SparkSession, d: str) -> DataFrame:
    return business.glossary(frame(spark, d, "symbols"), shout).select("code_term", "source_fqn", "business_meaning", F.size("synonyms").alias("n_synonyms"))


@query("f9_first_terms", "SELECT code_term, source_fqn FROM glossary_source")
def first_terms(spark: SparkSession, d: str) -> DataFrame:
    rows = frame(spark, d, "part_method").select(F.col("p_type").alias("code_term"), F.col("parent_fqn").alias("source_fqn"))
    return business.first_terms(rows, "source_fqn")


@query("g27_annotation_constraints", "SELECT 'p' || p_partkey || '_' || CASE p_size % 3 WHEN 0 THEN 'Min(' ELSE 'NotNull' END AS name, '参数验证: ' || CASE p_size % 3 WHEN 0 THEN '@Min(1)' ELSE '@NotNull' END AS description, fqn AS source_fqn, 'validation' AS constraint_type FROM part_method WHERE p_size % 3 < 2")
def annotation_constraints(spark: SparkSession, d: str) -> DataFrame:
    rows = frame(spark, d, "part_method").select("fqn", F.lit("method").alias("kind"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"), F.element_at(F.array(F.array(F.lit("@Min(1)")), F.array(F.lit("@NotNull"), F.lit("@Override")), F.array().cast("array<string>")), (F.col("p_size") % 3 + 1).cast("int")).alias("annotations"))
    return business.constraints_of_annotations(rows)


simple("g28_assert_constraints", "sources", business.constraints_of_asserts, "SELECT name || '_assert_0' AS name, p_name || ' has a size' AS description, fqn AS source_fqn, 'business_rule' AS constraint_type FROM sources JOIN part_method USING (fqn)")
simple("g29_comment_constraints", "comments", business.constraints_of_comments, "SELECT 'constraint_line_' || line AS name, trim(comment) AS description, fqn AS source_fqn, line AS source_line, 'business_rule' AS constraint_type FROM comments WHERE line % 4 < 3")


@query("j8_constraints", "SELECT constraint_type, count(*) AS n FROM (SELECT 'business_rule' AS constraint_type FROM sources) GROUP BY constraint_type")
def all_constraints(spark: SparkSession, d: str) -> DataFrame:
    return measures.counts_by(business.constraints(frame(spark, d, "symbols"), frame(spark, d, "sources")), "constraint_type")


_listed = "string_agg('- ' || summary, chr(10) ORDER BY part, summary)"


@query("j3_rolled_up", f"WITH by_class AS (SELECT c.fqn, coalesce((SELECT {_listed} FROM (SELECT s.name AS part, m.summary FROM symbols s JOIN summaries m ON m.target_fqn = s.fqn WHERE s.parent_fqn = c.fqn AND m.summary <> '')), c.name || ' (class)') AS summary FROM symbols c WHERE c.kind = 'class'), by_package AS (SELECT regexp_extract(fqn, '^(.*)[.][^.]*$', 1) AS fqn, string_agg('- ' || summary, chr(10) ORDER BY fqn, summary) AS summary FROM by_class GROUP BY 1), by_module AS (SELECT split_part(fqn, '.', 1) AS fqn, string_agg('- ' || summary, chr(10) ORDER BY fqn, summary) AS summary FROM by_package GROUP BY 1) SELECT level, fqn, md5(summary) AS digest FROM (SELECT 'class' AS level, * FROM by_class UNION ALL SELECT 'package', * FROM by_package UNION ALL SELECT 'module', * FROM by_module)")
def rolled_up(spark: SparkSession, d: str) -> DataFrame:
    said = frame(spark, d, "summaries").select(F.col("target_fqn").alias("fqn"), "summary")
    return business.bottom_up(frame(spark, d, "symbols"), said).select("level", "fqn", F.md5("summary").alias("digest"))


def echo(texts: pd.Series) -> pd.Series:
    """A stand-in for a model that fails for some."""
    if texts.str.contains("11").any():
        raise ValueError("no answer")
    return "摘要: asked " + texts.str.len().astype(str)


_todo = f"(SELECT fqn FROM symbols WHERE parent_fqn = '{_BRAND}' AND fqn IN (SELECT fqn FROM sources) AND fqn NOT IN (SELECT target_fqn FROM summaries WHERE NOT is_stale))"


@query("j1_refresh_result", f"WITH hit AS (SELECT fqn FROM symbols WHERE parent_fqn = '{_BRAND}' UNION SELECT from_fqn FROM edges WHERE relation = 'calls' AND to_fqn IN (SELECT fqn FROM symbols WHERE parent_fqn = '{_BRAND}') UNION SELECT '{_BRAND}') SELECT (SELECT count(*) FROM {_todo}) AS regenerated, (SELECT count(*) FROM symbols WHERE parent_fqn = '{_BRAND}') - (SELECT count(*) FROM {_todo}) AS skipped, (SELECT count(*) FROM symbols WHERE parent_fqn = '{_BRAND}') AS changed, (SELECT count(*) FROM hit) AS affected")
def refresh_result(spark: SparkSession, d: str) -> DataFrame:
    symbols, edges, summaries, sources = parts(spark, d, "symbols", "edges", "summaries", "sources")
    return business.refresh_result(symbols, edges, summaries, sources, symbols.where(F.col("parent_fqn") == _BRAND))


@query("j1_refreshed", f"SELECT target_fqn, level, CASE WHEN target_fqn NOT IN {_todo} THEN summary ELSE 'asked' END AS summary, is_stale AND target_fqn NOT IN {_todo} AS is_stale FROM summaries")
def refreshed(spark: SparkSession, d: str) -> DataFrame:
    symbols, edges, summaries, sources = parts(spark, d, "symbols", "edges", "summaries", "sources")
    out = business.refreshed(symbols, edges, summaries, sources, symbols.where(F.col("parent_fqn") == _BRAND), echo)
    return out.withColumn("summary", F.when(F.col("summary").rlike("^asked [0-9]+$|^Method: p"), "asked").otherwise(F.col("summary")))
