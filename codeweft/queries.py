"""The engine's operators over the test tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.fixtures import frame, with_views
from codeweft.functions import scalars
from codeweft.operators import graph, lookup, measures, mutations, relations, vectors
from codeweft.plans import rules
from codeweft.plans.impact import impact, impact_by_own_files
from codeweft.streaming.limits import limited

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, recursive: bool = False) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = with_views(sql, recursive)
        return f

    return register


def simple(name: str, view: str, build: Callable[[DataFrame], DataFrame], sql: str) -> None:
    query(name, sql)(lambda spark, d: build(frame(spark, d, view)))


SYMBOL = ["fqn", "kind", "name", "file_path", "parent_fqn"]
_symbol = ", ".join(SYMBOL)
_nation = "geo.NATION_3Controller"

simple("b1_symbol", "symbols", lambda s: lookup.equal(s, fqn=_nation).select(SYMBOL), f"SELECT {_symbol} FROM symbols WHERE fqn = '{_nation}'")
simple("b2_symbols_by_kind", "symbols", lambda s: lookup.equal(s, kind="class").select(SYMBOL), f"SELECT {_symbol} FROM symbols WHERE kind = 'class'")
simple("b3_children", "symbols", lambda s: lookup.equal(s, parent_fqn=_nation).select(SYMBOL), f"SELECT {_symbol} FROM symbols WHERE parent_fqn = '{_nation}'")
simple("b4_search_symbols", "symbols", lambda s: lookup.contains_any(s, "MAPPER", ["name"], ["name", "fqn"]).select(SYMBOL), f"SELECT {_symbol} FROM symbols WHERE name ILIKE '%MAPPER%' ORDER BY name, fqn LIMIT 100")
simple("b5_edges_from", "edges", lambda e: lookup.equal(e, from_fqn=_nation, relation="inherits"), f"SELECT * FROM edges WHERE from_fqn = '{_nation}' AND relation = 'inherits'")
simple("b6_edges_to", "edges", lambda e: lookup.equal(e, to_fqn="ext.Supplier.s7()"), "SELECT * FROM edges WHERE to_fqn = 'ext.Supplier.s7()'")
simple("b7_dependencies_by_type", "dependencies", lambda d: lookup.equal(d, caller_fqn=None, dependency_type="http"), "SELECT * FROM dependencies WHERE dependency_type = 'http'")
simple("b9_summary", "summaries", lambda s: lookup.equal(s, target_fqn="dao.Brand_4Mapper.p2()", level="method"), "SELECT * FROM summaries WHERE target_fqn = 'dao.Brand_4Mapper.p2()' AND level = 'method'")
simple("b10_stale_summaries", "summaries", lambda s: s.where("is_stale").orderBy("target_fqn").limit(1000), "SELECT * FROM summaries WHERE is_stale ORDER BY target_fqn LIMIT 1000")
simple("b13_search_glossary", "glossary", lambda g: lookup.contains_any(g, "e", ["code_term", "business_meaning"], ["code_term"]), "SELECT * FROM glossary WHERE code_term ILIKE '%e%' OR business_meaning ILIKE '%e%' ORDER BY code_term LIMIT 100")
simple("b17_constraints_by_type", "constraints", lambda c: lookup.equal(c, constraint_type="F"), "SELECT * FROM constraints WHERE constraint_type = 'F'")
simple("b20_constraint_context", "constraints", lambda c: c.where(F.col("source_fqn").ilike("svc.p1%") | F.col("name").ilike("svc.p1%")).orderBy("name"), "SELECT * FROM constraints WHERE source_fqn ILIKE 'svc.p1%' OR name ILIKE 'svc.p1%'")
simple("b25_glossary_page", "glossary", lambda g: lookup.page(g, "code_term", limit=3, offset=1), "SELECT * FROM glossary ORDER BY code_term LIMIT 3 OFFSET 1")
simple("c16_resolve_entry", "entry_points", lambda e: lookup.resolve_entry(e, "/seg/BUILDING/12/orders").drop("rank"), "SELECT * FROM entry_points WHERE http_path IS NOT NULL AND starts_with('/seg/BUILDING/12/orders', rtrim(http_path, '/')) ORDER BY symbol_fqn LIMIT 1")
simple("d1_symbol_count", "symbols", lambda s: s.agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM symbols")
simple("d2_edges_by_relation", "edges", lambda e: measures.counts_by(e, "relation"), "SELECT relation, count(*) AS n FROM edges GROUP BY relation")
simple("d11_entries_by_type", "entry_points", lambda e: measures.counts_by(e, "entry_type"), "SELECT entry_type, count(*) AS n FROM entry_points GROUP BY entry_type")
simple("d12_dependencies_by_type", "dependencies", lambda d: measures.counts_by(d, "dependency_type", "strength"), "SELECT dependency_type, strength, count(*) AS n FROM dependencies GROUP BY ALL")
simple("d27_package_files", "symbols", lambda s: s.where(F.col("fqn").startswith("geo.") & F.col("file_path").isNotNull()).select("file_path").distinct(), "SELECT DISTINCT file_path FROM symbols WHERE starts_with(fqn, 'geo.') AND file_path IS NOT NULL")
simple("f10_unique_dependencies", "dependencies", lambda d: relations.unique_dependencies(d), "SELECT DISTINCT * FROM dependencies")
simple("g1_layers", "symbols", lambda s: s.select("fqn", scalars.layer_or_unknown(F.col("kind"), F.col("annotations")).alias("layer")), "SELECT fqn, CASE WHEN annotation LIKE '%Controller%' THEN 'controller' WHEN annotation LIKE '%Service%' THEN 'service' WHEN annotation LIKE '%Repository%' THEN 'repository' WHEN kind = 'class' THEN 'domain' ELSE 'unknown' END AS layer FROM symbols")
simple("g2_chain_layers", "symbols", lambda s: s.select("fqn", scalars.chain_layer(F.col("annotations"), F.col("name"), F.col("fqn")).alias("layer")), "SELECT fqn, CASE WHEN annotation LIKE '%Controller%' THEN 'controller' WHEN annotation LIKE '%Service%' THEN 'service' WHEN annotation LIKE '%Repository%' OR annotation LIKE '%Mapper%' THEN 'repository' WHEN name LIKE '%Controller%' THEN 'controller' WHEN name LIKE '%Service%' THEN 'service' WHEN name LIKE '%Mapper%' OR name LIKE '%Dao%' OR name LIKE '%Repository%' THEN 'repository' WHEN fqn LIKE '%Controller%' THEN 'controller' WHEN fqn LIKE '%Service%' THEN 'service' WHEN fqn LIKE '%Mapper%' OR fqn LIKE '%Dao%' OR fqn LIKE '%Repository%' THEN 'repository' ELSE 'unknown' END AS layer FROM symbols")
simple("g5_test_files", "symbols", lambda s: s.select("fqn", scalars.is_test_file(F.col("file_path")).alias("is_test")), "SELECT fqn, coalesce(contains(lower(file_path), '/test/') OR regexp_matches(file_path, '(^|/)Test[^/]*$') OR regexp_matches(file_path, '(Test|Tests|IT)\\.java$'), false) AS is_test FROM symbols")
simple("g6_test_paths", "symbols", lambda s: s.where("file_path is not null").select("fqn", F.explode(scalars.test_paths(F.col("file_path"))).alias("test_path")), "SELECT fqn, regexp_replace(replace(file_path, '/main/java/', '/test/java/'), '\\.java$', '') || suffix || '.java' AS test_path FROM symbols, (VALUES ('Test'), ('Tests'), ('IT')) t(suffix) WHERE contains(file_path, '/main/java/')")
simple("g17_owners", "symbols", lambda s: s.where("kind = 'method'").select("fqn", scalars.owner(F.col("fqn")).alias("owner"), scalars.simple_name(F.col("fqn")).alias("simple_name")), "SELECT fqn, regexp_extract(split_part(fqn, '(', 1), '^(.*)\\.', 1) AS owner, regexp_extract(split_part(fqn, '(', 1), '([^.]*)$', 1) AS simple_name FROM symbols WHERE kind = 'method'")
simple("g24_spaced_terms", "symbols", lambda s: s.where("kind = 'class'").select("fqn", scalars.spaced_term(F.col("name")).alias("term")), "SELECT fqn, lower(trim(regexp_replace(name, '([A-Z])', ' \\1', 'g'))) AS term FROM symbols WHERE kind = 'class'")
simple("d15_request_metrics", "requests", lambda r: measures.request_metrics(r, "path").select("path", "n", F.round("mean_ms", 6).alias("mean_ms"), F.round("error_rate", 6).alias("error_rate"), "p95_ms", "p99_ms"),
    "WITH recent AS (SELECT * FROM requests QUALIFY row_number() OVER (PARTITION BY path ORDER BY ts DESC, request_id DESC) <= 1000), tails AS (SELECT path, list_sort(list(duration_ms)) AS d FROM recent GROUP BY path) SELECT path, n, mean_ms, error_rate, d[least(CAST(floor(len(d) * 0.95) AS INT), len(d) - 1) + 1] AS p95_ms, d[least(CAST(floor(len(d) * 0.99) AS INT), len(d) - 1) + 1] AS p99_ms FROM (SELECT path, count(*) AS n, round(avg(duration_ms), 6) AS mean_ms, round(avg(CASE WHEN status >= 400 THEN 1.0 ELSE 0.0 END), 6) AS error_rate FROM requests GROUP BY path) JOIN tails USING (path)")
simple("s3_sliding_count", "requests", lambda r: measures.sliding_count(r, 3600), "SELECT request_id, client, count(*) OVER (PARTITION BY client ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) - 1 AS n_before FROM requests")
_LIMITED = """WITH numbered AS (SELECT request_id, client, epoch_us(ts) AS us, row_number() OVER (PARTITION BY client ORDER BY ts, request_id) AS n FROM requests),
walk AS (SELECT client, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS request_id, false AS allowed, CAST([] AS BIGINT[]) AS held FROM (SELECT DISTINCT client FROM requests)
  UNION ALL SELECT client, n, request_id, ok, CASE WHEN ok THEN list_append(live, us) ELSE live END FROM (
    SELECT *, len(list_filter(live, lambda t: t > us - 10000000)) < 10 AND len(list_filter(live, lambda t: t > us - 60000000)) < 60 AND len(live) < 1000 AS ok FROM (
      SELECT r.client, r.n, r.request_id, r.us, list_filter(w.held, lambda t: t > r.us - 3600000000) AS live FROM walk w JOIN numbered r ON r.client = w.client AND r.n = w.n + 1)))
SELECT request_id, client, allowed FROM walk WHERE n > 0"""
query("s1_rate_limiter", _LIMITED, recursive=True)(lambda spark, d: limited(frame(spark, d, "requests")))


@query("b23_keyword_search", "WITH hits AS (SELECT * FROM symbols WHERE name ILIKE '%p1%' OR fqn ILIKE '%p1%' ORDER BY fqn LIMIT 40) SELECT h.fqn, h.kind, coalesce(s.summary, h.kind || ': ' || h.name) AS text, (SELECT count(*) FROM entry_points e WHERE e.symbol_fqn = h.fqn) AS n_entries, CAST(0.5 AS DOUBLE) AS score FROM hits h LEFT JOIN summaries s ON s.target_fqn = h.fqn")
def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    return lookup.keyword_search(frame(spark, d, "symbols"), frame(spark, d, "summaries"), frame(spark, d, "entry_points"), "p1", 40)


@query("b24_symbol_detail", "SELECT s.fqn, s.kind, s.name, m.summary, e.entry_type, e.http_path FROM symbols s LEFT JOIN summaries m ON m.target_fqn = s.fqn LEFT JOIN entry_points e ON e.symbol_fqn = s.fqn")
def symbol_detail(spark: SparkSession, d: str) -> DataFrame:
    return lookup.symbol_detail(frame(spark, d, "symbols"), frame(spark, d, "summaries"), frame(spark, d, "entry_points"))


@query("c1_related_symbols", f"SELECT s.fqn, relation, 'outgoing' AS direction, s.kind, s.name FROM edges JOIN symbols s ON to_fqn = s.fqn WHERE from_fqn = '{_nation}' UNION ALL SELECT s.fqn, relation, 'incoming', s.kind, s.name FROM edges JOIN symbols s ON from_fqn = s.fqn WHERE to_fqn = '{_nation}'")
def related(spark: SparkSession, d: str) -> DataFrame:
    return relations.related(frame(spark, d, "symbols"), frame(spark, d, "edges"), _nation)


@query("c9_orphan_edges", "SELECT side, fqn, count(*) AS n FROM (SELECT 'from' AS side, from_fqn AS fqn FROM edges UNION ALL SELECT 'to', to_fqn FROM edges) WHERE fqn NOT IN (SELECT fqn FROM symbols) GROUP BY ALL")
def orphan_edges(spark: SparkSession, d: str) -> DataFrame:
    return relations.orphan_edges(frame(spark, d, "symbols"), frame(spark, d, "edges"))


@query("c10_orphans", "SELECT 'edges_to' AS table_name, count(*) AS orphans FROM edges WHERE to_fqn NOT IN (SELECT fqn FROM symbols) UNION ALL SELECT 'parents', count(*) FROM symbols WHERE parent_fqn IS NOT NULL AND parent_fqn NOT IN (SELECT fqn FROM symbols) UNION ALL SELECT 'summaries', count(*) FROM summaries WHERE target_fqn NOT IN (SELECT fqn FROM symbols)")
def orphans(spark: SparkSession, d: str) -> DataFrame:
    symbols = frame(spark, d, "symbols")
    return relations.orphans(symbols, {"edges_to": (frame(spark, d, "edges"), "to_fqn"), "parents": (symbols.select("parent_fqn"), "parent_fqn"), "summaries": (frame(spark, d, "summaries"), "target_fqn")})


#: Frames with a key that should name a symbol: label, view, column.
_SATELLITES = [("edges_from", "edges", "from_fqn"), ("edges_to", "edges", "to_fqn"), ("entry_points", "entry_points", "symbol_fqn"), ("external_dependencies", "dependencies", "caller_fqn"), ("summaries", "summaries", "target_fqn"), ("glossary", "glossary_source", "source_fqn"), ("constraints", "constraints", "source_fqn")]
_anti_patterns = "(SELECT from_fqn FROM edges WHERE relation = 'calls' AND from_fqn LIKE 'geo.%Controller.%' AND to_fqn LIKE 'dao.%Mapper.%')"


@query("c10_all_orphans", " UNION ALL ".join(f"SELECT '{label}' AS table_name, count(*) AS orphans FROM {view} WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT fqn FROM symbols)" for label, view, column in [*_SATELLITES, ("anti_patterns", _anti_patterns, "from_fqn")]))
def all_orphans(spark: SparkSession, d: str) -> DataFrame:
    """The 8 checks of C10; anti-patterns are the rule's findings."""
    symbols, edges = frame(spark, d, "symbols"), frame(spark, d, "edges")
    checks = {label: (frame(spark, d, view), column) for label, view, column in _SATELLITES}
    return relations.orphans(symbols, checks | {"anti_patterns": (rules.detect(symbols, edges), "from_fqn")})


@query("d7_coverage", "WITH callers AS (SELECT DISTINCT to_fqn AS target, from_fqn AS fqn FROM edges) SELECT target, count(*) AS total_callers, CAST(sum(CASE WHEN contains(s.file_path, '/test/') THEN 1 ELSE 0 END) AS BIGINT) AS tested_callers, round(100.0 * sum(CASE WHEN contains(s.file_path, '/test/') THEN 1 ELSE 0 END) / count(*), 2) AS coverage_percentage FROM callers JOIN symbols s USING (fqn) GROUP BY target")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    return measures.coverage(frame(spark, d, "symbols"), frame(spark, d, "edges"))


_CUSTOMER = "(SELECT fqn FROM customer_method WHERE c_custkey = 1)"


def _walk(start: str, depth: int, reverse: bool) -> str:
    near, far = ("to_fqn", "from_fqn") if reverse else ("from_fqn", "to_fqn")
    return f"WITH walk AS (SELECT CAST(0 AS INT) AS depth, from_fqn, to_fqn FROM edges WHERE relation = 'calls' AND {near} = {start} UNION SELECT CAST(w.depth + 1 AS INT), e.from_fqn, e.to_fqn FROM walk w JOIN edges e ON e.{near} = w.{far} WHERE e.relation = 'calls' AND w.depth < {depth}) SELECT {start} AS source, depth, from_fqn, to_fqn FROM walk"


@query("e1_call_chain", _walk(_CUSTOMER, 10, False), recursive=True)
def call_chain(spark: SparkSession, d: str) -> DataFrame:
    return graph.traverse(frame(spark, d, "edges"), frame(spark, d, "customer_method").where("c_custkey = 1").select("fqn"))


@query("e2_reverse_callers", _walk("'ext.Supplier.s7()'", 10, True), recursive=True)
def reverse_callers(spark: SparkSession, d: str) -> DataFrame:
    return graph.traverse(frame(spark, d, "edges"), lookup.named(spark, "ext.Supplier.s7()"), reverse=True)


@query("e9_affected", "WITH changed AS (SELECT fqn FROM symbols WHERE parent_fqn = 'dao.Brand_4Mapper') SELECT fqn FROM changed UNION SELECT from_fqn FROM edges WHERE relation = 'calls' AND to_fqn IN (SELECT fqn FROM changed) UNION SELECT 'dao.Brand_4Mapper' FROM changed")
def affected(spark: SparkSession, d: str) -> DataFrame:
    symbols = frame(spark, d, "symbols")
    return graph.affected(symbols, frame(spark, d, "edges"), symbols.where("parent_fqn = 'dao.Brand_4Mapper'"))


@query("i1_controller_dao", "SELECT 'controller-dao' AS rule_id, from_fqn, to_fqn, 'error' AS severity FROM edges WHERE relation = 'calls' AND from_fqn LIKE 'geo.%Controller.%' AND to_fqn LIKE 'dao.%Mapper.%'")
def controller_dao(spark: SparkSession, d: str) -> DataFrame:
    return rules.detect(frame(spark, d, "symbols"), frame(spark, d, "edges")).drop("message")


_IMPACT = """WITH calls AS (SELECT DISTINCT from_fqn, to_fqn FROM edges WHERE relation = 'calls' AND from_fqn IN (SELECT fqn FROM symbols)),
targets AS (SELECT fqn AS source FROM part_method),
walk AS (SELECT t.source, 0 AS depth, c.from_fqn, c.to_fqn FROM targets t JOIN calls c ON c.to_fqn = t.source UNION SELECT w.source, w.depth + 1, c.from_fqn, c.to_fqn FROM walk w JOIN calls c ON c.to_fqn = w.from_fqn WHERE w.depth < 5),
reached AS (SELECT DISTINCT source, from_fqn AS fqn FROM walk),
base AS (SELECT t.source, (SELECT count(*) FROM walk w WHERE w.source = t.source) AS n_callers, coalesce(e.n, 0) AS n_entries, coalesce(r.tests, 0) AS n_tests, coalesce(r.untested, 0) AS n_untested FROM targets t
  LEFT JOIN (SELECT source, count(*) AS n FROM reached JOIN entry_points ON symbol_fqn = fqn GROUP BY source) e USING (source)
  LEFT JOIN (SELECT source, count(*) FILTER (contains(coalesce(file_path, ''), '/test/')) AS tests, count(*) FILTER (NOT contains(coalesce(file_path, ''), '/test/')) AS untested FROM reached JOIN symbols USING (fqn) GROUP BY source) r USING (source)),
scored AS (SELECT *, CAST(CASE WHEN n_callers > 20 THEN 30 WHEN n_callers > 10 THEN 20 WHEN n_callers > 5 THEN 10 ELSE 0 END + CASE WHEN n_entries > 5 THEN 50 WHEN n_entries > 2 THEN 40 WHEN n_entries > 0 THEN 30 ELSE 0 END + CASE WHEN n_untested > 5 THEN 20 WHEN n_untested > 2 THEN 15 WHEN n_untested > 0 THEN 10 ELSE 0 END AS INT) AS risk_score FROM base)
SELECT source, n_callers, n_entries, n_tests, n_untested, risk_score, CASE WHEN risk_score >= 70 THEN 'CRITICAL' WHEN risk_score >= 50 THEN 'HIGH' WHEN risk_score >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, round(least(1.0::DOUBLE, 0.5::DOUBLE + least(0.05::DOUBLE * n_callers, 0.3::DOUBLE) + least(0.1::DOUBLE * n_tests, 0.2::DOUBLE)), 6) AS confidence FROM scored"""


@query("i6_impact_batch", _IMPACT, recursive=True)
def impact_batch(spark: SparkSession, d: str) -> DataFrame:
    """Impact of a change in every part method; tests are callers in test files, as the SQL has it."""
    targets = frame(spark, d, "part_method").select("fqn")
    out = impact_by_own_files(frame(spark, d, "symbols"), frame(spark, d, "edges"), frame(spark, d, "entry_points"), targets)
    return out.withColumn("confidence", F.round("confidence", 6))


_IMPACT_TESTS = """WITH calls AS (SELECT DISTINCT from_fqn, to_fqn FROM edges WHERE relation = 'calls' AND from_fqn IN (SELECT fqn FROM symbols)),
targets AS (SELECT fqn AS source FROM part_method),
walk AS (SELECT t.source, 0 AS depth, c.from_fqn, c.to_fqn FROM targets t JOIN calls c ON c.to_fqn = t.source UNION SELECT w.source, w.depth + 1, c.from_fqn, c.to_fqn FROM walk w JOIN calls c ON c.to_fqn = w.from_fqn WHERE w.depth < 5),
files AS (SELECT DISTINCT file_path FROM symbols WHERE file_path IS NOT NULL),
tested AS (SELECT DISTINCT file_path FROM files, (VALUES ('Test'), ('Tests'), ('IT')) t(suffix) WHERE contains(file_path, '/main/java/') AND regexp_replace(replace(file_path, '/main/java/', '/test/java/'), '\\.java$', '') || suffix || '.java' IN (SELECT file_path FROM files)),
rows_of AS (SELECT w.source, w.from_fqn, s.file_path, coalesce(s.file_path IN (SELECT file_path FROM tested), false) AS has_test FROM walk w JOIN symbols s ON s.fqn = w.from_fqn),
counted AS (SELECT source, count(*) AS n_callers, count(DISTINCT file_path) FILTER (has_test) AS n_tests, count(*) FILTER (NOT has_test) AS n_untested FROM rows_of GROUP BY source),
reaching AS (SELECT source, count(*) AS n_entries FROM (SELECT DISTINCT source, from_fqn FROM walk) JOIN entry_points ON symbol_fqn = from_fqn GROUP BY source),
base AS (SELECT source, coalesce(n_callers, 0) AS n_callers, coalesce(n_entries, 0) AS n_entries, coalesce(n_tests, 0) AS n_tests, coalesce(n_untested, 0) AS n_untested FROM targets LEFT JOIN counted USING (source) LEFT JOIN reaching USING (source)),
scored AS (SELECT *, CAST(CASE WHEN n_callers > 20 THEN 30 WHEN n_callers > 10 THEN 20 WHEN n_callers > 5 THEN 10 ELSE 0 END + CASE WHEN n_entries > 5 THEN 50 WHEN n_entries > 2 THEN 40 WHEN n_entries > 0 THEN 30 ELSE 0 END + CASE WHEN n_untested > 5 THEN 20 WHEN n_untested > 2 THEN 15 WHEN n_untested > 0 THEN 10 ELSE 0 END AS INT) AS risk_score FROM base)
SELECT source, n_callers, n_entries, n_tests, n_untested, risk_score, CASE WHEN risk_score >= 70 THEN 'CRITICAL' WHEN risk_score >= 50 THEN 'HIGH' WHEN risk_score >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, round(least(1.0::DOUBLE, 0.5::DOUBLE + least(0.05::DOUBLE * n_callers, 0.3::DOUBLE) + least(0.1::DOUBLE * n_tests, 0.2::DOUBLE)), 6) AS confidence FROM scored"""


@query("i6_impact_tests", _IMPACT_TESTS, recursive=True)
def impact_tests(spark: SparkSession, d: str) -> DataFrame:
    """Impact of a change in every part method, with the tests found for the callers' files."""
    targets = frame(spark, d, "part_method").select("fqn")
    out = impact(frame(spark, d, "symbols"), frame(spark, d, "edges"), frame(spark, d, "entry_points"), targets)
    return out.withColumn("confidence", F.round("confidence", 6))


@query("f1_vector_top_k", "WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0) SELECT vec_id AS id, round(list_sum(list_transform(list_zip(embedding::DOUBLE[], q.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 6) AS distance FROM embeddings, q ORDER BY list_sum(list_transform(list_zip(embedding::DOUBLE[], q.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), vec_id LIMIT 10")
def vector_top_k(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    start = rows.where("id = 0").first()["embedding"]
    return vectors.top_k(rows, [float(x) for x in start]).select("id", F.round("distance", 6).alias("distance"))


@query("h9_stale_by_file", "WITH touched AS (SELECT fqn FROM symbols WHERE file_path = 'src/main/java/dao/Brand_4Mapper.java' UNION SELECT parent_fqn FROM symbols WHERE file_path = 'src/main/java/dao/Brand_4Mapper.java') SELECT target_fqn, level, summary, is_stale OR target_fqn IN (SELECT fqn FROM touched WHERE fqn IS NOT NULL) AS is_stale FROM summaries")
def stale_by_file(spark: SparkSession, d: str) -> DataFrame:
    paths = lookup.named(spark, "src/main/java/dao/Brand_4Mapper.java", column="file_path")
    return relations.stale_by_file(frame(spark, d, "symbols"), frame(spark, d, "summaries"), paths)


@query("h15_delete_by_file", "SELECT relation, count(*) AS n FROM edges WHERE from_fqn NOT LIKE 'dao.Brand_4Mapper%' AND to_fqn NOT LIKE 'dao.Brand_4Mapper%' GROUP BY relation")
def delete_by_file(spark: SparkSession, d: str) -> DataFrame:
    paths = lookup.named(spark, "src/main/java/dao/Brand_4Mapper.java", column="file_path")
    return measures.counts_by(relations.delete_by_file(frame(spark, d, "symbols"), frame(spark, d, "edges"), paths)[1], "relation")


@query("h1_upsert", "SELECT target_fqn, level, CASE WHEN is_stale THEN 'new' ELSE summary END AS summary, false AS is_stale FROM summaries WHERE is_stale UNION ALL SELECT target_fqn, level, summary, is_stale FROM summaries WHERE NOT is_stale")
def upsert(spark: SparkSession, d: str) -> DataFrame:
    """Summaries merged in, each twice; the later one wins."""
    old = frame(spark, d, "summaries")
    new = old.where("is_stale").select("target_fqn", F.lit("other").alias("level"), F.explode(F.array(F.struct(F.lit("first").alias("summary"), F.lit(0).alias("at")), F.struct(F.lit("new").alias("summary"), F.lit(1).alias("at")))).alias("s"), F.lit(False).alias("is_stale")).select("target_fqn", "level", "s.summary", "s.at", "is_stale")
    return mutations.upsert_summaries(old, new, order="at")
