"""Queries over wired classes: types of members, injection points and beans, annotations and their handlers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.fixtures import wired_classes
from codeweft.functions import descriptors
from codeweft.plans import handlers, wiring
from codeweft.queries import query

#: The fixture's classes by their key, as DuckDB sees them.
_K = "keys AS (SELECT CAST(c_custkey AS BIGINT) AS k FROM customer)"
_POINTS = f"""{_K},
points AS (
  SELECT k, CASE WHEN k % 7 = 0 THEN 'c' || 4 * (k % 5 + 1) ELSE 'dep' END AS member, 'field:' || CASE WHEN k % 2 = 1 THEN 'autowired' ELSE 'resource' END AS kind,
    CASE WHEN k % 5 = 0 THEN 'app.C' || k // 2 WHEN k % 5 = 1 THEN 'app.I1' ELSE 'app.I0' END AS type, CASE WHEN k % 2 = 0 THEN 'c' || 8 * (k % 4 + k % 3 + 1) END AS qualifier FROM keys WHERE k % 2 = 1 OR k % 4 = 0
  UNION ALL SELECT k, '<init>#' || place, 'constructor:inject', CASE place WHEN 0 THEN 'app.C' || k // 3 WHEN 1 THEN 'int' ELSE 'java.lang.String[]' END, CASE WHEN place = 0 AND k % 6 = 0 THEN 'c' || k // 3 END FROM keys, range(3) r(place) WHERE k % 3 = 0
  UNION ALL SELECT k, 'make#' || place, 'bean', CASE place WHEN 0 THEN 'int[][]' ELSE 'app.I0' END, NULL FROM keys, range(2) r(place) WHERE k % 8 = 0)"""
_WIRED = f"""WITH RECURSIVE {_POINTS},
parents AS (SELECT 'app.C' || k AS type, 'app.C' || k // 3 AS super FROM keys WHERE k % 3 = 0 UNION ALL SELECT 'app.C' || k, 'app.I' || k % 8 // 4 FROM keys WHERE k % 4 = 0 UNION ALL SELECT 'app.C' || k, 'org.quartz.Job' FROM keys WHERE k % 11 = 0),
above AS (SELECT type, super FROM parents UNION SELECT a.type, p.super FROM above a JOIN parents p ON p.type = a.super),
beans AS (SELECT 'app.C' || k AS bean, 'app.C' || k AS type, 'c' || k AS name, CASE WHEN k % 10 = 0 THEN 'q' || k % 30 END AS qualifier, k % 50 = 0 AS is_primary FROM keys WHERE k % 2 = 0
  UNION ALL SELECT 'app.C' || k || '.make(..)', 'app.C' || k + 1, 'make', NULL, k % 40 = 0 FROM keys WHERE k % 8 = 0),
offered AS (SELECT bean, name, qualifier, is_primary, type FROM beans UNION SELECT bean, name, qualifier, is_primary, super FROM beans JOIN above USING (type)),
by_type AS (SELECT type, count(*) AS n, min(bean) AS only_bean, count(*) FILTER (is_primary) AS n_primary, min(bean) FILTER (is_primary) AS primary_bean FROM offered GROUP BY type),
by_name AS (SELECT type, called, count(*) AS n_called, min(bean) AS bean_called FROM (SELECT type, bean, name AS called FROM offered UNION SELECT type, bean, qualifier FROM offered WHERE qualifier IS NOT NULL) GROUP BY type, called),
judged AS (SELECT p.*, coalesce(t.n, 0) AS n_candidates, CASE WHEN p.qualifier IS NOT NULL THEN CASE WHEN q.n_called = 1 THEN 'qualifier' WHEN q.n_called > 1 THEN 'ambiguous' ELSE 'missing' END
    WHEN t.n IS NULL THEN 'missing' WHEN t.n = 1 THEN 'type' WHEN t.n_primary = 1 THEN 'primary' WHEN t.n_primary > 1 THEN 'ambiguous' WHEN m.n_called = 1 THEN 'name' ELSE 'ambiguous' END AS how,
    t.only_bean, t.primary_bean, q.bean_called AS qualified, m.bean_called FROM points p LEFT JOIN by_type t USING (type) LEFT JOIN by_name q ON q.type = p.type AND q.called = p.qualifier LEFT JOIN by_name m ON m.type = p.type AND m.called = p.member)"""


@query("n9_wired", f"{_WIRED} SELECT 'app.C' || k AS class_fqn, member, kind, type, qualifier, n_candidates, how, CASE how WHEN 'qualifier' THEN qualified WHEN 'type' THEN only_bean WHEN 'primary' THEN primary_bean WHEN 'name' THEN bean_called END AS bean FROM judged")
def wired(spark: SparkSession, d: str) -> DataFrame:
    classes = wired_classes(spark, d)
    return wiring.wired(wiring.points_of(classes), wiring.beans_of(classes), wiring.supertypes(classes))


@query("n9_wiring_edges", f"{_WIRED} SELECT DISTINCT 'app.C' || k AS from_fqn, CASE how WHEN 'qualifier' THEN qualified WHEN 'type' THEN only_bean WHEN 'primary' THEN primary_bean WHEN 'name' THEN bean_called END AS to_fqn, 'wires' AS relation, kind FROM judged WHERE how NOT IN ('missing', 'ambiguous')")
def wiring_edges(spark: SparkSession, d: str) -> DataFrame:
    return wiring.wiring_edges(wired(spark, d))


@query("n9_injection_edges", f"WITH {_POINTS} SELECT type AS from_fqn, 'app.C' || k AS to_fqn, 'member_of' AS relation, CASE kind WHEN 'bean' THEN 'bean_dependency' ELSE kind END AS kind, CAST(split_part(member, '#', 2) AS INT) AS place, qualifier FROM points WHERE kind NOT LIKE 'field%'")
def injection_edges(spark: SparkSession, d: str) -> DataFrame:
    return wiring.injection_edges(wiring.methods_of(wired_classes(spark, d)))


@query("n3_field_edges", f"WITH {_K} SELECT CASE WHEN k % 5 = 0 THEN 'app.C' || k // 2 WHEN k % 5 = 1 THEN 'app.I1' ELSE 'app.I0' END AS from_fqn, 'app.C' || k AS to_fqn, 'member_of' AS relation, CASE WHEN k % 2 = 1 THEN 'class:autowired' WHEN k % 4 = 0 THEN 'class:resource' ELSE 'class' END AS kind, CAST(NULL AS INT) AS place, CASE WHEN k % 4 = 0 THEN 'c' || 8 * (k % 4 + k % 3 + 1) END AS qualifier FROM keys")
def field_edges(spark: SparkSession, d: str) -> DataFrame:
    return wiring.field_edges(wiring.fields_of(wired_classes(spark, d)))


@query("n4_member_edges", f"WITH {_K} SELECT 'app.C' || k + 1 AS from_fqn, 'app.C' || k || '.make(..)' AS to_fqn, 'member_of' AS relation, 'return' AS kind, CAST(NULL AS INT) AS place, CAST(NULL AS VARCHAR) AS qualifier FROM keys UNION ALL SELECT t, 'app.C' || k || m, 'member_of', 'argument', CAST(p AS INT), NULL FROM keys, LATERAL (VALUES ('app.C' || k // 3, '.<init>(..)', 0), ('java.lang.String[]', '.<init>(..)', 2), ('int[][]', '.make(..)', 0), ('app.I0', '.make(..)', 1), ('org.quartz.JobExecutionContext', '.execute(..)', 0)) v(t, m, p)")
def member_edges(spark: SparkSession, d: str) -> DataFrame:
    return wiring.member_edges(wiring.methods_of(wired_classes(spark, d)))


@query("g37_signatures", f"WITH {_K} SELECT 'app.C' || k || m AS fqn, s AS signature, r AS returns FROM keys, LATERAL (VALUES ('.<init>(..)', '(app.C' || k // 3 || ', int, java.lang.String[])', 'void'), ('.make(..)', '(int[][], app.I0)', 'app.C' || k + 1), ('.execute(..)', '(org.quartz.JobExecutionContext)', 'void')) v(m, s, r)")
def signatures(spark: SparkSession, d: str) -> DataFrame:
    rows = wired_classes(spark, d).select(F.explode("methods").alias("m"))
    return rows.select("m.fqn", descriptors.signature(F.col("m.signature")).alias("signature"), descriptors.return_type(F.col("m.signature")).alias("returns"))


@query("g36_modifiers", "SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_partkey & 1 > 0 THEN 'public' END, CASE WHEN p_partkey & 2 > 0 THEN 'private' END, CASE WHEN p_partkey & 4 > 0 THEN 'protected' END, CASE WHEN p_partkey & 8 > 0 THEN 'static' END, CASE WHEN p_partkey & 16 > 0 THEN 'final' END, CASE WHEN p_partkey & 1024 > 0 THEN 'abstract' END], lambda x: x IS NOT NULL), ' ') AS modifiers FROM part")
def modifiers(spark: SparkSession, d: str) -> DataFrame:
    """Part keys read as access flags."""
    rows = spark.read.parquet(f"{d}/part.parquet").select("p_partkey")
    return rows.select("p_partkey", F.array_join(descriptors.modifiers(F.col("p_partkey")), " ").alias("modifiers"))


_SAID = f"""WITH {_K}, said AS (
  SELECT 'app.C' || k AS owner, 'class' AS scope, a AS annotation, h AS handler, p AS priority FROM keys, LATERAL (VALUES (k % 2 = 0, '@org.springframework.stereotype.Service', 'SpringBean', 100), (k % 50 = 0, '@Primary', 'Primary', 65), (k % 9 = 0, '@Scope("prototype")', 'Scope', 60)) v(ok, a, h, p) WHERE ok
  UNION ALL SELECT 'app.C' || k || CASE WHEN place = 1 THEN '.count' WHEN k % 7 = 0 THEN '.c' || 4 * (k % 5 + 1) ELSE '.dep' END, 'field', a, h, p FROM keys, LATERAL (VALUES (k % 2 = 1, 0, '@Autowired', 'Autowired', 95), (k % 4 = 0, 0, '@Resource', 'Resource', 91), (k % 4 = 0, 0, '@Qualifier("c' || 8 * (k % 4 + k % 3 + 1) || '")', 'Qualifier', 90), (k % 3 = 0, 1, '@Value("${{app.k' || k || ':1}}")', 'Value', 93)) v(ok, place, a, h, p) WHERE ok
  UNION ALL SELECT 'app.C' || k || m, 'method', a, h, p FROM keys, LATERAL (VALUES (k % 8 = 0, '.make(..)', '@Bean', 'Bean', 92), (k % 7 = 0, '.make(..)', '@GetMapping("/p' || k || '")', 'RestMapping', 93), (k % 13 = 0, '.execute(..)', '@Transactional(propagation = "x")', 'Transactional', 90), (k % 17 = 0, '.execute(..)', '@Lorg/aspectj/lang/annotation/Around;', 'Aop', 80)) v(ok, m, a, h, p) WHERE ok)"""


@query("n12_handled", f"{_SAID} SELECT owner, scope, annotation, handler, CAST(priority AS INT) AS priority FROM said")
def handled(spark: SparkSession, d: str) -> DataFrame:
    return handlers.handled(handlers.annotations_of(wired_classes(spark, d))).drop("attributes")


_notes = "CASE handler WHEN 'SpringBean' THEN 'springBeanType=service' WHEN 'Primary' THEN 'primary=true' WHEN 'Scope' THEN 'springScope=prototype' WHEN 'Value' THEN 'configKey=app.k' || regexp_extract(annotation, 'k([0-9]+)', 1) WHEN 'Bean' THEN 'entryPointType=spring_bean;isBean=true;isEntryPoint=true' WHEN 'Transactional' THEN 'isTransactional=true' WHEN 'Aop' THEN 'adviceType=around;isAopAdvice=true' WHEN 'RestMapping' THEN 'apiPath=' || regexp_extract(annotation, '\"(.*)\"', 1) || ';entryPointType=rest_endpoint;httpMethod=GET;isEntryPoint=true;isRestEndpoint=true' END"


@query("n8_annotation_notes", f"{_SAID}, pairs AS (SELECT owner, scope, priority, handler, unnest(string_split({_notes}, ';')) AS pair FROM said), best AS (SELECT owner, scope, split_part(pair, '=', 1) AS key, pair FROM pairs WHERE pair IS NOT NULL QUALIFY row_number() OVER (PARTITION BY owner, scope, split_part(pair, '=', 1) ORDER BY priority DESC) = 1), own AS (SELECT owner, scope, max(CASE WHEN scope = 'class' AND handler IN ('SpringBean', 'Scope') THEN 1 ELSE 0 END) = 1 AS needs_proxy FROM said GROUP BY owner, scope) SELECT owner, scope, needs_proxy, coalesce((SELECT string_agg(pair, ';' ORDER BY key) FROM best b WHERE b.owner = own.owner AND b.scope = own.scope), '') AS attributes FROM own")
def annotation_notes(spark: SparkSession, d: str) -> DataFrame:
    noted = handlers.noted(handlers.annotations_of(wired_classes(spark, d)))
    pairs = F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return noted.withColumn("attributes", F.array_join(F.sort_array(pairs), ";"))


@query("n10_quartz_entries", f"WITH {_K} SELECT 'app.C' || k || '.execute(..)' AS symbol_fqn, 'quartz_job' AS entry_type FROM keys WHERE k % 11 = 0")
def quartz_entries(spark: SparkSession, d: str) -> DataFrame:
    return handlers.quartz_entries(wired_classes(spark, d))


_proxies = f"{_SAID}, own AS (SELECT 'app.C' || k AS fqn, k % 3 = 0 AS final, k % 4 = 0 OR k % 11 = 0 AS has_interfaces, k % 2 = 0 OR k % 9 = 0 AS needed FROM keys)"


@query("g40_proxy_types", f"{_proxies} SELECT fqn, CASE WHEN needed THEN CASE WHEN NOT final AND has_interfaces THEN 'jdk_or_cglib' ELSE 'cglib' END END AS proxy_type FROM own")
def proxy_types(spark: SparkSession, d: str) -> DataFrame:
    """Every third class stands for a final one."""
    classes = wired_classes(spark, d)
    noted = handlers.noted(handlers.annotations_of(classes)).where("scope = 'class'").select(F.col("owner").alias("fqn"), "needs_proxy")
    interfaces = F.exists("inheritance", lambda i: i["kind"] == "implements")
    final = F.exists("inheritance", lambda i: i["kind"] == "extends")
    joined = classes.select("fqn", final.alias("final"), interfaces.alias("interfaces")).join(noted, "fqn", "left")
    return joined.select("fqn", descriptors.proxy_type(F.coalesce("needs_proxy", F.lit(False)), F.col("final"), F.col("interfaces")).alias("proxy_type"))


@query("n6_base_mapper_calls", "SELECT to_fqn, CASE CAST(substr(to_fqn, 5, 1) = 'B' AS INT) WHEN 1 THEN 'SELECT' END AS operation FROM edges WHERE relation = 'calls' AND to_fqn LIKE 'dao.%'")
def base_mapper_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls of parts, taken for calls of the inherited ``selectById``."""
    from codeweft.fixtures import frame

    calls = frame(spark, d, "edges").where("relation = 'calls' and to_fqn like 'dao.%'")
    target = F.regexp_replace("to_fqn", r"\.p[0-9]+\(\)$", ".selectById()")
    return calls.select("to_fqn", handlers.base_mapper_operation(target).alias("operation"))
