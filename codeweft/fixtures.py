"""A layered code graph derived from the test tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import hashlib
import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codeweft.scratch import shared_folder

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

VIEWS = {
    "region_class": "SELECT r_regionkey, 'geo.' || replace(r_name, ' ', '_') AS fqn, r_name AS name FROM region",
    "nation_class": "SELECT n_nationkey, n_regionkey, 'geo.' || n_name || 'Controller' AS fqn, n_name || 'Controller' AS name, 'src/main/java/geo/' || n_name || 'Controller.java' AS file_path FROM nation",
    "customer_method": "SELECT c_custkey, c_mktsegment, n.fqn || '.c' || CAST(c_custkey AS STRING) || '()' AS fqn, n.fqn AS parent_fqn, n.file_path AS file_path FROM customer JOIN nation_class n ON c_nationkey = n.n_nationkey",
    "order_method": "SELECT o_orderkey, o_custkey, 'svc.P' || substr(o_orderpriority, 1, 1) || 'Service' AS parent_fqn, 'svc.P' || substr(o_orderpriority, 1, 1) || 'Service.o' || CAST(o_orderkey AS STRING) || '()' AS fqn, CASE WHEN substr(o_orderpriority, 1, 1) = '3' THEN 'src/test/java/svc/' ELSE 'src/main/java/svc/' END || 'P' || substr(o_orderpriority, 1, 1) || 'Service.java' AS file_path FROM orders",
    "part_method": "SELECT p_partkey, p_name, p_brand, p_size, p_type, 'dao.' || replace(p_brand, '#', '_') || 'Mapper' AS parent_fqn, 'dao.' || replace(p_brand, '#', '_') || 'Mapper.p' || CAST(p_partkey AS STRING) || '()' AS fqn, 'src/main/java/dao/' || replace(p_brand, '#', '_') || 'Mapper.java' AS file_path FROM part",
    "symbols": """
        SELECT fqn, 'class' AS kind, name, CAST(NULL AS STRING) AS file_path, CAST(NULL AS STRING) AS parent_fqn, CAST(NULL AS STRING) AS annotation FROM region_class
        UNION ALL SELECT n.fqn, 'class', n.name, n.file_path, r.fqn, 'RestController' FROM nation_class n JOIN region_class r ON n.n_regionkey = r.r_regionkey
        UNION ALL SELECT fqn, 'method', 'c' || CAST(c_custkey AS STRING), file_path, parent_fqn, NULL FROM customer_method
        UNION ALL SELECT DISTINCT parent_fqn, 'class', substr(parent_fqn, 5), file_path, CAST(NULL AS STRING), 'Service' FROM order_method
        UNION ALL SELECT fqn, 'method', 'o' || CAST(o_orderkey AS STRING), file_path, parent_fqn, NULL FROM order_method
        UNION ALL SELECT DISTINCT parent_fqn, 'class', substr(parent_fqn, 5), file_path, CAST(NULL AS STRING), CASE WHEN CAST(substr(p_brand, 7) AS INT) % 2 = 0 THEN 'Repository' END FROM part_method
        UNION ALL SELECT fqn, 'method', 'p' || CAST(p_partkey AS STRING), file_path, parent_fqn, NULL FROM part_method
        UNION ALL SELECT 'ext.Supplier.s' || CAST(s_suppkey AS STRING) || '()', 'method', 's' || CAST(s_suppkey AS STRING), NULL, 'ext.Supplier', NULL FROM supplier""",
    "edges": """
        SELECT c.fqn AS from_fqn, o.fqn AS to_fqn, 'calls' AS relation FROM order_method o JOIN customer_method c ON o.o_custkey = c.c_custkey
        UNION ALL SELECT o.fqn, p.fqn, 'calls' FROM lineitem JOIN order_method o ON l_orderkey = o.o_orderkey JOIN part_method p ON l_partkey = p.p_partkey
        UNION ALL SELECT DISTINCT p.fqn, 'ext.Supplier.s' || CAST(l_suppkey AS STRING) || '()', 'calls' FROM lineitem JOIN part_method p ON l_partkey = p.p_partkey
        UNION ALL SELECT c.fqn, p.fqn, 'calls' FROM lineitem JOIN order_method o ON l_orderkey = o.o_orderkey JOIN customer_method c ON o.o_custkey = c.c_custkey JOIN part_method p ON l_partkey = p.p_partkey WHERE l_linenumber = 1 AND l_returnflag = 'R'
        UNION ALL SELECT n.fqn, r.fqn, 'inherits' FROM nation_class n JOIN region_class r ON n.n_regionkey = r.r_regionkey
        UNION ALL SELECT fqn, 'java.io.Serializable', 'implements' FROM nation_class WHERE n_nationkey % 2 = 0
        UNION ALL SELECT a.fqn, b.fqn, 'calls' FROM region_class a JOIN region_class b ON b.r_regionkey = (a.r_regionkey + 1) % 5""",
    "entry_points": """
        SELECT fqn AS symbol_fqn, CASE c_mktsegment WHEN 'BUILDING' THEN 'http_api' WHEN 'MACHINERY' THEN 'scheduled' ELSE 'mq_consumer' END AS entry_type, CASE WHEN c_mktsegment = 'BUILDING' THEN '/seg/' || c_mktsegment || '/' || CAST(c_custkey AS STRING) END AS http_path
        FROM customer_method WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')""",
    "dependencies": """
        SELECT from_fqn AS caller_fqn, 'mysql' AS dependency_type, to_fqn AS target, 'strong' AS strength FROM edges WHERE from_fqn LIKE 'svc.%'
        UNION ALL SELECT from_fqn, 'http', to_fqn, 'weak' FROM edges WHERE from_fqn LIKE 'dao.%'""",
    "summaries": "SELECT fqn AS target_fqn, 'method' AS level, p_name AS summary, p_size > 25 AS is_stale FROM part_method",
    "glossary": "SELECT p_type AS code_term, min(p_name) AS business_meaning, min(p_brand) AS first_brand, count(*) AS n FROM part GROUP BY p_type",
    "glossary_source": "SELECT p_type AS code_term, min(parent_fqn) AS source_fqn FROM part_method GROUP BY p_type",
    "constraints": "SELECT DISTINCT o_orderstatus || '-' || o_orderpriority AS name, 'svc.P' || substr(o_orderpriority, 1, 1) || 'Service' AS source_fqn, o_orderstatus AS constraint_type FROM orders",
    "jobs": "SELECT 'job-' || CAST(event_id AS STRING) AS job_id, CASE WHEN event_id % 3 = 0 THEN 'full' ELSE 'incremental' END AS mode, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 7 = 0 THEN 'pending' WHEN event_id % 11 = 0 THEN 'running' ELSE 'complete' END AS status, CAST(event_id % 101 AS INT) AS progress, ts AS created_at FROM events",
    "metadata": "SELECT r_name AS key, CAST(r_regionkey AS STRING) AS value FROM region",
    "anti_patterns": "SELECT CASE WHEN relation = 'calls' THEN 'controller-dao' WHEN relation = 'inherits' THEN 'circular-type' ELSE 'transaction-scope' END AS rule_id, from_fqn, to_fqn, CASE relation WHEN 'calls' THEN 'error' WHEN 'inherits' THEN 'warning' ELSE 'info' END AS severity FROM edges WHERE relation <> 'calls' OR (from_fqn LIKE 'geo.%Controller.%' AND to_fqn LIKE 'dao.%Mapper.%')",
    "llm_usage": "SELECT event_id AS request_id, event_type AS model, CAST(floor(value) AS BIGINT) AS tokens, event_id % 5 = 0 AS cached FROM events",
    "java_files": "SELECT DISTINCT file_path AS path FROM order_method UNION ALL SELECT file_path FROM nation_class UNION ALL SELECT replace(replace(file_path, '/main/java/', '/test/java/'), '.java', 'Test.java') FROM nation_class WHERE n_nationkey % 3 = 0 UNION ALL SELECT replace(replace(file_path, '/main/java/', '/test/java/'), '.java', 'IT.java') FROM nation_class WHERE n_nationkey % 2 = 0",
    "sources": "SELECT fqn, 'p' || CAST(p_partkey AS STRING) AS name, 'void p' || CAST(p_partkey AS STRING) || '() begin assert size > ' || CAST(p_size AS STRING) || ' : \"' || p_name || ' has a size\"; /* note: ' || p_type || ' */ save(); end // ' || CASE WHEN p_size % 2 = 0 THEN 'key: ' ELSE 'plain: ' END || p_brand AS content FROM part_method",
    "comments": "SELECT fqn, p_size AS line, CASE p_size % 4 WHEN 0 THEN ' stock Must Not be negative ' WHEN 1 THEN '数量必须大于零' WHEN 2 THEN 'an order is required' ELSE 'adds one' END || ' ' || p_name AS comment FROM part_method",
    "test_sources": "SELECT p_partkey, '@Test public void checks' || CAST(p_partkey AS STRING) || '(); public void testSize' || CAST(p_size AS STRING) || '(); @Test void testTwice(); void helper();' AS content FROM part",
    "raw_terms": "SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN '[\"a\", \"' || n_name || '\"]' WHEN 1 THEN '[\"a\", ' || CAST(n_nationkey AS STRING) || ']' WHEN 2 THEN 'no json' END AS synonyms FROM nation",
    "requests": "SELECT event_id AS request_id, ts, user_id AS client, event_type AS path, value AS duration_ms, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status FROM events",
}

#: How Spark derives views whose rows are those of ``VIEWS``: keys and short codes are joined, and FQNs made of them last, so
#: that no shuffle moves texts and none is left to a guess at sizes.  Parts are made distinct before they are joined to
#: distinct pairs, which are in one place by part already; suppliers of parts without a brand, whose FQN is null, come apart.
DERIVED = {
    "edges": """
        SELECT n.fqn || '.c' || CAST(c_custkey AS STRING) || '()' AS from_fqn, 'svc.P' || p || 'Service.o' || CAST(o_orderkey AS STRING) || '()' AS to_fqn, 'calls' AS relation FROM (SELECT /*+ SHUFFLE_HASH(c) */ o_orderkey, p, c_custkey, c_nationkey FROM order_code o JOIN customer_code c ON o_custkey = c_custkey) JOIN nation_class n ON c_nationkey = n_nationkey
        UNION ALL SELECT 'svc.P' || p || 'Service.o' || CAST(o_orderkey AS STRING) || '()', 'dao.' || b || 'Mapper.p' || CAST(p_partkey AS STRING) || '()', 'calls' FROM (SELECT /*+ SHUFFLE_HASH(q) */ o_orderkey, p, p_partkey, b FROM (SELECT /*+ SHUFFLE_HASH(o) */ o_orderkey, p, l_partkey FROM line_code l JOIN order_code o ON l_orderkey = o_orderkey) l JOIN part_code q ON l_partkey = p_partkey)
        UNION ALL SELECT 'dao.' || b || 'Mapper.p' || CAST(p_partkey AS STRING) || '()', 'ext.Supplier.s' || CAST(l_suppkey AS STRING) || '()', 'calls' FROM (SELECT /*+ SHUFFLE_HASH(q) */ b, p_partkey, l_suppkey FROM (SELECT DISTINCT l_partkey, l_suppkey FROM (SELECT /*+ REPARTITION(l_partkey) */ l_partkey, l_suppkey FROM line_code)) l JOIN (SELECT DISTINCT p_partkey, b FROM part_code WHERE b IS NOT NULL) q ON l_partkey = p_partkey)
        UNION ALL SELECT DISTINCT CAST(NULL AS STRING), 'ext.Supplier.s' || CAST(l_suppkey AS STRING) || '()', 'calls' FROM line_code JOIN nameless ON l_partkey = p_partkey
        UNION ALL SELECT n.fqn || '.c' || CAST(c_custkey AS STRING) || '()', 'dao.' || b || 'Mapper.p' || CAST(p_partkey AS STRING) || '()', 'calls' FROM (SELECT /*+ SHUFFLE_HASH(q) */ c_custkey, c_nationkey, p_partkey, b FROM (SELECT /*+ SHUFFLE_HASH(c) */ c_custkey, c_nationkey, l_partkey FROM (SELECT /*+ SHUFFLE_HASH(l) */ o_custkey, l_partkey FROM order_code o JOIN (SELECT l_orderkey, l_partkey FROM line_code WHERE l_linenumber = 1 AND l_returnflag = 'R') l ON l_orderkey = o_orderkey) o JOIN customer_code c ON o_custkey = c_custkey) l JOIN part_code q ON l_partkey = p_partkey) JOIN nation_class n ON c_nationkey = n_nationkey
        UNION ALL SELECT n.fqn, r.fqn, 'inherits' FROM nation_class n JOIN region_class r ON n.n_regionkey = r.r_regionkey
        UNION ALL SELECT fqn, 'java.io.Serializable', 'implements' FROM nation_class WHERE n_nationkey % 2 = 0
        UNION ALL SELECT a.fqn, b.fqn, 'calls' FROM region_class a JOIN region_class b ON b.r_regionkey = (a.r_regionkey + 1) % 5""",
}


#: Tables that are joined when edges are derived, their rows of a partition, and the size of what a task reads of a shuffle.
WIDE_TABLES, WIDE_ROWS, WIDE_BYTES = ("customer", "part", "orders", "lineitem"), 500_000, "8m"


def _wide(spark: SparkSession, sf_dir: str) -> SparkSession:
    """A session of the same application that makes as many partitions as the largest of the joined tables has rows for, so
    that a task's memory doesn't grow with any of them: hashed are customers, parts and orders, and streamed line items."""
    wide = spark.newSession()
    n = max(spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in WIDE_TABLES) // WIDE_ROWS + 1
    wide.conf.set("spark.sql.shuffle.partitions", max(n, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    wide.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", WIDE_BYTES)
    return wide


def _codes(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The keys and codes of which edges are made."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in WIDE_TABLES}
    parts = tables["part"].select("p_partkey", F.replace("p_brand", F.lit("#"), F.lit("_")).alias("b"))
    nameless = parts.where("b is null").select("p_partkey")
    return {
        "customer_code": tables["customer"].select("c_custkey", "c_nationkey"),
        "order_code": tables["orders"].select("o_orderkey", "o_custkey", F.substring("o_orderpriority", 1, 1).alias("p")),
        "line_code": tables["lineitem"].select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"),
        "part_code": parts,
        "nameless": nameless.where(F.lit(False)) if nameless.isEmpty() else nameless,  # as a rule there are none
    }


def _needed(text: str) -> list[str]:
    """Views that ``text`` reads, with those that they read, in order of definition."""
    seen: set[str] = set()
    todo = [text]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for name in VIEWS.keys() & words - seen:
            seen.add(name)
            todo.append(VIEWS[name])
    return [name for name in VIEWS if name in seen]


def with_views(body: str, recursive: bool = False) -> str:
    """``body`` with the views it needs as common table expressions; a body may begin with its own ``WITH``."""
    views = ", ".join(f"{name} AS ({VIEWS[name]})" for name in _needed(body))
    own = re.match(r"\s*WITH\s+", body)
    rest = f", {body[own.end():]}" if own else f" {body}"
    return f"WITH {'RECURSIVE ' * recursive}{views}{rest}" if views else body


#: Views that many queries read; they are written once for each session and folder of tables.  ``dependencies`` are not:
#: they are edges under other names, of which a second copy would be written.
WRITTEN = ("customer_method", "order_method", "part_method", "symbols", "edges", "entry_points", "summaries")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views as a DataFrame; annotations become an array."""
    if name not in WRITTEN:
        return _derived(spark, sf_dir, name)
    path = f"{shared_folder(spark)}/graph-{_state(spark, sf_dir)}/{name}"
    key = (spark.sparkContext.applicationId, path)
    if key not in _schemas:
        df = _derived(_wide(spark, sf_dir) if name in DERIVED else spark, sf_dir, name)
        df.write.mode("overwrite").parquet(path)
        _schemas[key] = df.schema
    return spark.read.schema(_schemas[key]).parquet(path)


_schemas: dict[tuple[str, str], StructType] = {}


def _state(spark: SparkSession, sf_dir: str) -> str:
    """A name for what the source tables hold: their files with sizes and times, listed without reading them."""
    root = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for name in TABLES:
        table = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        if files.exists(table):
            listed = files.listFiles(table, True)
            while listed.hasNext():
                file = listed.next()
                found.append(f"{file.getPath()}:{file.getLen()}:{file.getModificationTime()}")
    return hashlib.md5("\n".join([sf_dir, *sorted(found)]).encode()).hexdigest()


def prepare(spark: SparkSession, sf_dir: str) -> None:
    """Writes the views that many queries read, those at one time that don't read each other."""
    left = set(WRITTEN)
    while left:
        ready = [name for name in WRITTEN if name in left and not left & set(_needed(DERIVED.get(name, VIEWS[name])))]
        with ThreadPoolExecutor(len(ready)) as pool:
            list(pool.map(lambda name: frame(spark, sf_dir, name), ready))
        left -= set(ready)


def _derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view from the tables and from the written views that it reads."""
    texts = VIEWS | DERIVED
    inner, known, todo = {name}, set(), [name]
    while todo:
        for other in VIEWS.keys() & set(re.findall(r"\w+", texts[todo.pop()])) - inner - known:
            if other in WRITTEN:
                known.add(other)
            else:
                inner.add(other)
                todo.append(other)
    sql = "WITH " + ", ".join(f"{v} AS ({texts[v]})" for v in VIEWS if v in inner) + f" SELECT * FROM {name}"
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b{t}\b", sql)}
    tables |= {v: frame(spark, sf_dir, v) for v in known} | (_codes(spark, sf_dir) if name in DERIVED else {})
    for t in tables:
        sql = re.sub(rf"(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    out = spark.sql(sql, **tables)
    if name == "symbols":
        out = out.withColumn("annotations", F.when(F.col("annotation").isNotNull(), F.array("annotation"))).drop("annotation")
    return out


def nested_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nation classes as nested metadata: customers are their methods, with calls inside and outside the project.

    Customers of the segment BUILDING are HTTP endpoints, MACHINERY is scheduled and HOUSEHOLD listens to a queue;
    those with a key divisible by 3 call a cache, by 5 another service, by 7 a flagged base mapper.
    """
    calls = frame(spark, sf_dir, "edges").where("relation = 'calls' and from_fqn like 'geo.%Controller.%'").select("from_fqn", F.col("to_fqn").alias("to"), F.lit(False).alias("base"))
    people = frame(spark, sf_dir, "customer_method")
    for divisor, target, base in ((1, "java.util.List.add(java.lang.Object)", False), (3, "org.springframework.data.redis.core.RedisTemplate.opsForValue()", False), (5, "org.springframework.web.client.RestTemplate.getForObject(java.lang.String)", False), (7, "dao.BaseMapper.selectById(java.lang.Long)", True)):
        calls = calls.unionByName(people.where(f"c_custkey % {divisor} = 0").select(F.col("fqn").alias("from_fqn"), F.lit(target).alias("to"), F.lit(base).alias("base")))
    none = F.lit(None).cast("string")
    call = F.struct(F.col("to").alias("toFqn"), F.lit("invokevirtual").alias("kind"), F.lit(1).alias("line"), F.lit(None).cast("int").alias("lineNumber"), F.col("base").alias("isMybatisBaseMapperCall"))
    people = people.join(calls.groupBy(F.col("from_fqn").alias("fqn")).agg(F.collect_list(call).alias("calls")), "fqn")
    segment = F.col("c_mktsegment")
    method = F.struct(
        "fqn", F.lit(None).cast("int").alias("line"), F.col("c_custkey").cast("int").alias("lineNumber"), none.alias("signature"), F.array(F.lit("public")).alias("modifiers"),
        F.when(segment == "HOUSEHOLD", F.array(F.lit("@RabbitListener"))).otherwise(F.array().cast("array<string>")).alias("annotations"),
        (segment == "BUILDING").alias("isRestEndpoint"), F.lit(None).cast("boolean").alias("isEntryPoint"), none.alias("entryPointType"), (segment == "MACHINERY").alias("isScheduled"),
        none.alias("httpMethod"), F.concat(F.lit("seg/"), segment, F.lit("/"), F.col("c_custkey").cast("string")).alias("apiPath"), none.alias("scheduledCron"),
        F.create_map(F.lit("queue"), segment, F.lit("scheduled_cron"), F.lit("0 0 * * *")).alias("attributes"), "calls",
    )
    methods = people.groupBy(F.col("parent_fqn").alias("fqn")).agg(F.collect_list(method).alias("methods"))
    up = frame(spark, sf_dir, "edges").where("relation <> 'calls'").groupBy(F.col("from_fqn").alias("fqn")).agg(F.collect_list(F.struct(F.col("to_fqn").alias("fqn"), F.when(F.col("relation") == "inherits", "extends").otherwise("implements").alias("kind"))).alias("inheritance"))
    fields = F.array(F.struct(F.lit("orderService").alias("name"), F.lit("svc.P1Service").alias("type"), F.array(F.lit("private")).alias("modifiers"), F.array(F.lit("@Autowired")).alias("annotations")))
    own = frame(spark, sf_dir, "nation_class").select("fqn", none.alias("type"), F.lit("class").alias("nodeType"), F.lit(1).alias("line"), F.array(F.lit("public")).alias("modifiers"), F.array(F.lit("@RestController")).alias("annotations"), F.lit("/api/").alias("classBasePath"))
    return own.join(up, "fqn", "left").withColumn("fields", fields).join(methods, "fqn", "left")


def wired_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class for each customer, in nested form, that is wired to others; its key decides everything.

    Classes ``app.C<key>`` with even keys are services; one with a key divisible by 3 extends that of a third of it, by 4
    implements ``app.I0`` or ``app.I1``.  They inject by field, by constructor and by the method of a bean.
    """
    key = F.col("c_custkey").cast("long")

    def every(n: int) -> Column:
        return key % n == 0

    def text(*pieces: Column | str) -> Column:
        return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in pieces))

    def some(*pairs: tuple[Column, Column | str]) -> Column:
        return F.array_compact(F.array(*(F.when(test, F.lit(x) if isinstance(x, str) else x) for test, x in pairs)))

    own, third, half = text("app.C", key), F.floor(key / 3), F.floor(key / 2)
    up = F.array_compact(F.array(
        F.when(every(3), F.struct(text("app.C", third).alias("fqn"), F.lit("extends").alias("kind"))),
        F.when(every(4), F.struct(text("app.I", F.floor(key % 8 / 4)).alias("fqn"), F.lit("implements").alias("kind"))),
        F.when(every(11), F.struct(F.lit("org.quartz.Job").alias("fqn"), F.lit("implements").alias("kind"))),
    ))
    marks = some((every(2), "@org.springframework.stereotype.Service"), (every(50), "@Primary"), (every(10), text('@Qualifier("q', key % 30, '")')), (every(9), '@Scope("prototype")'))
    odd, fourth = key % 2 == 1, every(4)
    injected = some((odd, "@Autowired"), (~odd & fourth, "@Resource"), (~odd & fourth, text('@Qualifier("c', 8 * (key % 4 + key % 3 + 1), '")')))
    wanted = F.when(every(5), text("app.C", half)).when(key % 5 == 1, "app.I1").otherwise("app.I0")
    public = F.array(F.lit("private"))

    def field(name: Column, kind: Column, annotations: Column) -> Column:
        return F.struct(name.alias("name"), kind.alias("type"), public.alias("modifiers"), annotations.alias("annotations"))

    fields = F.array(field(F.when(every(7), text("c", 4 * (key % 5 + 1))).otherwise("dep"), wanted, injected), field(F.lit("count"), F.lit("int"), some((every(3), text('@Value("${app.k', key, ':1}")')))))

    def method(name: str, descriptor: Column, annotations: Column, qualifier: Column) -> Column:
        values = {"fqn": text(own, f".{name}"), "signature": descriptor, "annotations": annotations, "attributes": F.create_map(F.lit("qualifier.0"), qualifier)}
        kinds = {"fqn": "string", "line": "int", "lineNumber": "int", "signature": "string", "modifiers": "array<string>", "annotations": "array<string>"}
        kinds |= {"isRestEndpoint": "boolean", "isEntryPoint": "boolean", "entryPointType": "string", "isScheduled": "boolean", "httpMethod": "string", "apiPath": "string", "scheduledCron": "string"}
        kinds |= {"attributes": "map<string,string>", "calls": "array<struct<toFqn:string,kind:string,line:int,lineNumber:int,isMybatisBaseMapperCall:boolean>>"}
        return F.struct(*(values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in kinds.items()))

    none = F.lit(None).cast("string")
    web = some((every(8), "@Bean"), (every(40), "@Primary"), (every(7), text('@GetMapping("/p', key, '")')))
    methods = F.array(
        method("<init>(..)", text("(Lapp/C", third, ";I[Ljava/lang/String;)V"), some((every(3), "@Inject")), F.when(every(6), text("c", third))),
        method("make(..)", text("([[ILapp/I0;)Lapp/C", key + 1, ";"), web, none),
        method("execute(..)", F.lit("(Lorg/quartz/JobExecutionContext;)V"), some((every(13), '@Transactional(propagation = "x")'), (every(26), "@Select"), (every(17), "@Lorg/aspectj/lang/annotation/Around;")), none),
    )
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    return rows.select(
        own.alias("fqn"), none.alias("type"), F.lit("class").alias("nodeType"), F.lit(1).alias("line"), F.array(F.lit("public")).alias("modifiers"),
        marks.alias("annotations"), none.alias("classBasePath"), up.alias("inheritance"), fields.alias("fields"), methods.alias("methods"),
    )
