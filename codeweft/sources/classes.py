"""Nested class metadata as a source of symbols, edges and entry points, and such metadata made from the graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions.scalars import http_path, simple_name
from codeweft.scratch import cut_small

SCHEMA = (
    "fqn string, type string, nodeType string, line int, modifiers array<string>, annotations array<string>, classBasePath string, "
    "inheritance array<struct<fqn:string,kind:string>>, "
    "fields array<struct<name:string,type:string,modifiers:array<string>,annotations:array<string>>>, "
    "methods array<struct<fqn:string,line:int,lineNumber:int,signature:string,modifiers:array<string>,annotations:array<string>,"
    "isRestEndpoint:boolean,isEntryPoint:boolean,entryPointType:string,isScheduled:boolean,httpMethod:string,apiPath:string,scheduledCron:string,"
    "attributes:map<string,string>,calls:array<struct<toFqn:string,kind:string,line:int,lineNumber:int,isMybatisBaseMapperCall:boolean>>>>"
)

# Packages whose calls are not kept as edges.
EXTERNAL = (
    "java.", "javax.", "jdk.", "sun.", "com.sun.",
    "org.w3c.", "org.xml.", "org.omg.", "org.ietf.",
    "org.slf4j.", "org.apache.", "org.springframework.",
    "com.fasterxml.", "com.google.", "org.hibernate.",
)
# Listener annotations of message queues.
LISTENERS = ("RabbitListener", "KafkaListener", "JmsListener")
#: Methods of a class that one nested row holds, about.
METHODS = 1000


def read_classes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def outer_name(fqn: Column) -> Column:
    """The outer class of an inner one, whose source file has both."""
    return F.substring_index(fqn, "$", 1)


def flatten_symbols(classes: DataFrame, sources: DataFrame | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Classes, methods and fields as symbols; ``sources`` (``fqn, file_path``) gives their files.  Columns of the classes
    that ``carry`` names come first.

    ``type`` and ``line`` may have their other spellings; a field without a name is no symbol.
    """
    kind = F.when(F.coalesce("type", "nodeType") == "interface", "interface").otherwise("class")
    none, strings = F.lit(None).cast("string"), F.array().cast("array<string>")
    own = classes.select(*carry, F.col("fqn").alias("class_fqn"), "fqn", kind.alias("kind"), F.substring_index("fqn", ".", -1).alias("name"), none.alias("parent_fqn"), F.col("line").alias("line_number"), "modifiers", none.alias("signature"), "annotations")
    inside = classes.select(*carry, F.col("fqn").alias("class_fqn"), F.explode("methods").alias("m"))
    methods = inside.select(*carry, "class_fqn", F.col("m.fqn").alias("fqn"), F.lit("method").alias("kind"), simple_name(F.col("m.fqn")).alias("name"), F.col("class_fqn").alias("parent_fqn"), F.coalesce("m.line", "m.lineNumber").alias("line_number"), "m.modifiers", "m.signature", "m.annotations")
    inside = classes.select(*carry, F.col("fqn").alias("class_fqn"), F.explode("fields").alias("f")).where("f.name is not null and f.name <> ''")
    fields = inside.select(*carry, "class_fqn", F.concat("class_fqn", F.lit("."), "f.name").alias("fqn"), F.lit("field").alias("kind"), F.col("f.name").alias("name"), F.col("class_fqn").alias("parent_fqn"), F.lit(None).cast("int").alias("line_number"), "f.modifiers", F.col("f.type").alias("signature"), "f.annotations")
    out = own.unionByName(methods).unionByName(fields)
    if sources is None:
        out = out.withColumn("file_path", none)
    else:
        files = sources.select(F.col("fqn").alias("__outer"), "file_path")
        out = out.join(files, outer_name(F.col("class_fqn")) == F.col("__outer"), "left")
    lists = {c: F.coalesce(c, strings).alias(c) for c in ("modifiers", "annotations")}
    return out.select(*carry, "fqn", "kind", "name", "file_path", "line_number", lists["modifiers"], "signature", "parent_fqn", lists["annotations"])


def flatten_edges(classes: DataFrame, external: tuple[str, ...] = EXTERNAL, carry: tuple[str, ...] = ()) -> DataFrame:
    """``from_fqn, to_fqn, relation, metadata``: inheritance, to whatever type, and calls outside the external packages."""
    parents = classes.select(*carry, F.col("fqn").alias("from_fqn"), F.explode("inheritance").alias("i"))
    extends = F.coalesce("i.kind", F.lit("extends")) == "extends"
    nothing = F.lit(None).cast("map<string,string>")
    up = parents.select(*carry, "from_fqn", F.col("i.fqn").alias("to_fqn"), F.when(extends, "inherits").otherwise("implements").alias("relation"), nothing.alias("metadata"))
    calls = classes.select(*carry, F.explode("methods").alias("m")).select(*carry, F.col("m.fqn").alias("from_fqn"), F.explode("m.calls").alias("c"))
    to = F.col("c.toFqn")
    inside = (to != "") & ~reduce(Column.__or__, [to.startswith(prefix) for prefix in external])
    where = F.create_map(F.lit("line"), F.coalesce("c.line", "c.lineNumber").cast("string"), F.lit("kind"), F.col("c.kind"))
    return up.unionByName(calls.where(inside).select(*carry, "from_fqn", to.alias("to_fqn"), F.lit("calls").alias("relation"), where.alias("metadata")))


def entry_points(classes: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """HTTP, scheduled and message-queue entry points of the methods; one method may be several."""
    methods = classes.select(*carry, "classBasePath", F.explode("methods").alias("m"))
    none = F.lit(None).cast("string")

    def entry(test: Column, kind: str, method: Column = none, path: Column = none, cron: Column = none, queue: Column = none) -> Column:
        return F.when(test, F.struct(F.lit(kind).alias("t"), method.alias("h"), path.alias("p"), cron.alias("c"), queue.alias("q")))

    web = (F.coalesce("m.isRestEndpoint", F.lit(False)) | F.coalesce("m.isEntryPoint", F.lit(False))) & F.coalesce("m.entryPointType", F.lit("rest_endpoint")).isin("rest_endpoint", "http_api")
    heard = F.exists(F.coalesce("m.annotations", F.array().cast("array<string>")), lambda a: reduce(Column.__or__, [a.contains(name) for name in LISTENERS]))
    found = F.array_compact(
        F.array(
            entry(web, "http_api", F.coalesce("m.httpMethod", F.lit("GET")), http_path(F.col("classBasePath"), F.col("m.apiPath"))),
            entry(F.coalesce("m.isScheduled", F.lit(False)), "scheduled", cron=F.coalesce(F.when(F.col("m.scheduledCron") != "", F.col("m.scheduledCron")), F.col("m.attributes")["scheduled_cron"])),
            entry(heard, "mq_consumer", queue=F.col("m.attributes")["queue"]),
        )
    )
    rows = methods.select(*carry, F.col("m.fqn").alias("symbol_fqn"), F.explode(found).alias("e"))
    return rows.select(*carry, "symbol_fqn", F.col("e.t").alias("entry_type"), F.col("e.h").alias("http_method"), F.col("e.p").alias("http_path"), F.col("e.c").alias("cron_expression"), F.col("e.q").alias("mq_queue"))


def nest(symbols: DataFrame, edges: DataFrame, most: int = METHODS) -> DataFrame:
    """``fqn, type, annotations, part, methods``: classes with their methods and these with their calls, from flat tables.

    A class without methods has an empty list, and so a method without calls.  A class of more than ``most`` methods comes in
    several rows, its parts from 0, of about so many at most: methods are dealt to them by a hash, all of one name to the
    same.  So no row and no task holds a whole class.  The calls of a method stay in one list.
    """
    methods = symbols.where("kind = 'method' and parent_fqn is not null").select("fqn", "parent_fqn")
    parts = F.ceil(F.count("*") / most).cast("int")
    large = cut_small(methods.groupBy("parent_fqn").agg(parts.alias("parts")).where("parts > 1"))  # at most a row for ``most`` methods
    parts = F.coalesce("parts", F.lit(1))
    dealt = methods.join(large, "parent_fqn", "left").select("fqn", "parent_fqn", F.pmod(F.xxhash64("fqn"), parts).cast("int").alias("part"))
    calls = edges.where("relation = 'calls' and from_fqn is not null").groupBy(F.col("from_fqn").alias("fqn")).agg(F.sort_array(F.collect_list("to_fqn")).alias("calls"))
    none = F.array().cast("array<string>")
    lists = dealt.join(calls, "fqn", "left").groupBy(F.col("parent_fqn").alias("fqn"), "part").agg(F.sort_array(F.collect_list(F.struct("fqn", F.coalesce("calls", none).alias("calls")))).alias("methods"))
    classes = symbols.where("kind in ('class', 'interface', 'enum')").select("fqn", F.col("kind").alias("type"), "annotations").join(large.withColumnRenamed("parent_fqn", "fqn"), "fqn", "left")
    rows = classes.select("fqn", "type", "annotations", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    out = rows.hint("shuffle_hash").join(lists, ["fqn", "part"], "left")  # by part too, and no list is sorted or moved again
    return out.select("fqn", "type", "annotations", "part", F.coalesce("methods", F.array().cast(out.schema["methods"].dataType)).alias("methods"))


def outline(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """``fqn, type, n_methods, n_calls`` of classes, interfaces and enums, counted in the flat tables."""
    calls = edges.where("relation = 'calls'").groupBy(F.col("from_fqn").alias("fqn")).agg(F.count("*").alias("n"))
    methods = symbols.where("kind = 'method' and parent_fqn is not null").select("fqn", "parent_fqn").join(calls, "fqn", "left")
    counts = methods.groupBy(F.col("parent_fqn").alias("fqn")).agg(F.count("*").alias("methods"), F.sum("n").alias("calls"))
    classes = symbols.where("kind in ('class', 'interface', 'enum')").select("fqn", F.col("kind").alias("type"))
    zero = F.lit(0).cast("long")
    return classes.join(counts, "fqn", "left").select("fqn", "type", F.coalesce("methods", zero).alias("n_methods"), F.coalesce("calls", zero).alias("n_calls"))


def _n_methods(classes: DataFrame) -> Column:
    return F.col("n_methods") if "n_methods" in classes.columns else F.size("methods").cast("long")


def _n_calls(classes: DataFrame) -> Column:
    nested = F.aggregate("methods", F.lit(0).cast("long"), lambda n, m: n + F.size(m["calls"])) if "n_calls" not in classes.columns else None
    return F.col("n_calls") if nested is None else nested


def light_index(classes: DataFrame) -> DataFrame:
    """``fqn, type, n_methods, n_calls`` of nested classes, or of an ``outline``, without enums; parts of a class are put together."""
    rows = classes.where("type <> 'enum'").select("fqn", "type", _n_methods(classes).alias("n_methods"), _n_calls(classes).alias("n_calls"))
    return rows.groupBy("fqn", "type").agg(F.sum("n_methods").alias("n_methods"), F.sum("n_calls").alias("n_calls")) if "part" in classes.columns else rows


def light_index_batch(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """``file_path, success, n_classes, error`` for each file asked for."""
    own = symbols.where("kind in ('class', 'interface')").groupBy("file_path").agg(F.count("*").alias("n"))
    joined = files.select("file_path").distinct().join(own, "file_path", "left")
    found = F.col("n").isNotNull()
    return joined.select("file_path", found.alias("success"), F.coalesce("n", F.lit(0)).cast("long").alias("n_classes"), F.when(~found, "no class found").alias("error"))


def totals(classes: DataFrame, *keys: str) -> DataFrame:
    """Classes, methods and calls, by ``keys`` or in all, of nested classes or of an ``outline``."""
    n = F.count_if(F.col("part") == 0) if "part" in classes.columns else F.count("*")
    return classes.groupBy(*keys).agg(n.alias("n_classes"), F.sum(_n_methods(classes)).alias("n_methods"), F.sum(_n_calls(classes)).alias("n_calls"))


def progress(classes: DataFrame, batch: str) -> DataFrame:
    """Totals of each batch of classes, those so far, and the percentage done, rounded down.

    ``batch`` names a column of batch numbers; there is one row for each.
    """
    from pyspark.sql import Window

    own = totals(classes, batch)
    so_far, everything = Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, 0), Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = {f"total_{c}": F.sum(f"n_{c}").over(so_far) for c in ("classes", "methods", "calls")}
    return own.withColumns(sums).withColumn("percentage", F.floor(100 * F.col("total_classes") / F.sum("n_classes").over(everything)).cast("int"))


def pipeline(classes: DataFrame, sources: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables of a module's nested classes: symbols, edges, entry points and dependencies."""
    from codeweft.plans.dependencies import detect_dependencies

    return {"symbols": flatten_symbols(classes, sources), "edges": flatten_edges(classes), "entry_points": entry_points(classes), "dependencies": detect_dependencies(classes)}


def stale_modules(hashes: DataFrame, stored: DataFrame) -> DataFrame:
    """``module, hash`` of the modules whose hash isn't the stored one, new ones too."""
    known = stored.select("module", F.col("hash").alias("stored"))
    return hashes.join(known, "module", "left").where(~F.col("hash").eqNullSafe(F.col("stored"))).select("module", "hash")
