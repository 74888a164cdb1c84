"""Annotations and what they say of a class, method or field: a table of handlers, and the attributes they give."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPRING = "org.springframework."
_WEB = f"{_SPRING}web.bind.annotation."
_CONTEXT = f"{_SPRING}context.annotation."
_FACTORY = f"{_SPRING}beans.factory.annotation."
_ASPECT = "org.aspectj.lang.annotation."
_TRANSACTIONAL = (f"{_SPRING}transaction.annotation.Transactional", "javax.transaction.Transactional", "jakarta.transaction.Transactional")
#: Prefixes of packages all of whose annotations one handler takes.
IBATIS, MYBATIS_PLUS = "org.apache.ibatis.annotations.", "com.baomidou.mybatisplus.annotation."


@dataclass(frozen=True)
class Handler:
    """Takes annotations by full name, or by package where a marker ends in a dot."""

    name: str
    scope: str
    priority: int
    markers: tuple[str, ...]
    proxy: bool = False


# Handlers by scope with their priorities and markers, and whether they make a class need a proxy.
HANDLERS = (
    Handler("SpringBean", "class", 100, (*(f"{_SPRING}stereotype.{x}" for x in ("Component", "Service", "Repository", "Controller")), f"{_WEB}RestController"), True),
    Handler("ControllerAdvice", "class", 98, (f"{_WEB}ControllerAdvice",), True),
    Handler("Aspect", "class", 95, (f"{_SPRING}aop.aspectj.annotation.Aspect", f"{_ASPECT}Aspect"), True),
    Handler("Transactional", "class", 90, _TRANSACTIONAL, True),
    Handler("MyBatisMapper", "class", 88, (f"{IBATIS}Mapper",)),
    Handler("MapStructMapper", "class", 87, ("org.mapstruct.Mapper",)),
    Handler("Async", "class", 85, (f"{_SPRING}scheduling.annotation.Async",), True),
    Handler("RequestMapping", "class", 80, (f"{_WEB}RequestMapping",), True),
    Handler("ConfigurationProperties", "class", 75, (f"{_SPRING}boot.context.properties.ConfigurationProperties",), True),
    Handler("MyBatisPlus", "class", 72, (MYBATIS_PLUS,)),
    Handler("Primary", "class", 65, (f"{_CONTEXT}Primary",)),
    Handler("Scope", "class", 60, (f"{_CONTEXT}Scope",), True),
    Handler("CrossOrigin", "class", 58, (f"{_WEB}CrossOrigin",), True),
    Handler("Lazy", "class", 55, (f"{_CONTEXT}Lazy",)),
    Handler("Order", "class", 50, (f"{_SPRING}core.annotation.Order",), True),
    Handler("RestMapping", "method", 93, tuple(f"{_WEB}{x}Mapping" for x in ("Get", "Post", "Put", "Delete", "Patch", "Request"))),
    Handler("Bean", "method", 92, (f"{_CONTEXT}Bean",)),
    Handler("Transactional", "method", 90, _TRANSACTIONAL, True),
    Handler("Async", "method", 85, (f"{_SPRING}scheduling.annotation.Async",), True),
    Handler("Aop", "method", 80, tuple(f"{_ASPECT}{x}" for x in ("Before", "After", "Around", "AfterReturning", "AfterThrowing", "Pointcut"))),
    Handler("Pointcut", "method", 78, (f"{_ASPECT}Pointcut",)),
    Handler("MyBatis", "method", 75, (IBATIS, MYBATIS_PLUS)),
    Handler("Scheduled", "method", 70, (f"{_SPRING}scheduling.annotation.Scheduled",)),
    Handler("DependsOn", "method", 68, (f"{_CONTEXT}DependsOn",)),
    Handler("CrossOrigin", "method", 58, (f"{_WEB}CrossOrigin",)),
    Handler("ResponseStatus", "method", 56, (f"{_WEB}ResponseStatus",)),
    Handler("Order", "method", 50, (f"{_SPRING}core.annotation.Order",)),
    Handler("Autowired", "field", 95, (f"{_FACTORY}Autowired",)),
    Handler("Value", "field", 93, (f"{_FACTORY}Value",)),
    Handler("Inject", "field", 92, ("javax.inject.Inject",)),
    Handler("Resource", "field", 91, ("javax.annotation.Resource",)),
    Handler("Qualifier", "field", 90, (f"{_FACTORY}Qualifier",)),
)


def full_name(annotation: Column) -> Column:
    """An annotation's name without its at sign and arguments; of a descriptor the dotted name."""
    plain = F.regexp_replace(F.regexp_replace(annotation, r"\(.*", ""), "^@|;$", "")
    return F.when(plain.contains("/"), F.replace(F.regexp_replace(plain, "^L", ""), F.lit("/"), F.lit("."))).otherwise(plain)


def simple_marker(annotation: Column) -> Column:
    return F.substring_index(full_name(annotation), ".", -1)


def argument(annotation: Column) -> Column:
    """The first quoted argument of an annotation, null if it has none."""
    found = F.regexp_extract(annotation, r'\([^"]*"([^"]*)"', 1)
    return F.when(annotation.rlike(r'\([^"]*"'), found)


def _table(scope: str, handlers: tuple[Handler, ...]) -> Column:
    """The handlers of a scope by marker, as a map; of several with one marker that with the highest priority.

    A simple name is a marker too, for annotations that are given without their package.
    """
    known: dict[str, tuple[int, str, bool]] = {}
    for h in handlers:
        if h.scope == scope:
            for marker in h.markers:
                for key in {marker, marker.rsplit(".", 1)[1] or marker}:
                    known[key] = max(known.get(key, (0, "", False)), (h.priority, h.name, h.proxy))
    return F.create_map(*[x for key, value in known.items() for x in (F.lit(key), F.struct(*[F.lit(v).alias(n) for v, n in zip(value, ("priority", "name", "proxy"), strict=True)]))])


def handler(scope: Column, annotation: Column, handlers: tuple[Handler, ...] = HANDLERS) -> Column:
    """``priority, name, proxy`` of the handler that takes an annotation, null if none does.

    The one with the highest priority in the scope counts, by full name or package; a simple name is looked up where
    the annotation has no package.
    """
    name = full_name(annotation)
    package = F.concat(F.regexp_extract(name, r"^(.*)\.[^.]*$", 1), F.lit("."))
    out = F.lit(None)
    for one in dict.fromkeys(h.scope for h in handlers):
        table = _table(one, handlers)
        out = F.when(scope == one, F.array_max(F.array(table[name], table[package]))).otherwise(out)
    return out


def http_method(annotation: Column) -> Column:
    """The HTTP method of a mapping annotation: ``ALL`` for a plain one, empty for other annotations."""
    verb = F.upper(F.regexp_extract(simple_marker(annotation), "^(Get|Post|Put|Delete|Patch|Request)Mapping$", 1))
    return F.when(verb == "REQUEST", "ALL").otherwise(verb)


def mapper_operation(annotation: Column) -> Column:
    """What an annotation of a mapper method does, by the first of some words in its name."""
    name, out = full_name(annotation), F.when(full_name(annotation).startswith(MYBATIS_PLUS), "mybatis_plus").otherwise("other")
    for word, operation in reversed((("Select", "select"), ("Insert", "insert"), ("Update", "update"), ("Delete", "delete"), ("Provider", "provider"), ("Result", "results"))):
        out = F.when(name.contains(word), operation).otherwise(out)
    return out


def base_mapper_operation(target: Column) -> Column:
    """The operation of a call to a mapper's inherited methods, by owner and name; null for other calls."""
    owner, name = F.regexp_extract(F.substring_index(target, "(", 1), r"^(.*)\.", 1), F.regexp_extract(F.substring_index(target, "(", 1), r"([^.]*)$", 1)
    kind = F.when(name == "insert", "INSERT").when(name.startswith("update"), "UPDATE").when(name.startswith("delete"), "DELETE").when(name.startswith("select"), "SELECT")
    return F.when(owner.endswith("Mapper"), kind)


def attributes(name: Column, annotation: Column) -> Column:
    """What a handler notes of an annotation, as a map of texts; empty where it only logs."""
    value, said, marker = argument(annotation), F.lit("true"), simple_marker(annotation)
    notes = {
        "SpringBean": {"springBeanType": F.lower(marker)},
        "Aspect": {"aspect": said},
        "Transactional": {"isTransactional": said},
        "MyBatisMapper": {"myBatisMapper": said, "source": F.lit("annotation")},
        "MapStructMapper": {"mapStructMapper": said},
        "Async": {"isAsync": said, "executor": value},
        "RequestMapping": {"classBasePath": value},
        "ConfigurationProperties": {"prefix": value},
        "Primary": {"primary": said},
        "Scope": {"springScope": value},
        "CrossOrigin": {"hasCrossOrigin": said},
        "Lazy": {"lazy": said},
        "Order": {"hasOrder": said},
        "RestMapping": {"isRestEndpoint": said, "httpMethod": http_method(annotation), "apiPath": value, "isEntryPoint": said, "entryPointType": F.lit("rest_endpoint")},
        "Bean": {"isBean": said, "beanName": value, "isEntryPoint": said, "entryPointType": F.lit("spring_bean")},
        "Aop": {"isAopAdvice": said, "adviceType": F.lower(marker), "pointcut": value},
        "Pointcut": {"isPointcut": said, "aopPointcut": value},
        "MyBatis": {"hasMyBatisAnnotation": said, "operation": mapper_operation(annotation)},
        "Scheduled": {"isScheduled": said, "isEntryPoint": said, "entryPointType": F.lit("spring_scheduled")},
        "DependsOn": {"hasDependsOn": said},
        "ResponseStatus": {"hasResponseStatus": said},
        "Value": {"configKey": F.regexp_extract(annotation, r"\$\{([^:}]*)", 1)},
    }
    out = F.create_map().cast("map<string,string>")
    for known, own in notes.items():
        out = F.when(name == known, F.map_filter(F.create_map(*[x for k, v in own.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())).otherwise(out)
    return out


def handled(annotations: DataFrame) -> DataFrame:
    """``owner, scope, annotation, handler, priority, attributes`` of the annotations in ``owner, scope, annotation`` that a
    handler takes; each row by itself, so repeated annotations give repeated rows.  Null annotations are left out."""
    found = annotations.select("owner", "scope", "annotation", handler(F.col("scope"), F.col("annotation")).alias("h")).where("h is not null")
    return found.select("owner", "scope", "annotation", F.col("h.name").alias("handler"), F.col("h.priority").alias("priority"), attributes(F.col("h.name"), F.col("annotation")).alias("attributes"))


def annotations_of(classes: DataFrame) -> DataFrame:
    """``owner, scope, annotation`` of nested classes, their methods and their fields."""
    own = classes.select(F.col("fqn").alias("owner"), F.lit("class").alias("scope"), F.explode("annotations").alias("annotation"))
    method = classes.select(F.explode("methods").alias("m")).select(F.col("m.fqn").alias("owner"), F.lit("method").alias("scope"), F.explode("m.annotations").alias("annotation"))
    field = classes.select("fqn", F.explode("fields").alias("f")).select(F.concat("fqn", F.lit("."), "f.name").alias("owner"), F.lit("field").alias("scope"), F.explode("f.annotations").alias("annotation"))
    return own.unionByName(method).unionByName(field)


def noted(annotations: DataFrame) -> DataFrame:
    """``owner, scope, needs_proxy, attributes``: what all of an owner's annotations say of it.

    Of two values of one attribute that of the handler with the highest priority counts, of one handler the greatest.  A
    MapStruct mapper isn't a MyBatis one.
    """
    proxies = [h.name for h in HANDLERS if h.proxy and h.scope == "class"]
    rows = handled(annotations).select("owner", "scope", "handler", "priority", F.explode_outer("attributes").alias("key", "value"))
    best = rows.groupBy("owner", "scope", "key").agg(F.max(F.struct("priority", "value")).alias("best"), F.max((F.col("scope") == "class") & F.col("handler").isin(*proxies)).alias("proxy"))
    pair = F.when(F.col("key").isNotNull(), F.struct("key", F.col("best.value").alias("value")))
    out = best.groupBy("owner", "scope").agg(F.max("proxy").alias("needs_proxy"), F.map_from_entries(F.sort_array(F.collect_list(pair))).alias("attributes"))
    mapstruct = F.map_contains_key("attributes", F.lit("mapStructMapper"))
    return out.withColumn("attributes", F.map_filter("attributes", lambda k, v: ~mapstruct | ~k.isin("myBatisMapper", "source")))


def quartz_entries(classes: DataFrame) -> DataFrame:
    """``symbol_fqn, entry_type`` of the methods that a Quartz scheduler runs, by what their class inherits, their name and
    their descriptor (``signature``)."""
    inherits = F.transform(F.coalesce("inheritance", F.array().cast("array<struct<fqn:string,kind:string>>")), lambda i: i["fqn"])
    methods = classes.select(inherits.alias("up"), F.explode("methods").alias("m")).where(F.col("m.signature") == "(Lorg/quartz/JobExecutionContext;)V")
    name = F.regexp_extract(F.substring_index("m.fqn", "(", 1), r"([^.]*)$", 1)
    kind = F.when(F.array_contains("up", "org.quartz.Job") & (name == "execute"), "quartz_job").when(F.array_contains("up", "org.springframework.scheduling.quartz.QuartzJobBean") & (name == "executeInternal"), "quartz_job_spring")
    return methods.select(F.col("m.fqn").alias("symbol_fqn"), kind.alias("entry_type")).where("entry_type is not null")
