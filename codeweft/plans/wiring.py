"""Types of members as edges, and injection points joined to the beans that they get.

Input are nested classes whose methods have a JVM descriptor as ``signature`` and may have ``attributes`` named
``qualifier.0``, ``qualifier.1`` and so on for their arguments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.functions import descriptors
from codeweft.functions.scalars import bean_name, simple_name
from codeweft.plans.handlers import argument, simple_marker
from codeweft.scratch import cut, cut_counted

# Annotations that inject, and those that make a class a bean.
INJECTIONS = ("Autowired", "Inject", "Resource")
STEREOTYPES = ("Component", "Service", "Repository", "Controller", "RestController", "Configuration")


def _marked(annotations: Column, *names: str) -> Column:
    """The annotations of these simple names."""
    return F.filter(F.coalesce(annotations, F.array().cast("array<string>")), lambda a: simple_marker(a).isin(*names))


def injection_of(annotations: Column) -> Column:
    """``autowired``, ``inject`` or ``resource``, of several the last, else null."""
    return F.lower(simple_marker(F.element_at(F.concat(F.array(F.lit(None).cast("string")), _marked(annotations, *INJECTIONS)), -1)))


def qualifier_of(annotations: Column) -> Column:
    return argument(F.get(_marked(annotations, "Qualifier"), F.lit(0)))


def fields_of(classes: DataFrame) -> DataFrame:
    """``class_fqn, name, type, injection, qualifier`` of the fields; ``type`` may be a descriptor."""
    rows = classes.select(F.col("fqn").alias("class_fqn"), F.explode("fields").alias("f"))
    kind = F.when(F.col("f.type").rlike(r"^\[*(L.*;|[BCDFIJSZ])$"), descriptors.type_name(F.col("f.type"))).otherwise(F.col("f.type"))
    return rows.select("class_fqn", "f.name", kind.alias("type"), injection_of(F.col("f.annotations")).alias("injection"), qualifier_of(F.col("f.annotations")).alias("qualifier"))


def methods_of(classes: DataFrame) -> DataFrame:
    """``class_fqn, fqn, name, returns, arguments, injection, is_bean, is_primary, bean_name, qualifier, attributes``."""
    rows = classes.select(F.col("fqn").alias("class_fqn"), F.explode("methods").alias("m"))
    marks, text = F.col("m.annotations"), F.col("m.signature")
    bean = _marked(marks, "Bean")
    name = simple_name(F.col("m.fqn"))
    return rows.select(
        "class_fqn", "m.fqn", name.alias("name"), descriptors.return_type(text).alias("returns"), descriptors.argument_types(text).alias("arguments"), injection_of(marks).alias("injection"),
        (F.size(bean) > 0).alias("is_bean"), (F.size(_marked(marks, "Primary")) > 0).alias("is_primary"), F.coalesce(argument(F.get(bean, F.lit(0))), name).alias("bean_name"), qualifier_of(marks).alias("qualifier"), "m.attributes",
    )


def edge(from_fqn: Column, to_fqn: Column, kind: Column, place: Column | None = None, qualifier: Column | None = None) -> list[Column]:
    """The columns of a ``member_of`` edge: from a type to what uses it, with the argument's place and its qualifier."""
    none = F.lit(None)
    return [
        from_fqn.alias("from_fqn"), to_fqn.alias("to_fqn"), F.lit("member_of").alias("relation"), kind.alias("kind"),
        (none if place is None else place).cast("int").alias("place"), (none if qualifier is None else qualifier).cast("string").alias("qualifier"),
    ]


def field_edges(fields: DataFrame) -> DataFrame:
    """An edge from each field's type to its class, but for plain types; an injected one says how in its kind."""
    kind = F.concat_ws(":", F.lit("class"), "injection")
    return fields.where(~descriptors.is_plain(F.col("type"))).select(*edge(F.col("type"), F.col("class_fqn"), kind, None, F.col("qualifier")))


def _arguments(methods: DataFrame) -> DataFrame:
    own = F.coalesce("attributes", F.create_map().cast("map<string,string>"))
    rows = methods.withColumn("own", own).select("*", F.posexplode("arguments").alias("place", "type"))
    return rows.withColumn("own_qualifier", F.col("own")[F.concat(F.lit("qualifier."), F.col("place").cast("string"))])


def member_edges(methods: DataFrame) -> DataFrame:
    """Edges from the types of return values and arguments to the methods; primitive types and constructors' returns have none."""
    returned = methods.where((F.col("name") != "<init>") & F.col("returns").isNotNull() & ~descriptors.is_primitive(F.col("returns")))
    taken = _arguments(methods).where(~descriptors.is_primitive(F.col("type")))
    return returned.select(*edge(F.col("returns"), F.col("fqn"), F.lit("return"))).unionByName(taken.select(*edge(F.col("type"), F.col("fqn"), F.lit("argument"), F.col("place"))))


def injection_edges(methods: DataFrame) -> DataFrame:
    """Edges from the arguments of injected constructors and setters, and of bean methods, to the class, with the
    argument's qualifier; an injected method's own qualifier stands in for a missing one."""
    rows = _arguments(methods)
    how = F.concat(F.when(F.col("name") == "<init>", "constructor:").otherwise("setter:"), "injection")
    injected = rows.where("injection is not null").select(*edge(F.col("type"), F.col("class_fqn"), how, F.col("place"), F.coalesce("own_qualifier", "qualifier")))
    return injected.unionByName(rows.where("is_bean").select(*edge(F.col("type"), F.col("class_fqn"), F.lit("bean_dependency"), F.col("place"), F.col("own_qualifier"))))


def points_of(classes: DataFrame) -> DataFrame:
    """``class_fqn, member, kind, type, qualifier``: everything that gets a bean."""
    fields = fields_of(classes).where("injection is not null")
    at_fields = fields.select("class_fqn", F.col("name").alias("member"), F.concat(F.lit("field:"), "injection").alias("kind"), "type", "qualifier")
    rows = _arguments(methods_of(classes)).where("injection is not null or is_bean")
    how = F.when(F.col("injection").isNull(), "bean").otherwise(F.concat(F.when(F.col("name") == "<init>", "constructor:").otherwise("setter:"), "injection"))
    own = F.when(F.col("injection").isNull(), F.col("own_qualifier")).otherwise(F.coalesce("own_qualifier", "qualifier"))
    at_methods = rows.select("class_fqn", F.concat("name", F.lit("#"), F.col("place").cast("string")).alias("member"), how.alias("kind"), "type", own.alias("qualifier"))
    return at_fields.unionByName(at_methods)


def beans_of(classes: DataFrame) -> DataFrame:
    """``bean, type, name, qualifier, is_primary``: classes with a stereotype, and what bean methods return."""
    marks = F.col("annotations")
    stereotype = F.get(_marked(marks, *STEREOTYPES), F.lit(0))
    own = classes.where(stereotype.isNotNull()).select(
        F.col("fqn").alias("bean"), F.col("fqn").alias("type"), F.coalesce(argument(stereotype), bean_name(F.substring_index("fqn", ".", -1))).alias("name"),
        qualifier_of(marks).alias("qualifier"), (F.size(_marked(marks, "Primary")) > 0).alias("is_primary"),
    )
    made = methods_of(classes).where("is_bean and returns is not null")
    return own.unionByName(made.select(F.col("fqn").alias("bean"), F.col("returns").alias("type"), F.col("bean_name").alias("name"), "qualifier", "is_primary"))


def supertypes(classes: DataFrame) -> DataFrame:
    """``type, super``: every type below each class or interface it inherits from, at whatever distance; without itself.

    Paths are doubled each round, so there are as many rounds as the logarithm of the longest; cycles end.
    """
    pair = classes.select(F.col("fqn").alias("type"), F.explode("inheritance").alias("i")).select("type", F.col("i.fqn").alias("super"))
    known, n = cut_counted(pair.where("super is not null").distinct())
    while True:
        further = known.join(known.select(F.col("type").alias("super"), F.col("super").alias("above")), "super").select("type", F.col("above").alias("super"))
        known, now = cut_counted(known.unionByName(further).distinct())
        if now == n:
            return known.where("type <> super")
        n = now


def wired(points: DataFrame, beans: DataFrame, above: DataFrame) -> DataFrame:
    """The injection points with the bean that each gets: ``n_candidates, how, bean``.

    Candidates are the beans whose type is the wanted one or below it.  A qualifier picks the one of that name or
    qualifier; else a single candidate is taken (``type``), then the only primary one, then the one that is named like
    the field.  ``how`` says which, or ``missing`` or ``ambiguous``, without a bean.

    Candidates are counted by type and by type and name, and points are joined to these counts, so that no point meets
    all of its candidates.
    """
    offered = beans.join(above, "type", "left").select("bean", "name", "qualifier", "is_primary", F.explode(F.array_compact(F.array("type", "super"))).alias("type")).distinct()
    offered = cut(offered)
    by_type = offered.groupBy("type").agg(F.count("*").alias("n"), F.min("bean").alias("only"), F.count_if("is_primary").alias("n_primary"), F.min(F.when(F.col("is_primary"), F.col("bean"))).alias("primary"))
    names = offered.select("type", "bean", F.explode(F.array_distinct(F.array_compact(F.array("name", "qualifier")))).alias("called"))
    by_name = cut(names.groupBy("type", "called").agg(F.count("*").alias("n_called"), F.min("bean").alias("bean_called")))
    by_qualifier = by_name.select("type", F.col("called").alias("qualifier"), F.col("n_called").alias("n_qualified"), F.col("bean_called").alias("qualified"))
    rows = points.join(by_type, "type", "left").join(by_qualifier, ["type", "qualifier"], "left").join(by_name.withColumnRenamed("called", "member"), ["type", "member"], "left")
    found = (
        F.when(F.col("qualifier").isNotNull(), F.when(F.col("n_qualified") == 1, _choice("qualifier", "qualified")).when(F.col("n_qualified") > 1, _choice("ambiguous")).otherwise(_choice("missing")))
        .when(F.col("n").isNull(), _choice("missing"))
        .when(F.col("n") == 1, _choice("type", "only"))
        .when(F.col("n_primary") == 1, _choice("primary", "primary"))
        .when(F.col("n_primary") > 1, _choice("ambiguous"))
        .when(F.col("n_called") == 1, _choice("name", "bean_called"))
        .otherwise(_choice("ambiguous"))
    )
    n = F.coalesce("n", F.lit(0)).cast("long").alias("n_candidates")
    return rows.withColumn("found", found).select("class_fqn", "member", "kind", "type", "qualifier", n, F.col("found.how").alias("how"), F.col("found.bean").alias("bean"))


def _choice(how: str, column: str | None = None) -> Column:
    return F.struct(F.lit(how).alias("how"), (F.lit(None).cast("string") if column is None else F.col(column)).alias("bean"))


def wiring_edges(resolved: DataFrame) -> DataFrame:
    """``from_fqn, to_fqn, relation, kind``: from each class to the beans that it gets, each pair and way once."""
    return resolved.where("bean is not null").select(F.col("class_fqn").alias("from_fqn"), F.col("bean").alias("to_fqn"), F.lit("wires").alias("relation"), "kind").distinct()
