"""Architecture rules: functions from symbols and edges to findings, in a registry."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.functions.scalars import STORE_SUFFIXES, owner
from codeweft.scratch import cut_small

Rule = Callable[[DataFrame, DataFrame], DataFrame]
RULES: dict[str, Rule] = {}


def rule(rule_id: str) -> Callable[[Rule], Rule]:
    def register(f: Rule) -> Rule:
        RULES[rule_id] = f
        return f

    return register


@rule("controller-dao")
def controller_dao(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Controller methods that call a mapper, DAO or repository; a finding for each call edge."""
    anns = F.coalesce("annotations", F.array().cast("array<string>"))
    classes = symbols.where("kind = 'class'")
    marked = F.exists(anns, lambda a: a.contains("Controller")) | F.col("name").contains("Controller")
    methods = symbols.where("kind = 'method'").select(F.col("fqn").alias("from_fqn"), F.col("parent_fqn").alias("class_fqn"))
    callers = methods.join(cut_small(classes.where(marked).select(F.col("fqn").alias("class_fqn")).distinct()), "class_fqn", "left_semi").select("from_fqn").distinct()
    name = F.substring_index("owner", ".", -1)
    named = F.lit(False)
    for part in STORE_SUFFIXES:
        named = named | name.contains(part)
    # Only classes that are stores by annotation are joined, and only with calls that the name doesn't decide.
    annotated = classes.where(F.exists(anns, lambda a: a.contains("Repository") | a.contains("Mapper"))).select(F.col("fqn").alias("owner"), F.lit(True).alias("is_store")).distinct()
    calls = edges.where("relation = 'calls'").withColumn("owner", owner(F.col("to_fqn"))).where(~name.startswith("Base"))
    found = calls.join(cut_small(annotated), "owner", "left").where(named | F.col("is_store")).join(callers, "from_fqn", "left_semi")
    message = F.concat(F.lit("controller calls data access without a service: "), "from_fqn", F.lit(" -> "), "to_fqn")
    return found.select(F.lit("controller-dao").alias("rule_id"), "from_fqn", "to_fqn", F.lit("error").alias("severity"), message.alias("message"))


def detect(symbols: DataFrame, edges: DataFrame, rule_id: str | None = None) -> DataFrame:
    if rule_id is not None and rule_id not in RULES:
        raise ValueError(f"unknown rule {rule_id!r}")
    found = [f(symbols, edges) for name, f in RULES.items() if rule_id in (None, name)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def check(findings: DataFrame, added: DataFrame) -> DataFrame:
    """Findings that touch a symbol in ``added.fqn`` at either end; ``blocking`` says whether they are errors."""
    fqns = cut_small(added.select("fqn").distinct().withColumn("hit", F.lit(True)))
    ends = findings.alias("f")
    for side in ("from", "to"):
        ends = ends.join(fqns.select(F.col("fqn").alias(f"__{side}"), F.col("hit").alias(f"__{side}_hit")), F.col(f"f.{side}_fqn") == F.col(f"__{side}"), "left")
    return ends.where("__from_hit or __to_hit").select("f.*", (F.col("f.severity") == "error").alias("blocking"))


def suggestions(findings: DataFrame) -> DataFrame:
    """What to do about findings, by their rule, each text once."""
    rule_id, pair = F.lower("rule_id"), F.concat("from_fqn", F.lit(" and "), "to_fqn")
    text = (
        F.when(rule_id.contains("dao"), F.concat(F.lit("Consider introducing a Service layer between "), pair))
        .when(rule_id.contains("circular"), F.concat(F.lit("Break circular dependency between "), pair, F.lit(" by introducing an interface")))
        .when(rule_id.contains("transaction"), F.concat(F.lit("Add @Transactional annotation to "), "from_fqn"))
    )
    return findings.select(text.alias("suggestion")).where("suggestion is not null").distinct()


def filtered(findings: DataFrame, context: str | None = None, severity: str | None = None) -> DataFrame:
    """Findings whose source begins with ``context`` (case ignored), of one severity, by severity as text, then source."""
    some = findings if context is None else findings.where(F.lower("from_fqn").startswith(context.lower()))
    some = some if severity is None else some.where(F.col("severity") == severity)
    return some.orderBy(F.desc("severity"), "from_fqn", "to_fqn")


def tallies(findings: DataFrame) -> DataFrame:
    """One row: findings by severity, and whether a check fails for them."""
    counts = [F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in ("error", "warning", "info")]
    return findings.agg(F.count("*").alias("n"), *counts).withColumn("failed", F.col("n_error") > 0)


def handler_of(annotation: Column, handlers: Sequence[tuple[str, str, int]]) -> Column:
    """The handler of an annotation by a table of ``handler, marker, priority``: the one with the highest priority
    whose marker the annotation has, of equal ones the first by name; else null."""
    out = F.lit(None).cast("string")
    for name, marker, _ in sorted(handlers, key=lambda h: (h[2], [-ord(c) for c in h[0]])):
        out = F.when(annotation.contains(marker), name).otherwise(out)
    return out
