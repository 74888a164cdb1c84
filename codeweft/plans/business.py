"""The business layer: terms, constraints, and summaries from methods up to modules.

Models are callables that take and return a pandas Series of texts; they run in Spark tasks on Arrow batches, and a
text that fails gets a fallback instead of failing the batch.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions import scalars
from codeweft.operators.graph import affected
from codeweft.operators.mutations import upsert_summaries
from codeweft.scratch import SMALL_ROWS, cut, cut_counted, sized

Model = Callable[[pd.Series], pd.Series]

# Validation annotations, and words that make a comment a constraint.
VALIDATIONS = ("@NotNull", "@NotEmpty", "@NotBlank", "@Min(", "@Max(", "@Size(", "@Pattern(", "@Email", "@Positive", "@Negative")
ASSERTION = r"""assert\s+(.+?)\s*:\s*["'](.+?)["']"""
MODAL_WORDS = "(?i)(必须|不能|不可|禁止|限制|要求|约束|规则)|(should not|must not|required|mandatory)"
#: What a model says of code that isn't worth a summary.
NOTHING = "N/A"


def terms(symbols: DataFrame) -> DataFrame:
    """``code_term, source_fqn``: terms of classes, their domain methods and their fields, each term once.

    Of the sources of one term the first counts by class, then classes before methods before fields, then FQN.
    """
    classes = symbols.where("kind in ('class', 'interface')").select("fqn", "name")
    own = classes.select(scalars.class_term(F.col("name")).alias("code_term"), F.col("fqn").alias("class_fqn"), F.lit(0).alias("rank"), F.col("fqn").alias("source_fqn"))
    inside = symbols.where("kind in ('method', 'field')").join(classes.select(F.col("fqn").alias("parent_fqn")), "parent_fqn", "left_semi")
    name, method = F.col("name"), F.col("kind") == "method"
    term = F.when(method & scalars.is_domain_method(name), scalars.method_term(name)).when(~method, scalars.field_term(name))
    members = inside.select(term.alias("code_term"), F.col("parent_fqn").alias("class_fqn"), F.when(method, 1).otherwise(2).alias("rank"), F.col("fqn").alias("source_fqn"))
    found = own.unionByName(members).where("code_term is not null")
    return found.groupBy("code_term").agg(F.min(F.struct("class_fqn", "rank", "source_fqn"))["source_fqn"].alias("source_fqn"))


@dataclass(frozen=True)
class Calls:
    """How a model is called: ``together`` texts at a time (a whole batch unless given), by at most ``threads`` threads of a
    task, up to ``attempts`` times where an error is ``retriable``, with waits that double from ``wait`` to ``longest``
    seconds."""

    together: int | None = None
    threads: int = 10
    attempts: int = 3
    wait: float = 1.0
    longest: float = 10.0
    retriable: tuple[type[BaseException], ...] = (ConnectionError, TimeoutError)


#: Texts of one task that asks a model.
SPREAD_ROWS = 20_000


def _tried(model: Model, texts: pd.Series, calls: Calls) -> tuple[list | None, int]:
    """The model's answers, or nothing where it fails for good, and how often it was called."""
    for attempt in range(1, calls.attempts + 1):
        try:
            answers = list(model(texts))
            if len(answers) != len(texts):
                raise ValueError("a model must give an answer for each text")
            return answers, attempt
        except Exception as error:  # noqa: BLE001  whatever a model raises costs only its own texts
            if not isinstance(error, calls.retriable) or attempt == calls.attempts:
                return None, attempt
            time.sleep(min(calls.longest, calls.wait * 2 ** (attempt - 1)))
    return None, calls.attempts


def _answered(model: Model, texts: pd.Series, calls: Calls, pool: ThreadPoolExecutor) -> pd.DataFrame:
    """``answer, failed, attempts`` of some texts in order; those of a call that fails for good are asked alone."""
    size = calls.together or max(1, len(texts))
    parts = [texts.iloc[low : low + size] for low in range(0, len(texts), size)]
    rows: list[tuple[object, bool, int] | None] = []
    for part, (answers, attempts) in zip(parts, pool.map(lambda part: _tried(model, part, calls), parts), strict=True):
        rows += [(answer, False, attempts) for answer in answers] if answers is not None else [(None, True, attempts)] * len(part)
    again = [k for k, row in enumerate(rows) if row[1] and (len(parts[k // size]) > 1)]
    for k, (answers, attempts) in zip(again, pool.map(lambda k: _tried(model, texts.iloc[k : k + 1], calls), again), strict=True):
        rows[k] = (None if answers is None else answers[0], answers is None, rows[k][2] + attempts)
    return pd.DataFrame(rows, columns=["answer", "failed", "attempts"]).astype({"answer": object, "failed": bool, "attempts": int})


def responses(prompt: Column, model: Model, calls: Calls = Calls()) -> Column:
    """``answer, failed, attempts`` of a model for each prompt.

    A task keeps at most ``calls.threads`` calls under way at a time and gives answers in order; a text whose calls fail has
    no answer and doesn't fail others.  Null prompts are asked as they are.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(calls.threads) as pool:
            for batch in batches:
                yield _answered(model, batch.reset_index(drop=True), calls, pool)

    return F.pandas_udf(run, "answer string, failed boolean, attempts int")(prompt)


def spread(df: DataFrame, rows: int = SPREAD_ROWS) -> DataFrame:
    """``df`` dealt to tasks of about ``rows`` rows, as many as the cluster has cores at least; a model's time goes by rows, not
    by the bytes that files are split by."""
    out, n = cut_counted(df)
    return out.repartition(max(df.sparkSession.sparkContext.defaultParallelism, n // rows + 1))


def asked(df: DataFrame, prompt: Column, answer: str, model: Model, fallback: Column, calls: Calls = Calls()) -> DataFrame:
    """``df`` with the model's answers to a prompt; where it gives none, or fails, the fallback."""
    said = spread(df).withColumn("__prompt", prompt).withColumn("__said", responses(F.col("__prompt"), model, calls))
    return said.withColumn(answer, F.coalesce("__said.answer", fallback)).drop("__prompt", "__said")


def call_counts(said: DataFrame, column: str = "said") -> DataFrame:
    """One row for a frame of ``responses``: texts, those answered and those that failed, calls, and calls beyond the first."""
    r = F.col(column)
    return said.agg(F.count("*").alias("total"), F.count_if(~r["failed"]).alias("success"), F.count_if(r["failed"]).alias("failed"), F.coalesce(F.sum(r["attempts"]), F.lit(0)).alias("calls"), F.coalesce(F.sum(r["attempts"] - 1), F.lit(0)).alias("retries"))


def structured(answer: Column, schema: str, *, strict: bool = False) -> Column:
    """A model's JSON as columns; what is no such JSON is null, or an error if ``strict``."""
    return F.from_json(answer, schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"})


def glossary(symbols: DataFrame, model: Model) -> DataFrame:
    """``code_term, source_fqn, business_meaning, synonyms``: terms with what the model answers as JSON.

    An answer that is no such JSON leaves the term without a meaning and with no synonyms.
    """
    found = terms(symbols)
    said = asked(found, F.concat(F.lit("term: "), "code_term"), "__json", model, F.lit("{}"))
    parsed = structured(F.col("__json"), "business_meaning string, synonyms array<string>")
    none = F.array().cast("array<string>")
    return said.select("code_term", "source_fqn", parsed["business_meaning"].alias("business_meaning"), F.coalesce(parsed["synonyms"], none).alias("synonyms"))


def constraints_of_annotations(symbols: DataFrame) -> DataFrame:
    """A validation for each validating annotation of a method."""
    rows = symbols.where("kind = 'method'").select("fqn", "name", F.explode("annotations").alias("annotation"))
    marks = F.filter(F.array(*map(F.lit, VALIDATIONS)), lambda m: F.col("annotation").startswith(m))
    hits = rows.select("fqn", "name", "annotation", F.explode(marks).alias("mark"))
    return hits.select(F.concat("name", F.lit("_"), F.replace("mark", F.lit("@"), F.lit(""))).alias("name"), F.concat(F.lit("参数验证: "), "annotation").alias("description"), F.col("fqn").alias("source_fqn"), F.lit("validation").alias("constraint_type"))


def constraints_of_asserts(sources: DataFrame) -> DataFrame:
    """A business rule for each assertion with a message in ``fqn, name, content``; numbered within a method."""
    texts = F.regexp_extract_all("content", F.lit(ASSERTION), 2)
    hits = sources.select("fqn", "name", F.posexplode(texts).alias("place", "message"))
    return hits.select(F.concat("name", F.lit("_assert_"), F.col("place").cast("string")).alias("name"), F.col("message").alias("description"), F.col("fqn").alias("source_fqn"), F.lit("business_rule").alias("constraint_type"))


def constraints_of_comments(comments: DataFrame) -> DataFrame:
    """A business rule for each comment in ``fqn, line, comment`` that says what must or must not be."""
    hits = comments.where(F.col("comment").rlike(MODAL_WORDS))
    return hits.select(F.concat(F.lit("constraint_line_"), F.col("line").cast("string")).alias("name"), F.trim("comment").alias("description"), F.col("fqn").alias("source_fqn"), F.col("line").alias("source_line"), F.lit("business_rule").alias("constraint_type"))


def constraints(symbols: DataFrame, sources: DataFrame, implicit: DataFrame | None = None) -> DataFrame:
    """All explicit constraints of methods, and those that a model has found (``name, description, source_fqn, constraint_type``)."""
    out = constraints_of_annotations(symbols).unionByName(constraints_of_asserts(sources))
    return out if implicit is None else out.unionByName(implicit)


def summarized(methods: DataFrame, model: Model) -> DataFrame:
    """``fqn, summary`` of methods (``fqn, name, parent_fqn, signature, modifiers, annotations, content``).

    Every method is asked about on its own, however many there are in a batch; one that fails gets a fallback.
    """
    text = scalars.prompt(F.col("content"), class_name=F.col("parent_fqn"), method_name=F.col("name"), signature=F.col("signature"), modifiers=F.array_join("modifiers", ", "), annotations=F.array_join("annotations", ", "))
    said = asked(methods, text, "summary", model, scalars.fallback_summary(F.col("fqn"), F.col("signature"), F.col("modifiers")))
    return said.select("fqn", scalars.clean_summary(F.col("summary")).alias("summary"))


#: Parts that a model is given in one prompt.
FAN_IN = 50


def rolled_up(parts: DataFrame, kind: str, model: Model | None = None, *, fan_in: int = FAN_IN, calls: Calls = Calls()) -> DataFrame:
    """``fqn, summary`` of the wholes of ``parts`` (``fqn, name, part, summary``), by the model from their parts' summaries.

    Empty summaries and those that say nothing are left out; a whole without any, or one whose model fails, has its
    name and ``kind``.  A model is given at most ``fan_in`` parts at a time; what it says of these are the parts of a
    further round, until each whole is one prompt.  Without a model the listed parts are the summary.
    """
    useful = (F.col("summary") != "") & (F.col("summary") != NOTHING)
    wholes = parts.select("fqn", "name").distinct()
    rows = parts.where(useful).select("fqn", "name", "part", "summary")
    if model is None:
        lists = rows.groupBy("fqn", "name").agg(F.transform(F.sort_array(F.collect_list(F.struct("part", "summary"))), lambda x: x["summary"]).alias("parts"))
        said = lists.select("fqn", "name", scalars.listed(F.col("parts")).alias("said"))
    else:
        said = None
        while said is None:
            place = F.row_number().over(Window.partitionBy("fqn", "name").orderBy("part", "summary")) - 1
            groups = rows.withColumn("group", F.floor(place / fan_in)).groupBy("fqn", "name", "group")
            lists = cut(groups.agg(F.transform(F.sort_array(F.collect_list(F.struct("part", "summary"))), lambda x: x["summary"]).alias("parts")))
            text = scalars.level_prompt(kind, F.col("fqn"), F.col("parts"))
            answered = cut(asked(lists, text, "summary", model, F.lit(None).cast("string"), calls))
            if answered.where("group > 0").isEmpty():
                said = answered.select("fqn", "name", F.col("summary").alias("said"))
            rows = answered.where("summary is not null and summary <> ''").select("fqn", "name", F.lpad(F.col("group").cast("string"), 12, "0").alias("part"), "summary")
    out = wholes.alias("w").join(said.alias("s"), F.col("w.fqn").eqNullSafe(F.col("s.fqn")) & F.col("w.name").eqNullSafe(F.col("s.name")), "left")
    return out.select("w.fqn", F.coalesce(F.trim("s.said"), F.concat("w.name", F.lit(f" {kind}"))).alias("summary"))


def bottom_up(symbols: DataFrame, method_summaries: DataFrame, model: Model | None = None) -> DataFrame:
    """``level, fqn, summary`` of classes, packages and modules, each from the level below.

    A package is a class FQN without its last part; a module is a package's first part.
    """
    classes = symbols.where("kind in ('class', 'interface')").select("fqn", "name")
    inside = symbols.where("kind = 'method'").select("fqn", F.col("name").alias("part"), "parent_fqn").join(method_summaries.select("fqn", "summary"), "fqn")
    parts = classes.join(inside.select(F.col("parent_fqn").alias("fqn"), "part", "summary"), "fqn", "left")
    by_class = rolled_up(parts, "(class)", model)
    package = F.regexp_extract("fqn", r"^(.*)\.[^.]*$", 1)
    by_package = rolled_up(by_class.select(package.alias("fqn"), package.alias("name"), F.col("fqn").alias("part"), "summary"), "package", model)
    module = F.substring_index("fqn", ".", 1)
    by_module = rolled_up(by_package.select(module.alias("fqn"), module.alias("name"), F.col("fqn").alias("part"), "summary"), "module", model)
    levels = [df.select(F.lit(level).alias("level"), "fqn", "summary") for level, df in (("class", by_class), ("package", by_package), ("module", by_module))]
    return levels[0].unionByName(levels[1]).unionByName(levels[2])


def by_prefix(classes: DataFrame, summaries: DataFrame) -> DataFrame:
    """``fqn, target_fqn``: summaries whose target begins with the class's FQN, also in the midst of a name.

    Every prefix of a target is looked up, so that this is a join by equality.  The planner takes the prefixes for as few rows
    as the summaries are and would send them to every executor: few classes are sent instead, with many both are sorted.
    """
    names, n = cut_counted(classes.select("fqn").distinct())
    names = sized(names, n)
    prefixes = F.transform(F.sequence(F.lit(1), F.length("target_fqn")), lambda n: F.left(F.col("target_fqn"), n))
    lengths = [r["n"] for r in names.select(F.length("fqn").alias("n")).distinct().limit(1001).collect()]
    if len(lengths) <= 1000:  # only the lengths that class names have
        prefixes = F.transform(F.array(*[F.lit(n) for n in sorted(lengths)] or [F.lit(0)]), lambda n: F.left(F.col("target_fqn"), n))
    sought = summaries.where("target_fqn <> ''").select("target_fqn", F.explode(F.array_distinct(prefixes)).alias("fqn"))
    found = sought.hint("merge").join(names, "fqn") if n > SMALL_ROWS else sought.join(names, "fqn")
    return found.where(F.col("target_fqn") != F.col("fqn")).distinct()


def to_refresh(symbols: DataFrame, edges: DataFrame, summaries: DataFrame, sources: DataFrame, changed: DataFrame) -> DataFrame:
    """Symbols whose summary a change makes out of date: affected, with source (``fqn, content``), and not fresh."""
    hit = affected(symbols, edges, changed)
    fresh = summaries.where("not is_stale").select(F.col("target_fqn").alias("fqn"))
    named = sources.where("content <> ''").select("fqn", "content")
    return symbols.join(hit, "fqn", "left_semi").join(fresh, "fqn", "left_anti").join(named, "fqn")


def refreshed(symbols: DataFrame, edges: DataFrame, summaries: DataFrame, sources: DataFrame, changed: DataFrame, model: Model) -> DataFrame:
    """``summaries`` after a change: those out of date are asked for again and no longer stale."""
    todo = to_refresh(symbols, edges, summaries, sources, changed)
    for name, kind in (("signature", "string"), ("modifiers", "array<string>")):
        if name not in todo.columns:
            todo = todo.withColumn(name, F.lit(None).cast(kind))
    level = F.when(F.col("kind") == "method", "method").otherwise("class")
    said = summarized(todo, model).join(todo.select("fqn", level.alias("level")), "fqn")
    return upsert_summaries(summaries, said.select(F.col("fqn").alias("target_fqn"), "level", "summary", F.lit(False).alias("is_stale")))


def refresh_result(symbols: DataFrame, edges: DataFrame, summaries: DataFrame, sources: DataFrame, changed: DataFrame) -> DataFrame:
    """One row: how many symbols are changed, affected, to be asked for, and skipped because they are fresh."""
    own, n_changed = cut_counted(changed.select("fqn").distinct())
    hit, n_hit = cut_counted(affected(symbols, edges, own))
    named = sources.where("content <> ''").select("fqn").join(sized(hit, n_hit), "fqn", "left_semi")
    asked_for = symbols.select("fqn").join(named, "fqn", "left_semi")
    fresh = asked_for.join(summaries.where("not is_stale").select(F.col("target_fqn").alias("fqn"), F.lit(True).alias("fresh")), "fqn", "left")
    counts = fresh.agg(F.count_if(F.col("fresh").isNull()).alias("regenerated"), F.count_if("fresh").alias("skipped"))
    return counts.withColumns({"changed": F.lit(n_changed).cast("long"), "affected": F.lit(n_hit).cast("long")})


def embedded(texts: DataFrame, model: Callable[[pd.Series], pd.Series], together: int = 100) -> DataFrame:
    """``id, embedding`` of ``id, text`` by a model from at most ``together`` texts to lists of floats; an empty text is an
    error."""
    if not texts.where("text is null or trim(text) = ''").isEmpty():
        raise ValueError("an empty text can't be embedded")

    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.concat([pd.Series([], dtype=object), *(pd.Series(list(model(batch.iloc[k : k + together])), dtype=object) for k in range(0, len(batch), together))], ignore_index=True)

    return spread(texts).select("id", F.pandas_udf(vectors, "array<float>")("text").alias("embedding"))


def first_terms(entries: DataFrame, order: str) -> DataFrame:
    """Glossary entries, of each term the first by ``order``."""
    first = Window.partitionBy("code_term").orderBy(order)
    return entries.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
