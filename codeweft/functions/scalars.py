"""Scalar functions of the code graph as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name suffixes, prefixes and markers that the analyses look for.
TEST_SUFFIXES = ("Test", "Tests", "IT")
STORE_SUFFIXES = ("Mapper", "Dao", "Repository")


def layer(kind: Column, annotations: Column) -> Column:
    """Layer by annotation in order (controller, service, repository); other classes are domain, the rest null."""

    def rule(a: Column) -> Column:
        return F.when(a.contains("Controller"), "controller").when(a.contains("Service"), "service").when(a.contains("Repository"), "repository")

    found = F.get(F.filter(F.transform(F.coalesce(annotations, F.array().cast("array<string>")), rule), lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(found, F.when(kind == "class", "domain"))


def layer_or_unknown(kind: Column, annotations: Column) -> Column:
    return F.coalesce(layer(kind, annotations), F.lit("unknown"))


def chain_layer(annotations: Column, name: Column, fqn: Column) -> Column:
    """Layer in call chains: over all annotations first, then the name, then the FQN; else unknown."""
    marks = [("controller", ("Controller",)), ("service", ("Service",)), ("repository", ("Repository", "Mapper"))]
    loose = [*marks[:2], ("repository", STORE_SUFFIXES)]
    anns = F.coalesce(annotations, F.array().cast("array<string>"))

    def any_part(text: Column, parts: tuple[str, ...]) -> Column:
        return reduce(Column.__or__, [F.coalesce(text, F.lit("")).contains(part) for part in parts])

    def annotated(parts: tuple[str, ...]) -> Column:
        return F.exists(anns, lambda a: any_part(a, parts))

    out = F.lit("unknown")
    for text in (fqn, name):
        for found, parts in reversed(loose):
            out = F.when(any_part(text, parts), found).otherwise(out)
    for found, parts in reversed(marks):
        out = F.when(annotated(parts), found).otherwise(out)
    return out


def is_test_file(path: Column) -> Column:
    """A path with a test folder, or a file named like a Java test; null and empty are not."""
    path = F.coalesce(path, F.lit(""))
    name = F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)
    folder = F.lower(path).contains("/test/") | F.lower(path).contains("\\test\\")
    return folder | name.startswith("Test") | name.endswith("Test.java") | name.endswith("Tests.java") | name.endswith("IT.java")


def test_paths(path: Column) -> Column:
    """Candidate test files of a main source file, as an array; empty for other files."""
    moved = F.replace(path, F.lit("/main/java/"), F.lit("/test/java/"))
    stem = F.regexp_replace(moved, r"\.java$", "")
    paths = F.transform(F.array(*map(F.lit, TEST_SUFFIXES)), lambda s: F.concat(stem, s, F.lit(".java")))
    return F.when(path.contains("/main/java/"), paths).otherwise(F.array().cast("array<string>"))


def simple_name(fqn: Column) -> Column:
    """The method name without owner and arguments."""
    return F.substring_index(F.substring_index(fqn, "(", 1), ".", -1)


def owner(fqn: Column) -> Column:
    """The class that a method FQN belongs to."""
    return F.regexp_extract(F.substring_index(fqn, "(", 1), r"^(.*)\.", 1)


def http_path(base: Column, path: Column) -> Column:
    """A class path and a method path joined with one slash; a method path that holds the base stays."""
    base, path = F.coalesce(base, F.lit("")), F.coalesce(path, F.lit(""))
    both = F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(path, "^/+", ""))
    alone = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return F.when((base != "") & path.startswith(base), path).when((base != "") & (path != ""), both).when(base != "", base).when(path != "", alone).otherwise("/")


def spaced_term(name: Column) -> Column:
    """camelCase as lower-case words; null under three characters."""
    out = F.lower(F.trim(F.regexp_replace(name, "([A-Z])", " $1")))
    return F.when(F.length(out) >= 3, out)


def risk_score(callers: Column, entries: Column, missing: Column) -> Column:
    def steps(x: Column, levels: tuple[tuple[int, int], ...]) -> Column:
        out = F.lit(0)
        for above, points in reversed(levels):
            out = F.when(x > above, points).otherwise(out)
        return out

    return steps(callers, ((20, 30), (10, 20), (5, 10))) + steps(entries, ((5, 50), (2, 40), (0, 30))) + steps(missing, ((5, 20), (2, 15), (0, 10)))


def risk_level(score: Column) -> Column:
    return F.when(score >= 70, "CRITICAL").when(score >= 50, "HIGH").when(score >= 30, "MEDIUM").otherwise("LOW")


def confidence(callers: Column, tests: Column) -> Column:
    return F.least(F.lit(1.0), 0.5 + F.least(0.05 * callers, F.lit(0.3)) + F.least(0.1 * tests, F.lit(0.2)))


# Packages of clients of other systems, by dependency type, in the order in which they are tried.
CLIENTS = {
    "redis": (
        "org.springframework.data.redis.core.RedisTemplate",
        "org.springframework.data.redis.core.StringRedisTemplate",
        "org.springframework.data.redis.core.ValueOperations",
        "org.springframework.data.redis.core.HashOperations",
        "org.springframework.data.redis.core.ListOperations",
        "org.springframework.data.redis.core.SetOperations",
        "org.springframework.data.redis.core.ZSetOperations",
        "redis.clients.jedis.Jedis",
        "io.lettuce.core.RedisClient",
    ),
    "mq": (
        "org.springframework.amqp.core.AmqpTemplate",
        "org.springframework.amqp.rabbit.core.RabbitTemplate",
        "org.springframework.kafka.core.KafkaTemplate",
        "org.springframework.jms.core.JmsTemplate",
        "com.rabbitmq.client.Channel",
    ),
    "http": (
        "org.springframework.web.client.RestTemplate",
        "org.springframework.web.reactive.function.client.WebClient",
        "org.apache.http.client.HttpClient",
        "okhttp3.OkHttpClient",
        "java.net.HttpURLConnection",
    ),
    "rpc": ("org.apache.dubbo", "io.grpc", "com.alibaba.dubbo"),
}
LAYERS = ("controller", "service", "repository", "domain")
RISK_LEVELS = ("low", "medium", "high", "critical")
CLASS_SUFFIXES = ("Entity", "DTO", "VO", "Model", "Service", "Repository", "Controller", "Manager", "Handler", "Processor")
BUSINESS_VERBS = ("create", "update", "delete", "save", "find", "validate", "process", "calculate", "generate")
ACCESSOR = "^(get|set|is)[A-Z].*$|^(has|contains|equals|hashCode|toString)$"
SUMMARY_PREFIXES = ("摘要:", "总结:", "功能:", "这个方法", "该方法")
TEST_METHOD = r"@Test\s+(?:public\s+)?(?:static\s+)?(?:\w+\s+)+(\w+)\s*\("
NAMED_TEST_METHOD = r"(?:public|protected|private)?\s+(?:static\s+)?(?:\w+\s+)+test(\w+)\s*\("
# Words in comments that ask a model for something; the first list counts in block comments, the second in line comments.
BLOCK_WORDS = ("IGNORE", "INSTRUCTIONS", "OUTPUT", "PRINT", "TRANSLATE", "SHOW", "REVEAL", "SYSTEM")
BLOCK_WORDS_TO_FIRST_END = ("SECRET", "PASSWORD", "KEY")
LINE_WORDS = ("IGNORE", "INSTRUCTIONS", "OUTPUT", "TRANSLATE", "SHOW", "REVEAL", "SYSTEM", "SECRET", "PASSWORD", "KEY")


def _any(tests: list[Column]) -> Column:
    return reduce(Column.__or__, tests)


def layer_priority(layer: Column) -> Column:
    """Sort key of a layer: controllers first, whatever isn't a layer last."""
    out = F.lit(len(LAYERS))
    for k, name in enumerate(LAYERS):
        out = F.when(layer == name, k).otherwise(out)
    return out


def sibling_test_paths(path: Column, has_sibling: Column) -> Column:
    """As ``test_paths``, with the file's own name in the test folder as a fourth candidate.

    Other files have candidates in the folder ``test`` beside their parent folder, where ``has_sibling`` says that
    it exists.
    """
    main = path.contains("/main/java/")
    aside = F.concat(F.regexp_extract(path, r"^(.*)/[^/]+/[^/]+$", 1), F.lit("/test/"), F.element_at(F.split(path, "/"), -1))
    moved = F.when(main, F.replace(path, F.lit("/main/java/"), F.lit("/test/java/"))).otherwise(aside)
    stem = F.regexp_replace(moved, r"\.java$", "")
    paths = F.transform(F.array(*(F.lit(s) for s in (*TEST_SUFFIXES, ""))), lambda s: F.concat(stem, s, F.lit(".java")))
    return F.when(main | has_sibling, paths).otherwise(F.array().cast("array<string>"))


def test_methods(content: Column) -> Column:
    """Methods after ``@Test``, then methods named ``test...`` that aren't among them; only the latter are made distinct."""
    marked = F.regexp_extract_all(content, F.lit(TEST_METHOD), 1)
    named = F.transform(F.regexp_extract_all(content, F.lit(NAMED_TEST_METHOD), 1), lambda x: F.concat(F.lit("test"), x))
    return F.concat(marked, F.array_except(named, marked))


def api_path(path: Column) -> Column:
    """A path from bytecode: one leading slash, no doubled ones."""
    return F.regexp_replace(F.concat(F.lit("/"), F.coalesce(path, F.lit(""))), "/+", "/")


def like_literal(text: Column) -> Column:
    """A pattern that matches the text itself, with a backslash before what LIKE would read otherwise."""
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")


def string_array(json: Column) -> Column:
    """A JSON array of strings; anything else, nulls and broken texts included, is an empty array."""
    items = F.from_json(json, "array<string>")
    kinds = F.from_json(json, "array<variant>")
    strings = F.coalesce(F.forall(kinds, lambda v: F.schema_of_variant(v) == "STRING"), F.lit(False))
    return F.when(strings, items).otherwise(F.array().cast("array<string>"))


def owner_name(fqn: Column) -> Column:
    """The simple name of the class that a method FQN belongs to."""
    return F.substring_index(owner(fqn), ".", -1)


def is_mapper_call(fqn: Column) -> Column:
    """Whether a called method's class is named like a mapper, DAO or repository and isn't a base class.

    The arguments are cut off first, so that dots in them don't count.
    """
    name = owner_name(fqn)
    return _any([name.endswith(s) for s in STORE_SUFFIXES]) & ~name.startswith("Base")


def client_type(fqn: Column) -> Column:
    """The dependency type of a called client, by the first list that has a prefix of it; else null."""
    out = F.lit(None).cast("string")
    for kind, prefixes in reversed(CLIENTS.items()):
        out = F.when(_any([fqn.startswith(p) for p in prefixes]), kind).otherwise(out)
    return out


def class_term(name: Column) -> Column:
    """A class name without the first suffix that fits; null for test and mock classes and under three characters."""
    cut = reduce(lambda rest, s: F.when(name.endswith(s), F.left(name, F.length(name) - len(s))).otherwise(rest), reversed(CLASS_SUFFIXES), name)
    return F.when(~name.startswith("Test") & ~name.startswith("Mock") & (F.length(cut) >= 3), cut)


def method_term(name: Column) -> Column:
    """A method's term: null for accessors."""
    return F.when(~name.rlike(ACCESSOR), spaced_term(name))


def field_term(name: Column) -> Column:
    """A field's term: null for technical fields."""
    return F.when(~name.startswith("_") & ~name.startswith("serial"), spaced_term(name))


def is_domain_method(name: Column) -> Column:
    """Whether a method has a business verb in its name and is no accessor."""
    return ~name.rlike(ACCESSOR) & _any([F.lower(name).contains(v) for v in BUSINESS_VERBS])


def config_key(value: Column) -> Column:
    """The key of ``${key}`` or ``${key:default}``; null for other texts."""
    key = F.regexp_extract(value, r"\$\{([^:}]+)", 1)
    return F.when(key != "", key)


def bean_name(name: Column) -> Column:
    """A class's default bean name: decapitalised unless it begins with two capitals."""
    return F.when(name.rlike("^[A-Z]{2}"), name).otherwise(F.concat(F.lower(F.left(name, F.lit(1))), F.substring(name, 2, 1 << 30)))


def client_key(forwarded: Column, host: Column) -> Column:
    """Who asks: the first forwarded address, else the host, else localhost."""
    first = F.trim(F.element_at(F.split(forwarded, ","), 1))
    return F.coalesce(F.when(first != "", first), F.when(host != "", host), F.lit("localhost"))


def scrubbed(code: Column, longest: int = 50_000) -> Column:
    """Source code cut to ``longest`` characters, without comments that could instruct a model.

    Matches are greedy, so one may reach up to the last comment, as documented for this rule.
    """
    out = F.substring(code, 1, longest)
    for words, pattern in ((BLOCK_WORDS, r"/\*.*{}.*\*/"), (BLOCK_WORDS_TO_FIRST_END, r"/\*.*{}.*?\*/"), (LINE_WORDS, "//.*{}.*")):
        for word in words:
            out = F.regexp_replace(out, "(?is)" + pattern.format(word), "")
    return F.trim(F.regexp_replace(out, r"^\s+|\s+$", ""))


def clean_summary(text: Column) -> Column:
    """A model's answer without the prefixes that it may begin with, taken off in order."""
    out = F.trim(text)
    for prefix in SUMMARY_PREFIXES:
        out = F.when(out.startswith(prefix), F.trim(F.substring(out, len(prefix) + 1, 1 << 30))).otherwise(out)
    return out


def fallback_summary(fqn: Column, signature: Column, modifiers: Column) -> Column:
    """What is said of a method when no model answers."""
    name = F.substring_index(fqn, ".", -1)
    reads = name.startswith("get") | name.startswith("is") | F.coalesce(F.lower(signature).contains("return"), F.lit(False))
    static = F.coalesce(F.array_contains(modifiers, "static"), F.lit(False))
    return F.when(reads, "N/A (getter/accessor)").when(name.startswith("set"), "N/A (setter/mutator)").when(static, F.concat(F.lit("Static method: "), name)).otherwise(F.concat(F.lit("Method: "), name))


def prompt_part(label: str, value: Column) -> Column:
    """``label: value``, or null where there is none."""
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}: "), value))


def prompt(code: Column, **context: Column) -> Column:
    """The lines of context that are there, then the scrubbed code in a fence."""
    fence = F.concat(F.lit("\n```java\n"), scrubbed(F.coalesce(code, F.lit(""))), F.lit("\n```"))
    return F.concat_ws("\n", *(prompt_part(name.replace("_", " "), value) for name, value in context.items()), fence)


def level_prompt(level: str, name: Column, items: Column, **context: Column) -> Column:
    """A prompt about a class, package or module (``level``, brackets left out): its name, what context is there, and its
    parts' summaries as a list."""
    parts = F.when(F.size(items) > 0, F.concat(F.lit("parts:\n"), listed(items)))
    return F.concat_ws("\n", prompt_part(level.strip("()"), name), *(prompt_part(label.replace("_", " "), value) for label, value in context.items()), parts)


def entry_fqn(symbol_fqn: Column, fqn: Column) -> Column:
    """The FQN of an entry of a call chain, empty if it has none."""
    return F.coalesce(symbol_fqn, fqn, F.lit(""))


def listed(items: Column) -> Column:
    """An array of lines as a dashed list."""
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")


def trace_line(depth: Column, fqn: Column, layer: Column) -> Column:
    """A line of a call chain, indented by its depth."""
    return F.concat(F.repeat(F.lit("  "), depth), F.lit("-> "), fqn, F.lit(" ["), layer, F.lit("]"))


def risk_rank(level: Column) -> Column:
    """A risk level's place; unknown levels count as the lowest."""
    out = F.lit(0)
    for k, name in enumerate(RISK_LEVELS):
        out = F.when(F.lower(level) == name, k).otherwise(out)
    return out
