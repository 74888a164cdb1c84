"""JVM descriptors, access flags and type names as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Descriptors of primitive types, access flags in the order in which they are shown, and the types that
# count as plain values, with the primitive ones.
PRIMITIVES = {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "V": "void", "Z": "boolean"}
FLAGS = {"public": 0x1, "private": 0x2, "protected": 0x4, "static": 0x8, "final": 0x10, "abstract": 0x400}
BOXES = ("Byte", "Short", "Integer", "Long", "Float", "Double", "Boolean", "Character", "String")

_TYPE = r"\[*(?:L[^;]+;|[BCDFIJSZV])"


def type_name(descriptor: Column) -> Column:
    """The type that a field descriptor names, an array with a pair of brackets for each dimension."""
    body = F.regexp_replace(descriptor, r"^\[+", "")
    primitive = F.create_map(*[F.lit(x) for pair in PRIMITIVES.items() for x in pair])[body]
    plain = F.coalesce(primitive, dotted(F.regexp_replace(body, "^L|;$", "")))
    return F.concat(plain, F.repeat(F.lit("[]"), F.length(descriptor) - F.length(body)))


def argument_types(descriptor: Column) -> Column:
    """The types of a method descriptor's arguments; none if it is no such descriptor."""
    return F.transform(F.regexp_extract_all(F.regexp_extract(descriptor, r"^\((.*)\)", 1), F.lit(_TYPE), 0), type_name)


def return_type(descriptor: Column) -> Column:
    """The type that a method descriptor returns; null if it is no such descriptor."""
    found = F.regexp_extract(descriptor, rf"\)({_TYPE})$", 1)
    return F.when(found != "", type_name(found))


def signature(descriptor: Column) -> Column:
    """A method descriptor's arguments as they stand in a method's FQN."""
    return F.concat(F.lit("("), F.array_join(argument_types(descriptor), ", "), F.lit(")"))


def modifiers(access: Column) -> Column:
    """The modifiers among access flags."""
    return F.array_compact(F.array(*(F.when(access.bitwiseAND(flag) != 0, name) for name, flag in FLAGS.items())))


def is_primitive(name: Column) -> Column:
    """Whether a type is primitive or void."""
    return F.coalesce(name, F.lit("")).isin(*PRIMITIVES.values())


def is_plain(name: Column) -> Column:
    """Whether a type is primitive, the box of one, or a string; no type is plain too."""
    boxes = [f"java.lang.{box}" for box in BOXES]
    return name.isNull() | name.isin(*(p for p in PRIMITIVES.values() if p != "void"), *boxes)


def dotted(internal: Column) -> Column:
    """An internal name with dots for slashes."""
    return F.replace(internal, F.lit("/"), F.lit("."))


def internal(name: Column) -> Column:
    """A dotted name with slashes for dots."""
    return F.replace(name, F.lit("."), F.lit("/"))


def package_name(fqn: Column) -> Column:
    """What stands before a class name's last dot; empty for a class without a package."""
    return F.regexp_extract(fqn, r"^(.*)\.[^.]*$", 1)


def proxy_type(needs_proxy: Column, final: Column, has_interfaces: Column) -> Column:
    """How a class that needs a proxy gets one; null for others."""
    return F.when(needs_proxy, F.when(~final & has_interfaces, "jdk_or_cglib").otherwise("cglib"))
