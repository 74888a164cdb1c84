"""Small DataFrame helpers shared by the operators of this subpackage."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.scratch import clear, cut, cut_counted, shared_folder, sized, small

__all__ = ["clear", "columns", "crc_mod", "cut", "cut_counted", "identity", "row_identity", "seed_of", "shared_folder", "sized", "small", "table", "unused"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame) -> list[Column]:
    """All columns, whatever their names hold."""
    return [F.col(f"`{name.replace('`', '``')}`") for name in df.columns]


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it none of the frame's columns."""
    taken = {x.lower() for x in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def identity(*values: Column | str) -> Column:
    """128 hash bits of some values, as text: unlike values meet with a chance of 1e-19 among 1e10.

    Spark's hash passes over nulls, so it is told where they stand.
    """
    told = [x for v in (F.col(v) if isinstance(v, str) else v for v in values) for x in (v.isNull(), v)]
    return F.concat_ws("-", F.hex(F.xxhash64(*told)), F.hex(F.xxhash64(F.lit(1), *told)))


_JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def row_identity(df: DataFrame) -> Column:
    """``identity`` of whole rows; nested columns, maps too, are taken as JSON, in which nulls have their places."""
    nested = ("array", "map", "struct", "variant")
    return identity(*(F.to_json(c, _JSON) if f.dataType.simpleString().startswith(nested) else c for c, f in zip(columns(df), df.schema, strict=True)))


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the column's text modulo ``modulus``; a null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def seed_of(*parts: object) -> int:
    """A stable 64-bit seed."""
    text = "\x1f".join(map(str, parts)).encode()
    return zlib.crc32(text) << 32 | zlib.crc32(text, 0x5EED)
