"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.storage import keep, shared_dir, temporary

__all__ = ["WORD_PATTERN", "fold", "free_name", "keep", "on_plain_names", "plain_names", "quoted", "shared_dir", "table", "temporary", "without_maps"]

#: Word of the size, rule and shingle contracts: a run of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, parts: int, seed: str = "") -> F.Column:
    """crc32 of an id as text modulo ``parts``; a null id counts as the empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.pmod(F.crc32(F.concat(text, F.lit(seed)) if seed else text), F.lit(parts))


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted working names, each with as many underscores before it as keep it apart from ``df``'s columns."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def quoted(column: str) -> F.Column:
    """The column of that very name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def plain_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with the working names c0, c1, ... and the working name of each of its own; ``toDF`` puts those back."""
    names = [f"c{k}" for k in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names, strict=True))


def on_plain_names(docs: DataFrame, operator: Callable[[DataFrame], DataFrame], *needed: str) -> DataFrame:
    """What ``operator`` makes of ``docs``, with working names in place of those it does not need.

    Columns come out under their own names, whatever characters those have; a column that the operator
    added gets underscores before its name where a column of ``docs`` has that name.
    """
    own = {c if c in needed else f"c{k}": c for k, c in enumerate(docs.columns)}
    out = operator(docs.toDF(*own))
    added = [c for c in out.columns if c not in own]
    named = own | dict(zip(added, free_name(docs, *added), strict=True))
    return out.toDF(*[named[c] for c in out.columns])


def without_maps(df: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with arrays of entries in place of maps, which can be neither compared nor hashed, and what puts the maps back."""
    kinds = {f.name: f.dataType for f in df.schema if _has_map(f.dataType)}
    if not kinds:
        return df, lambda out: out
    back = lambda out: out.withColumns({c: _mapped(quoted(c), kind) for c, kind in kinds.items()})
    return df.withColumns({c: _entries(quoted(c), kind) for c, kind in kinds.items()}), back


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind)
    return isinstance(kind, T.MapType) or (isinstance(kind, T.ArrayType) and _has_map(kind.elementType))


def _entries(value: F.Column, kind: T.DataType) -> F.Column:
    if not _has_map(kind):
        return value
    if isinstance(kind, T.MapType):
        return F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), _entries(e["value"], kind.valueType).alias("value")))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _entries(x, kind.elementType))
    return F.when(value.isNotNull(), F.struct(*[_entries(value.getField(f.name), f.dataType).alias(f.name) for f in kind]))


def _mapped(value: F.Column, kind: T.DataType) -> F.Column:
    if not _has_map(kind):
        return value
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.transform(value, lambda e: F.struct(e["key"].alias("key"), _mapped(e["value"], kind.valueType).alias("value"))))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _mapped(x, kind.elementType))
    return F.when(value.isNotNull(), F.struct(*[_mapped(value.getField(f.name), f.dataType).alias(f.name) for f in kind]))
