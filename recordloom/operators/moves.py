"""MOVE, INITIALIZE and the CORRESPONDING forms as projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recordloom.functions.semantics import pad


def corresponding(source: StructType, target: StructType) -> list[str]:
    """Names that both groups have, sorted."""
    return sorted({f.name for f in source} & {f.name for f in target})


def move_corresponding(df: DataFrame, source: str, target: str) -> DataFrame:
    a, b = df.schema[source].dataType, df.schema[target].dataType
    names = corresponding(a, b)
    return df.withColumn(target, F.struct(*[(F.col(f"{source}.{f.name}") if f.name in names else F.col(f"{target}.{f.name}")).alias(f.name) for f in b]))


def add_corresponding(df: DataFrame, source: str, target: str, sign: int = 1) -> DataFrame:
    a, b = df.schema[source].dataType, df.schema[target].dataType
    names = corresponding(a, b)
    return df.withColumn(target, F.struct(*[(F.col(f"{target}.{f.name}") + sign * F.col(f"{source}.{f.name}") if f.name in names else F.col(f"{target}.{f.name}")).alias(f.name) for f in b]))


def group(parts: list[tuple[Column, int]]) -> Column:
    """A group's characters: its items, each in its size."""
    return F.concat(*[pad(c, n) for c, n in parts])


def spread(text: Column, sizes: list[int]) -> list[Column]:
    """A group's characters dealt to items from left to right."""
    out, at = [], 1
    for n in sizes:
        out.append(pad(F.substring(text, at, n), n))
        at += n
    return out


def initialize(df: DataFrame, numeric: object = 0, alphanumeric: str = "", only: list[str] | None = None) -> DataFrame:
    """Numbers and texts of the named columns (default: all) reset by type."""
    out = []
    for f in df.schema:
        kind = f.dataType.simpleString()
        reset = None if only is not None and f.name not in only else alphanumeric if kind == "string" else numeric if kind.startswith(("decimal", "int", "bigint", "double", "float", "smallint")) else None
        out.append(F.col(f.name) if reset is None else F.lit(reset).cast(f.dataType).alias(f.name))
    return df.select(*out)


def move_all(text: str, size: int) -> Column:
    return F.lit((text * (size // len(text) + 1))[:size])
