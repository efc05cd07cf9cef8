"""Hierarchical segments as parent and child tables: the calls of a hierarchical database, with its status codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Found, not found, end of the database.
OK, NOT_FOUND, END = "  ", "GE", "GB"


def get_unique(segment: DataFrame, order: list[str], where: Column | None = None) -> DataFrame:
    """GU / GHU: the first segment by key that meets the condition, one row at most; no row is status GE."""
    return (segment if where is None else segment.where(where)).orderBy(*order).limit(1)


def get_next(segment: DataFrame, order: list[str], after: list[object] | None = None) -> DataFrame:
    """GN / GHN: the first segment behind a position (None: from the start); no row is status GB."""
    if after is None:
        return get_unique(segment, order)
    behind, same = F.lit(False), F.lit(True)
    for name, at in zip(order, after, strict=True):
        behind, same = behind | (same & (F.col(name) > F.lit(at))), same & (F.col(name) == F.lit(at))
    return get_unique(segment, order, behind)


def next_in_parent(parents: DataFrame, children: DataFrame, on: list[str], order: list[str], number: int = 1) -> DataFrame:
    """GNP / GHNP for every parent: its number-th child by key and status (GE: there is none)."""
    w = Window.partitionBy(*on).orderBy(*order)
    nth = children.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == number)
    return parents.join(nth, on, "left").withColumn("status", F.when(F.col("_rn").isNull(), NOT_FOUND).otherwise(OK)).drop("_rn")


def insert(segment: DataFrame, new: DataFrame) -> DataFrame:
    """ISRT"""
    return segment.unionByName(new)


def replace(segment: DataFrame, changed: DataFrame, key: list[str]) -> DataFrame:
    """REPL: segments of a changed key give way to it; a key that isn't there changes nothing."""
    put = changed.dropDuplicates(key).join(segment.select(*key).distinct(), key, "left_semi")
    return segment.join(put.select(*key), key, "left_anti").unionByName(put.select(*segment.columns))


def delete(segments: list[tuple[DataFrame, list[str]]], keys: DataFrame) -> list[DataFrame]:
    """DLET: the segments of these keys and all that hang below them; (frame, the columns it shares with the keys) for each level."""
    return [frame.join(keys.select(*on).distinct(), on, "left_anti") for frame, on in segments]
