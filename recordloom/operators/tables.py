"""OCCURS tables: element access and SEARCH."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search(table: Column, when: Callable[[Column], Column]) -> Column:
    """SEARCH: index (from 1) of the first element that meets the condition, or 0 (AT END)."""
    hits = F.transform(table, lambda x, i: F.when(when(x), i + 1).otherwise(F.lit(None)))
    return F.coalesce(F.array_min(F.array_compact(hits)), F.lit(0)).cast("int")


def search_all(probes: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """SEARCH ALL over a table kept as rows: an equality join; AT END are the rows without a hit."""
    return probes.join(table.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def put(table: Column, index: Column, value: Column) -> Column:
    """The table with one element replaced."""
    return F.transform(table, lambda x, i: F.when(i == index - 1, value).otherwise(x))


def depending_on(table: Column, count: Column) -> Column:
    return F.slice(table, F.lit(1), F.greatest(count, F.lit(0)))
