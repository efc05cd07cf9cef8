"""PERFORM … TIMES and VARYING … AFTER as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def times(df: DataFrame, count: Column, name: str = "iteration") -> DataFrame:
    """A row for each of n passes, numbered from 1; nothing for n < 1 or null."""
    return varying(df, [(name, F.lit(1), F.lit(1), count)])


def varying(df: DataFrame, loops: list[tuple[str, Column, Column, Column]], test_after: bool = False) -> DataFrame:
    """A row for each pass: (name, FROM, BY, last value that UNTIL lets through), the outermost first; later loops may use earlier names.

    test_after: every loop passes once at least. A step of 0 or away from the end gives no pass (or that one).
    """
    for name, start, by, last in loops:
        runs = (by > 0) & (start <= last) | (by < 0) & (start >= last)
        none = F.array(start.cast("bigint")) if test_after else F.array().cast("array<bigint>")
        df = df.withColumn(name, F.explode(F.when(runs, F.sequence(start.cast("bigint"), last.cast("bigint"), by.cast("bigint"))).otherwise(none)))
    return df
