"""Places in a total order and running totals, without a window that gathers all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows in ranges of the order, sorted within; _id holds the range's number (upper bits) and the place in it.

    It is kept, since every plan over it must see the same ranges.
    """
    by = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return df.repartitionByRange(by, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_id", 33)).persist()


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Every row with its place, from 1, in a total order: a place within its range, behind the rows of the ranges before."""
    ranged = _ranged(df, order)
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each range
    return ranged.join(F.broadcast(before), "_range").select(*df.columns, (F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + 1).alias(name))


def running(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """Every row with the total of a value over all rows up to it, never reset."""
    ranged = _ranged(df.withColumn("_value", value), order)
    totals = ranged.groupBy("_range").agg(F.sum("_value").alias("_t"))
    before = totals.select("_range", F.sum("_t").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))  # a row for each range
    within = F.sum("_value").over(Window.partitionBy("_range").orderBy("_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = ranged.withColumn("_within", within).join(F.broadcast(before), "_range", "left")
    return out.select(*df.columns, F.when(F.col("_before").isNull(), F.col("_within")).otherwise(F.col("_within") + F.col("_before")).alias(name))
