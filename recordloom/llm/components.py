"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import materialise


def connected(edges: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """node, label for every node of edges (a, b): label is the least node of its component.

    Each round every node's neighbours above it hang on its least neighbour, then those below it do; minima are
    aggregated before they are joined back, so a hub's edges never meet in one row. Rounds cut their lineage in
    the shared folder and go on until no edge changes, about the logarithm of the longest path. Labels that most_rounds leave unfinished are an error.
    """
    now = materialise(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for done in count(1):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        low = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        least = low.groupBy("a").agg(F.min("b").alias("m"))
        small = low.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a != b")
        now = materialise(small.distinct())
        row = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if mark == tuple(row):
            break
        mark = tuple(row)
        if done == most_rounds:
            raise RuntimeError(f"components still changed in round {done}")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
