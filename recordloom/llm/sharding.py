"""Weighted rendezvous hashing of stable keys, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _score(key: Column, shard: int, weight: float) -> Column:
    """-ln(u) / weight for a uniform u of (key, shard): the least score of all shards wins with odds by weight."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / F.lit(float(weight))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard of a key: 0 to len(weights) - 1. Shards of weight 0 take nothing; ties go to the lower shard."""
    if not any(w > 0 for w in weights):
        raise ValueError("some weight must be positive")
    best = F.least(*[F.struct(_score(key, s, w).alias("score"), F.lit(s).alias("shard")) for s, w in enumerate(weights) if w > 0], *([F.struct(F.lit(float("inf")).alias("score"), F.lit(-1).alias("shard"))] * (sum(w > 0 for w in weights) < 2)))
    return best["shard"]


def shard_documents(docs: DataFrame, weights: list[float], grown: list[float] | None = None, buckets: int = 256) -> DataFrame:
    """Shard, slot within it and the shard under the grown weights, for every row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The key doc_id and the weights alone decide a row's shard. `grown` has one shard more (default: of mean weight)
    and only that shard gains rows. Slots are gapless from 0: each (shard, bucket) counts its own rows and starts at
    the prefix sum of the buckets before, so no task holds a whole shard. The sums have shards x buckets rows.
    Null text: no bytes, size 1; a null doc_id is a key like others; repeated rows get slots of their own.
    """
    grown = [*weights, sum(weights) / len(weights)] if grown is None else grown
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    # shards are found once for each row: the wide expression sits below the exchange and is not repeated above it
    ids = docs.select("doc_id", rendezvous(key, weights).alias("shard"), F.pmod(F.xxhash64(key, F.lit("slot")), F.lit(buckets)).cast("int").alias("_bucket"))
    sums = ids.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    base = sums.select("shard", "_bucket", F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), rendezvous(key, weights).alias("shard"), rendezvous(key, grown).alias("grown_shard"), F.pmod(F.xxhash64(key, F.lit("slot")), F.lit(buckets)).cast("int").alias("_bucket"))
    placed = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("doc_id", "text_crc32", "size")) - 1)
    return placed.join(F.broadcast(base), ["shard", "_bucket"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_rank") + F.col("_base")).cast("bigint").alias("slot"), "grown_shard")
