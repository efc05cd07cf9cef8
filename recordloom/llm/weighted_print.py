"""Consistent weighted sampling of word shingles, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.llm.common import bucket_of, order_buckets, shuffle_partitions

WORDS = 5


def _gamma_quantiles(levels: int) -> list[float]:
    """Quantiles of Gamma(2, 1) at the middles of equal steps, by Newton's method on 1 - (1 + x) exp(-x)."""
    out, x = [], 1e-3
    for i in range(levels):
        p = (i + 0.5) / levels
        x = max(x, math.sqrt(2 * p) if p < 0.01 else x)
        for _ in range(60):
            step = (1 - (1 + x) * math.exp(-x) - p) / (x * math.exp(-x))
            x = x - step if x > step else x / 2
            if abs(step) < 1e-13 * x:
                break
        out.append(x)
    return out


def tables(spark: SparkSession) -> tuple[Column, Column]:
    """Quantiles of Gamma(2, 1) and logarithms of finer ones, as scalar subqueries: plans hold their names, not their values."""
    rows = spark.createDataFrame([(_gamma_quantiles(1 << 11), [math.log(x) for x in _gamma_quantiles(1 << 13)])], "gamma array<double>, log_gamma array<double>")
    return rows.select("gamma").scalar(), rows.select("log_gamma").scalar()


def words_of(text: Column) -> Column:
    """A text's words, split at ASCII white space."""
    return F.array_remove(F.split(text, "[ \\t-\\r]+"), "")


def terms(words: Column) -> Column:
    """Sorted 64-bit hashes of a text's WORDS-word shingles, one for each occurrence; of all words where there are fewer.

    `words` must be a column of the frame below: it is named many times, and a function in its place would be worked out each time.
    """
    n = F.size(words)
    shifted = [F.slice(words, i + 1, F.greatest(n - (WORDS - 1), F.lit(0))).alias(f"w{i}") for i in range(WORDS)]
    many = F.transform(F.arrays_zip(*shifted), lambda s: F.xxhash64(*[s[f"w{i}"] for i in range(WORDS)]))
    return F.sort_array(F.when(n >= WORDS, many).when(n > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>")))


def samples(term: Column, weight: Column, count: int, gamma: Column, log_c: Column) -> list[Column]:
    """For each sample the pair (a, id) of one weighted term as one number, to be minimised over a text's terms.

    Of every term and sample a hash gives r and c, Gamma(2, 1) by tabled quantiles, and a uniform b. With
    t = floor(ln w / r + b) the term's a is c / exp(r (t - b + 1)); the least a's (term, t) is the sample, and two
    texts' samples agree as often as their generalised Jaccard similarity says. ln a takes the upper bits in steps
    of 2^-24, the id of (term, t) the lower 32.
    """
    log_w, out = F.log(weight.cast("double")), []
    for j in range(count):
        h = F.xxhash64(term, F.lit(j))
        r = F.get(gamma, h.bitwiseAND(F.lit((1 << 11) - 1)).cast("int"))
        b = F.shiftrightunsigned(h, 40).cast("double") * (1.0 / (1 << 24))
        c = F.get(log_c, F.shiftrightunsigned(h, 20).bitwiseAND(F.lit((1 << 13) - 1)).cast("int"))
        t = F.floor(log_w / r + b)
        low = F.floor((c - r * (t - b + 1) + 64.0) * float(1 << 24))
        out.append(F.shiftleft(low, 32).bitwiseOR((term + t * 40503).bitwiseAND(F.lit(0xFFFFFFFF))))
    return out


def likeness(a: Column, b: Column, count: int) -> Column:
    """Share of equal samples of two fingerprints."""
    same = [(F.substring(a, 8 * j + 1, 8) == F.substring(b, 8 * j + 1, 8)).cast("int") for j in range(count)]
    total = same[0]
    for x in same[1:]:
        total = total + x
    return total / F.lit(float(count))


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """Every document (doc_id, text, _row, _b and the like) with the text of the next by ascending doc_id, the first after the last.

    doc_id falls into order-preserving buckets; the first document of each also goes, as a ghost, to the end of the
    bucket before, so a window within buckets finds every successor and texts cross the network once. Ghosts stay in
    (_ghost = 1) for a second look-up. Rows of equal doc_id follow each other by hash of their text; null ids come first.
    """
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    points = order_buckets(ids, "doc_id", buckets)
    firsts = ids.where("doc_id is not null").groupBy(bucket_of(F.col("doc_id"), points).alias("_at")).agg(F.min("doc_id").alias("_first"))
    everything = Window.orderBy("_at")
    before = firsts.select("_first", F.lag("_at").over(everything).alias("_before"), F.max("_at").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_last"))
    ghosts = before.select("_first", F.coalesce("_before", "_last").alias("_to"), F.when(F.col("_before").isNull(), 1).otherwise(0).alias("_round"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("_row")).withColumn("_key", F.xxhash64("text"))
    rows = rows.join(F.broadcast(ghosts), F.col("doc_id") == F.col("_first"), "left")
    own = F.struct(bucket_of(F.col("doc_id"), points).alias("_b"), F.lit(0).alias("_ghost"), F.lit(0).alias("_wrap"))
    ghost = F.struct(F.col("_to").alias("_b"), F.lit(1).alias("_ghost"), F.col("_round").alias("_wrap"))
    placed = rows.select("doc_id", "text", "_row", "_key", F.inline(F.when(F.col("_first").isNull(), F.array(own)).otherwise(F.array(own, ghost))))
    order = Window.partitionBy("_b").orderBy("_wrap", "doc_id", "_ghost", "_key", "_row")
    return placed.select("*", F.lead("text").over(order).alias("_next"))


def fingerprints(docs: DataFrame, count: int = 32, buckets: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next for every whole text.

    A term's weight is its number of occurrences. Null text is empty; a text without words has the fingerprint of
    ones, which agrees with its like alone. Repeated rows are documents of their own; a null doc_id comes first in the
    order. A very long text is one row until its terms are counted, then as many as it has distinct terms. With `count`
    samples a likeness moves in steps of 1 / count and has a standard error of about sqrt(l (1 - l) / count). Everything behind the one
    exchange of texts, by bucket, keeps to that partitioning.
    """
    rows = with_next(docs, buckets or 8 * shuffle_partitions(docs.sparkSession))
    n = F.length("text")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.coalesce(F.expr("substring(_next, 1, cast(floor(length(text) / 2) as int))"), F.lit("")))
    rows = rows.select("doc_id", "_row", "_key", "_b", "_ghost", "_wrap", n.cast("bigint").alias("n_chars"), "text", F.when(F.col("_ghost") == 0, edited).alias("_edited"))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("_edited").cast("binary"), 256))
    keys = ["_b", "_ghost", "_wrap", "doc_id", "_key", "_row", "n_chars", "edited_sha256"]
    sides = F.when(F.col("_ghost") == 0, F.array(F.struct(F.lit(0).alias("_side"), F.col("text").alias("_text")), F.struct(F.lit(1).alias("_side"), F.col("_edited").alias("_text")))).otherwise(F.array(F.struct(F.lit(0).alias("_side"), F.col("text").alias("_text"))))
    split = rows.select(*keys, F.inline(sides)).select(*keys, "_side", words_of(F.col("_text")).alias("_words")).select(*keys, "_side", terms(F.col("_words")).alias("_h"))
    starts = split.select(*keys, "_side", "_h", F.expr("filter(sequence(1, greatest(size(_h), 1)), i -> i <= size(_h) and (i = 1 or _h[i - 1] != _h[i - 2]))").alias("_s"))
    runs = starts.select(*keys, "_side", "_h", F.inline_outer(F.arrays_zip(F.col("_s").alias("a"), F.expr("concat(slice(_s, 2, size(_h) + 1), array(size(_h) + 1))").alias("b"))))
    weighted = runs.select(*keys, "_side", F.expr("_h[a - 1]").alias("_term"), F.expr("b - a").alias("_w"))
    least = weighted.groupBy(*keys, "_side").agg(*[F.min(s).alias(f"_m{j}") for j, s in enumerate(samples(F.col("_term"), F.col("_w"), count, *tables(docs.sparkSession)))])
    text = F.concat(*[F.lpad(F.lower(F.hex(F.coalesce(F.col(f"_m{j}").bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(0xFFFFFFFF)))), 8, "0") for j in range(count)])
    prints = least.select(*keys, "_side", text.alias("_print"))
    both = prints.groupBy(*keys).agg(F.max(F.when(F.col("_side") == 0, F.col("_print"))).alias("fingerprint"), F.max(F.when(F.col("_side") == 1, F.col("_print"))).alias("edited_fingerprint"))
    order = Window.partitionBy("_b").orderBy("_wrap", "doc_id", "_ghost", "_key", "_row")
    paired = both.select("*", F.lead("fingerprint").over(order).alias("_next_print")).where("_ghost = 0")
    return paired.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint"), count).alias("near_edited"), F.coalesce(likeness(F.col("fingerprint"), F.col("_next_print"), count), F.lit(0.0)).alias("near_next"))
