"""Supervised subword embeddings: hashed word and character n-gram vectors, averaged, softmax, stochastic gradient descent."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import fold, listed, map_arrow, text_bytes, word_codes

MIX = np.uint64(0x9E3779B97F4A7C15)
#: In bags, words of more bytes are not cached. N-grams of these, and of all words in scoring, are hashed as arrays, CHUNK places at a time.
LONG, CHUNK = 64, 1 << 18
_P1, _P2, _P3, _P4, _P5 = (np.uint32(x) for x in (2654435761, 2246822519, 3266489917, 668265263, 374761393))


def _turn(h: np.ndarray, by: int) -> np.ndarray:
    return (h << np.uint32(by)) | (h >> np.uint32(32 - by))


def window_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """xxh32 of every window of n bytes, n below 16."""
    count = len(data) - n + 1
    wide = data.astype(np.uint32)
    h = np.full(count, _P5 + np.uint32(n), np.uint32)
    for at in range(0, n - 3, 4):
        lane = sum(wide[at + k : at + k + count] << np.uint32(8 * k) for k in range(4))
        h = _turn(h + lane * _P3, 17) * _P4
    for at in range(n - n % 4, n):
        h = _turn(h + wide[at : at + count] * _P5, 11) * _P1
    h = (h ^ (h >> np.uint32(15))) * _P2
    h = (h ^ (h >> np.uint32(13))) * _P3
    return h ^ (h >> np.uint32(16))


@dataclass(frozen=True)
class Shape:
    buckets: int = 1 << 16
    dim: int = 12
    low: int = 3  # character n-grams of low to high bytes of <word>
    high: int = 5
    epochs: int = 8
    rate: float = 0.5
    seed: int = 11


class Features:
    """Hashed features of texts: for each distinct word its own and its n-grams' buckets; word pairs come from the words' hashes.

    A word of over LONG bytes gets a new code each time, its own bucket alone in `parts` and its bytes in `long`,
    until `forget_long`; `grams` gives the rest of its buckets.
    """

    def __init__(self, shape: Shape, limit: int = 150_000):
        self.shape, self.limit = shape, limit
        self.codes: dict[bytes, int] = {}
        self.parts: list[np.ndarray] = []
        self.hashes: list[int] = []
        self.long: dict[int, bytes] = {}

    def word(self, w: bytes) -> int:
        code, top = self.codes.get(w), self.shape.buckets
        if code is None and len(w) > LONG:
            code, h = len(self.parts), xxhash.xxh64_intdigest(w)
            self.long[code] = w
            self.parts.append(np.array([h % top], np.int64))
            self.hashes.append(h)
        elif code is None:
            code = self.codes[w] = len(self.parts)
            padded = b"<" + w + b">"
            h = xxhash.xxh64_intdigest(w)
            grams = [padded[i : i + n] for n in range(self.shape.low, self.shape.high + 1) for i in range(len(padded) - n + 1)]
            self.parts.append(np.array([h % top, *[xxhash.xxh32_intdigest(g) % top for g in grams]], np.int64))
            self.hashes.append(h)
        return code

    def grams(self, w: bytes) -> Iterator[np.ndarray]:
        """Buckets of all n-grams of a word, some at a time."""
        data = np.frombuffer(b"<" + w + b">", np.uint8)
        for n in range(self.shape.low, self.shape.high + 1):
            for at in range(0, len(data) - n + 1, CHUNK):
                yield window_hashes(data[at : at + CHUNK + n - 1], n).astype(np.int64) % self.shape.buckets

    def sums(self, words: list[bytes], scalar: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word the sum of `scalar` over its own and its n-grams' buckets, how many these are, and its hash; an empty word has none.

        A word's sum depends on the word alone, not on what stands beside it.
        """
        top = self.shape.buckets
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        padded = np.fromiter(map(len, words), np.int64, len(words)) + 2
        sums, ends, first = scalar[(hashes % np.uint64(top)).astype(np.int64)].astype(np.float64), np.cumsum(padded), 0
        while first < len(words):
            base = int(ends[first] - padded[first])
            last = max(first + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
            if padded[first] > CHUNK:
                sums[first] += sum(float(scalar[part].sum(dtype=np.float64)) for part in self.grams(words[first]))
            else:
                data = np.frombuffer(b"<" + b"><".join(words[first:last]) + b">", np.uint8)
                left = np.repeat((ends[first:last] - base).astype(np.int32), padded[first:last]) - np.arange(len(data), dtype=np.int32)
                found = np.zeros(len(data))
                for n in range(self.shape.low, min(self.shape.high, len(data)) + 1):
                    grams = scalar[window_hashes(data, n) % np.uint32(top)]
                    found[: len(grams)] += np.where(left[: len(grams)] >= n, grams, 0)  # windows that end in the next word don't count
                sums[first:last] += np.add.reduceat(found, ends[first:last] - padded[first:last] - base)
            first = last
        counts = 1 + sum(np.maximum(padded - n + 1, 0) for n in range(self.shape.low, self.shape.high + 1))
        sums[padded == 2] = counts[padded == 2] = 0
        return sums, counts, hashes

    def forget_long(self) -> None:
        self.long.clear()

    def reset_if_full(self) -> bool:
        if len(self.parts) > self.limit:
            self.codes.clear()
            self.parts.clear()
            self.hashes.clear()
            self.long.clear()
            return True
        return False

    def pairs(self, hashes: np.ndarray) -> np.ndarray:
        """Buckets of neighbouring words."""
        mixed = (hashes[:-1] * MIX) ^ hashes[1:]
        return ((mixed * MIX) >> np.uint64(20)).astype(np.int64) % self.shape.buckets

    def bag(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Distinct buckets of a text and their shares, which sum to 1; an empty text has none."""
        words = [self.word(w) for w in text.split()]
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.float32)
        ids = np.concatenate([*[self.parts[c] for c in words], self.pairs(np.array([self.hashes[c] for c in words], np.uint64))])
        if self.long:
            n = np.bincount(ids, minlength=self.shape.buckets)
            for c in words:
                for part in self.grams(self.long[c]) if c in self.long else ():
                    n += np.bincount(part, minlength=self.shape.buckets)
            self.forget_long()
            ids = np.flatnonzero(n)
            n = n[ids]
        else:
            ids, n = np.unique(ids, return_counts=True)
        return ids, (n / n.sum()).astype(np.float32)


@dataclass
class Model:
    shape: Shape
    scalar: np.ndarray  # each bucket's vector times the difference of the two classes' output weights
    bias: float

    def logits(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return sums / np.maximum(counts, 1) + self.bias


def descend(vectors: np.ndarray, out: np.ndarray, bias: np.ndarray, ids: np.ndarray, share: np.ndarray, label: int, rate: float) -> None:
    """One step against the gradient of a text's cross entropy, in place: output weights by `rate`, biases by a tenth of
    it, and vectors by `rate` times their length over the largest share, so that long texts' rare buckets move too."""
    mean = share @ vectors[ids]
    z = out @ mean + bias
    p = np.exp(z - z.max())
    p /= p.sum()
    p[label] -= 1
    back = p @ out
    out -= rate * np.outer(p, mean)
    bias -= rate * 0.1 * p
    vectors[ids] -= rate * vectors.shape[1] * np.outer(share, back) * min(8.0, 1.0 / float(share.max()))


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, shape: Shape) -> Model:
    """Stochastic gradient descent over shuffled documents, one at a time, with a rate that falls to 0. One class only: its prior."""
    rng = np.random.default_rng(shape.seed)
    vectors = (rng.random((shape.buckets, shape.dim), np.float32) - 0.5) / shape.dim
    out, bias = np.zeros((2, shape.dim), np.float32), np.zeros(2, np.float32)
    prior = (labels.sum() + 1) / (len(labels) + 2)
    bias[:] = np.log(1 - prior), np.log(prior)
    steps, done = shape.epochs * max(1, len(bags)), 0
    for _ in range(shape.epochs if len(set(labels.tolist())) == 2 else 0):
        for i in rng.permutation(len(bags)):
            if len(bags[i][0]):
                descend(vectors, out, bias, *bags[i], int(labels[i]), shape.rate * (1 - done / steps))
            done += 1
    return Model(shape, (vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 4_000, shape: Shape = Shape(), folds: int = 5) -> Model:
    """Learn from at most most_rows labelled documents, the first by a hash of doc_id, outside fold 0 of crc32(doc_id) mod folds.

    Only text is an input. Rows without doc_id or label are left out; without any row the score is a constant. Of
    labels that contradict each other the lowest counts; a labelled doc_id that several rows have teaches with each.
    What is learnt doesn't depend on how the rows are dealt.
    """
    picked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != 0)).groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    def per_slice():
        features = Features(shape)

        def apply(batch: pa.RecordBatch) -> dict:
            features.reset_if_full()
            bags = [features.bag(t) for t in text_bytes(batch)]
            return {"doc_id": batch.column("doc_id"), "quality": batch.column("quality").cast(pa.int32()), "ids": [b[0].astype("<i4").tobytes() for b in bags], "shares": [b[1].astype("<f4").tobytes() for b in bags]}

        return apply

    found = map_arrow(rows, per_slice, "doc_id bigint, quality int, ids binary, shares binary", "text").toArrow().sort_by([("doc_id", "ascending"), ("ids", "ascending"), ("shares", "ascending")])
    bags = [(np.frombuffer(i, "<i4").astype(np.int64), np.frombuffer(s, "<f4")) for i, s in zip(found["ids"].to_pylist(), found["shares"].to_pylist(), strict=True)]
    return train(bags, np.array(found["quality"].to_pylist(), np.int64), shape)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns of `keep`) and score, the probability of label 1, for every whole text; null is empty."""
    names = keep or ["doc_id"]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*names).schema)
    shape, scalar, bias = model.shape, model.scalar, model.bias

    def per_slice():
        features = Features(shape)

        def apply(batch: pa.RecordBatch) -> dict:
            codes, sizes, words = word_codes(batch, lower=False)
            sums, counts, hashes = features.sums(listed(words), scalar)
            by, real, starts = sums[codes], counts[codes] > 0, np.cumsum(sizes) - sizes
            for at in range(0, len(codes) - 1, CHUNK):
                both = real[at : at + CHUNK + 1]
                by[at + 1 : at + CHUNK + 1] += np.where(both[:-1] & both[1:], scalar[features.pairs(hashes[codes[at : at + CHUNK + 1]])], 0)
            # every text has a place at least, as an empty word stands behind its last
            total, count = np.add.reduceat(by, starts), np.add.reduceat(counts[codes], starts) + np.maximum(sizes - 2, 0)
            logit = total / np.maximum(count, 1) + bias
            return {c: batch.column(c) for c in names} | {"score": 1 / (1 + np.exp(-np.clip(logit, -500, 500)))}

        return apply

    columns = names if "text" in names else [*names, "text"]
    return map_arrow(docs.select(*columns), per_slice, f"{fields}score double", "text")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most_rows: int = 4_000, shape: Shape = Shape()) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from the threshold on) for every document.

    A row without doc_id isn't held out; null and empty texts get the score of no words; repeated rows come out
    repeatedly, and an empty table gives an empty one. A very long text is held whole, as one bag of buckets.
    """
    scored = score(docs, fit(docs, labels, most_rows, shape))
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most_rows: int = 4_000, shape: Shape = Shape()) -> DataFrame:
    """The documents that score at the threshold or above, with all their columns, whatever these are called.

    Null and empty texts are judged by the score of no words; repeated rows stay or go together; ties at the threshold
    stay; without usable labels the score is a constant and so is the verdict.
    """
    renamed = {c: f"_kept_{i}" for i, c in enumerate(docs.columns) if c != "text"}
    carried = docs.select(*[F.col(c).alias(renamed.get(c, c)) for c in docs.columns])
    scored = score(carried, fit(docs, labels, most_rows, shape), carried.columns).where(F.col("score") >= threshold)
    return scored.select(*[F.col(renamed.get(c, c)).alias(c) for c in docs.columns])
