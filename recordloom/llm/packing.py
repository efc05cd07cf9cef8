"""Best-fit packing of token sequences under several capacities at once."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recordloom.llm.common import map_arrow, materialise, shuffle_partitions, text_bytes
from recordloom.llm.encoders import shared_encoder


@dataclass(frozen=True)
class Bin:
    """What a sequence may hold: tokens, documents (pieces) and attention cost, the sum of squared lengths.

    A full piece costs tokens squared, which is the least attention capacity that lets it in.
    """

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048


def pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Token pieces of every document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    Null text counts as empty: one piece that holds the end id alone. Only documents of over `capacity` ids are
    cut; a very long text becomes many pieces, one at a time. Repeated rows yield repeated pieces; other columns of
    docs are ignored; a null doc_id stays null.
    """
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids

    def per_slice():
        encoder, end = shared_encoder(tokenizer), np.array([end_id], "<u4").tobytes()

        def apply(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(text_bytes(batch)), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out["doc_id"].append(doc)
                    out["piece"].append(piece)
                    out["start"].append(at // 4)
                    out["length"].append(len(part) // 4)
                    out["ids_crc32"].append(zlib.crc32(part))
                    if keep_ids:
                        out["ids"].append(np.frombuffer(part, "<i4"))
            return out

        return apply

    return map_arrow(docs.select(F.col("doc_id").cast("bigint"), "text"), per_slice, schema, "text", quiet=True, keeps=f"words:{tokenizer}")


NORM, DOT = "residual_norm", "dot_product"
#: Rules by which bins are selected, with the weights of residual tokens, documents and attention: `pack` tries each.
RULES = ((NORM, (1.0, 0.25, 0.25)), (DOT, (1.0, 0.25, 0.25)))
#: Capacities that `pack_documents` tries, tight ones first: the first of those that give the fewest sequences is taken.
BINS = (Bin(documents=256), Bin(documents=512), Bin())


def best_fit(histogram: dict[int, int], bin: Bin = Bin(), weights: tuple[float, float, float] = RULES[0][1], rule: str = NORM) -> np.ndarray:
    """Pack a histogram of lengths, longest first; rows: length, first rank, pieces, first bin, offset, pieces a bin.

    A bin's state is its residual vector (tokens, documents, attention). Among the states in which a piece fits
    under every capacity, `rule` selects: "residual_norm", the least weighted norm of what would be left, or
    "dot_product", the greatest weighted product of residual and demand. Bins of equal state form a run and are
    served together, so the work grows with the number of lengths, not of pieces. Ties go to the earliest run.
    """
    if rule not in (NORM, DOT):
        raise ValueError(f"unknown rule {rule}")
    start = np.array([bin.tokens, bin.documents, bin.attention], np.int64)
    cap, weight = start.astype(float), np.asarray(weights, float)
    room = np.zeros((256, 3), np.int64)  # residual vectors of the runs
    span = np.zeros((256, 2), np.int64)  # first bin, number of bins
    used = bins = 0
    rows: list[tuple] = []
    for length in sorted(histogram, reverse=True):
        left, rank = int(histogram[length]), 0
        need = np.array([length, 1, length * length], np.int64)
        if (need > start).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacities")
        while left:
            fits = np.flatnonzero((room[:used] >= need).all(1) & (span[:used, 1] > 0))
            if len(fits):
                after, share = (room[fits] - need) / cap, room[fits] / cap * (need / cap)
                run = fits[np.argmin((after**2 * weight).sum(1)) if rule == NORM else np.argmax((share * weight).sum(1))]
                residual, first, number = room[run].copy(), int(span[run, 0]), int(span[run, 1])
                # the least norm only falls as a bin fills, so it takes all that fit; the greatest product falls too, so each takes one
                each = int((residual // np.maximum(need, 1)).min()) if rule == NORM else 1
                full = min(number, left // each)
                took, each = (full, each) if full else (1, left)
                span[run] = (first + took, number - took)
            else:  # nothing but new bins can take this length until they are full, by either rule
                residual, first = start.copy(), bins
                each = int((residual // np.maximum(need, 1)).min())
                full = left // each
                took, each = (full, each) if full else (1, left)
                bins += took
            rows.append((length, rank, took * each, first, bin.tokens - int(residual[0]), each))
            if used == len(room):
                room, span = np.concatenate([room, np.zeros_like(room)]), np.concatenate([span, np.zeros_like(span)])
            room[used], span[used] = residual - each * need, (first, took)
            used += 1
            rank += took * each
            left -= took * each
    return np.array(rows, np.int64).reshape(-1, 6)


def bins_of(plan: np.ndarray) -> int:
    return int((plan[:, 3] + -(-plan[:, 2] // plan[:, 5])).max()) if len(plan) else 0


def best_plan(histogram: dict[int, int], bins: tuple[Bin, ...] = BINS, rules: tuple = RULES) -> tuple[Bin, np.ndarray]:
    """The capacities and plan of fewest sequences; of equals the first rule's, and its first capacities.

    Rules but the first are tried with the last, widest capacities only.
    """
    (rule, weights), *others = rules
    found = [(b, best_fit(histogram, b, weights, rule)) for b in bins] + [(bins[-1], best_fit(histogram, bins[-1], w, r)) for r, w in others]
    return min(found, key=lambda x: bins_of(x[1]))


def pack(items: DataFrame, bins: tuple[Bin, ...] = BINS, rules: tuple = RULES) -> DataFrame:
    """Add sequence_id and offset (both bigint) to items with columns doc_id, piece and length, by the best plan of bins and rules.

    Pieces of one length are alike, so only the histogram of lengths, bounded by the token capacity, is packed on
    the driver; each piece then finds its place by its rank among those of its length. Ranks come from salted
    groups and their prefix sums, so a length that a third of all rows share is still dealt over many tasks.
    An empty table gives an empty table; repeated rows are pieces of their own, and rows that agree in doc_id, piece
    and start share their ranks in any order. `items` is read twice.
    """
    histogram = {int(r["length"]): r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = best_plan(histogram, bins, rules)[1]
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    salts = max(64, 2 * shuffle_partitions(items.sparkSession))
    salted = items.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    sums = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    base = sums.select("length", "_salt", F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    order = [F.col(c) for c in ("doc_id", "piece", "start") if c in items.columns]
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)) - 1).join(base, ["length", "_salt"])
    ranked = ranked.select(*items.columns, (F.col("_rank") + F.col("_base")).cast("bigint").alias("_rank"))
    schema = StructType(list(items.schema.fields)).add("sequence_id", "long").add("offset", "long")
    key, names = (plan[:, 0] << 40) | plan[:, 1], list(items.columns)

    def per_slice():
        def apply(batch: pa.RecordBatch) -> dict:
            rank, length = np.asarray(batch.column("_rank")), np.asarray(batch.column("length"))
            row = plan[np.searchsorted(key, (length << 40) | rank, "right") - 1]
            at = rank - row[:, 1]
            return {c: batch.column(c) for c in names} | {"sequence_id": row[:, 3] + at // row[:, 5], "offset": row[:, 4] + at % row[:, 5] * length}

        return apply

    return map_arrow(ranked, per_slice, schema)


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", bins: tuple[Bin, ...] = BINS, end_id: int = 0) -> DataFrame:
    """Tokenise, cut and pack all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(materialise(pieces(docs, tokenizer, bins[-1].tokens, end_id)), bins)
