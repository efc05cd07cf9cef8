"""Exact Jaccard join of word-shingle sets by a size-aware heavy-light scheme.

Sets of equal content are one class. In one global order of shingles (those met in one set only first, the most
frequent last, else by hash) a set of n shingles shares with any partner at least one of its first n - o + 1 and at least two of its first n - o + 2, where
o = ceil(3 n / 4) is the least overlap at similarity 3/4. Small sets are indexed under all two-shingle subsets of the
longer prefix and meet in equal subsets; large sets, and those small ones that could be a large one's partner, under
the single shingles of the shorter prefix, whose inverted lists are scanned. Shingles that no other set has aren't
indexed, so texts that share phrases by chance seldom meet, however many there are. The size where the ways part is the one
of least estimated cost. Within a list, a parity bitmap of every set gives a sure lower bound of the symmetric
difference; sets that may link are chained. What is chained together is then compared exactly, once, and where sets
already lie in one component the rest of their comparisons is left out. Lists and groups too large for a task are
dealt in blocks that meet one common set first; what it doesn't join meets all blocks, so no task grows with the data
and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import bounded_batches, map_arrow, materialise, most_frequent, shuffle_partitions, text_bytes
from recordloom.llm.components import connected

WORDS = 5
#: Stands for a null doc_id, so that it comes last.
NOBODY = (1 << 63) - 1
#: Shingles of lower hash, three of five, are counted; a prefix needs a quarter of a set.
COUNTED = np.uint64(3 * (1 << 64) // 5)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def overlap(n: int) -> int:
    """Least intersection that a set of n shares with any partner."""
    return -(-3 * n // 4)


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts; word hashes are kept in a bounded cache."""

    def __init__(self, limit: int = 300_000):
        self.words: dict[bytes, int] = {}
        self.limit = limit

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.words
        if len(known) > self.limit:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if len(h) < WORDS:
            return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), 1)], np.uint64)
        n = len(h) - WORDS + 1
        out = np.zeros(n, np.uint64)
        for i in range(WORDS):
            out = (out ^ h[i : n + i]) * _ODD[i]
            out ^= out >> np.uint64(29)
        return np.unique(out)


def set_id(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def bitmap(shingles: np.ndarray) -> bytes:
    """Parity of the number of shingles in each slot; at least 1.5 slots a shingle, a power of two."""
    slots = 128
    while slots < 1.5 * len(shingles):
        slots *= 2
    return np.packbits(np.bincount((shingles >> np.uint64(17)).astype(np.int64) & (slots - 1), minlength=slots).astype(np.uint8) & 1, bitorder="little").tobytes()


def sets_of(docs: DataFrame) -> DataFrame:
    """doc_id, _text (hash of the text), sid (hash of the set), n and its bitmap, for every document."""

    def per_slice():
        shingles = Shingler()

        def apply(batch: pa.RecordBatch) -> dict:
            sets = [shingles(t) for t in text_bytes(batch)]
            return {c: batch.column(c) for c in ("doc_id", "_text")} | {"sid": [set_id(s) for s in sets], "n": [len(s) for s in sets], "bits": [bitmap(s) for s in sets]}

        return apply

    return map_arrow(docs, per_slice, "doc_id bigint, _text bigint, sid bigint, n int, bits binary", "text")


def _distinct_sets(shingles: Shingler, seen: set, batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Sets of a slice that the task hasn't seen lately: copies are indexed once a task."""
    if len(seen) > 200_000:
        seen.clear()
    for text in text_bytes(batch):
        s = shingles(text)
        if len(s) and (key := set_id(s)) not in seen:
            seen.add(key)
            yield s


def shingle_counts(docs: DataFrame) -> DataFrame:
    """slot, c: how often the shingles of hash below COUNTED stand in the sets, by the lower 32 bits of their hash."""

    def per_slice():
        shingles, seen = Shingler(), set()

        def apply(batch: pa.RecordBatch) -> dict:
            out = [s[: np.searchsorted(s, COUNTED)] for s in _distinct_sets(shingles, seen, batch)]
            return {"slot": (np.concatenate(out) if out else np.zeros(0, np.uint64)).astype(np.uint32).view(np.int32)}

        return apply

    return map_arrow(docs.select("text"), per_slice, "slot int", "text").groupBy("slot").agg(F.count("*").alias("c"))


@dataclass(frozen=True)
class Order:
    """The global order of shingles: unmarked ones, marked ones, those not counted, heavy ones, each by hash.

    `marks` is a hashed bitmap (a power of two of bits) of the slots of repeated shingles below COUNTED; `heavy` are the sorted slots of the
    most frequent ones. Whatever shingle is marked by mistake or missed, the order is a function of the hash alone,
    so results don't depend on it. `single`: an unmarked shingle below COUNTED stands in one set at most.
    """

    marks: np.ndarray
    heavy: np.ndarray
    single: bool

    def levels(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each shingle its level in the order, and whether another set may hold it."""
        counted, slot = shingles < COUNTED, shingles.astype(np.uint32)
        at = slot & np.uint32(8 * len(self.marks) - 1)
        level = (self.marks[at >> np.uint32(3)] >> (at & np.uint32(7)).astype(np.uint8)) & 1
        level[~counted] = 2
        shared = (level > 0) | (not self.single)
        if len(self.heavy):
            i = np.minimum(np.searchsorted(self.heavy, slot), len(self.heavy) - 1)
            level[(self.heavy[i] == slot) & counted] = 3
        return level, shared


def order_of(repeated: DataFrame, heavy: np.ndarray, most_bits: int = 1 << 29) -> Order:
    """The order by a table (slot, c) of the slots counted twice or more; eight bits a slot, most_bits (64 MB) at most.

    Where that would be over half full, only the more frequent slots are marked, and unmarked ones may be shared.
    """
    steps = {r["step"]: r["k"] for r in repeated.groupBy(F.floor(F.log2("c")).cast("int").alias("step")).agg(F.count("*").alias("k")).collect()}
    step, marked = 1, sum(steps.values())
    while 2 * marked > most_bits:
        marked, step = marked - steps.get(step, 0), step + 1
    bits = 1 << 15
    while bits < min(8 * marked, most_bits):
        bits *= 2
    place = F.col("slot").cast("bigint").bitwiseAND(F.lit(bits - 1))
    maps = repeated.where(F.col("c") >= 1 << step).select((place / 32768).cast("bigint").alias("_map"), (place % 32768).cast("bigint").alias("_at")).groupBy("_map").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    marks = np.zeros((bits // 32768, 4096), np.uint8)
    for batch in maps.toArrow().to_batches():
        for i, data in zip(batch.column("_map").to_pylist(), batch.column("_bits").to_pylist(), strict=True):
            marks[i] = np.frombuffer(data, np.uint8)
    return Order(marks.ravel(), heavy, step == 1)


def boundary(sizes: dict[int, int], scan: float) -> int:
    """The size under which two-shingle subsets cost less; scan: mean length of the lists that a posting meets."""

    def cost(x: int) -> float:
        total = 0.0
        for n, sets in sizes.items():
            p = n - overlap(n) + 1
            if 1 < n < x:
                total += sets * (p + 1) * p / 2
            if 4 * n >= 3 * x:
                total += sets * p * (1 + scan)
        return total

    return min((2, 6, 10, 16, 24, 32, 48, 64, 96, 128), key=cost)


def postings(docs: DataFrame, order: Order, small: int) -> DataFrame:
    """key, sid, n: the index entries of every distinct set, but for those that no other set can have."""
    shared_order = docs.sparkSession.sparkContext.broadcast(order)

    def per_slice():
        shingles, seen, order = Shingler(), set(), shared_order.value

        def apply(batch: pa.RecordBatch) -> dict:
            keys, ids, sizes = [], [], []
            sets = list(_distinct_sets(shingles, seen, batch))
            levels, shared = order.levels(np.concatenate(sets)) if sets else (None, None)
            end = 0
            for s in sets:
                n = len(s)
                start, end = end, end + n
                p, first = n - overlap(n) + 1, np.argsort(levels[start:end], kind="stable")
                first = first[: p + 1]
                met = shared[start:end][first]
                if not met.any():
                    continue
                sid, one, s = set_id(s), met[:p], s[first]
                if 1 < n < small:
                    both = s[met]
                    a, b = np.triu_indices(len(both), 1)
                    lo, hi = np.minimum(both[a], both[b]), np.maximum(both[a], both[b])
                    keys.append((lo * _ODD[0] ^ hi) * _ODD[1])
                    ids.append(np.full(len(a), sid))
                    sizes.append(np.full(len(a), n, np.int32))
                if 4 * n >= 3 * small:
                    keys.append(s[:p][one])
                    ids.append(np.full(len(keys[-1]), sid))
                    sizes.append(np.full(len(keys[-1]), n, np.int32))
            if not keys:
                return {"key": [], "sid": [], "n": []}
            return {"key": np.concatenate(keys).view(np.int64), "sid": np.concatenate(ids), "n": np.concatenate(sizes)}

        return apply

    return map_arrow(docs.select("text"), per_slice, "key bigint, sid bigint, n int", "text")


def lists_of(entries: DataFrame, most: int = 4096) -> DataFrame:
    """list, sid, n: index lists of two sets or more, cut where sizes differ too much to link; lists of the same sets are one.

    Tasks stream over sorted entries. A list's name is a sum over its members, so equal lists meet; one of over
    `most` members is passed on in parts under the name of its key.
    """

    def per_slice():
        held: list = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
        empty = {"list": [], "sid": [], "n": []}
        within: list = [None, 0]  # key and greatest size of a list that was passed on in part

        def cut(key: np.ndarray, sid: np.ndarray, n: np.ndarray, final: bool) -> dict:
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])
            key, sid, n = key[fresh], sid[fresh], n[fresh]
            if not len(key):
                return empty
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (4 * n[:-1].astype(np.int64) < 3 * n[1:])
            start = np.flatnonzero(new)
            keep = len(key)
            if not final and len(key) - start[-1] <= most:
                keep = int(start[-1])
            held[:] = [key[keep:], sid[keep:], n[keep:]]
            key, sid, n, start = key[:keep], sid[:keep], n[:keep], start[start < keep]
            if not len(key):
                return empty
            size = np.diff(np.concatenate([start, [len(key)]]))
            mixed = sid.view(np.uint64) * _ODD[0]
            mixed = (mixed ^ (mixed >> np.uint64(31))) * _ODD[1]
            name = np.add.reduceat(mixed, start).view(np.int64)
            by_key = (key[start].view(np.uint64) * _ODD[2]).view(np.int64)
            name = np.where(size > most, by_key, name)
            one = size > 1
            # the rest of a list that went before in part keeps its name, even if it is one set
            if within[0] is not None and key[0] == within[0] and 4 * within[1] >= 3 * n[0]:
                name[0], one[0] = by_key[0], True
            within[:] = [int(key[-1]), int(n[-1])] if name[-1] == by_key[-1] else [None, 0]
            take = np.repeat(one, size)
            return {"list": np.repeat(name, size)[take], "sid": sid[take], "n": n[take]}

        def apply(batch: pa.RecordBatch) -> dict:
            columns = [np.concatenate([h, np.asarray(batch.column(c))]) for h, c in zip(held, ("key", "sid", "n"), strict=True)]
            return cut(*columns, False)

        def finish() -> Iterator[dict]:
            yield cut(*held, True)

        apply.finish = finish
        return apply

    rows = entries.repartition(shuffle_partitions(entries.sparkSession), "key").sortWithinPartitions("key", "n", "sid")
    return _streamed(rows, per_slice, "list bigint, sid bigint, n int").distinct()


def _streamed(rows: DataFrame, per_slice, schema: str) -> DataFrame:
    """map_arrow without cutting batches: what streams over narrow sorted rows needs no small slices."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    struct = _parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)

    def run(batches):
        apply = per_slice()
        for batch in batches:
            out = apply(batch)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)
        for out in apply.finish():
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    bounded_batches(rows.sparkSession)
    return rows.mapInArrow(run, struct)


def _groups(columns: list[str], solve) -> object:
    """A streaming function over rows sorted by _task: gathers each task's rows and yields the edges that solve finds."""

    def per_slice():
        held: dict = {"task": None, "rows": []}

        def close(out: dict) -> None:
            if len(held["rows"]) > 1:
                for a, b in solve(held["rows"]):
                    out["a"].append(a)
                    out["b"].append(b)

        def apply(batch: pa.RecordBatch) -> dict:
            out: dict = {"a": [], "b": []}
            for task, *row in zip(*(batch.column(c).to_pylist() for c in ("_task", *columns)), strict=True):
                if task != held["task"]:
                    close(out)
                    held.update(task=task, rows=[])
                held["rows"].append(row)
            return out

        def finish() -> Iterator[dict]:
            out: dict = {"a": [], "b": []}
            close(out)
            yield out

        apply.finish = finish
        return apply

    return per_slice


def may_link(rows: list) -> Iterator[tuple[int, int]]:
    """Chains sets (sid, n, bits) whose bitmaps leave a link possible: a forest, found by widening from one set at a time.

    Sets that can link have bitmaps of one width or of one and its double, and meet at the smaller; so small sets in a
    list don't blur what is known of large ones.
    """
    ids, n = [r[0] for r in rows], np.array([r[1] for r in rows], np.int64)
    widths: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        widths.setdefault(len(r[2]), []).append(i)
    held, free = {}, {}
    for w, at in widths.items():
        own = np.frombuffer(b"".join(rows[i][2] for i in at), np.uint64).reshape(len(at), -1)
        half = own.shape[1] // 2
        held[w], free[w] = (np.array(at), own, own[:, :half] ^ own[:, half:]), np.arange(len(at))  # parities fold
    for w in held:
        while len(free[w]):
            front, free[w] = [(w, int(free[w][0]))], free[w][1:]
            while front:
                v, k = front.pop()
                i = int(held[v][0][k])
                for u in (v // 2, v, 2 * v):
                    if u not in held or not len(free[u]):
                        continue
                    at, others = held[u][0], free[u]
                    apart = np.bitwise_count(held[u][2 if u > v else 1][others] ^ held[v][2 if u < v else 1][k]).sum(1, dtype=np.int64)
                    m = n[at[others]]
                    near = (7 * apart <= m + n[i]) & (4 * np.minimum(m, n[i]) >= 3 * np.maximum(m, n[i]))
                    hit = others[near].tolist()
                    for j in hit:
                        yield ids[i], ids[int(at[j])]
                    front += [(u, j) for j in hit]
                    free[u] = others[~near]


def linked(rows: list) -> Iterator[tuple[int, int]]:
    """Links sets (id, sorted shingles) of similarity 3/4 or more: a spanning forest of the true components."""
    ids = [r[0] for r in rows]
    sets = [np.frombuffer(r[1], np.uint64) for r in rows]
    n = np.array([len(s) for s in sets], np.int64)
    _, dense = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(n)
    parts = [dense[e - k : e] for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
    mark = np.zeros(int(dense.max()) + 1, np.int64)
    free = np.arange(len(rows))
    flat, start, kept = dense, ends - n, np.arange(len(rows))
    while len(free) > 1:
        front, free = [int(free[0])], free[1:]
        while front and len(free):
            i = front.pop()
            if 2 * len(free) < len(kept):  # leave out what is settled
                kept = free
                flat, start = np.concatenate([parts[j] for j in kept.tolist()]), np.cumsum(n[kept]) - n[kept]
            mark[parts[i]] = 1
            common = np.add.reduceat(mark[flat], start)
            mark[parts[i]] = 0
            here = np.isin(kept, free, assume_unique=True) if len(kept) != len(free) else np.ones(len(kept), bool)
            near = here & (100 * common >= 75 * (n[kept] + n[i] - common))
            hit = kept[near].tolist()
            for j in hit:
                yield ids[i], ids[j]
            front += hit
            free = kept[here & ~near]


def with_likely(rows: DataFrame, column: str, wanted: DataFrame, bits: int = 1 << 25) -> DataFrame:
    """Rows with _may: whether their key may be among the one column of `wanted`. Never false for one that is.

    A hashed bitmap of bits / 8 bytes (4 MB), whatever the input's size, is broadcast.
    """

    def slot(key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit("slot")), F.lit(bits))

    place = slot(F.col(wanted.columns[0]))
    maps = wanted.select((place / 32768).cast("bigint").alias("_map"), (place % 32768).cast("bigint").alias("_at")).groupBy("_map").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    marked = rows.withColumn("_slot", slot(F.col(column))).join(F.broadcast(maps), F.floor(F.col("_slot") / 32768) == F.col("_map"), "left")
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_slot % 32768 div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return marked.select(*rows.columns, F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(_slot % 8 as int))")) != 0, F.lit(False)).alias("_may"))


def likely_in(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows whose key may be in `wanted`; those let through by mistake fall out in the join behind it."""
    return with_likely(rows, column, wanted).where("_may").drop("_may")


def _links_within(rows: DataFrame, payload: list[str], weight: Column, most: int, solve, attach=lambda tasks: tasks) -> DataFrame:
    """Edges (a, b) of sets by sid that `solve` finds within each group of rows (group, sid), once `attach` has added the payload.

    A group of over `most` weight is dealt in blocks. Each block is solved along with the group's set of least sid;
    where that joins all, nothing more is to do. Else only sets outside the group's largest component meet all the
    blocks, so a large group of likes costs its size, not its square, and no link is lost.
    """
    by, columns = shuffle_partitions(rows.sparkSession), ["sid", *payload]

    def solved(tasks: DataFrame) -> DataFrame:
        dealt = attach(tasks).select("_task", *columns).repartition(by, "_task").sortWithinPartitions("_task", "sid")
        return map_arrow(dealt, _groups(columns, solve), "a bigint, b bigint", payload[-1])

    large = materialise(rows.groupBy("group").agg(F.sum(weight).alias("_total"), F.min("sid").alias("_least")).where(F.col("_total") > most).select("group", "_least", F.ceil(F.col("_total") / most).cast("int").alias("_blocks")))
    if large.isEmpty():
        return solved(rows.withColumn("_task", F.xxhash64("group")))
    held = rows.join(large, "group", "left")
    own = F.pmod(F.xxhash64("sid", F.lit("block")), F.col("_blocks")).cast("int")
    everywhere = F.sequence(F.lit(0), F.col("_blocks") - 1)
    block = F.explode(F.when(F.col("_blocks").isNull(), F.array(F.lit(0))).when(F.col("sid") == F.col("_least"), everywhere).otherwise(F.array(own)))
    edges = materialise(solved(held.withColumn("_block", block).withColumn("_task", F.xxhash64("group", "_block"))))
    members = rows.join(large, "group").select("group", "sid", "_blocks")
    labelled = members.join(connected(edges), F.col("sid") == F.col("node"), "left").select("group", "sid", "_blocks", F.coalesce("label", "sid").alias("_part"))
    sizes = labelled.groupBy("group", "_part").agg(F.count("*").alias("_n"))
    main = sizes.groupBy("group").agg(F.max_by("_part", F.struct("_n", "_part")).alias("_main"), F.count("*").alias("_parts")).where("_parts > 1")
    apart = materialise(labelled.join(main, "group").select("group", "sid", "_blocks", (F.col("_part") != F.col("_main")).alias("_out")))
    outside = apart.where("_out").groupBy("group").agg(F.count("*").alias("_k"))
    if outside.isEmpty():
        return edges
    # outside sets are dealt in lots (i), all sets in blocks (j): every outside set meets every set in one task
    ways = apart.join(outside, "group").join(rows, ["group", "sid"])
    lots = F.greatest(F.ceil(F.col("_k") / F.lit(most)).cast("int"), F.lit(1))
    lot = F.pmod(F.xxhash64("sid", F.lit("lot")), lots).cast("int")
    inner = ways.where("_out").withColumn("_i", lot).withColumn("_j", F.explode(everywhere))
    outer = ways.withColumn("_j", own).withColumn("_i", F.explode(F.sequence(F.lit(0), lots - 1))).where(~F.col("_out") | (F.col("_i") != lot))
    return edges.union(solved(inner.unionByName(outer).withColumn("_task", F.xxhash64("group", "_i", "_j"))))


def components(docs: DataFrame, heavy_tokens: int = 131_072, heavy_from: int = 8, list_most: int = 4096, task_shingles: int = 500_000) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links, itself included) of every document.

    Two documents link when their sets of WORDS-word shingles have a Jaccard similarity of 0.75 or more. ASCII upper
    case is folded; a text of fewer words is one shingle; without words or text the set is empty and links with
    nothing. Links run between rows, whatever their doc_id: rows of one doc_id with different texts link each for
    itself, and a row of a null doc_id passes links on; its own component is the least doc_id it reaches, null if none.
    Repeated rows come out repeatedly; other columns are ignored. A very long text is held whole, as one set, by the
    task that reads it. The order of shingles takes only its speed, never its results, from the heavy_tokens most
    frequent ones.
    """
    sets, final = _labelled(docs, heavy_tokens, heavy_from, list_most, task_shingles)
    return sets.join(final, ["sid", "n"], "left").select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _labelled(docs: DataFrame, heavy_tokens: int = 131_072, heavy_from: int = 8, list_most: int = 4096, task_shingles: int = 500_000) -> tuple[DataFrame, DataFrame]:
    """The sets of all rows, and of each distinct set its component's least doc_id and (id, hash of text) of its first row."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("_text", F.xxhash64("text"))
    sets = materialise(sets_of(docs))
    nobody = F.lit(NOBODY)
    pick = F.min(F.struct(F.coalesce("doc_id", nobody).alias("id"), F.col("_text").alias("text")))
    classes = sets.where("n > 0").groupBy("sid", "n").agg(F.min("doc_id").alias("rep"), pick.alias("pick"), F.first("bits").alias("bits"))
    repeated = materialise(shingle_counts(docs).where("c > 1"))
    frequent = repeated.where(F.col("c") >= heavy_from)
    heavy = most_frequent(frequent, "c", ["slot"], heavy_tokens).toArrow()
    order = order_of(repeated, np.sort(np.asarray(heavy["slot"], np.int32).view(np.uint32)))
    sizes = {int(r["n"]): r["k"] for r in sets.groupBy("n").agg(F.count("*").alias("k")).collect()}
    rest = frequent.agg(F.coalesce(F.sum(F.when(F.col("c") < int(min(np.asarray(heavy["c"]), default=0)) + 1, F.col("c") * F.col("c"))), F.lit(0)).alias("s")).first()["s"]
    entries = sum(k * (n - overlap(n) + 1) for n, k in sizes.items())
    small = boundary(sizes, float(rest) / max(1, entries))
    lists = materialise(lists_of(postings(docs, order, small), list_most)).withColumnRenamed("list", "group")
    glued = connected(_links_within(lists, ["n", "bits"], F.lit(1), list_most, may_link, lambda tasks: tasks.join(classes.select("sid", "n", "bits"), ["sid", "n"])))
    groups = materialise(glued.join(classes.select("sid", "n", "pick"), F.col("node") == F.col("sid")).select("sid", "n", "pick", F.col("label").alias("group")))
    here = docs.withColumn("_id", F.coalesce("doc_id", nobody))
    texts = likely_in(here, "_text", groups.select("pick.text")).join(groups, (F.col("_id") == F.col("pick.id")) & (F.col("_text") == F.col("pick.text"))).select("sid", "n", "group", "text").dropDuplicates(["sid"])

    def per_slice():
        shingles = Shingler()
        return lambda batch: {c: batch.column(c) for c in ("group", "sid", "n")} | {"shingles": [shingles(t).tobytes() for t in text_bytes(batch)]}

    arrays = materialise(map_arrow(texts, per_slice, "group bigint, sid bigint, n int, shingles binary", "text"))
    labels = materialise(connected(_links_within(arrays, ["shingles"], F.col("n"), task_shingles, linked)))
    least = labels.join(classes.select("sid", "rep", "pick"), F.col("node") == F.col("sid")).groupBy("label").agg(F.min("rep").alias("component"), F.min("pick").alias("chosen"))
    reached = labels.join(least, "label").select(F.col("node").alias("sid"), "component", "chosen")
    return sets, classes.select("sid", "n", "rep", "pick").join(reached, "sid", "left").select("sid", "n", F.coalesce("component", "rep").alias("component"), F.coalesce("chosen", "pick").alias("chosen"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component with all its columns: that of the least doc_id (null last), then of the least hash of its text.

    Of rows repeated with doc_id and text one stays. A text without words links with nothing and stays, null too, as
    does every row of an empty table. Columns may have any names. Texts that nothing speaks against don't cross the
    network: a broadcast bitmap sifts out what may have to go.
    """
    sets, final = _labelled(docs)
    rows = sets.where("n > 0").join(final, ["sid", "n"]).select(F.struct(F.coalesce("doc_id", F.lit(NOBODY)).alias("id"), F.col("_text").alias("text")).alias("own"), "chosen")
    decided = materialise(rows.groupBy("own").agg(F.count("*").alias("k"), F.first(F.col("own") == F.col("chosen")).alias("first")).where("NOT first OR k > 1").select("own.id", "own.text", "first", F.xxhash64("own.id", "own.text").alias("key")))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NOBODY)).alias("id"), F.xxhash64("text").alias("text"))
    sifted = with_likely(packed.withColumn("key", F.xxhash64("id", "text")), "key", decided.select("key"))
    doubtful = sifted.where("_may").join(decided.drop("key"), ["id", "text"], "left")
    parts = [sifted.where("NOT _may").select("_row"), doubtful.where("first IS NULL").select("_row")]
    if not decided.where("first").isEmpty():
        parts.append(doubtful.where("first").dropDuplicates(["id", "text"]).select("_row"))
    return reduce(DataFrame.union, parts).select("_row.*")
