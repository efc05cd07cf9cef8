"""Byte-pair encoding by a minimal acyclic transducer of frequent words, with exact merges for the rest."""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import kept, listed, map_arrow, materialise, most_frequent, summed_by, text_bytes, tokenizer_path

#: The public split pattern of byte-level vocabularies, a fixed value.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Marks that may trail a word; an apostrophe is none of them, as it can begin a group of its own.
TRAIL = b".,;:!?*$%&#"
_INSIDE = regex.compile(r"(?<=[^\s\x1c-\x1f\x85]) (?=[^\s\x1c-\x1f\x85])")


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it prints, else 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class Merges:
    """The merge rules of a tokenizers file of byte-level kind: exact ids of any text, and the bytes of any ids."""

    def __init__(self, name: str, cache: int = 200_000):
        with open(tokenizer_path(name), encoding="utf-8") as f:
            data = json.load(f)
        vocab, symbols = data["model"]["vocab"], _byte_symbols()
        raw = {s: b for b, s in enumerate(symbols)}
        self.single = [vocab[s] for s in symbols]
        self.pairs: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for rule in data["model"]["merges"]:
            a, b = rule.split(" ") if isinstance(rule, str) else rule
            self.pairs.setdefault((vocab[a], vocab[b]), len(self.merged))
            self.merged.append(vocab[a + b])
        keys = np.array([(a << 20) | b for a, b in self.pairs], np.int64)
        by = np.argsort(keys)
        self._keys, self._ranks = keys[by], np.array(list(self.pairs.values()), np.int32)[by]
        self._made = np.array([*self.merged, 0], np.int32)
        self._single = np.array(self.single, np.int32)
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes = {i: bytes(raw[c] for c in s) for s, i in vocab.items() if all(c in raw for c in s)} | {i: s.encode() for s, i in self.special.items()}
        self._cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._cache: dict[str, tuple[int, ...]] = {}
        self._most = cache

    def piece(self, data: bytes) -> list[int]:
        """Merge one piece: always the rule of the lowest rank, leftmost first."""
        ids = [self.single[b] for b in data]
        if len(ids) > 48:
            return self._long(ids)
        get, none = self.pairs.get, len(self.merged)
        while len(ids) > 1:
            ranks = [get(p, none) for p in zip(ids, ids[1:], strict=False)]
            low = min(ranks)
            if low == none:
                break
            i = ranks.index(low)
            ids[i : i + 2] = [self.merged[low]]
        return ids

    def pieces(self, data: list[bytes]) -> list[list[int]]:
        """piece() of many short pieces at once: one merge a round in every piece that still has a rule."""
        out: list[list[int]] = [[]] * len(data)
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        for low, high in ((1, 7), (7, 11), (11, 16), (16, 24), (24, 49)):
            rows = np.flatnonzero((sizes >= low) & (sizes < high))
            if len(rows):
                for i, ids in zip(rows.tolist(), self._rounds([data[i] for i in rows.tolist()], high - 1), strict=True):
                    out[i] = ids
        for i in np.flatnonzero(sizes >= 49).tolist():
            out[i] = self.piece(data[i])
        return out

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the rule for each pair, or the number of rules; a right side of -1 is none."""
        key = (left.astype(np.int64) << 20) | right
        i = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where((self._keys[i] == key) & (right >= 0), self._ranks[i], len(self.merged)).astype(np.int32)

    def _rounds(self, data: list[bytes], width: int) -> list[list[int]]:
        raw = np.frombuffer(b"".join([d.ljust(width, b"\0") for d in data]), np.uint8).reshape(-1, width)
        size = np.fromiter(map(len, data), np.int64, len(data))
        ids = np.where(np.arange(width) < size[:, None], self._single[raw], -1).astype(np.int32)
        ids = np.concatenate([ids, np.full((len(ids), 1), -1, np.int32)], 1)
        rank = self._rank(ids[:, :-1], ids[:, 1:])
        none, done, live = len(self.merged), ids.copy(), np.arange(len(ids))
        column = np.arange(width + 1)
        while True:
            at = rank.argmin(1)
            low = rank[np.arange(len(rank)), at]
            go = low < none
            if not go.all():
                done[live[~go]] = ids[~go]
                live, ids, rank, at, low = live[go], ids[go], rank[go], at[go], low[go]
            if not len(live):
                break
            row = np.arange(len(live))
            ids[row, at] = self._made[low]
            # what stands behind moves one place to the left
            shifted = np.concatenate([ids[:, 1:], np.full((len(ids), 1), -1, np.int32)], 1)
            ids = np.where(column > at[:, None], shifted, ids)
            moved = np.concatenate([rank[:, 1:], np.full((len(rank), 1), none, np.int32)], 1)
            rank = np.where(column[:-1] > at[:, None], moved, rank)
            rank[row, at] = self._rank(ids[row, at], ids[row, at + 1])
            inner = row[at > 0]
            before = at[inner] - 1
            rank[inner, before] = self._rank(ids[inner, before], ids[inner, before + 1])
        count = (done >= 0).sum(1).tolist()
        return [x[:n] for x, n in zip(done.tolist(), count, strict=True)]

    def _long(self, ids: list[int]) -> list[int]:
        """The same by a heap over a linked list: n log n for long pieces."""
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        get = self.pairs.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.merged[rank], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else -1
                if right >= 0 and (r := get((ids[left], ids[right]))) is not None:
                    heapq.heappush(heap, (r, left, ids[left], ids[right]))
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> list[int]:
        """Exact ids of a text; special tokens in it are taken as such."""
        out: list[int] = []
        for part in self._cut.split(text) if self._cut and self._cut.search(text) else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            for piece in PATTERN.findall(part):
                ids = self._cache.get(piece)
                if ids is None:
                    ids = tuple(self.piece(piece.encode("utf-8")))
                    if len(self._cache) < self._most and len(piece) < 64:
                        self._cache[piece] = ids
                out += ids
        return out


class Transducer:
    """Minimal acyclic automaton over words' bytes whose edges carry numbers; a word's sum finds its ids.

    States of equal right language are one (suffixes are shared). An edge's output counts the words that sort
    before it from its state, so the outputs along a word sum to its rank, which indexes the id lists. All of it
    lies in flat arrays in one file that readers map into memory.
    """

    FIELDS = ("edges", "targets", "outputs", "accepts", "starts", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def compile(cls, lexicon: dict[bytes, list[int]]) -> Transducer:
        """Sorted words go in one after another; finished suffixes are looked up among those known."""
        words = sorted(lexicon)
        known: dict[tuple, int] = {}
        states: list[tuple[bool, tuple]] = []  # accepts, ((label, target), ...)
        count: list[int] = []  # words from a state on

        def settle(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in known:
                known[key] = len(states)
                states.append(key)
                count.append(node[0] + sum(count[t] for _, t in node[1]))
            return known[key]

        path: list[list] = [[False, []]]
        last = b""
        for word in words:
            shared = len(os.path.commonprefix([word, last]))
            while len(path) - 1 > shared:
                done = settle(path.pop())
                path[-1][1].append((last[len(path) - 1], done))
            for _ in word[shared:]:
                path.append([False, []])
            path[-1][0] = True
            last = word
        while len(path) > 1:
            done = settle(path.pop())
            path[-1][1].append((last[len(path) - 1], done))
        root = settle(path.pop())
        order = {root: 0} | {s: i for i, s in enumerate((s for s in range(len(states)) if s != root), 1)}
        edges, targets, outputs, accepts = [], [], [], np.zeros(len(states), np.uint8)
        for s, (accept, out) in enumerate(states):
            accepts[order[s]], passed = accept, int(accept)
            for label, target in out:
                edges.append((order[s] << 8) | label)
                targets.append(order[target])
                outputs.append(passed)
                passed += count[target]
        by = np.argsort(np.array(edges, np.int64), kind="stable")
        lists = [lexicon[w] for w in words]
        return cls({"edges": np.array(edges, np.int64)[by], "targets": np.array(targets, np.int32)[by], "outputs": np.array(outputs, np.int32)[by], "accepts": accepts, "starts": np.cumsum([0, *map(len, lists)]).astype(np.int64), "ids": np.array([i for x in lists for i in x], np.int32)})

    def to_bytes(self) -> bytes:
        """A head of names, types and places, then the arrays, each from a multiple of 64 on."""
        head, at, parts = [], 4096, []
        for name in self.FIELDS:
            a = np.ascontiguousarray(getattr(self, name))
            head.append((name, a.dtype.str, at, len(a)))
            parts.append((at, a.tobytes()))
            at += -(-a.nbytes // 64) * 64
        out = bytearray(at)
        text = json.dumps(head).encode()
        out[: len(text)] = text
        for place, data in parts:
            out[place : place + len(data)] = data
        return bytes(out)

    @classmethod
    def map(cls, path: str) -> Transducer:
        with open(path, "rb") as f:
            head = json.loads(f.read(4096).rstrip(b"\0"))
        return cls({name: np.asarray(np.memmap(path, kind, "r", at, (n,))) if n else np.zeros(0, kind) for name, kind, at, n in head})

    def find(self, words: list[bytes]) -> np.ndarray:
        """Rank of each word in the lexicon or -1: all words walk the automaton together, a byte a step."""
        state, rank = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        if not len(self.edges):
            return np.where([len(w) == 0 and bool(len(self.accepts)) and bool(self.accepts[0]) for w in words], 0, -1)
        size = np.fromiter(map(len, words), np.int64, len(words))
        data, start = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size
        live, step = np.flatnonzero(size > 0), 0
        while len(live):
            key = (state[live] << 8) | data[start[live] + step]
            i = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            hit = self.edges[i] == key
            state[live[~hit]] = -1
            live, i = live[hit], i[hit]
            state[live] = self.targets[i]
            rank[live] += self.outputs[i]
            step += 1
            live = live[size[live] > step]
        return np.where((state >= 0) & (self.accepts[np.maximum(state, 0)] > 0), rank, -1)

    def ids_of(self, rank: int) -> np.ndarray:
        return self.ids[self.starts[rank] : self.starts[rank + 1]]


#: Bytes that make a text uneven wherever they stand, and byte strings that do.
_CONTROL = bytes([9, 11, 12, 13, 28, 29, 30, 31])
_MARKS = (b"  ", b"\n ", b" \n", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80\x80")


def _even(text: bytes) -> bool:
    """Whether a text may be cut at every blank."""
    marks = _MARKS[:3] if text.isascii() else _MARKS
    return not (len(text.translate(None, _CONTROL)) < len(text) or any(m in text for m in marks) or text[:1].isspace() or text[-1:].isspace())


def words_of(text: bytes) -> list[bytes]:
    """Cut at every blank between two characters that aren't white space; token splits never cross such a place.

    All words but the first stand for themselves with the blank before them.
    """
    return text.split(b" ") if _even(text) else [w.encode("utf-8") for w in _INSIDE.split(text.decode("utf-8"))]


def word_codes(texts: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray, pa.Array]:
    """words_of of many texts: the texts' order, the number of words of each in it, a code for each word, the distinct words by code."""
    even = [i for i, t in enumerate(texts) if _even(t)]
    lists = pc.split_pattern(pa.array([texts[i] for i in even], pa.binary()), b" ")
    rest = sorted({*range(len(texts))}.difference(even))
    odd = [words_of(texts[i]) for i in rest]
    coded = pa.concat_arrays([lists.flatten(), pa.array([w for t in odd for w in t], pa.binary())]).dictionary_encode()
    sizes = np.concatenate([np.diff(lists.offsets.to_numpy()), np.array([len(t) for t in odd], np.int64)]).astype(np.int64)
    return even + rest, sizes, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def frequent_words(docs: DataFrame, most: int, most_rows: int = 1_500_000) -> list[bytes]:
    """The most frequent words (blank included) over all whole texts, by count and then by bytes. A task adds up the words of
    its slices; most_rows bounds those it holds, and 64 bytes for each of them."""

    def per_slice():
        parts: list[pa.Table] = []
        rows = size = 0

        def take() -> Iterator[dict]:
            nonlocal rows, size
            if parts:
                whole = summed_by(parts, ["word"]).combine_chunks()
                parts.clear()
                rows = size = 0
                for batch in whole.to_batches(65_536):
                    yield {c: batch.column(c) for c in ("word", "n")}

        def apply(batch: pa.RecordBatch) -> Iterator[dict] | None:
            nonlocal rows, size
            _, sizes, codes, words = word_codes(text_bytes(batch))
            n = np.bincount(codes, minlength=len(words)) - np.bincount(codes[np.cumsum(sizes) - sizes], minlength=len(words))  # all but the first
            at = np.flatnonzero(n)
            parts.append(pa.table({"word": words.take(pa.array(at)), "n": n[at]}))
            rows, size = rows + len(at), size + parts[-1].nbytes
            return take() if rows >= most_rows or size >= most_rows << 6 else None

        apply.finish = take
        return apply

    counts = map_arrow(docs.select("text"), per_slice, "word binary, n bigint", "text", quiet=True).groupBy("word").agg(F.sum("n").alias("n"))
    return [b" " + w for w in most_frequent(materialise(counts), "n", ["word"], most).toArrow()["word"].to_pylist()]


class Encoder:
    """Ids and decoded bytes of texts: words through the transducer, unknown ones by merging, each kept in a bounded cache.

    Of a word, its ids joined by commas and what those ids decode to are kept: for good if the lexicon has it, else in two
    generations; when the younger is half of the cache, the elder goes, but for what has been met again since.
    """

    def __init__(self, merges: Merges, lexicon: Transducer, cache_words: int = 450_000):
        self.merges, self.lexicon, self.limit = merges, lexicon, cache_words
        self.common: dict[bytes, tuple[str, bytes]] = {}
        self.shown: dict[bytes, tuple[str, bytes]] = {}
        self.elder: dict[bytes, tuple[str, bytes]] = {}
        self.trails: dict[bytes, tuple[str, bytes]] = {}
        self.names = {i: str(i) for i in merges.bytes}

    def _shown(self, ids: list[int]) -> tuple[str, bytes]:
        return ",".join(map(self.names.__getitem__, ids)), decode(ids, self.merges.bytes)

    def _learn(self, words: list[bytes]) -> None:
        """Take in words, which stand without the blank before them.

        Where the lexicon lacks a word, single line ends within it and marks that trail a letter are token groups apart;
        bare words merge together.
        """
        ranks = self.lexicon.find([b" " + w for w in words]).tolist()
        starts, listed = self.lexicon.starts, self.lexicon.ids
        plain: dict[bytes, int] = {}
        parts: list = []
        common, shown = self.common, self.shown
        for word, rank in zip(words, ranks, strict=True):
            if rank >= 0:
                parts.append(None)
                common[word] = self._shown(listed[starts[rank] : starts[rank + 1]].tolist())
                continue
            if word.isalpha():
                parts.append([plain.setdefault(b" " + word, len(plain))])
                continue
            atoms, blank = [], True
            for line in word.split(b"\n") if b"\n" in word else (word,):
                core = line.rstrip(TRAIL)
                if not core.isalpha() and not (core and (core[-1] > 127 or core[-1:].isalpha()) and core.decode("utf-8").isalpha()):
                    break
                trail = line[len(core) :]
                if not blank:
                    atoms.append(self._marks(b"\n"))
                known = (common.get(core) or shown.get(core)) if blank and trail else None
                if known is not None:
                    atoms.append(known)
                else:
                    atoms.append(plain.setdefault(b" " + core if blank else core, len(plain)))
                if trail:
                    atoms.append(self._marks(trail))
                blank = False
            else:
                parts.append(atoms)
                continue
            parts.append(self._shown(self.merges.encode(" " + word.decode("utf-8"))))
        merged = [self._shown(ids) for ids in self.merges.pieces(list(plain))]
        for word, part in zip(words, parts, strict=True):
            if isinstance(part, list):
                pairs = [merged[x] if isinstance(x, int) else x for x in part]
                part = pairs[0] if len(pairs) == 1 else (",".join([p[0] for p in pairs]), b"".join([p[1] for p in pairs]))
            if part is not None:
                shown[word] = part

    def _marks(self, trail: bytes) -> tuple[str, bytes]:
        found = self.trails.get(trail)
        if found is None:
            found = self._shown(self.merges.encode(trail.decode()))
            if len(self.trails) < 10_000:
                self.trails[trail] = found
        return found

    def batch(self, texts: list[bytes]) -> Iterator[tuple[str, bytes]]:
        """For each text its ids, joined by commas, and the bytes they decode to."""
        special = [s.encode() for s in self.merges.special]
        # a text's first word has no blank before it; a text with special tokens goes as one
        whole = {i: self._shown(self.merges.encode(t.decode("utf-8"))) for i, t in enumerate(texts) if any(s in t for s in special)}
        parted = [i for i in range(len(texts)) if i not in whole]
        order, sizes, at, distinct = word_codes([texts[i] for i in parted])
        names, starts = listed(distinct), np.cumsum(sizes) - sizes
        first = [self._shown(self.merges.encode(names[c].decode("utf-8"))) for c in at[starts].tolist()]
        later = np.ones(len(at), bool)
        later[starts] = False
        used = np.flatnonzero(np.bincount(at[later], minlength=len(names)))
        words = [names[i] for i in used.tolist()]
        new = [w for w in words if w not in self.common and w not in self.shown]
        if len(self.shown) + len(new) > self.limit // 2:
            self.elder, self.shown = self.shown, {}
            new = [w for w in words if w not in self.common]
        again = [w for w in new if w in self.elder]
        self.shown.update(zip(again, map(self.elder.__getitem__, again), strict=True))
        self._learn([w for w in new if w not in self.elder] if again else new)
        pairs = first + [self.common.get(w) or self.shown[w] for w in words]
        value = np.zeros(len(names), np.int64)
        value[used] = np.arange(len(first), len(first) + len(used))
        value = value[at]
        value[starts] = np.arange(len(first))
        # an empty first word has no ids, and no comma behind it
        there = np.ones(len(at), bool)
        there[starts] = [bool(text) for text, _ in first]
        ends = pa.array(np.concatenate([[0], np.cumsum(np.add.reduceat(there, starts, dtype=np.int64))]) if len(starts) else [0], pa.int64())
        value = pa.array(value[there])

        def joined(shown: list, kind: pa.DataType, by: str | bytes) -> dict[int, str | bytes]:
            lists = pa.LargeListArray.from_arrays(ends, pa.array(shown, kind).take(value))
            return dict(zip((parted[i] for i in order), pc.binary_join(lists, pa.scalar(by, kind)).to_pylist(), strict=True))

        ids = joined([text for text, _ in pairs], pa.large_string(), ",")
        raw = joined([data for _, data in pairs], pa.large_binary(), b"")
        for i in range(len(texts)):
            yield whole[i] if i in whole else (ids[i], raw[i])


def decode(ids: list[int], table: dict[int, bytes]) -> bytes:
    return b"".join(map(table.__getitem__, ids))


def _encoder(tokenizer: str, shared) -> Encoder:
    """An encoder over the broadcast lexicon. It is mapped from a file that loses its name at once, so nothing is left of it."""
    path = os.path.join(tempfile.gettempdir(), f"lexicon-{uuid.uuid4().hex}")
    with open(path, "wb") as f:
        f.write(shared.value)
    mapped = Transducer.map(path)
    os.unlink(path)
    return Encoder(Merges(tokenizer), mapped)


def encode_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", lexicon_words: int = 131_072, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and the decoded text, of every whole text.

    The lexicon holds the lexicon_words most frequent words of the corpus, a few MB: the driver compiles it, Spark
    broadcasts the file's bytes, and each task maps its executor's copy. Null text is empty: no ids, the digest of
    nothing. Repeated rows give repeated rows; other columns are ignored; a null doc_id stays null. A very long text is
    held whole, with its ids, by the task that encodes it; a word of any length is merged as a whole.
    """
    spark = docs.sparkSession
    merges = Merges(tokenizer)
    data = Transducer.compile({w: merges.encode(w.decode("utf-8")) for w in frequent_words(docs, lexicon_words)}).to_bytes()
    held, shared = f"lexicon:{tokenizer}:{hashlib.sha256(data).hexdigest()[:24]}", spark.sparkContext.broadcast(data)
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids

    def per_slice():
        encoder = kept(held, lambda: _encoder(tokenizer, shared))

        def apply(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")}
            for joined, raw in encoder.batch(text_bytes(batch)):
                decoded = raw.decode("utf-8", "replace")
                out["n_tokens"].append(joined.count(",") + 1 if joined else 0)
                out["ids_sha256"].append(hashlib.sha256(joined.encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                if keep_ids:
                    out["ids"].append([int(x) for x in joined.split(",")] if joined else [])
                    out["decoded"].append(decoded)
            return {"doc_id": batch.column("doc_id")} | out

        return apply

    return map_arrow(docs.select(F.col("doc_id").cast("bigint"), "text"), per_slice, schema, "text", quiet=True, keeps=held)
