"""Token files of independent zstandard frames with a trailing seek table and per-frame checksums.

Layout of a file: data frames; then two skippable frames. The first, of magic 0x184D2A5C, holds the documents:
for each its id (int64), frame (uint32), first token in the frame (uint32) and number of tokens (uint64, whose top
bit marks a document without id; such come first, with the least int64 as their id). The last
is the public seekable format's table (magic 0x184D2A5E): for each frame its compressed size, its size and the low
32 bits of the xxh64 of its content, then the number of frames, the descriptor 0x80 and 0x8F92EAB1. A file stays a
valid zstandard stream; a reader fetches the two tables and only the frames it needs.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import bucket_of, map_arrow, order_buckets, shared_folder, shuffle_partitions, text_bytes
from recordloom.llm.encoders import shared_encoder

SKIPPABLE_DOCS, SKIPPABLE_SEEK, SEEKABLE_MAGIC = 0x184D2A5C, 0x184D2A5E, 0x8F92EAB1
DOC = np.dtype([("doc_id", "<i8"), ("frame", "<u4"), ("first", "<u4"), ("n", "<u8")])
NO_ID, LEAST = 1 << 63, -(1 << 63)
SEEK = np.dtype([("packed", "<u4"), ("size", "<u4"), ("checksum", "<u4")])


def open_folder(url: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(url if "://" in url or url.startswith("file:") else f"file://{url}")


class FrameWriter:
    """Writes one file. Documents gather in a frame until it has frame_tokens tokens; a longer one has its own."""

    def __init__(self, out, frame_tokens: int = 32_768, level: int = 1):
        self.out, self.most = out, 4 * frame_tokens
        self.packer = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.held: list[bytes] = []
        self.bytes = self.tokens = 0
        self.docs: list[tuple] = []
        self.seek: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.held and self.bytes + len(ids) > self.most:
            self.flush()
        size = len(ids) // 4
        self.docs.append((LEAST if doc_id is None else doc_id, len(self.seek), self.bytes // 4, size | NO_ID if doc_id is None else size))
        self.held.append(ids)
        self.bytes += len(ids)
        self.tokens += len(ids) // 4

    def flush(self) -> None:
        data = b"".join(self.held)
        packed = self.packer.compress(data)
        self.out.write(packed)
        self.seek.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.held, self.bytes = [], 0

    def close(self) -> None:
        if self.held:
            self.flush()
        docs = np.array(self.docs, DOC).tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE_DOCS, len(docs) + 4) + docs + struct.pack("<I", len(self.docs)))
        table = np.array(self.seek, SEEK).tobytes() + struct.pack("<IBI", len(self.seek), 0x80, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)


class FrameReader:
    """Random access to one file: reads both tables, then only the frames asked for, each checked by its checksum."""

    def __init__(self, handle):
        self.handle, end = handle, handle.size()
        frames, descriptor, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEKABLE_MAGIC or descriptor != 0x80:
            raise ValueError("not a seekable token file")
        self.seek = np.frombuffer(self._at(end - 9 - 12 * frames, 12 * frames), SEEK)
        self.starts = np.concatenate([[0], np.cumsum(self.seek["packed"], dtype=np.int64)])
        tail = end - 9 - 12 * frames - 8
        (count,) = struct.unpack("<I", self._at(tail - 4, 4))
        docs = np.frombuffer(self._at(tail - 4 - DOC.itemsize * count, DOC.itemsize * count), DOC).copy()
        self.no_id = docs["n"] >= np.uint64(NO_ID)
        docs["n"] &= np.uint64(NO_ID - 1)
        self.docs = docs

    def _at(self, start: int, size: int) -> bytes:
        self.handle.seek(start)
        return self.handle.read(size)

    def frame(self, number: int) -> bytes:
        row = self.seek[number]
        data = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[number]), int(row["packed"])), max_output_size=int(row["size"]))
        if len(data) != row["size"] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != row["checksum"]:
            raise ValueError(f"frame {number} is damaged")
        return data

    def read(self, rows: Iterable[int] | None = None) -> Iterator[tuple[int | None, bytes]]:
        """(doc_id or None, ids as bytes) of the documents at the given places in the file, or of all; one frame is held at a time."""
        at, data = -1, b""
        for i in range(len(self.docs)) if rows is None else rows:
            doc = self.docs[i]
            if doc["frame"] != at:
                at, data = int(doc["frame"]), self.frame(int(doc["frame"]))
            yield None if self.no_id[i] else int(doc["doc_id"]), data[4 * int(doc["first"]) : 4 * int(doc["first"] + doc["n"])]

    def find(self, doc_id: int) -> bytes | None:
        hit = np.searchsorted(self.docs["doc_id"], doc_id) if doc_id != LEAST else int(self.no_id.sum())
        return next(self.read([int(hit)]))[1] if hit < len(self.docs) and self.docs["doc_id"][hit] == doc_id else None


def write_tokens(docs: DataFrame, folder: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, frame_tokens: int = 32_768, file_bytes: int = 256 << 20) -> list:
    """Encode documents and write their ids in ascending doc_id order; returns rows bucket, path, docs, tokens, a file each.

    Files are order-preserving buckets of doc_id of about file_bytes of text, as many as there are shuffle partitions
    at least: approximate quantiles over all ids give the split points. A task
    writes under a name of its own attempt, so a rerun after a lost executor never meets a half-written file, and
    the rows returned name the attempts that count. Null text is empty (its end id remains). Rows of equal doc_id
    are all written, one after another, in order of their ids; those of a null doc_id come before all others. A very
    long text has a frame of its own, which is held whole by the task that writes or reads it.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = max(shuffle_partitions(spark), -(-size // file_bytes))
    points = order_buckets(docs.select("doc_id"), "doc_id", buckets)

    def encode():
        encoder, end = shared_encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        packer = zstandard.ZstdCompressor(level=1)

        def apply(batch: pa.RecordBatch) -> dict:
            ids = [packer.compress(x + end) for x in encoder.encode(text_bytes(batch))]
            return {"bucket": batch.column("bucket"), "doc_id": batch.column("doc_id"), "ids": ids}

        return apply

    def write():
        where, base = open_folder(folder)
        where.create_dir(base, recursive=True)
        state: dict = {"bucket": None, "rows": []}

        def close() -> None:
            if state["bucket"] is not None:
                state["writer"].close()
                state["out"].close()
                state["rows"].append((state["bucket"], f"{folder}/{state['name']}", len(state["writer"].docs), state["writer"].tokens))

        def apply(batch: pa.RecordBatch) -> None:
            unpack = zstandard.ZstdDecompressor().decompress
            for bucket, doc, ids in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "ids")), strict=True):
                if bucket != state["bucket"]:
                    close()
                    state.update(bucket=bucket, name=f"tokens-{bucket:06d}-{uuid.uuid4().hex[:12]}.zst")
                    state["out"] = where.open_output_stream(f"{base}/{state['name']}", compression=None)
                    state["writer"] = FrameWriter(state["out"], frame_tokens)
                state["writer"].add(doc, unpack(ids))

        def finish() -> Iterator[dict]:
            close()
            yield dict(zip(("bucket", "path", "docs", "tokens"), map(list, zip(*state["rows"], strict=True)), strict=True)) if state["rows"] else dict.fromkeys(("bucket", "path", "docs", "tokens"), [])

        apply.finish = finish
        return apply

    keyed = docs.select(bucket_of(F.col("doc_id"), points).cast("int").alias("bucket"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    encoded = map_arrow(keyed, encode, "bucket int, doc_id bigint, ids binary", "text", quiet=True, keeps=f"words:{tokenizer}")
    sorted_rows = encoded.repartition(shuffle_partitions(spark), "bucket").sortWithinPartitions("bucket", "doc_id", "ids")
    return sorted(map_arrow(sorted_rows, write, "bucket int, path string, docs bigint, tokens bigint", "ids").collect(), key=lambda r: r["bucket"])


def read_tokens(spark, files: list) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and of every document in the given files (rows of write_tokens), in file order.

    start counts the ids of all documents before, over all files. Each task reads whole files frame by frame; a null
    doc_id comes back as null.
    """
    at, rows = 0, []
    for f in files:
        rows.append((f["path"], at))
        at += f["tokens"]

    def per_slice():
        def apply(batch: pa.RecordBatch) -> Iterator[dict]:
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "n_tokens", "ids_crc32")}
            for url, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                where, path = open_folder(url)
                with where.open_input_file(path) as handle:
                    for doc, ids in FrameReader(handle).read():
                        for k, v in zip(out, (doc, start, len(ids) // 4, zlib.crc32(ids)), strict=True):
                            out[k].append(v)
                        start += len(ids) // 4
                        if len(out["start"]) == 4096:
                            yield out
                            out = {k: [] for k in out}
            yield out

        return apply

    names = spark.createDataFrame(rows, "path string, start bigint").repartition(max(1, min(len(rows), 4 * shuffle_partitions(spark))))
    return map_arrow(names, per_slice, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_files(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1) -> DataFrame:
    """Write all documents to token files in the shared folder and read them back."""
    spark = docs.sparkSession
    return read_tokens(spark, write_tokens(docs, f"{shared_folder(spark)}-tokens", tokenizer, end_id))
