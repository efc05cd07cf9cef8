"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows that one call of a batch function sees; bounds a worker's memory.
SLICE_ROWS = 512
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors must share.

    Where that is unset, a session of one machine (master local[...], as in tests) gets a folder of its own that goes
    with the process; on a cluster, whose executors would each write to a disk of their own, it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="recordloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/recordloom-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def slices(batch: pa.RecordBatch, column: str | None = None) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no slice has over SLICE_ROWS rows or, by the named column, far over SLICE_BYTES bytes."""
    step = SLICE_ROWS
    if column is not None and batch.num_rows:
        step = max(1, min(step, int(SLICE_BYTES * batch.num_rows / max(1, batch.column(column).nbytes))))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


_COLLECT = gc.get_threshold()
#: What a Python worker keeps from task to task: one thing at a time.
_kept: dict[str, object] = {}


def kept(key: str, make: Callable[[], object]) -> object:
    """The worker's thing of that name, made where there is none; any other is dropped first."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def begin_task(keeps: str | None, rarely: bool) -> None:
    """Drop what another operator has left in the worker; `rarely`: look for cycles at wide intervals only."""
    if keeps not in _kept:
        _kept.clear()
    if rarely:
        gc.set_threshold(200_000, 20, 20)


def end_task() -> None:
    """Give freed memory back to the system: workers of several operators share an executor."""
    gc.set_threshold(*_COLLECT)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        return


def map_arrow(df: DataFrame, per_slice: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str | StructType, sized_by: str | None = None, quiet: bool = False, keeps: str | None = None) -> DataFrame:
    """mapInArrow over bounded slices. per_slice makes, once a task, the function from a slice to columns,
    to an iterator of such, or to nothing.

    quiet: a rare cycle collector, for functions with large caches and no cycles; keeps: the name under which the
    function finds what the worker's last task of it has `kept`.
    """
    struct = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(struct)

    def batch_of(columns: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) and c.type == f.type else pa.array(c, type=f.type) for c, f in ((columns[f.name], f) for f in arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task(keeps, quiet)
        apply = None
        try:
            apply = per_slice()
            for batch in batches:
                for part in slices(batch, sized_by):
                    found = apply(part)
                    for columns in (found,) if isinstance(found, dict) else found or ():
                        yield batch_of(columns)
            done = getattr(apply, "finish", None)
            for columns in done() if done else ():
                yield batch_of(columns)
        finally:
            del apply
            end_task()

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, struct)


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches to and from Python hold SLICE_BYTES at most, in this session: both ends keep several at a time."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > SLICE_BYTES:
        spark.conf.set(key, str(SLICE_BYTES))


def fold(key, modulus: int = 5):
    """crc32 of a key as text, modulo: the fixed folds of labels and training rows."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as UTF-8; null is empty."""
    return [v or b"" for v in batch.column(column).cast(pa.binary()).to_pylist()]


def word_codes(batch: pa.RecordBatch, column: str = "text", lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The texts' words, split at ASCII white space, A to Z in lower case if `lower`, an empty word behind each text's last: a code for
    each place, the number of places of each text, and the distinct words by code, as bytes. Null is empty."""
    texts = pc.binary_join_element_wise(pc.fill_null(batch.column(column), ""), "", " ")  # the blank behind a text parts an empty word off
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    coded = lists.flatten().dictionary_encode()
    codes, ends = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), lists.offsets.to_numpy()[1:].astype(np.int64)
    sizes = np.diff(ends, prepend=0)
    blank = codes[ends - sizes] == codes[ends - 1]  # white space before the first word parts an empty word off, too
    return np.delete(codes, (ends - sizes)[blank]), sizes - blank, coded.dictionary.cast(pa.large_binary() if pa.types.is_large_string(coded.dictionary.type) else pa.binary())


def listed(column: pa.Array | pa.ChunkedArray) -> list:
    """The values of a column of bytes without nulls; many times as fast as to_pylist."""
    return column.to_numpy(zero_copy_only=False).tolist() if isinstance(column, pa.Array) else column.to_numpy().tolist()


def summed_by(parts: list[pa.Table], keys: list[str], number: str = "n") -> pa.Table:
    """Rows of equal keys made one, with the sum of their numbers."""
    whole = pa.concat_tables(parts).group_by(keys, use_threads=False).aggregate([(number, "sum")])
    return whole.rename_columns([number if c == f"{number}_sum" else c for c in whole.column_names])


def most_frequent(counts: DataFrame, number: str, ties: list[str], most: int) -> DataFrame:
    """The `most` rows of greatest `number` (1 or more), equal ones by `ties`. `counts` is read twice: hand in a written table.

    A histogram by powers of 2 ** (1 / 8), some hundred rows whatever the input, tells first from which count on rows
    are needed; only those and the rest of their step are sorted, so the sort doesn't grow with the rows counted.
    """
    step = F.floor(F.log2(number) * 8).cast("int")
    left, least = most, None
    for row in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("k")).collect(), key=lambda r: -r["step"]):
        least, left = row["step"], left - row["k"]
        if left <= 0:
            break
    return (counts if least is None else counts.where(step >= least)).orderBy(F.desc(number), *ties).limit(most)


def order_buckets(ids: DataFrame, column: str, buckets: int) -> list:
    """At most `buckets` - 1 ascending split points of a column, by approximate quantiles over all rows, each off by a
    hundredth of a bucket at most, up to 10,000 buckets; the quantiles' table is bounded."""
    points = ids.agg(F.percentile_approx(column, [i / buckets for i in range(1, buckets)], min(100 * buckets, 1_000_000)).alias("q")).first()["q"] if buckets > 1 else None
    return sorted({p for p in points or [] if p is not None})


def bucket_of(column, points: list):
    """Number of split points at or below the value: an order-preserving bucket; null sorts first, in bucket 0.

    A binary search over one constant array: a step for every bit of the number of points.
    """
    if not points:
        return F.lit(0)
    splits = F.split(F.lit(",".join(map(str, points))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(points).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(splits, at + step - 1) <= column, at + step).otherwise(at))


def tokenizer_path(name: str) -> str:
    """Where the file of a public tokenizer lies on this machine; a name with a slash is a path already."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
