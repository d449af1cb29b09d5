"""Written intermediate tables and Arrow chunks.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``, the folder that the cluster names as shared, so lost
executors cost a re-read and never a result.  Where that setting is absent on one machine, as in tests, a temporary folder
is set; on a cluster its absence is an error.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes of a chunk: the unit that is combined before a shuffle and answered as a whole.
CHUNK_BYTES = 8 << 20
#: Bytes of blobs that go to Python at once.
BATCH_BYTES = 2 << 20


def lean(fn):
    """fn, a generator over batches, that gives freed memory back to the system when it ends: workers serve many tasks."""

    @functools.wraps(fn)
    def run(*args, **kwargs):
        try:
            yield from fn(*args, **kwargs)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # another C library
                ctypes.CDLL(None).malloc_trim(0)

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder of written intermediate tables."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder, read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Remove a table made by written(); only once nothing can read it again."""
    spark, path = df.sparkSession, getattr(df, "_tidemark_path", None)
    if path:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished jobs now: it does so when the driver's garbage is collected, and a plan is
    garbage only once the events of its end are handled."""
    for _ in range(1 if spark.sparkContext.master.startswith("local[") else 2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5 if not spark.sparkContext.master.startswith("local[") else 0)


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """Rows that run meanwhile go to Python in batches of about `size` bytes: rows of blobs are few, so all of a task's would else be
    one batch, which an executor holds several times over."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def to_ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_ipc(blob: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(pa.py_buffer(blob)) as r:
        return r.read_next_batch()


@lean
def _chunks(batches: Iterable[pa.RecordBatch], text: str, chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    from ._text import text_buffer, row_slices

    part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

    def out() -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        return pa.RecordBatch.from_arrays([pa.array([(part << 32) | seq], pa.int64()), pa.array([to_ipc(whole)], pa.binary())], names=["chunk_id", "payload"])

    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffer(batch.column(text))
        weights = offsets + 64 * np.arange(len(offsets))
        for lo, hi in row_slices(weights, chunk_bytes // 4):
            held.append(batch.slice(lo, hi - lo))
            size += int(weights[hi] - weights[lo])
            if size >= chunk_bytes * 3 // 4:
                yield out()
                seq, held, size = seq + 1, [], 0
    if held:
        yield out()


def chunked(docs: DataFrame, text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """docs as a written table (chunk_id, payload): compressed record batches of about chunk_bytes of text.

    A chunk is one row, so whatever is derived from it is the same in every pass, whichever task derives it.
    """
    rows = docs.mapInArrow(lambda it: _chunks(it, text, chunk_bytes), "chunk_id long, payload binary")
    return written(rows, "chunks", "uncompressed")


def answer_chunks(chunks: DataFrame, replies: DataFrame, fn: Callable[[pa.RecordBatch, list[tuple[int, bytes]]], Iterator[pa.RecordBatch]], schema: str, read: Callable = from_ipc, with_id: bool = False) -> DataFrame:
    """For each chunk, fn(its record batch, its replies as (bucket, blob)) gives rows of the result.

    replies: (chunk_id, bucket, blob); read: what makes a chunk of its payload; with_id: rows begin with the chunk_id.
    A chunk meets its own replies only, so a task holds one chunk at a time.
    """
    both = chunks.select("chunk_id", F.lit(-1).alias("bucket"), F.col(chunks.columns[1]).alias("blob")).unionByName(replies.select("chunk_id", "bucket", "blob"))
    n = partitions(chunks.sparkSession)

    def told(cid: int, chunk: bytes, got: list) -> Iterator[pa.RecordBatch]:
        for batch in fn(read(chunk), got):
            yield batch.add_column(0, "chunk_id", pa.array([cid] * batch.num_rows, pa.int64())) if with_id else batch

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, got, now = None, [], None
        for b in batches:
            for cid, bucket, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if cid != now:
                    if chunk is not None:
                        yield from told(now, chunk, got)
                    chunk, got, now = None, [], cid
                if bucket < 0:
                    chunk = blob.as_py()
                else:
                    got.append((bucket, blob.as_py()))
        if chunk is not None:
            yield from told(now, chunk, got)

    if with_id:
        schema = f"chunk_id long, {schema}"
    return both.repartition(n, "chunk_id").sortWithinPartitions("chunk_id", "bucket").mapInArrow(run, schema)


_CODEC, _QUICK = (pa.Codec("zstd", compression_level=k) for k in (6, 1))


def pack_arrays(*arrays: np.ndarray, quick: bool = False) -> bytes:
    """The arrays' bytes, compressed; unpack_arrays() needs their types only.  quick: for what hardly compresses, such as hashes."""
    raw = [np.ascontiguousarray(a) for a in arrays]
    head = np.array([len(raw), *(a.nbytes for a in raw)], np.int64).tobytes()
    return head + (_QUICK if quick else _CODEC).compress(b"".join(a.tobytes() for a in raw), asbytes=True)


def planes(x: np.ndarray) -> np.ndarray:
    """The array's bytes, first the lowest of all items, then the next: small numbers compress well so."""
    flat = np.ascontiguousarray(x).ravel()
    return np.ascontiguousarray(flat.view(np.uint8).reshape(len(flat), -1).T).ravel() if len(flat) else np.zeros(0, np.uint8)


def from_planes(raw: np.ndarray, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


def unpack_arrays(blob: bytes, *kinds) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    sizes = np.frombuffer(blob, np.int64, n, 8)
    raw = pa.decompress(memoryview(blob)[8 * (n + 1) :], decompressed_size=int(sizes.sum()), codec="zstd")
    raw, at, out = memoryview(raw), 0, []
    for size, kind in zip(sizes.tolist(), kinds):
        out.append(np.frombuffer(raw[at : at + size], kind))
        at += size
    return out
