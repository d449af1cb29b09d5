"""Exact top-k inner products by MaxScore.

A vector component is a query term's posting.  Shards of vectors keep, per component, the postings as a column and the
component's least and greatest value, which bound what a query term can add.  For a query, terms are ordered by the
width of what they can add; those whose bounds together cannot lift a vector over the query's present k-th score are
non-essential.  Essential postings are traversed for the whole shard; of the others only vectors that are still
competitive are probed, term by term.  A task goes on with the k-th scores of its earlier shards, and the shards' tops
are merged at the end.

Blocks of queries meet all shards: shards are dealt to groups of a few, each block goes to every group and streams past its
shards, so memory is bounded by these shards, one block and k rows a query.  This is a stated query set against all rows,
in blocks.

Edge cases: vectors that are null, empty or hold null or non-finite components take no part, as query or candidate;
vectors of another length than a query's are not candidates of it; ties go to the smaller id; rows that repeat an id
are candidates each, but never of that id's query; a query id that is repeated is asked for each of its vectors, and the
k best of all answers stay under the id; rows without an id take no part; an empty table gives no rows; other columns are
not read, so they cannot clash and do not come back.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._store import lean, pack_arrays, partitions, unpack_arrays, written

SHARD_ROWS = 8192
QUERY_BLOCK = 2048
#: Shards that a task holds at a time, on average.
SHARDS_HELD = 4


def quantised(column: pa.Array, scale: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions of usable vectors and floor(scale * x) of each."""
    at, out = [], []
    for k, v in enumerate(column):
        if v.is_valid and len(v.values):
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) if not v.values.null_count else None
            if x is not None and np.isfinite(x).all():
                at.append(k)
                out.append(np.floor(scale * x).astype(np.int64))
    return np.array(at, np.int64), out


@lean
def _blocks(batches: Iterable[pa.RecordBatch], scale: int, every: int) -> Iterator[pa.RecordBatch]:
    """Rows (dims, kind, part, blob): shards of vectors (kind 0) and single-row blocks are joined later by dims."""
    from pyspark import TaskContext

    held: dict[int, tuple[list[int], list[np.ndarray]]] = {}
    seq, part = 0, TaskContext.get().partitionId()

    def out(dims: int) -> pa.RecordBatch:
        nonlocal seq
        ids, rows = held.pop(dims)
        ids_a, m = np.array(ids, np.int64), np.array(rows)
        blobs = [(0, pack_arrays(ids_a, m))]
        ask = ids_a % every == 0
        for lo in range(0, int(ask.sum()), QUERY_BLOCK):
            blobs.append((1, pack_arrays(ids_a[ask][lo : lo + QUERY_BLOCK], m[ask][lo : lo + QUERY_BLOCK])))
        seq += 1
        return pa.RecordBatch.from_arrays(
            [pa.array([dims] * len(blobs), pa.int32()), pa.array([k for k, _ in blobs], pa.int32()), pa.array([(part << 32) | seq << 10 | i for i in range(len(blobs))], pa.int64()), pa.array([b for _, b in blobs], pa.binary())],
            names=["dims", "kind", "part", "blob"],
        )

    for batch in batches:
        ids = batch.column(0)
        at, vectors = quantised(batch.column(1), scale)
        for k, v in zip(at.tolist(), vectors):
            if not ids[k].is_valid:
                continue
            mine = held.setdefault(len(v), ([], []))
            mine[0].append(ids[k].as_py())
            mine[1].append(v)
            if len(mine[0]) >= SHARD_ROWS:
                yield out(len(v))
    for dims in list(held):
        yield out(dims)


def maxscore(query: np.ndarray, postings: np.ndarray, low: np.ndarray, high: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a shard (components x rows) whose score may reach the threshold, with exact scores; a row left out scores
    less than the threshold."""
    a, b = query * low, query * high
    least, most = np.minimum(a, b), np.maximum(a, b)
    order = np.argsort(most - least, kind="stable")[::-1]  # widest first
    rest = np.concatenate([np.cumsum(most[order][::-1])[::-1], [0]])  # the most that terms from here on can add
    ess = len(order)
    if threshold > np.iinfo(np.int64).min // 2:
        # non-essential: the tail whose bounds, on top of the least that essential terms add, stay below the threshold
        floor = np.concatenate([[0], np.cumsum(least[order])])
        below = np.flatnonzero(floor + rest < threshold)
        ess = max(1, min(len(order), int(below[0]) if len(below) else len(order) // 4))
    essential = order[:ess]
    partial = query[essential] @ postings[essential]
    rows = np.flatnonzero(partial + rest[ess] >= threshold)
    score = partial[rows]
    at = ess
    while at < len(order) and len(rows):
        step = order[at : at + 8]  # probe a few terms, then drop what is no longer competitive
        score = score + query[step] @ postings[step][:, rows]
        at += len(step)
        ok = score + rest[at] >= threshold
        rows, score = rows[ok], score[ok]
    return rows, score


@lean
def _search(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (dims, salt, kind, part, blob) in order: the shards of a salt, which are held, then all query blocks, one by one.
    Gives (query_id, vec_id, score) of each block's top k over these shards."""
    now, shards = None, []
    for batch in batches:
        for dims, salt, kind, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(4)):
            if (dims, salt) != now:
                now, shards = (dims, salt), []
            ids, flat = unpack_arrays(blob.as_py(), np.int64, np.int64)
            rows = flat.reshape(len(ids), dims)
            if kind == 0:
                shards.append((ids, np.ascontiguousarray(rows.T).astype(np.float64), rows.min(axis=0).astype(np.float64), rows.max(axis=0).astype(np.float64)))
                continue
            found: list[tuple] = []
            for query, vector in zip(ids.tolist(), rows.astype(np.float64)):
                bi, bs = np.zeros(0, np.int64), np.zeros(0, np.int64)
                for cand, postings, low, high in shards:  # the k-th score so far is the next shard's threshold
                    threshold = int(bs[-1]) if len(bs) == k else np.iinfo(np.int64).min
                    at, score = maxscore(vector, postings, low, high, threshold)
                    own = cand[at] != query
                    ni, ns = np.concatenate([bi, cand[at][own]]), np.concatenate([bs, score[own].astype(np.int64)])
                    if len(ns) > 4 * k:  # scores below the k-th cannot stay
                        ok = ns >= np.partition(ns, len(ns) - k)[len(ns) - k]
                        ni, ns = ni[ok], ns[ok]
                    top = np.lexsort((ni, -ns))[:k]
                    bi, bs = ni[top], ns[top]
                found.append((np.full(len(bi), query), bi, bs))
            columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, k: int = 5, scale: int = 256, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best of all other rows for each row whose id is divisible by `every`.

    Scores are exact integers while their sums stay below 2**53.
    """
    n = partitions(vectors.sparkSession)
    blocks = written(vectors.select(F.col(id_col).cast("long").alias("i"), F.col(vector_col).alias("v")).mapInArrow(lambda it: _blocks(it, scale, every), "dims int, kind int, part long, blob binary"), "shards", "uncompressed")
    salts = max(1, -(-blocks.filter("kind = 0").count() // SHARDS_HELD))
    one = F.pmod(F.xxhash64("part"), F.lit(salts)).cast("int")
    salt = F.when(F.col("kind") == 0, F.array(one)).otherwise(F.sequence(F.lit(0), F.lit(salts - 1)))
    met = blocks.select("dims", F.explode(salt).alias("salt"), "kind", "part", "blob").repartition(n, "dims", "salt").sortWithinPartitions("dims", "salt", "kind", "part")
    tops = met.mapInArrow(lambda it: _search(it, k), "query_id long, vec_id long, score long")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return tops.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
