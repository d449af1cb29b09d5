"""Exact removal of repeated passages by super-k-mer partitioning.

A window is `window` consecutive words of one document.  Consecutive windows that share a minimiser (the least hash of
the word pairs in them) travel as one packed string to the bucket of that minimiser, so equal windows always meet.  Windows
of a frequent minimiser are dealt by their greatest word pair as well, so no bucket holds them all.
Within a chunk of documents equal strings travel once, with the least and the greatest document that hold them; a
passage that a third of all documents share therefore costs a bucket one string a chunk.  In the bucket the strings'
words get exact numbers, windows are sorted and equal ones compared word by word, and each string that holds a window
which also starts in a smaller document is answered with its windows' least documents.  A chunk then meets the answers
to its own strings and drops the words that they cover.

Edge cases: a null text has no words and stays null; texts of fewer words than a window lose nothing; a document that
repeats itself loses nothing for that; rows of one id are each judged against smaller ids only; rows without an id are
returned with nothing removed and remove nothing; a text longer than a chunk is a chunk of its own; an empty table gives no
rows.  Input columns named like the added
ones (n_words, n_removed) are replaced; all others are kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._store import CHUNK_BYTES, answer_chunks, chunked, from_ipc, lean, pack_arrays, partitions, unpack_arrays
from ._text import _STEP, binary_array, mix64, ragged, text_buffer, word_hashes, word_spans

WINDOW = 13
#: Text bytes of a bucket on average: a bucket is what is sorted at once, and there are as many as the corpus needs.
BUCKET_BYTES = 4 << 20
#: A minimiser of a larger share of windows is frequent; in how many chunks that is looked up.
HOT_SHARE, HOT_CHUNKS = 0.001, 16


NO_HOT = np.zeros(0, np.uint64)


def _over(x: np.ndarray, length: int, what) -> np.ndarray:
    """what (least or greatest) of x over length consecutive items, from each on."""
    have = 1
    while have < length:
        step = min(have, length - have)
        x = what(x[: len(x) - step], x[step:])
        have += step
    return x


class SuperKmers:
    """The super-k-mers of a chunk by bucket: a function of the chunk's rows alone."""

    def __init__(self, batch: pa.RecordBatch, text_col: str, id_col: str, window: int, buckets: int, hot: np.ndarray = NO_HOT):
        self.buf, offsets = text_buffer(batch.column(text_col))
        self.starts, self.ends, self.first = word_spans(self.buf, offsets)
        ids = batch.column(id_col)
        self.has_id = pc.is_valid(ids).to_numpy(zero_copy_only=False)
        self.ids = pc.fill_null(ids.cast(pa.int64()), 0).to_numpy()
        n, rows = len(self.starts), len(self.ids)
        windows = np.where(self.has_id, np.maximum(np.diff(self.first) - window + 1, 0), 0)
        at = ragged(self.first[:-1], windows)  # the first word of each window
        if not len(at):
            self.bucket = self.word = self.count = self.row = np.zeros(0, np.int64)
            self.window = window
            return
        hashes = word_hashes(self.buf, self.starts, self.ends)
        with np.errstate(over="ignore"):
            pair = mix64(hashes[:-1] * _STEP[0] + hashes[1:] * _STEP[1])
        least = _over(pair, window - 1, np.minimum)[at]
        row = np.repeat(np.arange(rows), windows)
        new = np.ones(len(at), dtype=bool)
        new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
        key = least
        if len(hot):  # windows of a frequent minimiser are told apart by their greatest pair as well
            place = np.minimum(np.searchsorted(hot, least), len(hot) - 1)
            of_hot = hot[place] == least
            if of_hot.any():
                most = _over(pair, window - 1, np.maximum)[at]
                new[1:] |= of_hot[1:] & (most[1:] != most[:-1])
                with np.errstate(over="ignore"):
                    key = np.where(of_hot, mix64(least + most * _STEP[2]), least)
        lo = np.flatnonzero(new)
        self.least, self.per_least = least[lo], np.diff(np.append(lo, len(at)))
        count = self.per_least
        bucket = (key[lo] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        self.bucket, self.word, self.count, self.row = bucket[order], at[lo][order], count[order], row[lo][order]
        self.window = window
        assert n

    def by_bucket(self, only: set[int] | None = None) -> Iterator[tuple[int, slice, list[bytes], np.ndarray]]:
        """(bucket, its range of super-k-mers, distinct strings, number of the string of each)."""
        raw = self.buf.tobytes()
        begins = self.starts[self.word] if len(self.word) else self.word
        finishes = self.ends[self.word + self.count + self.window - 2] if len(self.word) else self.word
        cuts = np.flatnonzero(np.diff(self.bucket, prepend=-1, append=-1) != 0) if len(self.bucket) else np.zeros(0, np.int64)
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            b = int(self.bucket[lo])
            if only is None or b in only:
                seen: dict[bytes, int] = {}
                number = [seen.setdefault(raw[s:e], len(seen)) for s, e in zip(begins[lo:hi].tolist(), finishes[lo:hi].tolist())]
                yield b, slice(lo, hi), list(seen), np.array(number, np.int64)


@lean
def _minimisers(chunks: Iterable[pa.RecordBatch], text_col: str, id_col: str, window: int) -> Iterator[pa.RecordBatch]:
    """(minimiser, share of the chunk's windows) of those that a chunk has often."""
    for batch in chunks:
        for payload in batch.column(1):
            sk = SuperKmers(from_ipc(payload.as_py()), text_col, id_col, window, 1)
            if len(sk.word):
                least, inverse = np.unique(sk.least, return_inverse=True)
                share = np.bincount(inverse, sk.per_least) / sk.per_least.sum()
                often = share > HOT_SHARE
                yield pa.RecordBatch.from_arrays([pa.array(least[often].view(np.int64)), pa.array(share[often])], names=["m", "share"])


@lean
def _send(chunks: Iterable[pa.RecordBatch], text_col: str, id_col: str, window: int, buckets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in chunks:
        for cid, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
            sk = SuperKmers(from_ipc(payload.as_py()), text_col, id_col, window, buckets, hot)
            out: list[tuple[int, bytes]] = []
            for b, span, strings, number in sk.by_bucket():
                ids = sk.ids[sk.row[span]]
                least, most = np.full(len(strings), np.iinfo(np.int64).max), np.full(len(strings), np.iinfo(np.int64).min)
                np.minimum.at(least, number, ids)
                np.maximum.at(most, number, ids)
                out.append((b, pack_arrays(np.array([len(s) for s in strings], np.int32), least, most, np.frombuffer(b"".join(strings), np.uint8))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([cid] * len(out), pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["bucket", "chunk_id", "blob"])


def least_by_window(codes: np.ndarray, begins: np.ndarray, windows: np.ndarray, least: np.ndarray, window: int) -> np.ndarray:
    """For each window of each string (strings of `windows` windows whose words start at `begins`), the least `least`
    of all strings that hold an equal window."""
    at = ragged(begins, windows)
    owner = np.repeat(np.arange(len(begins)), windows)
    with np.errstate(over="ignore"):
        mixed = mix64(codes.astype(np.uint64) + np.uint64(1))
        sums = np.zeros(len(at), np.uint64)
        for j in range(window):
            sums += mixed[at + j] * _STEP[j]
    order = np.argsort(sums, kind="stable")
    same = sums[order][1:] == sums[order][:-1]
    twin = np.flatnonzero(same)
    x, y = at[order[twin + 1]], at[order[twin]]
    if any((codes[x + j] != codes[y + j]).any() for j in range(window)):  # a hash collision: sort by the words themselves
        order = np.lexsort([codes[at + j] for j in range(window - 1, -1, -1)])
        same = np.ones(len(at) - 1, dtype=bool)
        for j in range(window):
            c = codes[at[order] + j]
            same &= c[1:] == c[:-1]
    cuts = np.flatnonzero(np.append(True, ~same))
    each = np.minimum.reduceat(least[owner][order], cuts)
    out = np.empty(len(at), np.int64)
    out[order] = np.repeat(each, np.diff(np.append(cuts, len(at))))
    return out


def _answer(bucket: int, parts: list[tuple[int, bytes]], window: int) -> Iterator[tuple[int, int, bytes]]:
    got = [unpack_arrays(blob, np.int32, np.int64, np.int64, np.uint8) for _, blob in parts]
    sizes = np.concatenate([g[0] for g in got]).astype(np.int64)
    least, most = np.concatenate([g[1] for g in got]), np.concatenate([g[2] for g in got])
    strings = binary_array(np.concatenate([g[3] for g in got]), np.concatenate([[0], np.cumsum(sizes)]), pa.large_string())
    words = pc.ascii_split_whitespace(strings)
    first = words.offsets.to_numpy().astype(np.int64)
    codes = words.flatten().dictionary_encode().indices.to_numpy()
    windows = np.diff(first) - window + 1
    found = least_by_window(codes, first[:-1], windows, least, window)
    begins = np.cumsum(windows) - windows
    hit = np.minimum.reduceat(found, begins) < most
    at = 0
    for (cid, _), g in zip(parts, got):
        mine = np.flatnonzero(hit[at : at + len(g[0])])
        if len(mine):
            yield cid, bucket, pack_arrays(mine.astype(np.int32), found[ragged(begins[at + mine], windows[at + mine])])
        at += len(g[0])


@lean
def _buckets(batches: Iterable[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    now, parts = None, []

    def out() -> Iterator[pa.RecordBatch]:
        rows = list(_answer(now, parts, window)) if parts else []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["chunk_id", "bucket", "blob"])

    for batch in batches:
        for b, cid, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if b != now:
                yield from out()
                now, parts = b, []
            parts.append((cid, blob.as_py()))
    yield from out()


def covered(batch: pa.RecordBatch, replies: list[tuple[int, bytes]], text_col: str, id_col: str, window: int, buckets: int, hot: np.ndarray = NO_HOT) -> tuple[SuperKmers, np.ndarray]:
    """Which words of the chunk a window covers that also starts in a smaller document."""
    sk = SuperKmers(batch, text_col, id_col, window, buckets, hot)
    edge = np.zeros(len(sk.starts) + 1, np.int32)
    told = dict(replies)
    for b, span, strings, number in sk.by_bucket(set(told)):
        mine, least = unpack_arrays(told[b], np.int32, np.int64)
        counts = np.zeros(len(strings), np.int64)
        word, count, ids = sk.word[span], sk.count[span], sk.ids[sk.row[span]]
        counts[number] = count
        begin = np.full(len(strings), -1, np.int64)
        begin[mine] = np.cumsum(counts[mine]) - counts[mine]
        use = begin[number] >= 0
        at = ragged(word[use], count[use])
        at = at[least[ragged(begin[number[use]], count[use])] < np.repeat(ids[use], count[use])]
        edge[at] += 1
        edge[at + window] -= 1
    return sk, np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each text's kept words, joined by one space, and n_words, n_removed."""
    spark = docs.sparkSession
    n = partitions(spark)
    docs = docs.drop("n_words", "n_removed")
    chunks = chunked(docs, text_col)
    n_chunks = max(1, chunks.count())
    buckets = max(n, n_chunks * CHUNK_BYTES // BUCKET_BYTES)
    # frequent minimisers are looked up in some chunks; which they are only says how windows are dealt, never what is found
    every = -(-n_chunks // HOT_CHUNKS)
    some = chunks.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(every)) == 0)
    seen = some.mapInArrow(lambda it: _minimisers(it, text_col, id_col, window), "m long, share double")
    least = max(HOT_SHARE, 4 / buckets)  # what holds several buckets' share
    often = seen.groupBy("m").agg((F.sum("share") / F.lit(n_chunks / every)).alias("share")).filter(F.col("share") > least).collect()  # some thousand rows at most
    hot = np.sort(np.array([r["m"] for r in often], np.int64).view(np.uint64))
    sent = chunks.mapInArrow(lambda it: _send(it, text_col, id_col, window, buckets, hot), "bucket int, chunk_id long, blob binary")
    replies = sent.repartition(n, "bucket").sortWithinPartitions("bucket", "chunk_id").mapInArrow(lambda it: _buckets(it, window), "chunk_id long, bucket int, blob binary")
    schema = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in docs.schema), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    arrow = to_arrow_schema(schema)

    def finish(batch: pa.RecordBatch, told: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        sk, gone = covered(batch, told, text_col, id_col, window, buckets, hot)
        before = np.concatenate([[0], np.cumsum(gone)])
        removed = before[sk.first[1:]] - before[sk.first[:-1]]
        texts = []
        for k, text in enumerate(batch.column(text_col)):
            if text.is_valid:
                words = text.as_buffer().to_pybytes().split()
                if removed[k]:
                    words = [w for w, g in zip(words, gone[sk.first[k] : sk.first[k + 1]].tolist()) if not g]
                texts.append(b" ".join(words))
            else:
                texts.append(None)
        kept = pa.array(texts, pa.large_binary()).cast(pa.large_string())
        cols = [kept if f.name == text_col else batch.column(f.name) for f in docs_fields] + [pa.array(np.diff(sk.first), pa.int64()), pa.array(removed.astype(np.int64), pa.int64())]
        out = pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(cols, arrow)], schema=arrow)
        for lo in range(0, out.num_rows, 2000):
            yield out.slice(lo, 2000)

    docs_fields = list(docs.schema)
    return answer_chunks(chunks, replies, finish, schema)
