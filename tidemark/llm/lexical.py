"""Ranked lexical search over a two-level quantised index.

The index is a written table of shards.  A shard holds a lexicon (terms and how many of its documents hold each) and
postings on two levels: for each term the documents with a *byte impact*, the term's saturated frequency rounded up to
one of 255 steps, and beside it the frequency itself.  A query adds weight x byte over its postings, which gives every
document an upper bound, and a lower bound one step a term below it.  The k-th lower bound so far is the threshold; every
document whose upper bound reaches it is scored again from frequencies and lengths in 64-bit integers, and the exact
scores raise the threshold for the shards that a task meets later.  What the tasks keep is merged by a rank window, so no
document that belongs to the best k is ever lost.

Statistics (documents, terms, and documents by term) are sums over all shards.  Queries meet all shards in blocks: where
the queries' terms and weights are small, which is counted first, every task gets them and the shards stay where they lie;
otherwise blocks of bounded size go to groups of a few shards through a shuffle.

Edge cases: null and empty texts have no terms and are not counted; items without an id take no part, rows that share an
item's id make one item with the terms of them all; documents without an id are counted but cannot be named, so they are
no answers; documents that share an id are ranked each by its own text; equal scores go to the smaller id; an item whose
terms occur nowhere has no rows; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._store import drop_written, from_planes, lean, pack_arrays, partitions, planes, unpack_arrays, written
from ._text import binary_array, ragged, row_slices, text_buffer

#: Text bytes of a shard.
SHARD_BYTES = 16 << 20
#: Shards that a task holds at a time, on average, where queries come to it in blocks.
SHARDS_HELD = 4
#: Bytes of terms and weights that every task may get; more travel in blocks of this size.
BLOCK_BYTES = 4 << 20
#: An impact is below SCALE; STEP is what one step of a byte impact stands for.
SCALE = 1_000_000
STEP = -(-SCALE // 255)

_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_MANY = np.iinfo(np.int64).max


class Index(NamedTuple):
    shards: DataFrame
    documents: int
    terms: int


def terms(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all rows, in order, as a binary array and, for each row, the index of its first (one entry more)."""
    buf, offsets = text_buffer(column)
    if not len(buf):
        return pa.array([], pa.large_binary()), np.zeros(len(offsets), np.int64)
    solid = _TERM[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | cut[1:-1]
    kept = np.flatnonzero(solid)
    starts = np.flatnonzero(first)
    at = np.searchsorted(kept, starts)
    return binary_array(_LOWER[buf[kept]], np.append(at, len(kept))), np.searchsorted(starts, offsets)


def damping(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """A document's m; past 64 bits numpy gives way to Python's integers."""
    if len(n) and 90 * int(n.max()) * documents > _MANY:
        return np.array([10 + 90 * x * documents // total for x in n.tolist()], np.int64)
    return 10 + 90 * n.astype(np.int64) * documents // max(1, total)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


@lean
def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        documents = total = 0
        _, offsets = text_buffer(b.column(0))
        for lo, hi in row_slices(offsets, SHARD_BYTES):
            n = np.diff(terms(b.column(0).slice(lo, hi - lo))[1])
            documents, total = documents + int((n > 0).sum()), total + int(n.sum())
        yield pa.RecordBatch.from_pydict({"documents": [documents], "terms": [total]})


def _shard(ids: pa.Array, column: pa.Array, documents: int, total: int) -> tuple[bytes, bytes]:
    """(lexicon, postings) of some documents."""
    found, first = terms(column)
    n = np.diff(first)
    coded = found.dictionary_encode()
    key = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(n) + np.repeat(np.arange(len(n)), n)
    key.sort()
    new = np.flatnonzero(np.diff(key, prepend=-1))
    tf = np.diff(np.append(new, len(key)))
    term, doc = np.divmod(key[new], max(1, len(n)))
    held = np.bincount(term, minlength=len(coded.dictionary))
    byte = (impact(tf, damping(n, documents, total)[doc]) + STEP - 1) // STEP
    raw, offsets = text_buffer(coded.dictionary)
    named = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    lexicon = pack_arrays(raw, planes(np.diff(offsets).astype(np.int32)), planes(held.astype(np.int64)))
    postings = pack_arrays(named, pc.is_valid(ids).to_numpy(zero_copy_only=False).astype(np.uint8), planes(n), planes(doc.astype(np.uint32)), planes(tf.astype(np.uint32)), byte.astype(np.uint8))
    return lexicon, postings


def _lexicon(blob: bytes) -> tuple[pa.Array, np.ndarray]:
    raw, lengths, held = unpack_arrays(blob, np.uint8, np.uint8, np.uint8)
    offsets = np.concatenate([[0], np.cumsum(from_planes(lengths, np.int32), dtype=np.int64)])
    return binary_array(raw, offsets), from_planes(held, np.int64)


@lean
def _shards(batches: Iterable[pa.RecordBatch], documents: int, total: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def out() -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        lexicon, postings = _shard(whole.column(0), whole.column(1), documents, total)
        return pa.RecordBatch.from_pydict({"lexicon": [lexicon], "postings": [postings]})

    for b in batches:
        _, offsets = text_buffer(b.column(1))
        for lo, hi in row_slices(offsets, SHARD_BYTES // 4):
            held.append(b.slice(lo, hi - lo))
            size += int(offsets[hi] - offsets[lo])
            if size >= SHARD_BYTES * 3 // 4:
                yield out()
                held, size = [], 0
    if size:
        yield out()


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """All documents' shards, written, with the counts that their impacts rest on; read in two passes."""
    docs = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    sums = docs.select("t").mapInArrow(_count, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    documents, total = sums[0] or 0, sums[1] or 0
    shards = docs.mapInArrow(lambda it: _shards(it, documents, total), "lexicon binary, postings binary")
    return Index(written(shards, "lexical", "uncompressed"), documents, total)


@lean
def _item_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found, first = terms(b.column(1))
        if len(found):
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), np.diff(first)))), found.cast(pa.binary())], names=["item", "term"])


@lean
def _held(batches: Iterable[pa.RecordBatch], wanted: pa.Array | None) -> Iterator[pa.RecordBatch]:
    """(term, documents) of a task's shards: of the wanted terms, summed, or of all."""
    sums = np.zeros(0 if wanted is None else len(wanted), np.int64)
    for b in batches:
        for blob in b.column(0):
            lexicon, held = _lexicon(blob.as_py())
            if wanted is None:
                yield pa.RecordBatch.from_arrays([lexicon.cast(pa.binary()), pa.array(held)], names=["term", "held"])
            else:
                at = pc.index_in(wanted, value_set=lexicon)
                hit = np.flatnonzero(pc.is_valid(at).to_numpy(zero_copy_only=False))
                sums[hit] += held[at.take(pa.array(hit)).to_numpy(zero_copy_only=False)]
    if len(sums):
        yield pa.RecordBatch.from_arrays([wanted.cast(pa.binary()), pa.array(sums)], names=["term", "held"])


def _small(rows: DataFrame) -> bool:
    """Whether rows of (…, term, …) may be sent to all tasks."""
    return (rows.agg(F.sum(F.octet_length("term") + 24)).first()[0] or 0) <= BLOCK_BYTES


def term_weights(asked: DataFrame, idx: Index) -> DataFrame:
    """(item, term, weight) of the asked (item, term), with the documents of each term counted over all shards."""
    vocabulary = asked.select("term").distinct()
    wanted = None
    if _small(vocabulary):
        wanted = pa.array([bytes(r.term) for r in vocabulary.collect()], pa.large_binary())
    held = idx.shards.select("lexicon").mapInArrow(lambda it: _held(it, wanted), "term binary, held long")
    if wanted is None:
        held = held.join(vocabulary, "term", "left_semi")
    held = held.groupBy("term").agg(F.sum("held").alias("held")).filter("held > 0")
    weight = F.floor(1000 * F.log(F.lit(2.0 * idx.documents + 2) / (2.0 * F.col("held") + 1))).cast("long")
    return asked.join(held, "term").select("item", "term", weight.alias("weight")).filter("weight > 0")


class Block(NamedTuple):
    """Queries: distinct terms and, by item, their indices and weights."""

    terms: pa.Array
    items: np.ndarray
    first: np.ndarray
    term: np.ndarray
    weight: np.ndarray


def _block(items: np.ndarray, names: pa.Array, weights: np.ndarray) -> Block:
    order = np.argsort(items, kind="stable")
    coded = names.cast(pa.large_binary()).dictionary_encode()
    ids, first = np.unique(items[order], return_index=True)
    return Block(coded.dictionary, ids, np.append(first, len(order)), coded.indices.to_numpy(zero_copy_only=False)[order], weights[order])


class Shard:
    """A decoded shard, for scoring."""

    def __init__(self, lexicon: bytes, postings: bytes, documents: int, total: int) -> None:
        self.lexicon, held = _lexicon(lexicon)
        ids, named, n, doc, tf, self.byte = unpack_arrays(postings, np.int64, np.uint8, np.uint8, np.uint8, np.uint8, np.uint8)
        self.ids, self.named = ids, named.astype(bool)
        self.m = damping(from_planes(n, np.int64), documents, total)
        self.doc, self.tf = from_planes(doc, np.uint32), from_planes(tf, np.uint32)
        self.held, self.first = held, np.cumsum(held) - held

    def best(self, at: np.ndarray, weight: np.ndarray, k: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, exact scores) of the documents that may be among the k best, given the best k scores known so far.

        at, weight: the query's terms as places in the lexicon, and their weights.
        """
        size, length = len(self.ids), self.held[at]
        spot, w = ragged(self.first[at], length), np.repeat(weight, length)
        doc = self.doc[spot]
        above = np.bincount(doc, w * self.byte[spot].astype(np.float64), size)
        above[~self.named] = 0
        low = (above - np.bincount(doc, w, size))[above > 0] * STEP
        low = np.concatenate([known, low])
        threshold = np.partition(low, len(low) - k)[len(low) - k] if len(low) >= k else -np.inf
        keep = (above > 0) & (above * STEP >= threshold)
        spot, w = spot[keep[doc]], w[keep[doc]]
        doc = self.doc[spot]
        score = np.zeros(size, np.int64)
        np.add.at(score, doc, w * impact(self.tf[spot], self.m[doc]))
        rows = np.flatnonzero(score)
        return self.ids[rows], score[rows]


class Tops:
    """The best k of each item over the shards met so far."""

    def __init__(self, block: Block, k: int) -> None:
        self.block, self.k = block, k
        self.ids = [np.zeros(0, np.int64)] * len(block.items)
        self.scores = [np.zeros(0, np.int64)] * len(block.items)

    def meet(self, shard: Shard) -> None:
        b = self.block
        at = pc.fill_null(pc.index_in(b.terms, value_set=shard.lexicon), -1).to_numpy(zero_copy_only=False)
        for i in range(len(b.items)):
            mine = at[b.term[b.first[i] : b.first[i + 1]]]
            hit = mine >= 0
            if hit.any():
                ids, scores = shard.best(mine[hit], b.weight[b.first[i] : b.first[i + 1]][hit], self.k, self.scores[i])
                ids, scores = np.concatenate([self.ids[i], ids]), np.concatenate([self.scores[i], scores])
                top = np.lexsort((ids, -scores))[: self.k]
                self.ids[i], self.scores[i] = ids[top], scores[top]

    def rows(self) -> pa.RecordBatch:
        n = [len(x) for x in self.ids]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.block.items, n), pa.int64()), pa.array(np.concatenate(self.ids), pa.int64()), pa.array(np.concatenate(self.scores), pa.int64())], names=["item_id", "doc_id", "score"])


@lean
def _search_all(batches: Iterable[pa.RecordBatch], block: Block, k: int, documents: int, total: int) -> Iterator[pa.RecordBatch]:
    tops = Tops(block, k)
    for b in batches:
        for lexicon, postings in zip(b.column(0), b.column(1)):
            tops.meet(Shard(lexicon.as_py(), postings.as_py(), documents, total))
    yield tops.rows()


@lean
def _search_blocks(batches: Iterable[pa.RecordBatch], k: int, documents: int, total: int) -> Iterator[pa.RecordBatch]:
    """Rows (salt, kind, one, two) in order: the shards of a salt, which are held, then all blocks, one by one."""
    now, shards = None, []
    for b in batches:
        for salt, kind, one, two in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
            if salt != now:
                now, shards = salt, []
            if kind == 0:
                shards.append(Shard(one.as_py(), two.as_py(), documents, total))
                continue
            names, _ = _lexicon(one.as_py())
            tops = Tops(_block(*_unpacked(names, two.as_py())), k)
            for shard in shards:
                tops.meet(shard)
            yield tops.rows()


def _unpacked(names: pa.Array, blob: bytes) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    items, weights = unpack_arrays(blob, np.int64, np.int64)
    return items, names, weights


@lean
def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (item, term, weight) sorted by item, as blocks (one, two); an item's terms are never cut."""
    held, size, last = [], 0, None

    def out() -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        raw, offsets = text_buffer(whole.column(1))
        one = pack_arrays(raw, planes(np.diff(offsets).astype(np.int32)), planes(np.ones(whole.num_rows, np.int64)))
        return pa.RecordBatch.from_pydict({"one": [one], "two": [pack_arrays(whole.column(0).to_numpy(), whole.column(2).to_numpy())]})

    for b in batches:
        items = b.column(0).to_numpy()
        edges = np.flatnonzero(np.diff(items)) + 1
        for lo, hi in zip(np.append(0, edges).tolist(), np.append(edges, len(items)).tolist()):
            if size >= BLOCK_BYTES and items[lo] != last:
                yield out()
                held, size = [], 0
            held.append(b.slice(lo, hi - lo))
            size, last = size + held[-1].nbytes, items[lo]
    if held:
        yield out()


def search(idx: Index, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best documents of each item."""
    n, documents, total = partitions(items.sparkSession), idx.documents, idx.terms
    asked = items.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("t"))
    asked = written(asked.mapInArrow(_item_terms, "item long, term binary").distinct(), "asked")
    weighted = written(term_weights(asked, idx), "weights")
    if _small(weighted):
        rows = weighted.collect()
        block = _block(np.array([r.item for r in rows], np.int64), pa.array([bytes(r.term) for r in rows], pa.large_binary()), np.array([r.weight for r in rows], np.int64))
        drop_written(asked)
        drop_written(weighted)
        found = idx.shards.mapInArrow(lambda it: _search_all(it, block, k, documents, total), "item_id long, doc_id long, score long") if rows else items.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    else:
        blocks = weighted.repartition(n, "item").sortWithinPartitions("item").mapInArrow(_packed, "one binary, two binary")
        salts = max(1, -(-idx.shards.count() // SHARDS_HELD))
        put = F.pmod(F.xxhash64("lexicon"), F.lit(salts)).cast("int")
        both = idx.shards.select(put.alias("salt"), F.lit(0).alias("kind"), F.col("lexicon").alias("one"), F.col("postings").alias("two"))
        both = both.unionByName(blocks.select(F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(1).alias("kind"), "one", "two"))
        met = both.repartition(n, "salt").sortWithinPartitions("salt", "kind")
        found = met.mapInArrow(lambda it: _search_blocks(it, k, documents, total), "item_id long, doc_id long, score long")
    w = W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
