"""Document fingerprints by one-permutation MinHash with optimal densification and packed low-order bits.

Each shingle (five consecutive words) is hashed once; the hash's top bits choose one of `bins` bins and each bin keeps
its least hash.  An empty bin borrows from the bin that a universal hash of (bin, attempt) names, attempts going on
until a filled bin is met: the same attempts in every document, so likeness is kept.  Of each bin `bits` low-order bits
are stored, as lowercase hex, and a comparison takes the chance agreement of those bits off again.

Edge cases: a null text is empty; a text without words has the fingerprint of zeros with the suffix "-", whose likeness
is 1 to another such and 0 to any other; texts of fewer than five words have one shingle, all their words; equal texts
have equal fingerprints; rows of one id follow each other in the order of their texts; a single row is its own
neighbour; rows without an id come before all others; a very long text is hashed as any other; an empty table gives no rows;
only id and text are read, so other columns cannot clash and do not come back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import lean, partitions
from ._text import SHINGLE_WORDS, mix64, row_slices, seeded, shingle_hashes, text_buffer, word_hashes, word_spans

BINS = 512
BITS = 4
#: Ranges of ids a shuffle partition.
RANGES_EACH = 4
SLICE_BYTES = 1 << 20
_NO_ID = -(1 << 63)


def signatures(column: pa.Array, bins: int = BINS, bits: int = BITS, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(rows x bins) low-order bits and whether a row has words."""
    buf, offsets = text_buffer(column)
    n = len(offsets) - 1
    out, filled = np.zeros((n, bins), np.uint8), np.zeros(n, dtype=bool)
    shift = np.uint64(64 - int(bins).bit_length() + 1)
    for lo, hi in row_slices(offsets, SLICE_BYTES):
        part, offs = buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, first = word_spans(part, offs)
        hashes, begins = shingle_hashes(word_hashes(part, starts, ends), first, size)
        rows = hi - lo
        least = np.full(rows * bins, np.iinfo(np.uint64).max, np.uint64)
        cell = np.repeat(np.arange(rows) * bins, np.diff(begins)) + (hashes >> shift).astype(np.int64)
        np.minimum.at(least, cell, mix64(hashes))
        have = np.zeros(rows * bins, dtype=bool)
        have[cell] = True
        some = np.diff(begins) > 0
        filled[lo:hi] = some
        densify(least, have, some, bins)
        out[lo:hi] = (least.reshape(rows, bins) & np.uint64((1 << bits) - 1)).astype(np.uint8)
        out[lo:hi][~some] = 0
    return out, filled


def densify(least: np.ndarray, have: np.ndarray, some: np.ndarray, bins: int) -> None:
    """Fill each empty bin of rows with words from the first filled bin that its attempts name."""
    empty = np.flatnonzero(~have & np.repeat(some, bins))
    attempt = 0
    while len(empty):
        attempt += 1
        with np.errstate(over="ignore"):
            target = (mix64(np.arange(bins, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + seeded(1, 1000 + attempt)[0]) % np.uint64(bins)).astype(np.int64)
        source = empty // bins * bins + target[empty % bins]
        ok = have[source]
        least[empty[ok]] = least[source[ok]]
        empty = empty[~ok]


def packed(sig: np.ndarray, filled: np.ndarray, bits: int = BITS) -> list[str]:
    """Hex strings of the low-order bits."""
    flat = np.unpackbits(sig[:, :, None], axis=2)[:, :, 8 - bits :].reshape(len(sig), -1)
    return [b.tobytes().hex() + ("" if f else "-") for b, f in zip(np.packbits(flat, axis=1), filled)]


def likeness(a: np.ndarray, b: np.ndarray, fa: np.ndarray, fb: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Similarity from the share of agreeing bins, less the agreement of unlike bins by chance, within 0 and 1."""
    by_chance = 1.0 / (1 << bits)
    same = np.clip(((a == b).mean(axis=1) - by_chance) / (1 - by_chance), 0.0, 1.0)
    return np.where(fa & fb, same, np.where(fa | fb, 0.0, 1.0))


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, object, bool, str]]:
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            yield row[0], row[1], row[2], row[3] or ""


def _neighbours(batches: Iterable[pa.RecordBatch], hold: int) -> Iterator[tuple[list[object], list[str], str]]:
    """Runs of (ids, texts) in order and the text that follows each run; a run is about `hold` characters."""
    ids, texts, size, now = [], [], 0, None
    for bucket, doc, guest, text in _rows(batches):
        if bucket != now:
            ids, texts, size, now = [], [], 0, bucket
        elif ids and (guest or size >= hold):
            yield ids, texts, text
            ids, texts, size = [], [], 0
        if guest:
            now = None  # what a range's guest precedes is another range
            continue
        ids.append(doc)
        texts.append(text)
        size += len(text)


@lean
def _deal(batches: Iterable[pa.RecordBatch], bounds: np.ndarray, firsts: np.ndarray, guest_of: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each document into its range of ids, and the first of each range also, as a guest, into the range before."""
    for batch in batches:
        key = pc.fill_null(batch.column(0).cast(pa.int64()), _NO_ID).to_numpy()
        own = np.searchsorted(bounds, key, "left").astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.zeros(len(key), bool)), pa.array(key), *batch.columns], names=["r", "guest", "k", *batch.schema.names])
        at = np.searchsorted(firsts, key)
        hit = np.flatnonzero(firsts[np.minimum(at, len(firsts) - 1)] == key)
        if len(hit):
            some = batch.take(pa.array(hit))
            yield pa.RecordBatch.from_arrays([pa.array(guest_of[at[hit]]), pa.array(np.ones(len(hit), bool)), pa.array(key[hit]), *some.columns], names=["r", "guest", "k", *batch.schema.names])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, bits: int = BITS) -> DataFrame:
    """One row per document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Documents are dealt into ranges of ids, a few for each shuffle partition so that long texts even out, each followed by a guest: the first
    document of the next range.  The bounds of the ranges, two numbers each, are all that the driver sees.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    schema = f"_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    ranges = RANGES_EACH * partitions(docs.sparkSession)
    keys = docs.select(F.coalesce(F.col("_id").cast("long"), F.lit(_NO_ID)).alias("k"))
    cuts = keys.agg(F.percentile_approx("k", [i / ranges for i in range(1, ranges)], 10 * ranges + 1000)).first()[0] if ranges > 1 else None
    bounds = np.array(sorted(set(cuts or [])), np.int64)

    def ranged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, int] = {}
        for batch in batches:
            key = batch.column(0).to_numpy()
            for r, k in zip(np.searchsorted(bounds, key, "left").tolist(), key.tolist()):
                least[r] = min(k, least.get(r, k))
        yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.int32()), pa.array(list(least.values()), pa.int64())], names=["r", "k"])

    found = sorted((r.k, r.r) for r in keys.mapInArrow(ranged, "r int, k long").groupBy("r").agg(F.min("k").alias("k")).collect())  # a row for each range
    firsts = np.array([k for k, _ in found] or [0], np.int64)
    guest_of = np.array([found[i - 1][1] for i in range(len(found))] or [0], np.int32)  # the first of all follows the last
    dealt = docs.mapInArrow(lambda it: _deal(it, bounds, firsts, guest_of), f"r int, guest boolean, k long, _id {kind}, _text string")
    ordered = dealt.repartition(ranges, "r").sortWithinPartitions("r", "guest", "k", "_text").select("r", "_id", "guest", "_text")

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        def typed():
            nonlocal kept
            for b in batches:
                kept = b.schema.field(1).type
                yield b
        for ids, texts, follow in _neighbours(typed(), 2 * SLICE_BYTES):
            after = [*texts[1:], follow]
            edited = [t[: len(t) - len(t) // 4] + a[: len(t) // 4] for t, a in zip(texts, after)]
            own, own_some = signatures(pa.array([*texts, follow], pa.large_string()), bins, bits)
            new, new_some = signatures(pa.array(edited, pa.large_string()), bins, bits)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, kept),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                    pa.array(packed(own[:-1], own_some[:-1], bits)),
                    pa.array(packed(new, new_some, bits)),
                    pa.array(likeness(own[:-1], new, own_some[:-1], new_some, bits)),
                    pa.array(likeness(own[:-1], own[1:], own_some[:-1], own_some[1:], bits)),
                ],
                names=[x.split()[0] for x in schema.split(", ")],
            )

    return ordered.mapInArrow(run, schema).withColumnRenamed("_id", id_col)

