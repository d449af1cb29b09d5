"""Vectorised text primitives shared by the corpus operators.

Everything works on the raw UTF-8 bytes of an Arrow string column, so a batch of documents costs a few numpy passes
and no Python object per word.  A *word* is a run of bytes outside ``[\\x20\\x09-\\x0D]``, kept unchanged.  Null texts
count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Shingle length and similarity that near-duplicate operators use unless told otherwise.
SHINGLE_WORDS = 5
NEAR_SIMILARITY = 0.8

_M64 = (1 << 64) - 1
_SEED = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_HASH_BLOCK = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element-wise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """n well mixed 64-bit constants."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_SEED) + np.uint64(seed * 0x632BE59BD9B4E019 & _M64))


_BYTE_CODE = seeded(256, 1)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, grown on demand."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            for at, base in enumerate((_BASE, _BASE_INV)):
                p = np.full(size, np.uint64(base))
                p[0] = 1
                np.multiply.accumulate(p, out=p)
                if len(_powers) > at:
                    _powers[at] = p
                else:
                    _powers.append(p)
    return _powers[0], _powers[1]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, int64 offsets) of a string or binary column; nulls are empty.  Offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    n = len(column)
    _, offs, data = column.buffers()
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, budget: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most `budget` bytes; a longer row is a range of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + budget, "right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words and, for each row, the index of its first word (one entry more than rows)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_IS_SPACE[buf]
    cut = np.zeros(len(buf) + 1, dtype=bool)
    cut[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | cut[1:-1]
    last = solid
    last[:-1] &= ~solid[1:] | cut[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, by prefix sums of a polynomial; blocks bound the working memory."""
    out = np.empty(len(starts), np.uint64)
    at, n = 0, len(starts)
    with np.errstate(over="ignore"):
        while at < n:
            base = starts[at]
            to = min(n, max(at + 1, int(np.searchsorted(ends, base + _HASH_BLOCK, "right"))))
            part = buf[base : ends[to - 1]]
            power, inverse = _power_tables(len(part) + 1)
            sums = np.empty(len(part) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(_BYTE_CODE[part] * power[: len(part)], out=sums[1:])
            s, e = starts[at:to] - base, ends[at:to] - base
            out[at:to] = mix64((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(_SEED))
            at = to
    return out


_STEP = seeded(64, 2) | np.uint64(1)


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `size` consecutive words of one row and, for each row, the index of its first shingle.

    A row of fewer words, but not none, has one shingle: all of it.
    """
    n = len(words)
    count = np.diff(first)
    shingles = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    begins = np.zeros(len(count) + 1, np.int64)
    np.cumsum(shingles, out=begins[1:])
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for j in range(min(size, n)):
            total[: n - j] += words[j:] * _STEP[j]
        rows = np.flatnonzero(shingles)
        if (count[rows] >= size).all():
            at = np.arange(begins[-1]) + np.repeat(first[:-1] - begins[:-1], shingles)
            return mix64(total[at]), begins
        at = np.arange(begins[-1]) + np.repeat(first[:-1] - begins[:-1], shingles)
        out = total[at]
        for r in rows[count[rows] < size]:  # at most `size` - 1 words each
            w = words[first[r] : first[r + 1]]
            out[begins[r]] = (w * _STEP[: len(w)]).sum(dtype=np.uint64) + np.uint64(len(w)) * np.uint64(_SEED)
    return mix64(out), begins


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def binary_array(buf: np.ndarray, offsets: np.ndarray, kind: pa.DataType = pa.large_binary()) -> pa.Array:
    """An Arrow array over bytes and int64 offsets, without a copy."""
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(buf))])
