"""Packing of tokenised documents into fixed windows by non-negative least squares.

Per block of tokens (bounded memory, no shuffle): whole windows are cut off long documents; the remainders' lengths,
in units of `unit` tokens, form a histogram; all combinations of at most `depth` lengths that fill a window exactly are
enumerated; non-negative least squares finds how often to use each; the counts are rounded down, and what is left over
(the residuals) is packed greedily: it fills the slack that the units leave, then windows of its own.  The end of a
block is cut at powers of two, which need no padding.

Edge cases: a null or empty text is the end token alone; repeated rows, and rows without an id, are packed once per row; an empty table gives
no rows; a document longer than a block is cut across blocks of the same task; input columns other than the id and the
text are not returned, so their names cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ._store import lean
from ._text import ragged, row_slices, text_buffer

WINDOW = 2048
END_ID = 1
#: Tokens packed together; a block's last window is the only one that the plan cannot fill.
BLOCK_TOKENS = 1 << 21
SLICE_BYTES = 4 << 20
#: Distinct stems that a task remembers; beyond it starts afresh.
CACHED_WORDS = 600_000
#: Plain Latin letters, then ASCII marks but the apostrophe, which starts contractions.
_STEM_TAIL = r"^(?P<stem>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[!-&(-/:-@\[-`{-~]*)$"


class WordEncoder:
    """Token ids of texts; the library encodes each distinct stem once.

    The vocabulary's pre-tokenizer drops white space and never spans it, and its normaliser works letter by letter, so
    a text's ids are those of its words in a row.  A word of plain Latin letters and then plain ASCII marks is two
    pre-tokens, a stem and a tail, each of which ends with the only end-of-word id that it has; many stems are encoded
    by one call and split there.  All other words are encoded one by one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._reset()

    def _reset(self) -> None:
        self.at: dict[str | None, int] = {"": 0, None: 0}
        self.starts, self.lengths, self.pool = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def _learn(self, words: list[str], single: bool) -> None:
        ids, lengths = [], []
        for lo in range(0, len(words), 2000 if single else 1):
            part = words[lo : lo + 2000 if single else lo + 1]
            got = self._ids(" ".join(part))
            cuts = np.flatnonzero(self.ends[got]) + 1 if single else np.array([len(got)])
            if len(cuts) != len(part):
                each = [self._ids(w) for w in part]
                got, cuts = np.concatenate(each), np.cumsum([len(x) for x in each])
            ids.append(got)
            lengths.append(np.diff(cuts, prepend=0))
        if words:
            self.at.update(zip(words, range(len(self.starts), len(self.starts) + len(words))))
            n = np.concatenate(lengths)
            self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(n) - n])
            self.lengths = np.concatenate([self.lengths, n])
            self.pool = np.concatenate([self.pool, *ids])

    def _entries(self, strings: pa.Array, single: bool) -> np.ndarray:
        found = strings.dictionary_encode()
        unique = found.dictionary.to_pylist()
        known = list(map(self.at.get, unique))
        if None in known:
            self._learn([w for w, k in zip(unique, known) if k is None], single)
            known = list(map(self.at.get, unique))
        codes = np.array([*known, 0], np.int64)
        return codes[pc.fill_null(found.indices, len(unique)).to_numpy()]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each row's ended by END_ID, and the index of each row's first id (one entry more)."""
        words = pc.ascii_split_whitespace(pc.fill_null(column, "").cast(pa.large_string()))
        cuts = words.offsets.to_numpy()
        cuts = cuts - cuts[0]
        found = words.flatten().dictionary_encode()
        unique = found.dictionary
        if len(self.at) > CACHED_WORDS:
            self._reset()
        split = pc.extract_regex(unique, _STEM_TAIL)
        odd = self._entries(pc.if_else(split.is_null(), unique, None), False)
        stem = self._entries(pc.utf8_lower(pc.struct_field(split, "stem")), True)
        tail = self._entries(pc.struct_field(split, "tail"), True)
        parts = np.column_stack([odd, stem, tail]).ravel()
        n = self.lengths[parts]
        pool = np.concatenate([self.pool[ragged(self.starts[parts], n)], [END_ID]]).astype(np.int32)
        n = np.append(n.reshape(-1, 3).sum(axis=1), 1)
        starts = np.cumsum(n) - n
        code = np.insert(found.indices.to_numpy(), cuts[1:], len(unique))
        per_word = n[code]
        before = np.concatenate([[0], np.cumsum(per_word)])
        return pool[ragged(starts[code], per_word)], before[cuts + np.arange(len(cuts))]


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """argmin |a x - b| over x >= 0, by Lawson and Hanson's active sets."""
    m = a.shape[1]
    x, on = np.zeros(m), np.zeros(m, dtype=bool)
    gram, rhs = a.T @ a, a.T @ b
    for _ in range(rounds):
        grad = np.where(on, -np.inf, rhs - gram @ x)
        j = int(np.argmax(grad))
        if grad[j] <= 1e-8 * max(1.0, float(np.abs(rhs).max())):
            break
        on[j] = True
        while True:
            k = np.flatnonzero(on)
            s = np.linalg.lstsq(gram[np.ix_(k, k)], rhs[k], rcond=None)[0]
            if s.min(initial=1.0) > 0:
                x[:] = 0
                x[k] = s
                break
            bad = s <= 0
            step = np.min(x[k][bad] / np.maximum(x[k][bad] - s[bad], 1e-300))
            x[k] += step * (s - x[k])
            on[k[(x[k] <= 1e-12) | (bad & (x[k] <= 1e-9))]] = False
            x[~on] = 0
            if not on.any():
                break
    return x


@lru_cache(maxsize=8)
def combinations(units: int, depth: int) -> tuple[tuple[int, ...], ...]:
    """All multisets of at most `depth` positive lengths that add up to `units`."""
    found: list[tuple[int, ...]] = []

    def extend(head: tuple[int, ...], left: int, most: int) -> None:
        if not left:
            found.append(head)
        elif len(head) < depth:
            for x in range(min(left, most), 0, -1):
                if x * (depth - len(head)) >= left:
                    extend((*head, x), left - x, x)

    extend((), units, units)
    return tuple(found)


def plan(lengths: np.ndarray, window: int = WINDOW, unit: int = 32, depth: int = 3) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (document, start, length): every token of every document once, none above `window`."""
    windows: list[list[tuple[int, int, int]]] = []
    full, rest = lengths // window, lengths % window
    for d in np.flatnonzero(full):
        windows += [[(int(d), k * window, window)] for k in range(int(full[d]))]
    units = -(-window // unit)
    by: list[list[int]] = [[] for _ in range(units + 1)]
    for d in np.flatnonzero(rest):
        by[-(-int(rest[d]) // unit)].append(int(d))
    ways = [c for c in combinations(units, depth) if all(by[u] for u in c)]
    piece = lambda d: (d, int(full[d]) * window, int(rest[d]))
    planned: list[tuple[int, list[tuple[int, int, int]]]] = []
    if ways:
        used = sorted({u for c in ways for u in c})
        row = {u: i for i, u in enumerate(used)}
        a = np.zeros((len(used), len(ways)))
        for j, c in enumerate(ways):
            for u in c:
                a[row[u], j] += 1
        counts = np.floor(nnls(a, np.array([len(by[u]) for u in used], float)) + 1e-6).astype(int)
        for j in np.argsort(-counts, kind="stable"):
            for _ in range(counts[j]):
                if any(len(by[u]) < ways[j].count(u) for u in set(ways[j])):
                    break
                got = [piece(by[u].pop()) for u in ways[j]]
                planned.append((window - sum(p[2] for p in got), got))
    left = [piece(d) for u in range(units, 0, -1) for d in by[u]]
    planned.sort(key=lambda p: -p[0])
    slack, pool, at = sum(p[0] for p in planned), sum(p[2] for p in left), 0
    while at < len(planned) and slack > pool:  # not enough residuals to fill what the units leave: take windows apart
        slack -= planned[at][0]
        pool += window - planned[at][0]
        left += planned[at][1]
        at += 1
    left.sort(key=lambda p: p[2])
    stack = left[::-1]  # shortest on top

    def fill(into: list[tuple[int, int, int]], room: int) -> None:
        while room and stack:
            d, s, n = stack.pop()
            if n > room:
                stack.append((d, s + room, n - room))
                n = room
            into.append((d, s, n))
            room -= n

    for room, got in planned[at:]:
        fill(got, room)
        windows.append(got)
    remaining = sum(p[2] for p in stack)
    while remaining:
        size = window if remaining >= window else 1 << (remaining.bit_length() - 1)
        windows.append([])
        fill(windows[-1], size)
        remaining -= size
    return windows


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length[, ids].

    `with_ids` adds the piece's token ids.  sequence_id is unique over the result, though not without gaps.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long" + ", ids array<int>" * with_ids

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, seq = WordEncoder(tokenizer_path), TaskContext.get().partitionId(), 0
        held_ids: list[np.ndarray] = []
        held: list[tuple] = []  # (doc id, the document's ids before, ids here, all its ids)
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal seq, held, held_ids, size
            if not held:
                return
            ids = np.concatenate(held_ids)
            first = np.concatenate([[0], np.cumsum([h[2] for h in held])])
            rows: list[tuple] = []
            for w in plan(np.array([h[2] for h in held], np.int64), window):
                at, total = 0, sum(p[2] for p in w)
                for d, s, n in w:
                    x = ids[first[d] + s : first[d] + s + n]
                    rows.append((held[d][0], held[d][1] + s, n, zlib.crc32(x.astype("<u4").tobytes()), held[d][3], (part << 32) + seq, at, total) + ((x,) if with_ids else ()))
                    at += n
                seq += 1
            cols = list(zip(*rows))
            arrays = [pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:8])]
            if with_ids:
                arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in cols[8]])]), pa.int32()), pa.array(np.concatenate(cols[8]), pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length"] + ["ids"] * with_ids)
            held, held_ids, size = [], [], 0

        for batch in batches:
            ids_col, texts = batch.column(0), batch.column(1)
            id_type = ids_col.type
            _, offsets = text_buffer(texts)
            for lo, hi in row_slices(offsets + 64 * np.arange(len(offsets)), SLICE_BYTES):
                ids, first = encoder.encode(texts.slice(lo, hi - lo))
                for k, doc in enumerate(ids_col.slice(lo, hi - lo).to_pylist()):
                    a, b = int(first[k]), int(first[k + 1])
                    at = a
                    while at < b:
                        take = min(b - at, block_tokens - size)
                        held_ids.append(ids[at : at + take])
                        held.append((doc, at - a, take, b - a))
                        size, at = size + take, at + take
                        if size >= block_tokens:
                            yield from flush()
        yield from flush()

    return docs.select(id_col, text_col).mapInArrow(run, schema)
