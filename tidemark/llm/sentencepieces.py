"""SentencePiece encoding and decoding by suffix-array matching.

A batch's texts are cut where a piece can never span (before a run of spaces), its distinct segments are joined into one
text, and that text's suffix array is built.  Every piece of the vocabulary finds its range of occurrences by binary
search; the occurrences are edges, which are sorted by the position that they end at and then relaxed from left to
right.  For a pair-merge (BPE) model the relaxation keeps, at each position, the one last piece that merging the text so
far leaves: an edge is taken if the piece before its start and the edge's piece, merged alone, stay those two.  (Greedy
merging is local in this sense: a row of pieces is the merge result of its text if and only if each neighbouring pair
is.)  Characters without a piece become byte pieces.  Decoding joins the pieces' bytes.

Edge cases: null and empty texts have no ids and decode to the empty text; the mark that stands for a space decodes to
a space, so texts that hold the mark itself do not come back as they were (`round_trip` is false there); bytes that are
no text cannot occur; repeated rows and rows without an id are encoded as any other; a very long text is a slice of its own,
and one without spaces a single segment, whose suffix array takes some fifty bytes a character; an empty table gives no
rows; only id and text are read, so other columns cannot clash and do not come back.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ._store import lean
from ._text import ragged, row_slices, text_buffer

SPACE = "\u2581"
SLICE_BYTES = 8 << 20
#: Segments that a task remembers; beyond it starts afresh.
CACHED_SEGMENTS = 1_200_000
#: Characters of joined segments that are indexed at once.
INDEX_CHARS = 1 << 21


_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_LATIN = "".join(chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0x100)) if chr(c).isalpha())


class Pieces:
    """The vocabulary: pieces, scores and byte fallbacks of a pair-merge model."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.piece = [model.id_to_piece(i) for i in range(n)]
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.piece) if model.is_byte(i)}
        usable = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.score = {self.piece[i]: model.get_score(i) for i in usable}
        self.id = {self.piece[i]: i for i in usable}
        self.longest = max(map(len, self.id))
        self.bytes_of = [b""] * n
        for i in usable:
            self.bytes_of[i] = self.piece[i].replace(SPACE, " ").encode()
        for b, i in self.byte.items():
            self.bytes_of[i] = bytes([b])
        whole = [p for p in self.id if self.merge(p) == [p]]  # a piece that merging never leaves has no edges
        self.words = sorted(whole, key=lambda p: p.encode("utf-32-be"))
        self.word_ids = np.array([self.id[p] for p in self.words], np.int64)
        self.compatible: dict[int, bool] = {}
        # marks that no piece holds right after a Latin letter: merging never crosses there
        pairs = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        self.safe = "".join(m for m in _MARKS if not any(c + m in pairs for c in _LATIN))

    def merge(self, text: str) -> list[str]:
        """Pair merging by best score, the leftmost first among equals."""
        symbols, left, right = list(text), list(range(-1, len(text) - 1)), list(range(1, len(text) + 1))
        heap: list[tuple[float, int, str, int]] = []

        def offer(i: int) -> None:
            j = right[i]
            if i >= 0 and j < len(symbols):
                s = symbols[i] + symbols[j]
                if s in self.score:
                    heapq.heappush(heap, (-self.score[s], i, s, j))

        for i in range(len(symbols) - 1):
            offer(i)
        while heap:
            _, i, s, j = heapq.heappop(heap)
            if not symbols[i] or right[i] != j or j >= len(symbols) or symbols[i] + symbols[j] != s:
                continue
            symbols[i], symbols[j] = s, ""
            right[i] = right[j]
            if right[j] < len(symbols):
                left[right[j]] = i
            if left[i] >= 0:
                offer(left[i])
            offer(i)
        return [s for s in symbols if s]

    def stays(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b (numbers in `words`, -1 for a byte fallback or a start) stay two when merged alone."""
        out = np.ones(len(a), dtype=bool)
        ask = np.flatnonzero((a >= 0) & (b >= 0))
        key, inverse = np.unique(a[ask] * len(self.words) + b[ask], return_inverse=True)
        known = list(map(self.compatible.get, key.tolist()))
        for k in [k for k, v in enumerate(known) if v is None]:
            x, y = self.words[int(key[k]) // len(self.words)], self.words[int(key[k]) % len(self.words)]
            known[k] = self.compatible[int(key[k])] = self.merge(x + y) == [x, y]
        out[ask] = np.array(known, dtype=bool)[inverse] if len(ask) else True
        return out


def suffix_array(chars: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the `depth` characters from each on (all that a piece can tell apart), by rank doubling."""
    letters, rank = np.unique(chars, return_inverse=True)
    rank = rank.astype(np.uint64) + np.uint64(1)
    have = next(k for k in (8, 4, 2) if len(letters) + 1 < 1 << (64 // k))
    padded = np.concatenate([rank, np.zeros(have, np.uint64)])
    key = np.zeros(len(rank), np.uint64)
    for d in range(have):
        key = key << np.uint64(64 // have) | padded[d : d + len(rank)]
    order = np.argsort(key, kind="stable")
    while have < depth:
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], (key[order][1:] != key[order][:-1]).astype(np.int64)]))
        after = np.zeros(len(rank), np.int64)
        after[: max(len(rank) - have, 0)] = rank[have:]
        key = rank * (int(rank.max(initial=0)) + 1) + after
        order = np.argsort(key, kind="stable")
        have *= 2
    return order


def occurrences(chars: np.ndarray, order: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(position, number of the piece) of all occurrences; all pieces search at once, character by character."""
    n, lo, hi = len(chars), np.zeros(len(words), np.int64), np.full(len(words), len(chars), np.int64)
    size = np.array([len(w) for w in words])
    letter = np.zeros((len(words), int(size.max(initial=1))), np.uint32)
    for k, w in enumerate(words):
        letter[k, : len(w)] = np.frombuffer(w.encode("utf-32-le"), np.uint32)
    padded = np.concatenate([chars, np.zeros(letter.shape[1], np.uint32)])
    for d in range(letter.shape[1]):
        live = np.flatnonzero((size > d) & (lo < hi))
        if not len(live):
            break
        want = letter[live, d]
        bounds = []
        for strict in (False, True):  # first suffix whose d-th character is not less, then greater
            a, b = lo[live].copy(), hi[live].copy()
            while (open_ := a < b).any():
                mid = (a + b) // 2
                got = padded[order[np.minimum(mid, n - 1)] + d]
                less = (got <= want) if strict else (got < want)
                a = np.where(open_ & less, mid + 1, a)
                b = np.where(open_ & ~less, mid, b)
            bounds.append(a)
        lo[live], hi[live] = bounds
    count = np.maximum(hi - lo, 0)
    return order[ragged(lo, count)], np.repeat(np.arange(len(words)), count)


def relax(pieces: Pieces, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all segments, one after another, and how many each has."""
    joined = "\0".join(segments) + "\0"
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    size = np.array([len(s) for s in segments], np.int64)
    begin = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    ends = begin + size
    chars[ends] = 0x110000  # no piece holds it
    position, number = occurrences(chars, suffix_array(chars, pieces.longest), pieces.words)
    width = np.array([len(w) for w in pieces.words])[number]
    stop = position + width
    n = len(chars)
    covered = np.zeros(n + 1, dtype=bool)
    covered[stop[width == 1]] = True
    last = np.full(n + 1, -2, np.int64)  # the piece that merging leaves last; -1 for byte pieces or a start
    origin = np.full(n + 1, -1, np.int64)
    last[begin] = -1
    # edges by the position, within their segment, that they end at; all segments go on one character at a time, so an
    # edge's start has been settled when it is relaxed
    place = stop - np.repeat(begin, size + 1)[np.minimum(stop - 1, n - 1)]
    by_place = np.argsort(place.astype(np.uint16) if size.max(initial=0) < 1 << 16 else place, kind="stable")
    cuts = np.searchsorted(place[by_place], np.arange(1, int(size.max(initial=0)) + 2))
    for k in range(1, int(size.max(initial=0)) + 1):
        e = by_place[cuts[k - 1] : cuts[k]]
        prior = last[position[e]]
        e = e[prior > -2]
        ok = e[pieces.stays(last[position[e]], number[e])]
        last[stop[ok]], origin[stop[ok]] = number[ok], position[ok]
        bare = begin[size >= k] + k
        bare = bare[~covered[bare]]  # a character without a piece merges with nothing
        last[bare], origin[bare] = -1, bare - 1
    at, live = ends.copy(), np.flatnonzero(size > 0)
    steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(live):
        steps.append((live, last[at[live]], at[live]))
        at[live] = origin[at[live]]
        live = live[at[live] > begin[live]]
    if not steps:
        return np.zeros(0, np.int32), np.zeros(len(segments), np.int64)
    who, which, where = (np.concatenate(x) for x in zip(*steps))
    order = np.argsort(where)  # positions of the joined text, so segments in their order too
    who, which, where = who[order], which[order], where[order]
    ids = pieces.word_ids[which]
    bare = np.flatnonzero(which < 0)
    if len(bare):
        fallback = [[pieces.byte[b] for b in joined[x - 1].encode("utf-8", "surrogatepass")] for x in where[bare].tolist()]
        count = np.ones(len(ids), np.int64)
        count[bare] = [len(f) for f in fallback]
        spread = np.repeat(ids, count)
        spread[np.repeat(which < 0, count)] = [i for f in fallback for i in f]
        ids, who = spread, np.repeat(who, count)
    return ids.astype(np.int32), np.bincount(who, minlength=len(segments))


_CUT = re.compile(rf"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Encoder:
    """Ids of texts, each distinct segment once."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.decode_starts = np.concatenate([[0], np.cumsum([len(b) for b in self.pieces.bytes_of])])
        self.decode_pool = np.frombuffer(b"".join(self.pieces.bytes_of), np.uint8)
        self._reset()

    def _reset(self) -> None:
        self.at: dict[str, int] = {}
        self.lengths, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int64)

    def _learn(self, segments: list[str]) -> None:
        lo = 0
        while lo < len(segments):
            hi, size = lo, 0
            while hi < len(segments) and (hi == lo or size + len(segments[hi]) < INDEX_CHARS):
                size += len(segments[hi]) + 1
                hi += 1
            ids, n = relax(self.pieces, segments[lo:hi])
            self.at.update(zip(segments[lo:hi], range(len(self.starts), len(self.starts) + hi - lo)))
            self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(n) - n])
            self.lengths = np.concatenate([self.lengths, n])
            self.pool = np.concatenate([self.pool, ids])
            lo = hi

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows and the index of each row's first id (one entry more)."""
        texts = pc.fill_null(column, "").cast(pa.large_string())
        empty, mark = pa.scalar("", pa.large_string()), pa.scalar(SPACE, pa.large_string())
        marked = pc.if_else(pc.equal(texts, ""), empty, pc.binary_join_element_wise(mark, pc.replace_substring(texts, " ", SPACE), empty))
        # a segment is a run of marks and what follows up to the next run; pieces never hold a mark after a letter
        cut = next((c for c in map(chr, range(0xFDD0, 0xFDF0)) if not pc.any(pc.match_substring(marked, c)).as_py()), None)
        if cut is None:
            parts = pa.array([_CUT.findall(t) for t in marked.to_pylist()], pa.large_list(pa.large_string()))
        else:
            parts = pc.replace_substring_regex(marked, f"([^{SPACE}]){SPACE}", f"\\1{cut}{SPACE}")
            if self.pieces.safe:
                parts = pc.replace_substring_regex(parts, f"([{_LATIN}])([{re.escape(self.pieces.safe)}])", f"\\1{cut}\\2")
            parts = pc.split_pattern(parts, cut)
        cuts = parts.offsets.to_numpy().astype(np.int64)
        cuts -= cuts[0]
        found = parts.flatten().cast(pa.large_string()).dictionary_encode()
        unique = found.dictionary.to_pylist()
        if len(self.at) > CACHED_SEGMENTS:
            self._reset()
        known = list(map(self.at.get, unique))
        if None in known:
            self._learn([u for u, k in zip(unique, known) if k is None])
            known = list(map(self.at.get, unique))
        code = np.array(known, np.int64)[found.indices.to_numpy()] if unique else np.zeros(0, np.int64)
        n = self.lengths[code]
        before = np.concatenate([[0], np.cumsum(n)])
        return self.pool[ragged(self.starts[code], n)], before[cuts]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows' texts, and the index of each row's first byte; the space that encoding adds is taken off."""
        n = self.decode_starts[ids + 1] - self.decode_starts[ids]
        before = np.concatenate([[0], np.cumsum(n)])[first]
        buf = self.decode_pool[ragged(self.decode_starts[ids], n)]
        some = before[:-1][np.diff(before) > 0]
        keep = np.ones(len(buf), dtype=bool)
        keep[some] = buf[some] != 32
        return buf[keep], np.concatenate([[0], np.cumsum(keep)])[before]


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per document: id, n_ids, ids_crc32 (of unsigned little-endian 32-bit ids), decoded_crc32 (of the UTF-8 that the
    ids decode to), n_bytes, round_trip; `with_ids` adds the ids and the decoded text."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_ids long, ids_crc32 long, decoded_crc32 long, n_bytes long, round_trip boolean" + ", ids array<int>, decoded string" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model_path)
        for batch in batches:
            buf, offsets = text_buffer(batch.column(1))
            for lo, hi in row_slices(offsets + 64 * np.arange(len(offsets)), SLICE_BYTES):
                ids, first = encoder.encode(batch.column(1).slice(lo, hi - lo))
                out, at = encoder.decode(ids, first)
                raw, plain = ids.astype("<u4").tobytes(), out.tobytes()
                own = buf[offsets[lo] : offsets[hi]].tobytes()
                rows, base = range(hi - lo), int(offsets[lo])
                spans = [(int(at[k]), int(at[k + 1])) for k in rows]
                arrays = [
                    batch.column(0).slice(lo, hi - lo),
                    pa.array(np.diff(first), pa.int64()),
                    pa.array([zlib.crc32(raw[4 * int(first[k]) : 4 * int(first[k + 1])]) for k in rows], pa.int64()),
                    pa.array([zlib.crc32(plain[a:b]) for a, b in spans], pa.int64()),
                    pa.array(np.diff(at), pa.int64()),
                    pa.array([plain[a:b] == own[int(offsets[lo + k]) - base : int(offsets[lo + k + 1]) - base] for k, (a, b) in enumerate(spans)]),
                ]
                if with_ids:
                    arrays += [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32())), pa.array([plain[a:b].decode("utf-8", "replace") for a, b in spans])]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
