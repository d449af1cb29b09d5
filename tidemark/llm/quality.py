"""Quality by co-training of a text-content and a page-metadata classifier.

The text view is how often each pair of neighbouring kinds of bytes occurs, by length, and the text's layout (lines, words,
shares of marks, capitals and repeated words); the metadata view is the language, the source and the recorded length,
and nothing of the text.  Each view's logistic classifier starts from labelled documents; over rounds, each labels the
unlabelled documents that it is sure of for the other to learn from, where each class's pseudo-labels weigh as much as its
labels.  Both are calibrated on labelled documents kept apart, and the calibrated views' log odds are combined by a
third logistic fit on the same.

All labelled and all unlabelled documents take part: their features, some hundred numbers each, are one written table, and
every step of a fit is a sum over it.  Only the text view's leading components and the numbers' scales come from a bounded
sample of labelled documents (`max_labelled`, the least by a hash of the id, of at most `max_bytes` of text).  All
documents are scored on whole texts.

Edge cases: a null text is empty, and an empty text has the score of its metadata and of no pairs; null language, source
or length are values of their own; languages and sources but the most frequent share hashed weights; copies of a text
give one pseudo-label; labels that are null are ignored, an id labelled twice is good if all its labels are, and an id with
several rows teaches its least one; with one class of labels only, every score is 0.5 for lack of evidence and counts as
good; repeated rows score alike; an empty table gives no rows; columns other than those named are not read, and
keep_good() returns all of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import drop_written, lean, pack_arrays, partitions, unpack_arrays, written
from ._text import row_slices, text_buffer, word_hashes, word_spans
from .toxicity import logistic, sampled

#: Labelled documents, and bytes of their texts, that scales and components come from at most.
MAX_LABELLED, MAX_BYTES = 3000, 24 << 20
#: Rounds, and at most so many steps of a fit in each and in the first.
ROUNDS, STEPS, FIRST_STEPS = 3, 4, 12
COMPONENTS, PAIRS_USED = 80, 512
SLICE_BYTES = 1 << 20
#: A document counts as good from this probability on: what is not clearly bad is kept.
THRESHOLD = 0.3
#: Bytes of no kind that every text is taken to hold besides, so that short ones prove little.
PRIOR = 100
#: Sources and languages that have a weight of their own, the most frequent of all documents, and weights the others share.
NAMED, HASHED = 64, 64
#: Log odds from which on a view is sure of a label: a probability of 0.95.
SURE = float(np.log(0.95 / 0.05))
#: Rows of features that a task sums at least, if there are more than a few tasks.
ROWS_A_TASK = 20_000
#: A number counts as at most so many spreads from its mean.
MOST_SPREADS = 8
#: Calibration counts documents by both views' log odds, in steps of this size up to 15.
GRID = 0.25


def _kinds() -> np.ndarray:
    """A class of each byte: itself for lower-case letters and marks, one each for capitals, digits, spaces and others."""
    out, own = np.full(256, 3, np.int32), 4
    for c in range(256):
        if 65 <= c <= 90:
            out[c] = 0
        elif 48 <= c <= 57:
            out[c] = 1
        elif c == 32 or 9 <= c <= 13:
            out[c] = 2
        elif 33 <= c < 127:
            out[c], own = own, own + 1
    return out


_KIND = _kinds()
_SIDE = int(_KIND.max()) + 1
PAIRS = _SIDE * _SIDE


def pair_index(buf: np.ndarray) -> np.ndarray:
    """Index of the pair that each byte makes with the one after it."""
    kind = _KIND[buf]
    return kind[:-1] * _SIDE + kind[1:]


def pair_rates(texts: list[bytes]) -> np.ndarray:
    out = np.zeros((len(texts), PAIRS), np.float32)
    for k, t in enumerate(texts):
        x = np.frombuffer(t, np.uint8)
        if len(x) > 1:
            out[k] = np.bincount(pair_index(x), minlength=PAIRS) / (len(x) - 1 + PRIOR)
    return out


def layout(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Shape of each text: logarithms of length, lines and words, and shares of kinds of bytes."""
    n = np.diff(offsets)
    size = n + PRIOR

    def share(flag: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(flag)])
        return (c[offsets[1:]] - c[offsets[:-1]]) / size

    upper, lower = (buf >= 65) & (buf <= 90), (buf >= 97) & (buf <= 122)
    digit, high, space = (buf >= 48) & (buf <= 57), buf >= 128, (buf == 32) | ((buf >= 9) & (buf <= 13))
    mark = ~(upper | lower | digit | high | space)
    lines, words = share(buf == 10), share(space)
    starts, ends, first = word_spans(buf, offsets)
    hashes = word_hashes(buf, starts, ends)
    again = np.zeros(len(hashes) + 1, dtype=bool)  # the word before once more
    again[1:-1] = hashes[1:] == hashes[:-1]
    again[first[:-1]] = False
    c = np.concatenate([[0], np.cumsum(again[:-1])])
    repeats = (c[first[1:]] - c[first[:-1]]) / (np.diff(first) + PRIOR // 5)
    return np.column_stack([np.log1p(n), np.log1p(lines * 1000), np.log1p(words * 1000), share(upper), share(lower), share(digit), share(high), share(mark), np.sqrt(share(mark)), np.sqrt(share(upper)), repeats, np.sqrt(repeats)])


def _by_slices(fn, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """fn(bytes, offsets) of slices of rows, so that working memory does not follow the batch."""
    parts = [fn(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in row_slices(offsets, SLICE_BYTES)]
    return np.concatenate(parts)


def _scale(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and spread of columns; one that hardly varies in the sample is left as it is, for it may elsewhere."""
    spread = x.std(axis=0)
    return x.mean(axis=0), np.where(spread > 1e-3, spread, 1.0)


class Space:
    """What the views are made of: the text's leading components and scales, and the named languages and sources."""

    def __init__(self, texts: list[bytes], lengths: np.ndarray, langs: list, sources: list):
        self.langs, self.sources = ({v: k for k, v in enumerate(c)} for c in (langs, sources))
        buf, offsets = text_buffer(pa.array(texts, pa.large_binary()))
        shape = _by_slices(layout, buf, offsets)
        self.shape_mean, self.shape_std = _scale(shape)
        self.meta_mean, self.meta_std = _scale(self._numbers(lengths))
        # the leading components over the pairs that vary most
        rates = pair_rates(texts)
        self.columns = np.sort(np.argsort(-rates.var(axis=0), kind="stable")[:PAIRS_USED])
        rates = rates[:, self.columns] * 100
        self.centre = rates.mean(axis=0)
        rates -= self.centre
        value, vector = np.linalg.eigh(rates.T @ rates / len(rates))
        self.basis = vector[:, np.argsort(-value)[:COMPONENTS]]

    @staticmethod
    def _numbers(lengths: np.ndarray) -> np.ndarray:
        return np.column_stack([np.log1p(np.maximum(lengths, 0)), lengths < 0]).astype(float)

    def text(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Features of the text view."""
        texts = [buf[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        pairs = (pair_rates(texts)[:, self.columns] * 100 - self.centre) @ self.basis
        return np.hstack([pairs, self.shape(buf, offsets)]).astype(np.float32)

    def shape(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.clip((layout(buf, offsets) - self.shape_mean) / self.shape_std, -MOST_SPREADS, MOST_SPREADS)

    def meta(self, langs: list, sources: list, lengths: np.ndarray) -> np.ndarray:
        """Features of the metadata view."""
        one_hot = np.zeros((len(langs), len(self.langs) + len(self.sources) + 2 * HASHED), np.float32)
        for names, column, base in ((self.langs, langs, 0), (self.sources, sources, len(self.langs) + HASHED)):
            for k, v in enumerate(column):
                one_hot[k, base + (names[v] if v in names else len(names) + zlib.crc32(str(v).encode()) % HASHED)] = 1
        numbers = np.clip((self._numbers(lengths) - self.meta_mean) / self.meta_std, -MOST_SPREADS, MOST_SPREADS)
        return np.hstack([numbers.astype(np.float32), one_hot])

    def sizes(self) -> tuple[int, int]:
        """Weights of each view, the constant included."""
        return self.basis.shape[1] + len(self.shape_mean) + 1, 2 + len(self.langs) + len(self.sources) + 2 * HASHED + 1


class Model:
    """A space, both views' weights in it (the last for the constant) and their combination."""

    def __init__(self, space: Space, text: np.ndarray, meta: np.ndarray, combine: np.ndarray):
        self.space, self.text, self.meta, self.combine = space, text, meta, combine
        # the text's linear score by pair of bytes, so that a text is scored in one pass
        k = space.basis.shape[1]
        w = space.basis @ text[:k]
        self.pair_weights = np.zeros(PAIRS, np.float32)
        self.pair_weights[space.columns] = (w * 100).astype(np.float32)
        self.pair_bias = float(text[-1] - space.centre @ w)

    def text_view(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        shape = self.space.shape(buf, offsets) @ self.text[self.space.basis.shape[1] : -1]
        if len(buf) < 2:
            return self.pair_bias + shape
        c = np.concatenate([[0.0], np.cumsum(self.pair_weights[pair_index(buf)], dtype=np.float64)])
        lo, hi = np.minimum(offsets[:-1], len(buf) - 1), np.clip(offsets[1:] - 1, 0, len(buf) - 1)
        hi = np.maximum(lo, hi)
        return (c[hi] - c[lo]) / (hi - lo + PRIOR) + self.pair_bias + shape

    def meta_view(self, langs: list, sources: list, lengths: np.ndarray) -> np.ndarray:
        return self.space.meta(langs, sources, lengths) @ self.meta[:-1] + self.meta[-1]

    def probability(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        z = np.clip(np.column_stack([text, meta]), -15, 15) @ self.combine[:-1] + self.combine[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _lengths(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column.cast(pa.float64()), -1.0).to_numpy(zero_copy_only=False)


def _features(docs: DataFrame, space: Space) -> DataFrame:
    """(i, h, x, lang, source, n_chars) of rows (i, text, lang, source, n_chars): h is a hash of the text, x its features."""
    sent = docs.sparkSession.sparkContext.broadcast(space)  # of fixed size

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_buffer(batch.column("text"))
            for lo, hi in row_slices(offsets, SLICE_BYTES):
                x = sent.value.text(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("i"), part.column("h"), pa.array([r.tobytes() for r in x], pa.binary()), *(part.column(c) for c in ("lang", "source", "n_chars"))], names=["i", "h", "x", "lang", "source", "n_chars"])

    kinds = {c: docs.schema[c].dataType.simpleString() for c in ("lang", "source")}
    return docs.withColumn("h", F.xxhash64("text")).mapInArrow(run, f"i long, h long, x binary, lang {kinds['lang']}, source {kinds['source']}, n_chars double")


def _matrices(batch: pa.RecordBatch, space: Space) -> list[np.ndarray]:
    """Both views' features with a column of ones."""
    n = batch.num_rows
    x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(n, -1) if n else np.zeros((0, space.sizes()[0] - 1), np.float32)
    m = space.meta(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), _lengths(batch.column("n_chars")))
    return [np.hstack([v, np.ones((n, 1), np.float32)]) for v in (x, m)]


def _summed(rows: DataFrame, fn, sizes: list[int]) -> list[np.ndarray]:
    """Sums over all rows of fn(batch), arrays of the given sizes; partial sums meet in a tree."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for blob in batch.column(0):
                got = unpack_arrays(blob.as_py(), *[np.float64] * len(sizes))
                total = [g.copy() for g in got] if total is None else [a + b for a, b in zip(total, got)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pack_arrays(*total)], pa.binary())], names=["blob"])

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(s) for s in sizes]
        for batch in batches:
            for t, x in zip(total, fn(batch)):
                t += x.ravel()
        yield pa.RecordBatch.from_arrays([pa.array([pack_arrays(*total)], pa.binary())], names=["blob"])

    n = max(1, int(partitions(rows.sparkSession) ** 0.5))
    got = rows.mapInArrow(run, "blob binary").repartition(n).mapInArrow(add, "blob binary").coalesce(1).mapInArrow(add, "blob binary").collect()
    return unpack_arrays(bytes(got[0]["blob"]), *[np.float64] * len(sizes)) if got else [np.zeros(s) for s in sizes]


def _told(y: np.ndarray, views: list[np.ndarray], then: list[np.ndarray] | None) -> list[np.ndarray]:
    """What each view learns of each row: its label, or for rows without one what the other view was sure of; else NaN."""
    out = []
    for k in (0, 1):
        if then is None:
            out.append(y)
        else:
            z = views[1 - k] @ then[1 - k]
            out.append(np.where(np.isnan(y), np.where(z > SURE, 1.0, np.where(z < -SURE, 0.0, np.nan)), y))
    return out


def co_train(known: DataFrame, unknown: DataFrame, space: Space, rounds: int = ROUNDS, steps: int = STEPS, ridge: float = 1.0) -> Model | None:
    """known: features with y (1 good, 0 bad) and apart (kept for calibration); unknown: features without labels.  None if a
    class has no label."""
    learn = known.filter("not apart").drop("apart")
    rows = learn.unionByName(unknown.withColumn("y", F.lit(None).cast("int")))
    sizes = space.sizes()
    now = [np.zeros(s) for s in sizes]

    def labels(batch: pa.RecordBatch) -> np.ndarray:
        return pc.fill_null(batch.column("y").cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)

    for r in range(rounds + 1):
        table, then = (rows, [w.copy() for w in now]) if r else (learn, None)

        def count(batch: pa.RecordBatch, then=then) -> list[np.ndarray]:
            y, views = labels(batch), _matrices(batch, space)
            mine = np.isnan(y)
            return [np.array([[np.sum((t == c) & (mine == p)) for c in (0, 1)] for p in (False, True)], float) for t in _told(y, views, then)]

        counts = [c.reshape(2, 2) for c in _summed(table, count, [4, 4])]  # of each view: labels and pseudo-labels, bad and good
        if (counts[0][0] == 0).any():
            return None
        total = counts[0][0].sum()
        each = [0.5 * total / np.maximum(c, 1) for c in counts]  # every class's labels weigh alike, and its pseudo-labels as much
        base, least = [w.copy() for w in now], [np.inf, np.inf]  # the best weights so far and their loss
        for _ in range(steps if r else FIRST_STEPS):

            def slopes(batch: pa.RecordBatch, then=then, now=now, each=each) -> list[np.ndarray]:
                y, views = labels(batch), _matrices(batch, space)
                out = []
                for v, t, w, e in zip(views, _told(y, views, then), now, each):
                    use = ~np.isnan(t)
                    x, t, pseudo = v[use].astype(np.float64), t[use], np.isnan(y)[use].astype(int)
                    weight, z = e[pseudo, t.astype(int)], x @ w
                    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                    out += [np.array([weight @ np.logaddexp(0, np.where(t == 1, -z, z))]), x.T @ (weight * (t - p)), (x * (weight * p * (1 - p))[:, None]).T @ x]
                return out

            got, moved = _summed(table, slopes, [n for s in sizes for n in (1, s, s * s)]), 0.0
            for k, s in enumerate(sizes):
                loss = got[3 * k][0] + 0.5 * ridge * now[k] @ now[k]
                if loss > least[k]:  # the step went too far: half of it
                    now[k] = (now[k] + base[k]) / 2
                    moved = np.inf
                    continue
                base[k], least[k] = now[k], loss
                step = np.linalg.solve(got[3 * k + 2].reshape(s, s) + ridge * np.eye(s), got[3 * k + 1] - ridge * now[k])
                now[k] = now[k] + step
                moved = max(moved, np.abs(step).max())
            if moved < 1e-3:
                break
        now = base
    side = int(round(15 / GRID)) * 2 + 1

    def grid(batch: pa.RecordBatch) -> list[np.ndarray]:
        views = [np.rint((np.clip(v @ w, -15, 15) + 15) / GRID).astype(np.int64) for v, w in zip(_matrices(batch, space), now)]
        return [np.bincount((labels(batch).astype(np.int64) * side + views[0]) * side + views[1], minlength=2 * side * side)]

    cells = _summed(known.filter("apart"), grid, [2 * side * side])[0].reshape(2, side, side)
    if (cells.sum(axis=(1, 2)) == 0).any():  # too few labels to keep some apart
        cells = _summed(known, grid, [2 * side * side])[0].reshape(2, side, side)
    y, a, b = np.nonzero(cells)
    weight = cells[y, a, b]
    views = np.column_stack([a, b]) * GRID - 15
    single = [logistic(views[:, [k]], y.astype(float), weight, ridge=0.1) for k in (0, 1)]
    calibrated = np.column_stack([views[:, k] * single[k][0] + single[k][1] for k in (0, 1)])
    both = logistic(calibrated, y.astype(float), weight, ridge=0.1)
    combine = np.array([both[0] * single[0][0], both[1] * single[1][0], both[2] + both[0] * single[0][1] + both[1] * single[1][1]])
    return Model(space, now[0], now[1], combine)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_bytes: int = MAX_BYTES) -> Model | None:
    """A model from all labelled documents and all without a label."""
    rows = docs.select(F.col("doc_id").cast("long").alias("i"), F.coalesce("text", F.lit("")).alias("text"), "lang", "source", F.coalesce(F.col("n_chars").cast("double"), F.lit(-1.0)).alias("n_chars"))
    named = labels.filter("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("i")).agg(F.min("quality").cast("int").alias("y"))
    some = named.orderBy(F.xxhash64("i"), "i").limit(2 * max_labelled).join(rows.select("i").distinct(), "i", "left_semi").orderBy(F.xxhash64("i"), "i").limit(max_labelled)
    first = sampled(rows.withColumnRenamed("text", "x"), some, max_bytes).toArrow().sort_by("i")  # max_labelled rows and max_bytes at most
    if first.num_rows < 2:
        return None
    top = tuple([r[0] for r in rows.groupBy(c).count().orderBy(F.desc("count"), c).limit(NAMED).collect()] for c in ("lang", "source"))
    space = Space([t.encode() for t in first["x"].to_pylist()], first["n_chars"].to_numpy(), *top)
    features = written(_features(rows, space), "features")
    one = F.min(F.struct("h", "x", "lang", "source", "n_chars")).alias("r")
    held = features.filter("i is not null").join(named, "i").groupBy("i").agg(one, F.first("y").alias("y"))
    known = written(held.select("r.x", "r.lang", "r.source", "r.n_chars", "y", (F.pmod(F.xxhash64("i", F.lit(5)), F.lit(3)) == 2).alias("apart")), "known")
    free = features.join(named, "i", "left_anti").groupBy("h").agg(one)
    unknown = written(free.select("r.x", "r.lang", "r.source", "r.n_chars"), "unknown")
    drop_written(features)
    model = co_train(*(t.coalesce(max(8, t.count() // ROWS_A_TASK)) for t in (known, unknown)), space)
    drop_written(known)
    drop_written(unknown)
    return model


def _score(batch: pa.RecordBatch, model: Model | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both views' log odds and the probability of good of columns text, lang, source, n_chars."""
    n = batch.num_rows
    if model is None or not n:
        return np.zeros(n), np.zeros(n), np.full(n, 0.5)
    buf, offsets = text_buffer(batch.column("text"))
    text = _by_slices(model.text_view, buf, offsets)
    meta = model.meta_view(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), _lengths(batch.column("n_chars")))
    return text, meta, model.probability(text, meta)


def quality(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_score, meta_score (log odds of the views), score (probability of good), good (1 from the threshold)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # weights of fixed size

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, meta, p = _score(batch, sent.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text), pa.array(meta), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "text_score", "meta_score", "score", "good"])

    return docs.select("doc_id", "text", "lang", "source", "n_chars").mapInArrow(run, f"doc_id {kind}, text_score double, meta_score double, score double, good int")


def keep_good(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that count as good."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # weights of fixed size

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_score(batch, sent.value)[2] >= threshold))

    return docs.mapInArrow(run, docs.schema)
