"""N-gram Jaccard join: MinHash banding, shuffled on band hashes, verified on full n-gram sets.

Texts with equal n-gram sets form one class first and are represented by the class's least document.  Band and row
counts follow from the recall wanted at the threshold.  Representatives that share a band hash are tied to the least
of their bucket (as many ties as rows, never pairs), and the ties' components say which n-gram sets have to meet.  A
component is cut into blocks of bounded texts and n-grams, and each pair of blocks that share a band is one unit of work: it
gets the texts with such a band, and compares the sets of all pairs sharing one, a tile of them at a time.  A unit returns how many documents each representative is linked to, and a spanning forest
of the links; pairs are never written.

Edge cases: a null text is empty; texts without words are copies of each other and like no other; texts of fewer than
`size` words have one n-gram; repeated rows are copies; rows without an id belong to no class (class_id null, no links)
and link to none; a very long text is one n-gram set, in a block as any other; an empty table gives no rows; only the id and
the text are read, so other columns cannot clash, and keep_one_each() returns all of them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._store import drop_written, lean, partitions, written
from ._text import NEAR_SIMILARITY, SHINGLE_WORDS, mix64, row_slices, seeded, shingle_hashes, text_buffer, word_hashes, word_spans

RECALL = 0.9995
MAX_HASHES = 160
#: N-grams and texts of a block of a component, on average; pairs of TILE by TILE texts are compared at a time.
BLOCK_NGRAMS, BLOCK_REPS, TILE = 1_000_000, 500, 1000
SLICE_BYTES = 1 << 20


def bands_for(threshold: float, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows) with the most rows a band that reach the recall at the threshold within max_hashes."""
    best = None
    for rows in range(1, 33):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - p))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("max_hashes is too small for this recall")
    return best


def ngram_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For slices of rows: (first row, n-gram hashes, index of each row's first); an n-gram may occur again."""
    buf, offsets = text_buffer(column)
    for lo, hi in row_slices(offsets, SLICE_BYTES):
        part, offs = buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, first = word_spans(part, offs)
        yield lo, *shingle_hashes(word_hashes(part, starts, ends), first, size)


def set_key(ngrams: np.ndarray) -> bytes:
    return hashlib.blake2b(ngrams.tobytes(), digest_size=16).digest()


@lean
def _signatures(batches: Iterable[pa.RecordBatch], size: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    flips, factors = seeded(bands * rows, 11), seeded(bands * rows, 12) | np.uint64(1)
    band_code = seeded(bands, 13)
    for batch in batches:
        ids = batch.column(0)
        for lo, grams, begins in ngram_sets(batch.column(1), size):
            n = len(begins) - 1
            some = np.flatnonzero(np.diff(begins))
            code = np.zeros((n, bands), np.uint64)
            if len(some):
                at = begins[some]
                with np.errstate(over="ignore"):
                    for b in range(bands):
                        held = np.full(len(some), band_code[b])
                        for r in range(b * rows, (b + 1) * rows):
                            held = mix64(held * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat((grams ^ flips[r]) * factors[r], at))
                        code[some, b] = held
            keys, counts = [], []
            for k in range(n):
                grams_k = np.unique(grams[begins[k] : begins[k + 1]])
                keys.append(set_key(grams_k))
                counts.append(len(grams_k))
            width = np.where(np.diff(begins) > 0, bands, 0)
            flat = code[np.diff(begins) > 0].ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, n).cast(pa.int64()), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(width)]), pa.int32()), pa.array(flat))],
                names=["doc", "key", "n", "bands"],
            )


def linked(sets: list[np.ndarray], pairs: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs (rows i, j of numbers of sets) reach the threshold, exactly."""
    n = np.array([len(s) for s in sets], np.float64)
    i, j = pairs[:, 0], pairs[:, 1]
    out = np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9
    pairs = pairs[out]
    if not len(pairs):
        return out
    used = np.unique(pairs)
    value, inverse, times = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(used)), n[used].astype(int))
    twice = times >= 2
    column = np.cumsum(twice) - 1
    shared = twice[inverse]
    owner, column, width = owner[shared], column[inverse[shared]], int(twice.sum())
    where = np.searchsorted(used, pairs)
    left, right = np.unique(where[:, 0]), np.unique(where[:, 1])
    if len(left) * len(right) * width / 8e9 < len(pairs) * (15e-6 + 30e-9 * n[used].mean()):
        inter = np.zeros((len(left), len(right)), np.float32)
        row, col = np.full(len(used), -1), np.full(len(used), -1)
        row[left], col[right] = np.arange(len(left)), np.arange(len(right))
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        step = max(1, 4_000_000 // (len(left) + len(right)))
        for lo in range(0, width, step):
            a, b = np.searchsorted(column, [lo, lo + step])
            who, at = owner[a:b], column[a:b] - lo
            parts = []
            for place, size in ((row, len(left)), (col, len(right))):
                m, has = np.zeros((size, min(step, width - lo)), np.float32), place[who] >= 0
                m[place[who[has]], at[has]] = 1
                parts.append(m)
            inter += parts[0] @ parts[1].T
        both = inter[row[where[:, 0]], col[where[:, 1]]].astype(np.float64)
    else:
        both = np.empty(len(pairs))
        for k, (x, y) in enumerate(pairs.tolist()):
            x, y = (sets[x], sets[y]) if len(sets[x]) < len(sets[y]) else (sets[y], sets[x])
            at = np.searchsorted(y, x)
            both[k] = np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x)
    out[out] = both * (1 + threshold) >= threshold * (n[pairs[:, 0]] + n[pairs[:, 1]]) - 1e-6
    return out


def _unit(group: list[tuple], size: int, threshold: float) -> list[tuple[int, int | None, int]]:
    """Links within a block, or between two: (representative, the least it hangs together with or null, documents linked)."""
    bi, bj = group[0][1], group[0][2]
    rep, block, weight, bands, sets, seen = [], [], [], [], [], set()
    texts = pa.array([g[8] for g in group], pa.large_string())
    for lo, grams, begins in ngram_sets(texts, size):
        for k in range(len(begins) - 1):
            g, s = group[lo + k], np.unique(grams[begins[k] : begins[k + 1]])
            if g[5] not in seen and set_key(s) == g[5]:  # an id may come with several texts
                seen.add(g[5])
                rep.append(g[3])
                block.append(g[4])
                weight.append(g[6])
                bands.append(g[7])
                sets.append(s)
    if len(rep) < 2:
        return []
    code, block = np.array(bands, np.int64), np.array(block)
    rep, weight = np.array(rep, np.int64), np.array(weight, np.int64)
    here = np.arange(len(rep)) if bi == bj else np.flatnonzero(block == bi)
    there = np.arange(len(rep)) if bi == bj else np.flatnonzero(block == bj)
    links = [np.zeros((0, 2), np.int64)]
    for lo in range(0, len(here), TILE):  # some rows at a time: memory is a tile, however many are alike
        mine = here[lo : lo + TILE]
        for ro in range(0, len(there), TILE):
            theirs = there[ro : ro + TILE]
            may = np.zeros((len(mine), len(theirs)), dtype=bool)
            for b in range(code.shape[1]):
                may |= code[mine, b, None] == code[None, theirs, b]
            if bi == bj:
                may &= mine[:, None] < theirs[None, :]
            x, y = np.nonzero(may)
            if len(x):
                pairs = np.column_stack([mine[x], theirs[y]])
                links.append(pairs[linked(sets, pairs, threshold)].astype(np.int32))
    links = np.concatenate(links)
    told = np.zeros(len(rep), np.int64)
    np.add.at(told, links[:, 0], weight[links[:, 1]])
    np.add.at(told, links[:, 1], weight[links[:, 0]])
    label = rep.copy()
    while len(links):  # least representative of what hangs together here
        new = label.copy()
        np.minimum.at(new, links[:, 0], label[links[:, 1]])
        np.minimum.at(new, links[:, 1], label[links[:, 0]])
        if (new == label).all():
            break
        label = new
    return [(int(r), int(x) if x != r else None, int(t)) for r, x, t in zip(rep, label, told) if t]


@lean
def _units(batches: Iterable[pa.RecordBatch], size: int, threshold: float) -> Iterator[pa.RecordBatch]:
    names = ["a", "b", "links"]
    held: list[tuple] = []

    def out() -> Iterator[pa.RecordBatch]:
        rows = _unit(held, size, threshold) if len(held) > 1 else []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            for row in zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns)):
                if held and row[:3] != held[0][:3]:
                    yield from out()
                    held = []
                held.append(row)
    yield from out()


def near_classes(docs: DataFrame, threshold: float = NEAR_SIMILARITY, size: int = SHINGLE_WORDS, recall: float = RECALL, max_hashes: int = MAX_HASHES, id_col: str = "doc_id", text_col: str = "text", block_ngrams: int = BLOCK_NGRAMS, block_reps: int = BLOCK_REPS) -> DataFrame:
    """One row per document: id, class_id (the least id that it hangs together with by links), n_links (other documents
    of at least the threshold's similarity)."""
    bands, rows = bands_for(threshold, recall, max_hashes)
    n = partitions(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    signed = written(docs.filter("doc is not null").mapInArrow(lambda it: _signatures(it, size, bands, rows), "doc long, key binary, n long, bands array<long>"), "signatures")
    grouped = written(signed.groupBy("key").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands")), "texts")
    # an id may stand for several texts, so a class is known by its key; ids serve as nodes only where they are unique
    reps = grouped.withColumn("node", F.xxhash64("key"))
    spread = reps.select("node", F.explode("bands").alias("band"))
    buckets = spread.groupBy("band").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    shared = written(spread.join(buckets, "band").select("node", "band", "least", "c"), "shared")
    met = components(shared.select(F.col("node").alias("a"), F.col("least").alias("b")), hashed=True)
    parts = met.join(reps, "node").select("label", "node", "rep", "key", "copies", "bands", "n")
    size_of = F.greatest(F.sum("n") / F.lit(float(block_ngrams)), F.count(F.lit(1)) / F.lit(float(block_reps)))
    cut = parts.groupBy("label").agg(F.ceil(size_of).cast("int").alias("blocks"))
    # a block is made of whole buckets where they fit, so that few blocks share a band; a large bucket goes over several
    home = shared.groupBy("node").agg(F.max(F.struct("c", "band")).alias("home"))
    turn = F.pmod(F.xxhash64("node", F.lit(7)), F.ceil(F.col("home.c") / F.lit(block_reps)))
    dealt = parts.join(cut, "label").join(home, "node").withColumn("own", F.pmod(F.xxhash64("home.band") % F.lit(1 << 30) + turn, F.col("blocks")).cast("int")).drop("home")
    dealt = written(dealt, "blocks")
    # a text goes to the pairs of blocks that its own bands are in
    seen = dealt.filter("blocks > 1").select("node", "own").join(shared, "node").select("node", "own", "band")
    blocks_in = seen.groupBy("band").agg(F.collect_set("own").alias("in"))
    others = seen.join(blocks_in, "band").groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("in"))).alias("others"))
    dealt_out = dealt.join(others, "node", "left").withColumn("other", F.explode(F.coalesce("others", F.array("own"))))
    dealt_out = dealt_out.select("label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "own", "key", "copies", "bands", F.col("rep").alias("doc"))
    work = dealt_out.join(docs.filter("doc is not null"), "doc").drop("doc")
    found = written(work.repartition(n, "label", "i", "j").sortWithinPartitions("label", "i", "j", "node").select("label", "i", "j", "node", "own", "key", "copies", "bands", "text").mapInArrow(lambda it: _units(it, size, threshold), "a long, b long, links long"), "links")
    together = components(found.filter("b is not null").select("a", "b"), hashed=True)
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    named = reps.select("key", "node", "rep", "copies").join(together, "node", "left").join(counts, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("rep").alias("class_id"))
    classes = written(named.join(least, "label").select("key", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes")
    for table in (grouped, shared, met, dealt, found, together):
        drop_written(table)
    out = signed.select("doc", "key").join(classes, "key").select(F.col("doc").cast(kind).alias(id_col), F.col("class_id").cast(kind).alias("class_id"), "n_links")
    nameless = docs.filter("doc is null").select(F.lit(None).cast(kind).alias(id_col), F.lit(None).cast(kind).alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(nameless)


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of docs, all columns, but of each class only its least document.

    Where ids are null or repeat, rows are numbered first, and one row of each class stays.
    """
    columns = docs.columns
    ids = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("c")).filter(F.col(id_col).isNull() | (F.col("c") > 1))
    key = id_col
    if not ids.isEmpty():
        key = "_row"
        while key in columns:
            key += "_"
        docs = written(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    gone = near_classes(docs, id_col=key, **how).filter(f"{key} <> class_id").select(key)
    return docs.join(gone, key, "left_anti").select(*columns)
