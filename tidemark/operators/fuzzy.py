"""Greedy choices among titles: the order of the rows decides which stay, and yet no group of rows has to fit a task.

`fuzzy_articles` keeps a row unless an earlier kept row has its URL, or its title or one like it on the same member and
date.  Rows with an equal URL or title meet by key, never in pairs.  Titles of a member and date meet in cells of bounded
size, where prints of their trigrams say which can be alike; only those are compared, and only pairs that are alike are written.
The choice then goes in rounds over keys and pairs: of the undecided rows those are kept that no earlier undecided row
rules out, and what they rule out is dropped.  What is left when few rows are undecided goes through one ordinary pass.

`ranked_containment` keeps a member's best rows unless an earlier kept title equals, holds or is held by theirs.  Equal titles
are reduced to the first, and in each round a bounded window of each member's next titles is looked at; of the rest, all
that the kept titles rule out are filtered where they lie.  Each round keeps at least one row a member, so there are no
more rounds than rows that a member may keep.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import plain_title
from ..sources.tables import written
from .cells import by_cell, dealt

GRAM = 3
#: Bits of a title's print, titles of a group, and how many are held against a group at once.
PRINT_BITS, CELL, STRIP = 512, 4096, 64
#: Undecided rows and pairs that one task may finish.
LEFT = 100_000
#: Titles of a member that a round looks at.
LOOK = 64


# ---- titles that are alike -------------------------------------------------------------------------------------------
def unmatched(n: int, threshold: float) -> int:
    """The most characters of two titles, one of them n long, that a ratio of the threshold leaves without a counterpart."""
    other = int(n * (2 - threshold) / threshold + 1e-9)
    return int((1 - threshold) * (n + other) + 1e-9)


def rare_grams(title: str, often: dict[str, int], threshold: float) -> list[str]:
    """The title's rarest trigrams, each with its number among equal ones: any title that is like enough has one of them among
    its own.  A character without counterpart breaks at most GRAM trigrams, so all but so many are shared."""
    n = unmatched(len(title), threshold)
    if not n:
        return []  # only an equal title is like enough
    seen: Counter[str] = Counter()
    grams = []
    for i in range(len(title) - GRAM + 1):
        g = title[i : i + GRAM]
        seen[g] += 1
        grams.append((often.get(g, 0), g, seen[g]))
    return [f"{g}{k}" for _, g, k in sorted(grams)[: GRAM * n + 1]]


def alike(a: str, b: str, threshold: float) -> bool:
    """Whether the ratio reaches the threshold, by its upper bounds first."""
    if not a or not b or 2 * min(len(a), len(b)) < threshold * (len(a) + len(b)):
        return False
    m = SequenceMatcher(None, a, b)
    return m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold and m.ratio() >= threshold


def prints_of(titles: list[str]) -> np.ndarray:
    """A print of PRINT_BITS bits of each title: of every trigram that it has the bit is set."""
    size = np.array([len(t) for t in titles], np.int64)
    text = np.frombuffer("".join(titles).encode("utf-32-le"), np.uint32).astype(np.uint64)
    out = np.zeros((len(titles), PRINT_BITS), np.uint8)
    whose = np.repeat(np.arange(len(titles)), size)[: max(len(text) - GRAM + 1, 0)]
    inside = whose == np.repeat(np.arange(len(titles)), size)[GRAM - 1 :]
    gram = np.zeros(len(whose), np.uint64)
    for k in range(GRAM):
        gram = gram << np.uint64(21) | text[k : k + len(whose)]
    bit = (gram * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - PRINT_BITS.bit_length())).astype(np.int64)
    out[whose[inside], bit[inside]] = 1
    return np.packbits(out, axis=1).view(np.uint64)


def likely_pairs(a: list[str], b: list[str] | None, threshold: float) -> Iterator[tuple[int, int]]:
    """Places in two lists of titles, or of two in one, of all pairs that can make a ratio of the threshold, and of few others.

    Of the trigrams of one title those are not the other's that an unmatched character of its own, three at most each, or one
    of the other's, two at most, breaks; so prints differ in five bits at most for each unmatched character of the two.
    """
    lists = (a, a if b is None else b)
    sizes, marks = [np.array([len(t) for t in x], np.int64) for x in lists], [prints_of(x) for x in lists]
    order = np.argsort(sizes[1], kind="stable")
    length, print_ = sizes[1][order], np.ascontiguousarray(marks[1][order].T)
    at = np.argsort(sizes[0], kind="stable")
    for lo in range(0, len(at), STRIP):
        strip = at[lo : lo + STRIP]
        own = sizes[0][strip]
        first, last = np.searchsorted(length, [int(own[0] * threshold / (2 - threshold)), int(own[-1] * (2 - threshold) / threshold) + 2])
        theirs = length[first:last]
        apart = np.zeros((len(strip), last - first), np.uint16)
        for k in range(print_.shape[0]):
            apart += np.bitwise_count(marks[0][strip, k, None] ^ print_[None, k, first:last])
        both = own[:, None] + theirs
        close = apart <= 5 * ((1 - threshold) * both + 1e-9).astype(np.int64)
        i, j = np.nonzero(close & (2 * np.minimum(own[:, None], theirs) >= threshold * both))
        i, j = strip[i], order[first + j]
        if b is None:
            i, j = i[i < j], j[i < j]
        yield from zip(i.tolist(), j.tolist())


def like_titles(titles: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the titles (t, block, title) of one block where title a before title b makes a ratio of the threshold; a
    ratio can depend on the order, so both are tried.  Titles meet in cells, and only pairs that are alike leave a task."""

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, second in by_cell(batches):
            t, x = first["t"].to_pylist(), first["title"].to_pylist()
            u, y = (t, x) if second is None else (second["t"].to_pylist(), second["title"].to_pylist())
            out = []
            for i, j in likely_pairs(x, None if second is None else y, threshold):
                out += [p for p, one, two in (((t[i], u[j]), x[i], y[j]), ((u[j], t[i]), y[j], x[i])) if alike(one, two, threshold)]
                if len(out) > LEFT:
                    yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return dealt(titles.select("t", "block", "title", F.lit(0).alias("place")), CELL, "t").mapInArrow(compare, "a long, b long")


def first_choices(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(seq) of rows (seq, u, t) that stay: in the order of seq, a row goes if an earlier one that stays has its u or its t, or
    a t that rules its own out by a pair (a, b).  Null keys tie nothing."""
    undecided, kept = rows, []
    while True:
        undecided = written(undecided, "undecided")
        many = undecided.count()
        if many <= LEFT:
            ties = pairs.join(undecided.select(F.col("t").alias("a")).distinct(), "a", "left_semi").join(undecided.select(F.col("t").alias("b")).distinct(), "b", "left_semi").select("a", "b")
            ties = written(ties, "ties")
            if ties.count() <= LEFT:
                kept.append(_one_pass(undecided, ties))
                break
        least = {k: undecided.filter(F.col(k).isNotNull()).groupBy(k).agg(F.min("seq").alias(f"least_{k}")) for k in ("u", "t")}
        ruled = pairs.join(least["t"].withColumnRenamed("t", "a"), "a").groupBy(F.col("b").alias("t")).agg(F.min("least_t").alias("before"))
        seen = undecided.join(least["u"], "u", "left").join(least["t"], "t", "left").join(ruled, "t", "left")
        free = F.coalesce(F.col("least_u") == F.col("seq"), F.lit(True)) & F.coalesce(F.col("least_t") == F.col("seq"), F.lit(True)) & F.coalesce(F.col("before") > F.col("seq"), F.lit(True))
        stays = written(seen.filter(free).select("seq", "u", "t"), "stays")
        kept.append(stays.select("seq"))
        out = pairs.join(stays.select(F.col("t").alias("a"), F.col("seq").alias("by")), "a").groupBy(F.col("b").alias("t")).agg(F.min("by").alias("by"))
        rest = undecided.join(stays, "seq", "left_anti")
        for k in ("u", "t"):
            rest = rest.join(stays.select(k).filter(F.col(k).isNotNull()).distinct(), k, "left_anti")
        undecided = rest.join(out, "t", "left").filter(F.col("by").isNull() | (F.col("by") > F.col("seq"))).select("seq", "u", "t")
    found = kept[0]
    for more in kept[1:]:
        found = found.unionByName(more)
    return found


def _one_pass(undecided: DataFrame, ties: DataFrame) -> DataFrame:
    """The same choice for few rows, in one task; their number was counted."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules_out: dict[int, list[int]] = {}
        urls, gone, out = set(), set(), []
        for b in batches:
            for kind, seq, u, t in zip(*(c.to_pylist() for c in b.columns)):
                if kind == 0:
                    rules_out.setdefault(u, []).append(t)
                elif not (u is not None and u in urls) and not (t is not None and t in gone):
                    out.append(seq)
                    if u is not None:
                        urls.add(u)
                    if t is not None:
                        gone.add(t)
                        gone.update(rules_out.get(t, ()))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["seq"])

    both = ties.select(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("seq"), F.col("a").alias("u"), F.col("b").alias("t")).unionByName(undecided.select(F.lit(1).alias("kind"), "seq", "u", "t"))
    return both.repartition(1).sortWithinPartitions("kind", "seq").mapInArrow(run, "seq long")


def fuzzy_articles(df: DataFrame, threshold: float = 0.92, member: str = "member_name_en", date: str = "published_at") -> DataFrame:
    """Rows in order, less those whose URL was kept before or whose title is like one kept of the same member and date.

    A URL counts once its row is kept.  Rows without a URL, and empty titles, rule nothing out.  seq is a row's name and place.
    """
    title, url = plain_title(F.col("title")), F.nullif(F.col("url"), F.lit(""))
    block = F.concat_ws("|", *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in (member, date)))
    rows = written(df.select("seq", url.alias("url"), block.alias("block"), F.nullif(title, F.lit("")).alias("title")), "titles")
    # urls, blocks and titles are named by the first row that has them
    blocks = rows.groupBy("block").agg(F.min("seq").alias("b"))
    titles = rows.filter("title is not null").groupBy("block", "title").agg(F.min("seq").alias("t"))
    urls = rows.filter("url is not null").groupBy("url").agg(F.min("seq").alias("u"))
    pairs = written(like_titles(titles.join(blocks, "block").select("t", F.col("b").alias("block"), "title"), threshold), "like")
    keyed = rows.join(urls, "url", "left").join(titles, ["block", "title"], "left").select("seq", "u", "t")
    return df.join(first_choices(keyed, pairs), "seq", "left_semi").select(*df.columns)


# ---- ranked titles ---------------------------------------------------------------------------------------------------
def _ruled_out(title: Column, other: Column, least: int) -> Column:
    held = F.when(F.length(title) <= F.length(other), F.contains(other, title)).otherwise(F.contains(title, other))
    return (title == other) | ((F.least(F.length(title), F.length(other)) >= least) & held)


def ranked_containment(df: DataFrame, most: int = 10, least: int = 35) -> DataFrame:
    """Per member, preferred and newest first: rows whose normalised title repeats, holds or is held by an earlier one go.

    Rows without a member are one member's; seq is a row's name within its member.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("member").cast("string")), F.lit(""))
    rows = df.select("seq", key.alias("m"), plain_title(F.col("title")).alias("title"), F.struct(F.coalesce(F.col("preferred"), F.lit(False)).alias("p"), F.col("published_at").alias("day"), (-F.col("seq")).alias("back")).alias("o"))
    rows = rows.groupBy("m", "title").agg(F.max("o").alias("o"))  # the greatest comes first
    rows = written(rows, "ranked")
    kept = None
    look = W.partitionBy("m").orderBy(F.desc("o"))

    def choose(batch: pa.Table) -> pa.Table:
        got = batch.sort_by("rn").to_pydict()
        before = got["kept"][0] or []
        seen, out = list(before), []
        for k, title in enumerate(got["title"]):
            if len(seen) >= most:
                break
            if not any(title == s or (min(len(title), len(s)) >= least and (title in s or s in title)) for s in seen):
                seen.append(title)
                out.append(k)
        full = len(seen) >= most or len(got["rn"]) < LOOK
        held = {"m": got["m"][:1], "seqs": [[-got["o"][k]["back"] for k in out]], "kept": [seen], "full": [full]}
        return pa.table([pa.array(held["m"], pa.string()), pa.array(held["seqs"], pa.list_(pa.int64())), pa.array(held["kept"], pa.list_(pa.string())), pa.array(held["full"], pa.bool_())], names=["m", "seqs", "kept", "full"])

    state = rows.select("m").distinct().withColumn("kept", F.array().cast("array<string>"))
    while True:
        window = rows.withColumn("rn", F.row_number().over(look)).filter(F.col("rn") <= LOOK).join(state, "m")
        found = written(window.groupBy("m").applyInArrow(choose, "m string, seqs array<long>, kept array<string>, full boolean"), "chosen")
        seqs = found.select(F.col("m").alias("_m"), F.explode("seqs").alias("seq"))
        kept = seqs if kept is None else kept.unionByName(seqs)
        state = found.filter(~F.col("full")).select("m", "kept")
        if state.isEmpty():
            return df.withColumn("_m", key).join(kept, ["_m", "seq"], "left_semi").select(*df.columns)
        rest = rows.join(state, "m").filter(~F.exists("kept", lambda k: _ruled_out(F.col("title"), k, least))).select(*rows.columns)
        rows = written(rest, "ranked")
