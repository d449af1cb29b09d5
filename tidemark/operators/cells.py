"""Pairs of near rows without rows of pairs: rows are dealt into groups of bounded size, and each two groups meet in a cell.

A row goes once to every cell of its group, so what is shuffled are rows, and a pair is formed in the memory of the task that
has its cell.  A cell holds two groups, so no block of rows has to fit a task, however many rows are near each other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CELL = ("block", "one_place", "one_group", "two_place", "two_group")


def near_units(units: DataFrame, reach: int = 0) -> DataFrame:
    """(block, place, groups) with `near`: the places at most `reach` apart that the block has, and their groups."""
    offered = units.select("block", F.col("place").alias("to"), F.col("groups").alias("theirs"), F.explode(F.sequence(F.col("place") - reach, F.col("place") + reach)).alias("place"))
    near = offered.groupBy("block", "place").agg(F.collect_list(F.struct("to", "theirs")).alias("near"))  # 2 * reach + 1 at most
    return units.join(near, ["block", "place"])


def group_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.col("groups")).cast("int")


def dealt(rows: DataFrame, size: int, key: str, reach: int = 0) -> DataFrame:
    """Rows (block long or string, place int, ...) by cells, in which those of one block and of places at most `reach` apart
    meet: with _CELL and `side`, 0 for the cell's first group and 1 for its second."""
    units = rows.groupBy("block", "place").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("groups"))
    own = rows.join(near_units(units, reach), ["block", "place"]).withColumn("group", group_of(key))
    return meeting(own, [c for c in rows.columns if c not in ("block", "place")])


def meeting(own: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that are of a group, with what near_units() says of theirs, by cells."""
    met = own.withColumn("near", F.explode("near")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("near.theirs") - 1)))
    a, b = F.struct(F.col("place").alias("place"), F.col("group").alias("group")), F.struct(F.col("near.to").alias("place"), F.col("other").alias("group"))
    one, two = F.least(a, b), F.greatest(a, b)
    cell = dict(zip(_CELL, (F.col("block"), one["place"], one["group"], two["place"], two["group"])))
    out = met.select(*(c.alias(k) for k, c in cell.items()), (a > b).cast("int").alias("side"), *columns)
    n = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return out.repartition(n, *_CELL).sortWithinPartitions(*_CELL)


def by_cell(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.Table | None]]:
    """The two groups of each cell of a partition of dealt(); one group alone where it meets itself."""
    for cell in runs(batches, _CELL):
        if all(cell[f"one_{x}"][0] == cell[f"two_{x}"][0] for x in ("place", "group")):
            yield cell, None
        else:
            first, second = (cell.filter(pc.equal(cell["side"], k)) for k in (0, 1))
            if first.num_rows and second.num_rows:
                yield first, second


def runs(batches: Iterable[pa.RecordBatch], columns: Iterable[str]) -> Iterator[pa.Table]:
    """The rows that follow each other and are equal in the columns."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        leaves = np.zeros(b.num_rows, dtype=bool)
        for c in columns:
            x = b.column(c)
            leaves[1:] |= pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
            leaves[0] |= bool(held) and held[-1].column(c)[-1] != x[0]
        cuts = [0, *np.flatnonzero(leaves).tolist(), b.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if lo < b.num_rows and leaves[lo] and held:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            if hi > lo:
                held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
