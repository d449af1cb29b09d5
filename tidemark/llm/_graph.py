"""Connected components of an edge table, by contraction to least neighbours.

Every round each node moves to the least of itself and its neighbours by a hash, edges move with their ends, and loops and
repetitions go.  A star is gone in one round and a component in about the logarithm of its size, whatever the order of its
ids, for the hash puts them in a random one.  Rounds are written tables, so nothing is collected but a count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import drop_written, written


def _moves(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("node"), "b").unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("b")))
    return both.groupBy("node").agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label"))


def _hashed(edges: DataFrame) -> DataFrame:
    """(node, label) for edges (a, b) of nodes in a random order."""
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    labels = written(_moves(edges), "labels")
    moves = labels
    while True:
        ends = edges.join(moves.select(F.col("node").alias("a"), F.col("label").alias("x")), "a").join(moves.select(F.col("node").alias("b"), F.col("label").alias("y")), "b")
        rest = written(ends.filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
        drop_written(edges)
        if moves is not labels:
            drop_written(moves)
        if rest.isEmpty():
            drop_written(rest)
            return labels
        edges = rest
        moves = written(_moves(edges), "labels")
        new = written(labels.join(moves.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        drop_written(labels)
        labels = new


def components(edges: DataFrame, hashed: bool = False) -> DataFrame:
    """(node, label) for every node of edges (a, b); the label is the least node of its component.

    Loops and repeated edges are allowed; rows with a null end are ignored; no edges give no rows.  hashed: the nodes are
    hashes themselves, in no order that their edges follow.
    """
    if hashed:
        return _hashed(edges)
    mixed = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n")).alias(c)
    found = _hashed(edges.filter("a is not null and b is not null").select(mixed("a"), mixed("b")))
    least = found.groupBy("label").agg(F.min("node.n").alias("least"))
    out = written(found.join(least, "label").select(F.col("node.n").alias("node"), F.col("least").alias("label")), "labels")
    drop_written(found)
    return out
