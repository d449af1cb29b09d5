"""Many phrases in one pass over a text.

A set of phrases is one automaton, built once in each worker, that reads a text once whatever the number of phrases; texts
come as Arrow batches.  What it gives is a short array of the phrases' numbers, and all that follows (weights, labels, lists)
is native columns on that array.  A phrase is present if it is a substring; the empty phrase is in every text; a null text
has null hits, which count as none.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Mapping

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


@functools.lru_cache(maxsize=64)
def automaton(phrases: tuple[str, ...]):
    """Each phrase's number as the automaton's value; None if there is no phrase to look for."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, p in enumerate(phrases):
        if p:
            a.add_word(p, i)
    if not len(a):
        return None
    a.make_automaton()
    return a


def found_numbers(phrases: tuple[str, ...], text: str) -> set[int]:
    a = automaton(phrases)
    return {i for _, i in a.iter(text)} if a is not None else set()


class Phrases:
    """Distinct phrases of some lexicons, numbered in the order in which they first occur."""

    def __init__(self, *lexicons: Iterable[str]) -> None:
        self.all = tuple(dict.fromkeys(p for lexicon in lexicons for p in lexicon))
        self.number = {p: i for i, p in enumerate(self.all)}

    def hits(self, text: Column) -> Column:
        """Numbers of the phrases that are in the text, ascending."""
        phrases = self.all
        always = {i for i, p in enumerate(phrases) if not p}

        @F.arrow_udf("array<int>")
        def find(texts: pa.Array) -> pa.Array:
            return pa.array([None if t is None else sorted(found_numbers(phrases, t) | always) for t in texts.to_pylist()], pa.list_(pa.int32()))

        return find(text)

    def weight(self, hits: Column, lexicon: Mapping[str, int]) -> Column:
        """Sum of the weights of the phrases present; a phrase counts once."""
        weights = F.array(*(F.lit(lexicon.get(p, 0)) for p in self.all))
        return F.coalesce(F.aggregate(hits, F.lit(0), lambda a, i: a + F.element_at(weights, i + 1)), F.lit(0))

    def any(self, hits: Column, terms: Iterable[str]) -> Column:
        return F.coalesce(F.arrays_overlap(hits, F.array(*(F.lit(self.number[t]) for t in dict.fromkeys(terms)))), F.lit(False))

    def labels(self, hits: Column, groups: Mapping[str, Iterable[str]]) -> Column:
        """Names of groups of which any phrase is present, in the groups' order."""
        return F.array_compact(F.array(*(F.when(self.any(hits, terms), F.lit(name)) for name, terms in groups.items() if terms)))

    def found(self, hits: Column, entries: Iterable[tuple[str, Column]]) -> Column:
        """Of (phrase, what it stands for), what stands for the phrases present, in the order given."""
        table = F.array(*(F.struct(F.lit(self.number[p]).alias("n"), x.alias("x")) for p, x in entries))
        return F.transform(F.filter(table, lambda e: F.array_contains(F.coalesce(hits, F.array().cast("array<int>")), e["n"])), lambda e: e["x"])


def found_terms(text: Column, terms: Iterable[str]) -> Column:
    """The distinct terms that a text holds, as strings."""
    known = tuple(dict.fromkeys(t for t in terms if t))

    @F.arrow_udf("array<string>")
    def find(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else [known[i] for i in sorted(found_numbers(known, t))] for t in texts.to_pylist()], pa.list_(pa.string()))

    return find(text)
