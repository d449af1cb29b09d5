"""Ranked lexical search against a plain model."""

import math
import random
import re

import numpy as np
import pytest

from tidemark.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return TERM.findall((text or "").translate(LOWER))


def best(docs, items, k=10):
    held = [(i, split(t)) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    n, total, df = len(held), sum(len(t) for _, t in held), {}
    for _, t in held:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    asked, out = {}, []
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(split(t))
    for i, want in asked.items():
        scores = []
        for d, t in held:
            m = 10 + 90 * len(t) * n // total
            s = 0
            for x in want & set(t):
                tf = t.count(x)
                s += math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (1000000000 * tf // (1000 * tf + 8 * m))
            if s > 0 and d is not None:
                scores.append((-s, d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def tables(seed=3, n=400):
    rng = random.Random(seed)
    words = ["the", "The", "ÉTÉ", "été", "日本", "a1", "İ", "x_y", "co-op"] + [f"w{i}" for i in range(120)]
    docs = [(None, "the w1 w2"), (7, "w1 w1 w2 the"), (7, "w3 the"), (9001, None), (9002, ""), (9003, " .-\x00! "), (9004, "W1\x00w1\x7fw2")]
    docs += [(i, rng.choice([" ", ", ", "\n"]).join(rng.choice(words[: rng.choice([5, 130])]) for _ in range(rng.randrange(1, 60)))) for i in range(10, n)]
    docs += [(i + 10000, t) for i, t in docs[20:60]]
    docs.append((8000, " ".join(rng.choice(words) for _ in range(20000))))
    items = [(0, "the w1 W1 ÉTÉ"), (1, None), (2, "nowhere"), (None, "the"), (3, "w5 w6"), (3, "w7"), (4, " ".join(words)), (5, docs[40][1])]
    return docs, items


@pytest.mark.parametrize("small", [True, False])
def test_search(spark, monkeypatch, small):
    docs, items = tables()
    if not small:
        monkeypatch.setattr(lexical, "BLOCK_BYTES", 10)
        monkeypatch.setattr(lexical, "SHARDS_HELD", 1)
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int").repartition(5)
    q = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string").repartition(2)
    got = sorted(tuple(r) for r in lexical.search(lexical.index(d), q).collect())
    assert got == best(docs, items) and len(got) == 40


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(lexical.index(docs.filter("false")), items).count() == 0
    assert lexical.search(lexical.index(docs), items.filter("false")).count() == 0
    assert [tuple(r) for r in lexical.search(lexical.index(docs), items).collect()] == best([(1, "a b")], [(1, "a")])


def test_bounds_hold():
    rng = np.random.default_rng(0)
    tf, n = rng.integers(1, 500, 20000), rng.integers(500, 100000, 20000)
    q = lexical.impact(tf, lexical.damping(n, 1000, 3_000_000))
    byte = (q + lexical.STEP - 1) // lexical.STEP
    assert byte.max() <= 255 and (byte * lexical.STEP >= q).all() and ((byte - 1) * lexical.STEP <= q).all()


def test_lengths_beyond_64_bits():
    got = lexical.damping(np.array([10**7, 3]), 3 * 10**10, 10**13)
    assert got.tolist() == [10 + 90 * x * 3 * 10**10 // 10**13 for x in (10**7, 3)]
