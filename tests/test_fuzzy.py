"""Greedy choices by rounds, windows and indexes against plain passes."""

import random
from difflib import SequenceMatcher

import pytest

from tidemark.operators import fuzzy


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 7))) for _ in range(n))


def near(rng, t, edits):
    t = list(t)
    for _ in range(edits):
        i = rng.randrange(len(t) + 1)
        what = rng.randrange(3)
        if what == 0:
            t.insert(i, rng.choice("abc "))
        elif t and what == 1:
            t.pop(min(i, len(t) - 1))
        elif t:
            t[min(i, len(t) - 1)] = rng.choice("xyz")
    return " ".join("".join(t).split())


def test_rare_grams_find_all_like_titles():
    rng = random.Random(1)
    hits = 0
    for _ in range(4000):
        a = words(rng, rng.randrange(1, 14))
        b = near(rng, a, rng.randrange(0, 5)) or "x"
        often = {a[i : i + 3]: rng.randrange(5) for i in range(len(a))}
        if a != b and fuzzy.alike(a, b, 0.92):
            hits += 1
            assert set(fuzzy.rare_grams(a, often, 0.92)) & set(fuzzy.rare_grams(b, often, 0.92)), (a, b)
    assert hits > 300


def test_likely_pairs_hold_all_like_titles():
    rng = random.Random(2)
    for _ in range(25):
        a = [words(rng, rng.randrange(1, 14)) for _ in range(150)]
        b = [near(rng, t, rng.randrange(0, 8)) for t in a]
        want = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if i == j and (fuzzy.alike(x, y, 0.92) or fuzzy.alike(y, x, 0.92))}
        got = list(fuzzy.likely_pairs(a, b, 0.92))
        assert want <= set(got) and len(set(got)) == len(got) < 150 * 150 / 4 and len(want) > 50
        both = a + b
        assert {(i, j + 150) for i, j in want if a[i] != b[j]} <= set(fuzzy.likely_pairs(both, None, 0.92))


@pytest.mark.parametrize("size", [4096, 7])
def test_only_like_pairs_leave_a_task(spark, monkeypatch, size):
    """Titles that share their rarest trigrams are compared where they meet: what is shuffled does not grow with their pairs."""
    monkeypatch.setattr(fuzzy, "CELL", size)
    rng = random.Random(3)
    titles = sorted({near(rng, words(random.Random(k % 9), 9), rng.randrange(9)) for k in range(60)})
    rows = [(k, k % 2, t) for k, t in enumerate(titles)]
    got = fuzzy.like_titles(spark.createDataFrame(rows, "t long, block long, title string").repartition(3), 0.92)
    want = {(a, b) for a, m, x in rows for b, n, y in rows if a != b and m == n and fuzzy.alike(x, y, 0.92)}
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
    assert "gram" not in got._jdf.queryExecution().analyzed().toString()


def chain(seed, n):
    """Rows of which many rule each other out, also in long chains of URLs and titles by turns."""
    rng = random.Random(seed)
    base = [words(rng, 8) for _ in range(6)]
    rows = []
    for k in range(n):
        t = near(rng, rng.choice(base), rng.randrange(4)) if rng.random() < 0.7 else words(rng, rng.randrange(9))
        rows.append((k, rng.choice(["hot", "hot", "m", None]), rng.choice(["2024-01-01", "2024-01-02", None]), t if rng.random() < 0.95 else None, rng.choice([None, "", "same", *(f"u{i}" for i in range(n // 3))])))
    for k in range(n, n + 30, 2):  # each row's URL is the next one's, whose title is the next one's
        title = words(rng, 7)
        rows += [(k, "c", "d", title, f"c{k // 2}"), (k + 1, "c", "d", title, f"c{k // 2 + 1}")]
    return rows


def plain_fuzzy(rows):
    urls, titles, out = set(), {}, []
    for seq, m, d, t, u in rows:
        own = titles.setdefault((m, d), [])
        if (u and u in urls) or any(t and o and (t == o or SequenceMatcher(None, o, t).ratio() >= 0.92) for o in own):
            continue
        urls.add(u)
        own.append(t)
        out.append(seq)
    return out


@pytest.mark.parametrize("left", [100_000, 40, 0])
def test_rounds_choose_as_one_pass(spark, monkeypatch, left):
    monkeypatch.setattr(fuzzy, "LEFT", left)
    rows = chain(left, 70)
    df = spark.createDataFrame([(*r, 1) for r in rows], "seq long, member_name_en string, published_at string, title string, url string, block int").repartition(3)
    out = fuzzy.fuzzy_articles(df)
    assert sorted(r.seq for r in out.collect()) == plain_fuzzy(rows) and out.columns == df.columns


def test_a_url_of_most_rows_is_no_pairs(spark):
    df = spark.range(30_000).selectExpr("id as seq", "'m' as member_name_en", "'d' as published_at", "concat('t', id % 5) as title", "if(id % 2 = 0, 'hot', concat('u', id)) as url")
    assert sorted(r.seq for r in fuzzy.fuzzy_articles(df).collect()) == [0, 1, 3, 7, 9]


def plain_ranked(rows, most, least):
    out, by = [], {}
    for r in sorted(rows, key=lambda r: r[0]):
        by.setdefault(r[1], []).append(r)
    for own in by.values():
        seen = []
        for seq, _, t, _, _ in sorted(own, key=lambda r: (r[4] or False, r[3] is not None, r[3] or ""), reverse=True):
            t = t or ""
            if len(seen) == most:
                break
            if not any(t == s or (min(len(t), len(s)) >= least and (t in s or s in t)) for s in seen):
                seen.append(t)
                out.append(seq)
    return sorted(out)


@pytest.mark.parametrize("look", [64, 3, 1])
def test_windows_choose_as_one_pass(spark, monkeypatch, look):
    monkeypatch.setattr(fuzzy, "LOOK", look)
    rng = random.Random(look)
    base = [words(rng, 4) for _ in range(12)]
    rows = []
    for k in range(260):
        t = rng.choice(base)
        t = rng.choice([t, t + " " + words(rng, 2), words(rng, 1) + " " + t, words(rng, 5), None])
        rows.append((k, rng.choice(["hot", "hot", "a", None]), t, rng.choice([None, *(f"2024-01-0{d}" for d in range(1, 9))]), rng.choice([True, False, None])))
    df = spark.createDataFrame(rows, "seq long, member string, title string, published_at string, preferred boolean").repartition(3)
    for most, least in ((10, 12), (4, 35), (1, 5)):
        assert sorted(r.seq for r in fuzzy.ranked_containment(df, most, least).collect()) == plain_ranked(rows, most, least)
    assert fuzzy.ranked_containment(df.filter("false")).count() == 0
