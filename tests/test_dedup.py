"""Duplicate operators against plain Python models on random inputs."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tidemark.operators import dedup, fuzzy, linkage


def plain(t):
    return " ".join("".join(c if c.isascii() and (c.isalnum() or c.isspace()) else " " for c in (t or "").lower()).split())


def model_fuzzy(rows):
    kept, urls = [], set()
    for seq, m, d, t, u in rows:
        if u and u in urls:
            continue
        if any(m == k[1] and d == k[2] and plain(t) and plain(k[3]) and SequenceMatcher(None, plain(t), plain(k[3])).ratio() >= 0.92 for k in kept):
            continue
        if u:
            urls.add(u)
        kept.append((seq, m, d, t, u))
    return {k[0] for k in kept}


def test_fuzzy_articles(spark):
    rng = random.Random(3)
    for trial in range(3):
        rows = []
        for k in range(60):
            t = rng.choice(["Fed chair speaks on policy and prices", "Rates to stay where they are for now", "금리 인상", None])
            if t and rng.random() < 0.6:
                i = rng.randrange(len(t))
                t = t[:i] + rng.choice("abcxyz") + t[i + rng.randrange(2) :]
            rows.append((k, rng.choice(["a", "b", None]), rng.choice(["2024-01-01", "2024-01-02"]), t, rng.choice([None, "", *(f"u{i}" for i in range(25))])))
        df = spark.createDataFrame(rows, "seq long, member_name_en string, published_at string, title string, url string")
        assert {r.seq for r in fuzzy.fuzzy_articles(df).collect()} == model_fuzzy(rows)


def test_links_first_group_wins(spark):
    # B is like A and C, A and C are unlike; in order A, C, B: two groups
    rows = [(1, "m", "2024-01-01", "aa bb cc dd", ""), (2, "m", "2024-01-01", "ee ff gg hh", ""), (3, "m", "2024-01-01", "aa bb ee ff", ""), (4, "m", "2024-01-03", "aa bb cc dd", ""), (5, "", "2024-01-01", "aa bb cc dd", ""), (6, "m", None, "aa bb cc dd", "")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "seq long, member_name_en string, event_day string, title string, text string, score int")
    got = {r.seq: r.group for r in linkage.link_events(df).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 6}


def test_merge_and_numbers(spark):
    rows = [(1, 1, "m", "2024-01-02", "t1", "x", "NEWS", "s1", "u1"), (2, 1, "m", "2024-01-02", "t2", "y", "OFFICIAL", "s2", "u2"), (3, 3, "m", "2024-01-05", "t3", "z", "INFOMAX", "s3", "u3")]
    df = spark.createDataFrame(rows, "seq long, group long, member_name_en string, event_day string, title string, text string, source_type string, source string, url string")
    got = linkage.numbered_events(linkage.merge_groups(df)).orderBy("event_id").collect()
    assert [(r.event_id, r.seq, r.source_coverage, r.event_titles) for r in got] == [("EVT0001", 3, "INFOMAX", ["t3"]), ("EVT0002", 2, "OFFICIAL", ["t2", "t1"])]


def test_containment(spark):
    long = "the central bank holds rates again today"
    rows = [(1, "m", long + " says x", "2024-01-02", False), (2, "m", long, "2024-01-01", True), (3, "m", "short", "2024-01-03", False), (4, "m", "Short!", "2024-01-01", False)]
    df = spark.createDataFrame(rows, "seq long, member string, title string, published_at string, preferred boolean")
    assert {r.seq for r in fuzzy.ranked_containment(df).collect()} == {2, 3}


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(0, "u1", "2024-01-01", "a"), (1, "u2", "2024-01-03", "b")], "seq long, url string, published_at string, title string")
    new = spark.createDataFrame([(0, "u1", "2024-01-02", "A"), (1, " ", "2024-01-04", "c")], "seq long, url string, published_at string, title string")
    key = dedup.identity(F.col("url"), F.lit("m"), F.col("published_at"), F.col("title"))
    once = dedup.upsert(old, new, key)
    assert [r.title for r in once.collect()] == ["c", "b", "A"]
    assert [r.title for r in dedup.upsert(once, new, key).collect()] == ["c", "b", "A"]


def test_paragraphs_and_titles(spark):
    r = spark.createDataFrame([("A line that is long enough\nshort\na LINE that is long enough\nAnother long enough line",)], "t string").select(dedup.distinct_paragraphs(F.col("t")).alias("x"), dedup.strip_suffix(F.lit("Head - Out"), F.lit("Out")).alias("h")).first()
    assert (r.x, r.h) == ("A line that is long enough\nAnother long enough line", "Head")


def plain_title(t):
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", (t or "").lower(), flags=re.A)).strip()


@pytest.fixture(scope="module")
def table(spark):
    """The whole small table with repeated titles and addresses."""
    from tidemark.plans.views import articles

    a = articles(spark, "/root/testdata/sf0.001")
    again = a.filter("seq % 4 = 0").withColumns({"seq": F.col("seq") + 1000, "title": F.concat(F.upper("title"), F.lit("!")), "url": F.concat("url", F.lit("x"))})
    return a.unionByName(again).withColumn("url", F.when(F.col("seq") % 10 == 3, "").otherwise(F.col("url"))).cache()


def test_fuzzy_articles_equal_a_plain_pass_over_the_table(table):
    rows = sorted(table.collect(), key=lambda r: r.seq)
    seen, titles, want = set(), {}, []
    for r in rows:
        t, block = plain_title(r.title), (r.member_name_en, r.published_at)
        if r.url and r.url in seen:
            continue
        if any((t and t == o) or (t and o and SequenceMatcher(None, o, t).ratio() >= 0.92) for o in titles.get(block, [])):
            continue
        if r.url:
            seen.add(r.url)
        titles.setdefault(block, []).append(t)
        want.append(r.seq)
    got = sorted(r.seq for r in fuzzy.fuzzy_articles(table).collect())
    assert got == want and 0 < len(want) < len(rows)


def test_ranked_containment_equals_a_plain_pass_over_the_table(table):
    a = table.select("seq", F.col("source").alias("member"), "title", "published_at", (F.col("seq") % 2 == 0).alias("preferred"))
    want = []
    by = {}
    for r in sorted(a.collect(), key=lambda r: r.seq):
        by.setdefault(r.member, []).append(r)
    for own in by.values():
        seen = []
        for r in sorted(own, key=lambda r: (r.preferred, r.published_at or ""), reverse=True):
            t = plain_title(r.title)
            if len(seen) == 10:
                break
            if not any(t == s or (min(len(t), len(s)) >= 35 and (t in s or s in t)) for s in seen):
                seen.append(t)
                want.append(r.seq)
    assert sorted(r.seq for r in fuzzy.ranked_containment(a).collect()) == sorted(want)


def test_linked_events_equal_a_plain_pass_over_the_table(table):
    from tidemark.functions.columns import plain_event_text, words
    from tidemark.operators.score import fingerprint

    a = table.withColumn("event_day", F.to_date("published_at")).withColumn("score", (F.col("seq") % 9 - 4).cast("int"))
    body = plain_event_text(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.substring(F.coalesce("text", F.lit("")), 1, 1000)))
    rows = a.select("seq", F.col("member_name_en").alias("m"), "event_day", "score", fingerprint(F.col("title"), F.col("text")).alias("p"), words(body).alias("w")).collect()
    groups, want = [], {}

    def same(x, y):
        gap, common = abs((x.event_day - y.event_day).days), len(set(x.p) & set(y.p))
        union = len(set(x.w) | set(y.w))
        sign = lambda s: (s >= 1) - (s <= -1)
        alike = x.w and y.w and len(set(x.w) & set(y.w)) / union >= 0.25
        return gap <= 1 and (common >= 2 or alike or (gap == 0 and common >= 1 and sign(x.score) != 0 and sign(x.score) == sign(y.score)))

    for r in sorted(rows, key=lambda r: (r.event_day, r.seq)):  # the oldest first
        for k, g in enumerate(groups):
            if g[0].m == r.m and any(same(r, o) for o in g):
                g.append(r)
                want[r.seq] = k
                break
        else:
            want[r.seq] = len(groups)
            groups.append([r])
    got = {r.seq: r.group for r in linkage.link_events(a).collect()}
    parts = lambda of: sorted(sorted(s for s in of if of[s] == g) for g in set(of.values()))
    assert parts(got) == parts(want) and len(groups) < len(rows)
