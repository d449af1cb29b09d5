"""Scores, predicates, dates and pages on small texts."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions import dates as D
from tidemark.operators import filters, score
from tidemark.operators.entity import attribute, roster
from tidemark.sources import pages as P


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_relevance(spark):
    df = spark.createDataFrame([("interest rates", ""), ("rate cut", ""), (None, None), ("Commencement", "jobs")], "title string, text string")
    got = [(r.policy_score, r.relevance_score, r.relevance) for r in score.relevance(df).collect()]
    assert got == [(6, 6, "HIGH"), (5, 5, "MEDIUM"), (0, 0, "LOW"), (0, 0, "LOW")]


def test_topics_keep_order(spark):
    assert one(spark, score.topics(F.col("a"), F.col("b")), a="Jobs", b="inflation and the dollar") == ["INFLATION", "LABOR", "FX"]


@pytest.mark.parametrize("text,want", [("He is open to cutting rates soon", (-5, None, "supports cuts")), ("warned against a hike; possible rate hike", (-5, None, "warns against hikes")), ("no rush to cut. inflation is sticky", (5, "resists cuts", None)), ("", (0, None, None))])
def test_news_rules(spark, text, want):
    r = one(spark, score.news_rules(F.col("t")), t=text)
    assert (r.score, r.hawk_hit, r.dove_hit) == want


@pytest.mark.parametrize(
    "sentence,want",
    [
        ("Inflation remains too high.", (6, 0)),  # phrase 4 and pattern 3, clipped
        ("The mortality rate cut was large.", (0, -3)),  # a strong policy term overrules
        ("Rates of delinquency rose and the default rate was raised.", (0, 0)),
        ("I believe a rate cut is appropriate.", (0, -4)),  # 3 x 1.35 to the nearest even
        ("금리 인상이 필요하지 않다고 말했다.", (0, -6)),
        ("nothing here", (0, 0)),
    ],
)
def test_sentences(spark, sentence, want):
    r = score.sentence_scores(spark.createDataFrame([(sentence,)], "sentence string")).first()
    assert (r.hawk_score, r.dove_score) == want


def test_article_stance(spark):
    df = spark.createDataFrame([(1, "Rate hike", "Inflation remains elevated today. Short. " + "x" * 100), (2, None, None)], "seq long, title string, text string")
    got = {r.seq: r for r in score.article_stance(df).collect()}
    assert got[1].hawkish_score == 10 and got[1].label == "HAWKISH" and got[1].confidence == "MEDIUM" and len(got[1].evidence) == 2
    assert (got[2].score, got[2].confidence, got[2].evidence) == (0, "LOW", [])


def test_fingerprint_and_key(spark):
    p = one(spark, score.fingerprint(F.col("a"), F.col("b")), a="More restrictive policy", b="금리 인상")
    assert p == ["RATE_HIKE", "TIGHTENING"]
    k = one(spark, score.event_key(F.col("m"), F.lit(None), F.array(F.lit("A"), F.lit("B")), F.lit("")), m="Ann  O'X")
    assert k.startswith("ann o x|unknown-date|") and len(k.rsplit("|", 1)[1]) == 12


def test_jaccard(spark):
    assert one(spark, score.token_jaccard(F.col("a"), F.col("b")), a="aa bb cc", b="bb cc dd x") == 0.5
    assert one(spark, score.token_jaccard(F.col("a"), F.col("b")), a="", b="bb") == 0.0


def test_attribution(spark):
    people = roster(spark.createDataFrame([(1, "Ann Long", "안", "Governor", "이사", "AL|annie", 1), (2, "Bo Short", "보", "President", "총재", "", 1)], "member_id int, name_en string, name_ko string, role_en string, role_ko string, aliases string, voter int"))
    a = spark.createDataFrame([(1, "Ann Long", "t", "", ""), (2, "", "bo short and ann long", "", ""), (3, None, None, None, None), (4, "", "Short", "", "")], "seq long, speaker_raw string, title string, text string, url string")
    got = {r.seq: (r.member_id, r.match_score, r.member_group) for r in attribute(a, people).collect()}
    assert got == {1: (1, 33, "FOMC"), 2: (1, 13, "FOMC"), 3: (None, 0, "UNMATCHED"), 4: (2, 3, "FOMC")}


def test_near_term(spark):
    near = lambda t: one(spark, filters.near_term(F.col("t"), "Ann", [["said"], ["rate"]], 10, 20), t=t)
    assert near("x ann said the rate") and not near("ann " + "y" * 40 + " said rate") and near("ann " + "y" * 60 + " rate ann said") and not near("") and not near("said rate")


@pytest.mark.parametrize("text,want", [("January 5, 2024", "2024-01-05"), ("on Sept. 9, 2023 in X", "2023-09-09"), ("9 Mar 2022", "2022-03-09"), ("2021-12-31T00", "2021-12-31"), ("3/4/2020", "2020-03-04"), ("Feb 30, 2020", None), ("", None)])
def test_english_date(spark, text, want):
    assert one(spark, D.english_date(F.col("t")), t=text) == want


@pytest.mark.parametrize("pub,text,want", [("2026-08-05", "4일(현지시간) 연설", "2026-08-04"), ("2026-08-02", "31일(현지시간)", "2026-07-31"), ("2026-08-20", "1일(현지시간)", None), ("bad", "4일(현지시간)", None), ("2026-08-05", "", None)])
def test_spoken_date(spark, pub, text, want):
    assert one(spark, D.spoken_date(F.col("t"), F.col("p")), t=text, p=pub) == want


def test_rss_and_url_dates(spark):
    assert str(one(spark, D.rss_date(F.col("t")), t="Mon, 01 Jan 2024 10:00:00 GMT")) == "2024-01-01 10:00:00"
    assert str(one(spark, D.rss_date(F.col("t")), t="Mon, 01 Jan 2024 10:00:00 +0900")) == "2024-01-01 01:00:00"
    assert one(spark, D.url_date(F.col("u")), u="https://x/20249999/20240229/s-230101") == "2024-02-29"
    assert one(spark, D.url_date(F.col("u")), u="https://x/s-230101") == "2023-01-01"


def test_text_helpers(spark):
    assert one(spark, C.clean_text(F.col("t")), t=" aâ€™b  c\n") == "a’b c"
    assert one(spark, C.handle(F.col("t")), t=" @@bo ") == "bo"
    assert one(spark, C.alias_list(F.col("t")), t="a| b ||") == ["a", "b"]
    assert one(spark, C.sentences(F.col("t")), t="One long sentence here. No. 길고 긴 문장이라 남는다다. Another one is kept!") == ["One long sentence here.", "길고 긴 문장이라 남는다다.", "Another one is kept!"]


def _against_sql(spark, folder, query, pages):
    import duckdb

    from tidemark.plans import registry, text_queries  # noqa: F401

    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    got = sorted(map(tuple, registry.QUERIES[query](spark, str(folder)).collect()))
    assert got == sorted(con.execute(registry.ORACLE_SQL[query]).fetchall())
    return got


_OPEN_REFERENCES = [(1, "u", "<h1>a&amp; b&amp</h1><p>x &lt y &copy;</p>"), (2, "u", "<h1>&amp;amp;&ampb &nbsp;c</h1>")]


def test_markup_free_equals_its_sql_on_open_references(spark, tmp_path):
    assert _against_sql(spark, tmp_path, "c4_markup_free", _OPEN_REFERENCES)[0] == (1, "a& b&amp x &lt y ©")
    assert one(spark, C.markup_free(F.col("t")), t="<b>a&amp</b>") == "a&"  # the operator decodes both, as browsers do


def test_headings_equal_their_sql_on_open_references(spark, tmp_path):
    assert _against_sql(spark, tmp_path, "c17_headings", _OPEN_REFERENCES)[0] == (1, "a& b&amp")


def test_pages(spark):
    html = '<html><title>T</title><h1>Head &amp; x</h1><a href="/s/20240105a.htm">Talk</a><a href="mailto:x">m</a><a href="http://other.org/s/">o</a><p>A paragraph of twenty characters.</p><p>short<p>A paragraph of twenty characters.</html>'
    df = spark.createDataFrame([(1, "https://www.x.org/list/", html)], "page_id long, url string, html string")
    got = P.speech_links(df, ["/s/"], F.lit("https://x.org"), key="page_id").collect()
    assert [(r.url, r.title, r.published_at) for r in got] == [("https://www.x.org/s/20240105a.htm", "Talk", "2024-01-05")]
    r = df.select(P.paragraphs(F.col("html")).alias("p"), P.heading(F.col("html")).alias("h")).first()
    assert (r.p, r.h) == ("A paragraph of twenty characters.", "Head & x")
    feed = spark.createDataFrame([(1, "<rss><item><title><![CDATA[A & b]]></title><link>u</link><pubDate>d</pubDate></item><item><title>C</title></item></rss>"), (2, None)], "k int, xml string")
    assert [(i.title, i.url) for i in P.feed_items(feed).orderBy("pos").collect()] == [("A & b", "u"), ("C", "")]


def test_fallbacks(spark):
    e, a = spark.range(0), spark.range(2)
    assert P.first_with_rows(e, a, spark.range(5)).count() == 2 and P.first_with_rows(e, e).count() == 0
    b = one(spark, P.body_cascade([("EXISTING", F.col("a")), ("DIRECT", F.col("b"))], 3), a="x", b="long")
    assert (b.text, b.method, b.fetched) == ("long", "DIRECT", True)


def test_plain_signs_are_listed(spark):
    """The list of signs keeps what the ranges keep, of all characters; ranges of ASCII are tried one by one and take far longer."""
    from tidemark.functions import columns

    ranges = "[^0-9a-zA-Z가-힣]+"
    df = spark.range(0x110000).filter("id not between 55296 and 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c")).withColumn("t", F.concat(F.lit("a "), "c", F.lit("  b"), "c"))
    assert df.filter(F.regexp_replace("t", columns._NOT_PLAIN, " ") != F.regexp_replace("t", ranges, " ")).count() == 0
    assert "0-9" not in columns._NOT_PLAIN and "a-z" not in columns._NOT_PLAIN
