"""Crawl, search and attachment queries.  Pages and feeds are written from table rows, so the SQL says what must be found from
the rows themselves and shares no pattern with the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import dates as D
from ..operators import attach, filters
from ..operators import signals as S
from ..operators.entity import search_terms
from ..operators.profile import attach_signals
from ..sources import chains as K
from ..sources import pages as P
from .registry import query
from .signal_queries import _CURRENT, _FINAL, _NEWS, _as_of, _eligible
from .views import A, U, articles, stance_sql, table, utterances

#: orders as dated items of the years from 2004 on: a key, a member and a day.
O = "o AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS DATE) + INTERVAL 12 YEAR AS t, o_orderpriority AS p FROM orders), i AS (SELECT *, CAST(t AS DATE) AS d FROM o)"


def items(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.add_months(F.to_date("o_orderdate"), 144).alias("d"), F.col("o_orderpriority").alias("p"))


def text(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


# ---- scalars ---------------------------------------------------------------------------------------------------------
@query("c7_wire_date", f"WITH {O} SELECT k, CASE WHEN k % 5 < 4 THEN strftime(d, '%Y-%m-%d') END AS d FROM i")
def c7(spark, sf):
    d = F.col("d")
    forms = F.when(F.col("k") % 5 == 0, F.date_format(d, "EEE, d MMM yyyy '10:00:00 GMT'")).when(F.col("k") % 5 == 1, text("입력 ", F.date_format(d, "yyyy.M.d"), " 09:30")).when(F.col("k") % 5 == 2, F.date_format(d, "yyyy년 M월 d일"))
    forms = forms.when(F.col("k") % 5 == 3, F.date_format(d, "yyyy-MM-dd")).otherwise(F.lit("어제"))
    return items(spark, sf).select("k", D.wire_date(forms).alias("d"))


_SLUGS = ["powell", "cook", "jefferson", "barr", "bowman", "waller", "warsh", "miran", ""]


@query("c12_url_speaker", f"WITH {O} SELECT k, [{', '.join(repr(D.URL_SPEAKERS[s]) if s in D.URL_SPEAKERS else 'NULL' for s in _SLUGS)}][k % 9 + 1] AS speaker FROM i")
def c12(spark, sf):
    slug = F.element_at(F.array(*(F.lit(s) for s in _SLUGS)), (F.col("k") % 9 + 1).cast("int"))
    return items(spark, sf).select("k", D.url_speaker(text("https://x.org/newsevents/speech/", slug, F.date_format("d", "yyyyMMdd"), "a.htm")).alias("speaker"))


@query("c14_page_speaker", f"WITH {O} SELECT k, CASE WHEN k % 2 = 0 THEN 'Lisa Cook' WHEN k % 3 = 0 THEN 'Michael Barr' END AS speaker FROM i")
def c14(spark, sf):
    k = F.col("k")
    body = text("Remarks by ", F.when(k % 3 == 0, "governor MICHAEL BARR, ").otherwise(""), F.when(k % 2 == 0, "and lisa cook").otherwise(""), " at the table")
    return items(spark, sf).select("k", D.page_speaker(body).alias("speaker"))


@query("c23_voter", "SELECT c_custkey, c_custkey % 8 IN (0, 1, 2, 3) AS voter FROM customer")
def c23(spark, sf):
    flags = F.element_at(F.array(*(F.lit(x) for x in ("1", "1.0", " Yes ", "TRUE", "0", "no", "2", None))), (F.col("c_custkey") % 8 + 1).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", C.votes(flags).alias("voter"))


@query("c23_display", "SELECT c_custkey, c_name || CASE c_custkey % 3 WHEN 0 THEN ' (~2027)' WHEN 1 THEN ' (~2028)' ELSE ' (당연직)' END AS shown FROM customer")
def c23d(spark, sf):
    year = F.when(F.col("c_custkey") % 3 == 0, "2027.0").when(F.col("c_custkey") % 3 == 1, "2028")
    return table(spark, sf, "customer").select("c_custkey", C.shown_member(F.col("c_name"), year).alias("shown"))


_LABELS = [*C.SHOWN_MOMENTUM, *C.SHOWN_STANCE, *C.SHOWN_CONFIDENCE, "other"]


@query("c22_shown_labels", f"WITH {O}, l AS (SELECT k, [{', '.join(repr(x) for x in _LABELS)}][k % {len(_LABELS)} + 1] AS x FROM i) SELECT k, " + ", ".join("CASE x " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in t.items()) + f" ELSE x END AS {n}" for n, t in (("momentum", C.SHOWN_MOMENTUM), ("stance", C.SHOWN_STANCE), ("confidence", C.SHOWN_CONFIDENCE))) + " FROM l")
def c22(spark, sf):
    x = F.element_at(F.array(*(F.lit(v) for v in _LABELS)), (F.col("k") % len(_LABELS) + 1).cast("int"))
    return items(spark, sf).select("k", C.shown(x, C.SHOWN_MOMENTUM).alias("momentum"), C.shown(x, C.SHOWN_STANCE).alias("stance"), C.shown(x, C.SHOWN_CONFIDENCE).alias("confidence"))


@query("c4_references", f"WITH {O} SELECT k, 'A & B <c> ' || chr(8212) || ' \"' || CAST(k AS VARCHAR) || '\" ' || chr(233) || chr(128512) || ' ' || chr(8364) || ' &none; &amp;' AS t FROM i")
def c4r(spark, sf):
    raw = text("<p>A &amp; B &lt;c&gt; &mdash;</p><b>&quot;", F.col("k"), "&#34;</b> &eacute;&#x1F600; &#128; &none; &amp;amp;")
    return items(spark, sf).select("k", F.replace(C.markup_free(F.replace(raw, F.lit("&lt;c&gt;"), F.lit("\u0001"))), F.lit("\u0001"), F.lit("<c>")).alias("t"))


@query("c13_page_date", f"WITH {O} SELECT k, strftime(d, '%Y-%m-%d') AS d FROM i")
def c13(spark, sf):
    k, iso = F.col("k"), F.date_format("d", "yyyy-MM-dd")
    page = F.when(k % 4 == 0, text('<meta property="article:published_time" content="', iso, 'T10:00:00Z">')).when(k % 4 == 1, text('<p>x</p><time class="d" datetime="', iso, '">then</time>'))
    page = page.when(k % 4 == 2, text("<h1>T</h1><p>", F.date_format("d", "MMMM d, yyyy"), "</p>")).otherwise(text('<meta name="date" content="', iso, '"><p>January 2, 1999</p>'))
    return items(spark, sf).select("k", P.page_date(page).alias("d"))


@query("c15_reader_text", f"WITH {O} SELECT k, 'Body ' || CAST(k AS VARCHAR) || chr(10) || 'Title of nothing' AS t FROM i")
def c15(spark, sf):
    return items(spark, sf).select("k", P.reader_text(text("Title: x\nURL Source: https://a.org\nPublished Time: 2024\nMarkdown Content:\nBody ", F.col("k"), "\nTitle of nothing\n")).alias("t"))


@query("c26_search_queries", "SELECT c_custkey, 'site:n.org \"' || c_name || '\"|site:n.org \"k' || CAST(c_custkey AS VARCHAR) || '\"' AS q FROM customer")
def c26(spark, sf):
    c = table(spark, sf, "customer")
    names = P.search_queries(F.col("c_name"), F.col("c_name"), F.array(text("k", F.col("c_custkey")), F.lit(" ")), "n.org")
    return c.select("c_custkey", F.array_join(names, "|").alias("q"))


@query("c8_month_turns", f"WITH {O}, g AS (SELECT k, d, CAST(k % 10 AS INTEGER) AS b, d - CAST(k % 10 AS INTEGER) AS s FROM i) SELECT k, CASE WHEN b <= 7 AND (month(s) = month(d) OR (day(d) <= 5 AND day(s) >= 25)) THEN strftime(s, '%Y-%m-%d') END AS spoken FROM g WHERE month(s) = month(d) OR day(s) >= 25 OR day(d) > 5 OR TRUE")
def c8(spark, sf):
    said = F.date_sub("d", (F.col("k") % 10).cast("int"))
    return items(spark, sf).select("k", D.spoken_date(text(F.dayofmonth(said), "일(현지 시간) 말했다"), F.date_format("d", "yyyy-MM-dd")).alias("spoken"))


@query("c10_url_dates", f"WITH {O} SELECT k, strftime(d, '%Y-%m-%d') AS u FROM i")
def c10(spark, sf):
    k = F.col("k")
    url = F.when(k % 3 == 0, text("https://x.org/a20991399/s_", F.date_format("d", "yyyyMMdd"), ".htm")).when(k % 3 == 1, text("https://x.org/s-", F.date_format("d", "yyMMdd"))).otherwise(text("https://x.org/", F.date_format("d", "yyyyMMdd"), "-19991231"))
    return items(spark, sf).select("k", D.url_date(url).alias("u"))


@query("c11_year_tiers", f"WITH {O} SELECT k, CAST(year(d) AS INTEGER) AS y FROM i")
def c11(spark, sf):
    k, y = F.col("k"), F.date_format("d", "yyyy")
    url = F.when(k % 3 == 0, text("https://x.org/", y, "/a20991231")).when(k % 3 == 1, text("https://x.org/s", F.date_format("d", "yyyyMMdd"), "b")).otherwise(text("https://x.org/talk", y, "x"))
    return items(spark, sf).select("k", D.year_of(F.when(k % 5 == 0, F.date_format("d", "yyyy-MM-dd")), url).alias("y"))


# ---- pages and crawls --------------------------------------------------------------------------------------------------
@query("s9_any_quotes", "SELECT page_id, count(*) AS n, string_agg(h, ',' ORDER BY h) AS hrefs FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a href=\"([^\"]*)\">', 1)) AS h FROM pages) GROUP BY page_id")
def s9q(spark, sf):
    p = table(spark, sf, "pages")
    html = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("html", r'<a href="([^"]*)">', "<a class=x href='$1'>")).when(F.col("page_id") % 3 == 1, F.regexp_replace("html", r'<a href="([^"]*)">', "<a href=$1 >")).otherwise(F.col("html"))
    return P.links(p.withColumn("html", html)).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("href")), ",").alias("hrefs"))


def _note_pages(spark, sf):
    p, i = table(spark, sf, "pages"), F.col("page_id")
    own = text("<section><h2>Desk ", i, "</h2><ul><li>By Speaker ", i % 7, " <a href='/n/", i, "'>Note <i>", i, "</i> here</a> on the day</li></ul></section>")
    return p.withColumn("html", F.concat(own, F.col("html")))


@query("c18_link_context", "SELECT page_id, 'Note ' || page_id || ' here' AS title, 'By Speaker ' || page_id % 7 || ' Note ' || page_id || ' here on the day | Desk ' || page_id || ' By Speaker ' || page_id % 7 || ' Note ' || page_id || ' here on the day' AS context FROM pages")
def c18(spark, sf):
    return K.link_contexts(_note_pages(spark, sf)).filter("href like '/n/%'").select("page_id", F.col("text").alias("title"), "context")


@query("f17_member_in_context", "SELECT page_id FROM pages WHERE page_id % 7 IN (3, 5)")
def f17(spark, sf):
    rows = K.link_contexts(_note_pages(spark, sf)).filter("href like '/n/%'")
    terms = F.array(F.lit("Speaker 3"), F.lit(" "), F.lit("SPEAKER 5"), F.lit("chair of all"))
    return rows.filter(K.member_named(F.col("context"), terms)).select("page_id")


_LISTED = f"""WITH {O}, l AS (SELECT *, CAST(k % 12 AS INTEGER) AS s, CAST(floor(k / 4) AS BIGINT) AS g FROM i), r(s, source, base, part, m) AS (VALUES {', '.join(f"({n}, '{a}', '{b}', '{p}', {str(m).lower()})" for n, (a, b, p, m) in enumerate(P.REGISTRY))}),
f AS (SELECT k, source, base || part || '/' || g || '-' || strftime(d, '%Y%m%d') AS url, d FROM l JOIN r USING (s) WHERE NOT m OR k % 3 = 0)"""


def _list_pages(spark, sf):
    """A list page for each order, of one of the registry's sources or of none, with a link to a speech and three others."""
    i = items(spark, sf)
    config = spark.createDataFrame([(n, a, b, p) for n, (a, b, p, _) in enumerate(P.REGISTRY)], "s int, source string, base string, part string")
    rows = i.withColumn("s", (F.col("k") % 12).cast("int")).join(F.broadcast(config), "s", "left")
    link = text(F.coalesce("base", F.lit("https://none.org")), F.coalesce("part", F.lit("/x/")), "/", F.floor(F.col("k") / 4).cast("long"), "-", F.date_format("d", "yyyyMMdd"))
    who = F.when(F.col("k") % 3 == 0, "by Jane Doe").otherwise("by nobody")
    page = text("<ul><li>", who, " <a href='", link, "'>Talk of the day</a></li><li><a href='", link, ".pdf'>Talk of the day</a></li><li><a href='#top'>Top of page</a></li><li><a href='https://other.org", F.coalesce("part", F.lit("/x/")), "/1'>Talk elsewhere</a></li></ul>")
    return rows.select(F.col("k").alias("page_id"), F.coalesce("base", F.lit("https://none.org")).alias("url"), page.alias("html"), F.coalesce("source", F.lit("No such source")).alias("source"))


def _speeches(spark, sf):
    return K.speech_list(_list_pages(spark, sf), members=F.array(F.lit("Jane Doe"), F.lit("Doe")))


@query("s10_speech_list", _LISTED + " SELECT url, min(k) AS page_id, any_value(source) AS source, any_value(strftime(d, '%Y-%m-%d')) AS published_at FROM f GROUP BY url")
def s10(spark, sf):
    return _speeches(spark, sf).select("url", "page_id", "source", "published_at")


@query("s11_registry", _LISTED + " SELECT source, count(DISTINCT url) AS n FROM f GROUP BY source")
def s11(spark, sf):
    return _speeches(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("p5_canonical_row", _LISTED + " SELECT url, 'OFFICIAL' AS source_type, 'Talk of the day' AS title, '' AS text FROM f GROUP BY url")
def p5(spark, sf):
    return _speeches(spark, sf).select("url", "source_type", "title", "text")


@query("s12_dated_paths", f"WITH {O} SELECT 'https://www.philadelphiafed.org/the-economy/macro/' || strftime(d, '%y%m%d') || '-talk-' || c AS url, min(k) AS page_id, strftime(d, '%Y-%m-%d') AS published_at FROM i WHERE year(d) = 2008 GROUP BY c, d")
def s12(spark, sf):
    day, c = F.date_format("d", "yyMMdd"), F.col("c")
    page = text("<a href='/the-economy/macro/", day, "-talk-", c, "'>Talk ", c, "</a><a href='/the-economy/macro/", day, "-list'>Macroeconomics</a><a href='/the-economy/macro/089931-x'>Bad day</a><a href='/about/", day, "-y'>Other</a>")
    pages = items(spark, sf).select(F.col("k").alias("page_id"), F.lit("https://www.philadelphiafed.org/list").alias("url"), page.alias("html"))
    return K.dated_paths(pages, 2008, "Jane Doe").select("url", "page_id", "published_at")


@query("s13_fall_backs", f"WITH {O} SELECT c, k, CASE WHEN c % 3 = 0 THEN 'main' WHEN c % 3 = 1 THEN 'feed' ELSE 'profile' END AS branch FROM i")
def s13(spark, sf):
    i = items(spark, sf).select("c", "k")
    return K.first_branch([("main", i.filter("c % 3 = 0")), ("feed", i.filter("c % 3 <= 1")), ("profile", i)], "c").select("c", "k", "branch")


@query("s14_sitemap", f"WITH {O} SELECT c, 'https://www.stlouisfed.org/remarks/' || k % 5 AS url, strftime(max(d), '%Y-%m-%d') AS modified FROM i GROUP BY c, k % 5")
def s14(spark, sf):
    k = F.col("k")
    entry = text("<url><loc>https://www.StLouisFed.org/", F.when(k % 2 == 0, "Remarks").otherwise("remarks"), "/", k % 5, F.when(k % 3 == 0, "/").otherwise(""), "</loc><lastmod>", F.date_format("d", "yyyy-MM-dd"), "T01:02:03Z</lastmod></url>")
    maps = items(spark, sf).withColumn("e", entry).groupBy("c").agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list("e"), "\n"), F.lit("</urlset>")).alias("xml"))
    return K.sitemap_urls(maps).select("c", "url", "modified")


@query("s15_all_sources", f"WITH {O}, x AS (SELECT k, k % 40 AS u, CASE WHEN k % 5 <> 0 THEN strftime(d, '%Y-%m-%d') END AS day, k % 3 = 0 AS spoken, k % 2 = 0 AS long FROM i WHERE k % 5 = 0 OR year(d) = 2008), q AS (SELECT *, CASE WHEN day IS NULL THEN 0 ELSE 2 END + CASE WHEN spoken THEN 2 ELSE 0 END + 1 + CASE WHEN long THEN 4 ELSE 0 END AS points FROM x), b AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY u ORDER BY points DESC, k) = 1) SELECT k, day AS published_at, CASE WHEN k % 4 = 0 THEN 'OFFICIAL' ELSE 'REGIONAL' END AS source_type, row_number() OVER (ORDER BY coalesce(day, '0000') DESC, k) AS place FROM b")
def s15(spark, sf):
    k = F.col("k")
    rows = items(spark, sf).select(
        k.alias("seq"), text("https://x.org/talk-", k % 40, "-").alias("url"), F.when(k % 5 != 0, F.date_format("d", "yyyy-MM-dd")).alias("published_at"), F.lit("Talk").alias("title"), F.lit("s").alias("source"),
        F.when(k % 4 == 0, " ").when(k % 4 == 1, F.lit(None)).otherwise("").alias("_"), F.when(k % 4 != 0, "REGIONAL").alias("source_type"), F.when(k % 3 == 0, "Jane Doe").alias("speaker_raw"), F.when(k % 2 == 0, F.repeat(F.lit("x"), 600)).alias("text"),
    ).drop("_")
    from pyspark.sql import Window as W

    out = K.all_sources(rows, 2008)
    return out.withColumn("place", F.row_number().over(W.orderBy(F.coalesce("published_at", F.lit("0000")).desc(), "seq")).cast("long")).select(F.col("seq").alias("k"), "published_at", "source_type", "place")


@query("l1_newest_first", f"WITH {O} SELECT k, row_number() OVER (ORDER BY CASE WHEN k % 4 = 0 THEN '' ELSE strftime(d, '%Y-%m-%d') END DESC, k) AS place FROM i")
def l1(spark, sf):
    from pyspark.sql import Window as W

    day = F.when(F.col("k") % 4 != 0, F.date_format("d", "yyyy-MM-dd"))
    return items(spark, sf).select("k", F.row_number().over(W.orderBy(F.coalesce(day, F.lit("")).desc(), "k")).cast("long").alias("place"))


_HEAD = "'Governor ' || c || ' on interest rates, note ' || lpad(CAST(k AS VARCHAR), 9, '0')"


@query("s16_news_search", f"WITH {O}, n AS (SELECT k, c, {_HEAD} AS title, strftime(d, '%Y-%m-%d') AS day, p LIKE '1%' AS pref FROM i WHERE d >= DATE '2010-08-01' - 90 AND k % 7 <> 0) SELECT c AS member, title, day AS published_at, pref AS preferred FROM n QUALIFY row_number() OVER (PARTITION BY c ORDER BY pref DESC, day DESC, k) <= 3")
def s16(spark, sf):
    k, c = F.col("k"), F.col("c")
    outlet = F.when(F.col("p").startswith("1"), "Reuters").otherwise("The Daily")
    title = text("Governor ", c, " on interest rates, note ", F.lpad(k.cast("string"), 9, "0"))
    about = F.when(k % 7 == 0, text("Governor ", c, " on the weather of ", k)).otherwise(title)
    item = lambda t: text("<item><title><![CDATA[", t, " - ", outlet, "]]></title><link>https://n.org/", k, "</link><source url='x'>", outlet, "</source><pubDate>", F.date_format("d", "EEE, dd MMM yyyy"), " 10:00:00 GMT</pubDate><description>Say &lt;b&gt;no&lt;/b&gt; more</description></item>")
    feeds = items(spark, sf).withColumn("e", F.concat(item(about), F.when(k % 3 == 0, item(F.upper(about))).otherwise(""))).groupBy("c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "e"))), lambda x: x["e"]), "").alias("xml"))
    out = K.news_search(feeds.withColumnRenamed("c", "member"), F.lit("2010-08-01").cast("date"), 90, 3, outlets=["Reuters"], terms=F.array(F.concat(F.lit("governor "), F.col("member").cast("string"), F.lit(" "))))
    return out.select("member", "title", "published_at", "preferred")


@query("s17_wire_search", f"WITH {O} SELECT min(k) AS seq FROM i WHERE k % 4 = 0 AND year(d) = 2008 GROUP BY c")
def s17(spark, sf):
    k, c = F.col("k"), F.col("c")
    good = text("제롬 파월 의장은 기준금리를 두고 말했다: 파월 의장은 금리를 유지한다고 밝혔다. ", c)
    body = F.when(k % 4 == 0, good).when(k % 4 == 1, text("날씨가 좋다 ", c)).when(k % 4 == 2, text("파월 의장의 사진 ", c)).otherwise(good)
    rows = items(spark, sf).filter("year(d) = 2008 or k % 2 = 0").select(
        k.alias("seq"), F.when(k % 4 == 3, "Other press").otherwise("연합인포맥스").alias("source"), text("https://w.org/", F.when(k % 4 == 0, text("a", c)).otherwise(text("b", k))).alias("url"),
        text("보도 ", k % 3, " - 연합인포맥스").alias("title"), body.alias("text"), F.date_format("d", "yyyy-MM-dd").alias("published_at"),
    )
    # one row a URL is decided before the year, as the search goes: a URL's rows of other years are left out here
    rows = rows.filter(F.startswith("published_at", F.lit("2008")) | (F.col("seq") % 4 != 0))
    return K.wire_search(rows, ["파월"], 2008, most=None).select("seq")


@query("s17_wire_roster", f"""WITH {O}, m AS (SELECT k, unnest(CASE WHEN k % 15 = 0 THEN [c % 40, (c + 1) % 40] ELSE [c % 40] END) AS member, d FROM i WHERE k % 4 = 0 AND k % 3 <> 1 AND year(d) = 2008)
SELECT DISTINCT member, k AS seq, rn AS place FROM (SELECT *, row_number() OVER (PARTITION BY member ORDER BY k) AS rn FROM m) t WHERE rn <= 7""")
def s17_roster(spark, sf):
    from pyspark.sql import Window as W

    k, who = F.col("k"), lambda c: text("위원", F.lpad((c % 40).cast("string"), 2, "0"))
    said = lambda c: text(who(c), " 의장은 기준금리를 두고 말했다: 금리를 유지한다고 밝혔다. ", F.repeat(F.lit("그리고 "), 90))
    good = F.when(k % 15 == 0, text(said(F.col("c")), said(F.col("c") + 1))).otherwise(said(F.col("c")))
    body = F.when(k % 4 == 0, good).when(k % 4 == 1, text(who(F.col("c")), " 날씨가 좋다")).when(k % 4 == 2, text(who(F.col("c")), "의 사진, 기준금리")).otherwise(good)
    rows = items(spark, sf).select(
        k.alias("seq"), F.when(k % 3 == 1, "Other press").otherwise("연합인포맥스").alias("source"), text("https://w.org/", k).alias("url"), text("보도 - 연합인포맥스").alias("title"), body.alias("text"),
        F.when(k % 4 == 3, "").otherwise(F.date_format("d", "yyyy-MM-dd")).alias("published_at"),
    ).filter("seq % 4 <> 3")
    members = spark.range(40).select(F.col("id").alias("member"), F.array(text("위원", F.lpad(F.col("id").cast("string"), 2, "0")), F.lit("")).alias("terms"))
    found = K.wire_search_all(rows, members, 2008, 7)
    return found.select("member", "seq", F.row_number().over(W.partitionBy("member").orderBy("seq")).cast("long").alias("place"))


@query("s19_body_fetch", f"WITH {A} SELECT seq, CASE WHEN seq % 3 = 2 THEN NULL WHEN length(trim(text)) >= 100 AND seq % 2 = 0 THEN 'EXISTING' WHEN seq % 5 <> 0 THEN 'DIRECT' ELSE 'FAILED' END AS body_method FROM a")
def s19(spark, sf):
    a = articles(spark, sf).withColumn("relevance", F.element_at(F.array(F.lit("HIGH"), F.lit("MEDIUM"), F.lit("LOW")), (F.col("seq") % 3 + 1).cast("int"))).withColumn("url", text("u", F.col("seq")))
    a = a.withColumn("text", F.when(F.col("seq") % 2 == 0, F.col("text")))
    bodies = a.select("url", F.when(F.col("seq") % 5 != 0, F.repeat(F.lit("body "), 30)).otherwise("short").alias("body"))
    return K.fetched_bodies(a, bodies, ("HIGH", "MEDIUM")).select("seq", "body_method")


@query("l5_target_cap", f"WITH {A}, w AS (SELECT seq FROM a WHERE seq % 3 = 0 ORDER BY seq LIMIT 50) SELECT count(*) AS n, count(*) FILTER (seq IN (SELECT seq FROM w)) AS fetched FROM a")
def l5(spark, sf):
    a = articles(spark, sf).withColumn("relevance", F.when(F.col("seq") % 3 == 0, "HIGH").otherwise("LOW")).withColumn("url", text("u", F.col("seq")))
    out = K.fetched_bodies(a, a.select("url", F.lit("b").alias("body")), ("HIGH",), most=50)
    return out.agg(F.count(F.lit(1)).alias("n"), F.count("body_method").alias("fetched"))


# ---- attachments -------------------------------------------------------------------------------------------------------
@query("p3_member_meta", f"WITH {A} SELECT seq, 'Name ' || seq % 4 AS member_name_en, 'Name ' || seq % 4 AS speaker_raw, 100 AS member_match_score, 'Yonhap Infomax' AS source, 'INFOMAX' AS source_type, CAST(seq % 4 = 0 AS INTEGER) AS member_voter FROM a")
def p3(spark, sf):
    members = spark.range(4).select(F.col("id").alias("member_id"), text("Name ", F.col("id")).alias("name_en"), (F.col("id") == 0).cast("int").alias("voter"))
    out = attach.attach_member(articles(spark, sf).withColumn("member_id", F.col("seq") % 4), members)
    return out.select("seq", "member_name_en", "speaker_raw", "member_match_score", "source", "source_type", "member_voter")


@query("p6_crossed_dates", f"WITH {A} SELECT seq, CASE WHEN seq % 3 = 0 THEN '2020-01-01' ELSE published_at END AS published_at, CASE WHEN seq % 2 = 0 THEN '2020-01-01' ELSE '2021-02-02' END AS date FROM a")
def p6(spark, sf):
    a = articles(spark, sf).withColumn("published_at", F.when(F.col("seq") % 3 == 0, "").otherwise(F.col("published_at"))).withColumn("date", F.when(F.col("seq") % 2 != 0, "2021-02-02"))
    return attach.crossed_dates(a, F.lit("2020-01-01")).select("seq", "published_at", "date")


_MOMENTUM = f"""mo AS (SELECT *, row_number() OVER (PARTITION BY member ORDER BY d DESC, seq) AS rn FROM u WHERE relevance IN ('HIGH', 'MEDIUM') AND score IS NOT NULL),
mc AS (SELECT member, count(*) AS c, avg(score) FILTER (rn <= 3) AS a3, avg(score) FILTER (rn BETWEEN 4 AND 6) AS b3, avg(score) FILTER (rn <= 2) AS a2, avg(score) FILTER (rn BETWEEN 3 AND 4) AS b2 FROM mo GROUP BY member),
mm AS (SELECT m.member, coalesce(c, 0) AS c, CASE WHEN c >= 6 THEN a3 WHEN c >= 4 THEN a2 END AS a, CASE WHEN c >= 6 THEN b3 WHEN c >= 4 THEN b2 END AS b, CASE WHEN c >= 6 THEN 3 WHEN c >= 4 THEN 2 ELSE 0 END AS k FROM (SELECT DISTINCT member FROM u) m LEFT JOIN mc USING (member)),
momentum AS (SELECT member, a - b AS momentum_score, CASE WHEN a - b >= 3 THEN 'STRONG_HAWKISH_SHIFT' WHEN a - b >= 1 THEN 'HAWKISH_SHIFT' WHEN a - b <= -3 THEN 'STRONG_DOVISH_SHIFT' WHEN a - b <= -1 THEN 'DOVISH_SHIFT' WHEN a IS NOT NULL THEN 'STABLE' ELSE 'INSUFFICIENT' END AS momentum_label,
  CASE k WHEN 3 THEN 'HIGH' WHEN 2 THEN 'LOW' ELSE 'INSUFFICIENT' END AS momentum_confidence, a AS momentum_recent_avg, b AS momentum_previous_avg, CAST(k AS BIGINT) AS momentum_recent_count, CAST(k AS BIGINT) AS momentum_previous_count, c AS momentum_total_important_count FROM mm)"""
_MOMENTUM_COLUMNS = ("momentum_score", "momentum_label", "momentum_confidence", "momentum_recent_avg", "momentum_previous_avg", "momentum_recent_count", "momentum_previous_count", "momentum_total_important_count")


@query("p9_own_momentum", f"WITH {U}, {_MOMENTUM} SELECT u.seq, {', '.join(_MOMENTUM_COLUMNS)} FROM u LEFT JOIN momentum USING (member)")
def p9(spark, sf):
    return attach.own_momentum(utterances(spark, sf), None).select("seq", *_MOMENTUM_COLUMNS)


@query("p10_momentum_results", f"WITH {U}, {_MOMENTUM} SELECT u.seq, momentum_score, coalesce(CASE WHEN member % 2 = 0 THEN momentum_label END, 'INSUFFICIENT') AS momentum_label, coalesce(CASE WHEN member % 2 = 0 THEN momentum_recent_count END, 0) AS momentum_recent_count FROM u LEFT JOIN (SELECT * FROM momentum WHERE member % 2 = 0) USING (member)")
def p10(spark, sf):
    u = utterances(spark, sf)
    return attach.attach_momentum(u, S.momentum(u, None).filter("member % 2 = 0")).select("seq", "momentum_score", "momentum_label", "momentum_recent_count")


@query("p10_cross_checks", f"WITH {U}, {_NEWS} SELECT u.seq, news_score, coalesce(news_label, 'INSUFFICIENT') AS news_label, coalesce(news_usable_count, 0) AS news_usable_count, coalesce(news_confidence, 'LOW') AS news_confidence, 'NEWS_INSUFFICIENT' AS cross_check FROM u LEFT JOIN (SELECT * FROM news WHERE member % 3 = 0) USING (member)")
def p10c(spark, sf):
    u = utterances(spark, sf)
    news = S.news_score(u.filter("source_type = 'NEWS'"), None).filter("member % 3 = 0").withColumn("cross_check", F.lit(None).cast("string"))
    return attach.attach_cross_checks(u, news).select("seq", "news_score", "news_label", "news_usable_count", "news_confidence", "cross_check")


@query("a2b_settled_stance", f"WITH {U}, {_CURRENT} SELECT member, coalesce(speech_score, 0.0) AS speech_score, CASE WHEN speech_score IS NULL THEN 'NEUTRAL' ELSE speech_label END AS speech_label, sample_count FROM cur")
def a2b(spark, sf):
    u = utterances(spark, sf)
    return attach.settled_stance(S.current_stance(u, digits=None))


@query("p8_all_signals", f"""WITH {U}, {_CURRENT}, {_FINAL}, {_MOMENTUM} SELECT u.seq, u.d, u.score, u.relevance, u.source_type, u.preferred, coalesce(model_stance, 'INSUFFICIENT') AS model_stance, model_score, coalesce(model_confidence, 'INSUFFICIENT') AS model_confidence, coalesce(evidence_count, 0) AS model_evidence_count,
  coalesce(recent_signal, 'INSUFFICIENT') AS recent_signal, recent_score AS recent_signal_score, coalesce(recent_confidence, 'INSUFFICIENT') AS recent_signal_confidence, 7 AS recent_lookback_days,
  ax.aux_score AS aux_speech_score, {stance_sql('ax.aux_score', missing='INSUFFICIENT')} AS aux_speech_label, coalesce(recent.aux_count, 0) AS aux_speech_count,
  news.news_score AS recent_news_score, coalesce(news_label, 'INSUFFICIENT') AS recent_news_label, coalesce(news_confidence, 'LOW') AS recent_news_confidence, coalesce(recent.news_usable_count, 0) AS recent_news_usable_count,
  coalesce(final_stance, 'INSUFFICIENT') AS final_stance, final_score, coalesce(final_confidence, 'INSUFFICIENT') AS final_confidence, coalesce(model_weight, 0) AS final_model_weight, coalesce(recent_weight, 0) AS final_recent_weight, coalesce(signal_conflict, false) AS final_signal_conflict, coalesce(final_reason, '{S.REASONS['none']}') AS final_reason,
  {', '.join(_MOMENTUM_COLUMNS)}, speech_score AS speech_current_score, speech_label AS speech_current_label, sample_count AS speech_sample_count,
  news.news_score, coalesce(news_label, 'INSUFFICIENT') AS news_label, coalesce(news_count, 0) AS news_count, coalesce(news.news_usable_count, 0) AS news_usable_count, coalesce(news_confidence, 'LOW') AS news_confidence
FROM u LEFT JOIN final USING (member) LEFT JOIN model USING (member) LEFT JOIN recent USING (member) LEFT JOIN ax USING (member) LEFT JOIN news USING (member) LEFT JOIN momentum USING (member) LEFT JOIN cur USING (member)""")
def p8(spark, sf):
    return attach_signals(utterances(spark, sf), _eligible(), F.col("source_type") == "NEWS", _as_of(), 7, digits=None).drop("member")


@query("q1_speaker_summary", f"WITH {U}, {_FINAL}, f AS (SELECT member, seq, d, score, relevance FROM u QUALIFY row_number() OVER (PARTITION BY member ORDER BY seq) = 1) SELECT f.*, 'Name ' || member AS name, final_score, model_score, row_number() OVER (ORDER BY final_score DESC NULLS LAST, model_score DESC NULLS LAST, member) AS place FROM f LEFT JOIN final USING (member) LEFT JOIN model USING (member)")
def q1(spark, sf):
    from pyspark.sql import Window as W

    from .serve import speaker_summary
    from .signal_queries import all_signals

    u = utterances(spark, sf)
    results = all_signals(u).select("member", "final_score", "model_score")
    out = speaker_summary(u, results, S.members_of(u).withColumn("name", text("Name ", F.col("member"))))
    order = W.orderBy(F.col("final_score").desc_nulls_last(), F.col("model_score").desc_nulls_last(), "member")
    return out.withColumn("place", F.row_number().over(order).cast("long"))


@query("c1_repaired_text", f"WITH {O} SELECT k, 'It’s “' || k || '” – x — y' AS t FROM i")
def c1(spark, sf):
    return items(spark, sf).select("k", C.clean_text(text(" Itâ€™s  â€œ", F.col("k"), "â€\x9d â€“  xÂ\n â€” y ")).alias("t"))


@query("c17_article_paragraphs", f"WITH {O} SELECT k, 'First paragraph, number ' || k || ' & more' || chr(10) || 'Another one of some length' AS body FROM i")
def c17(spark, sf):
    page = text("<p>Outside of the article, long enough</p><article class='x'><p>First paragraph, number ", F.col("k"), " &amp; more</p><p>Short</p><p id=q>FIRST <b>paragraph,</b> number ", F.col("k"), " &amp; MORE</p><p>Another one of some length</article><p>Also outside, and long enough too</p>")
    return items(spark, sf).select("k", P.paragraphs(page).alias("body"))


@query("c17_selectors", f"""WITH {O} SELECT k, CASE WHEN k % 6 = 5 THEN 'Above of all that counts ' || k || chr(10) ELSE '' END || 'Body of the page number ' || k || chr(10) || 'Nested in it, number ' || k || CASE WHEN k % 6 = 5 THEN chr(10) || 'Below of all that counts ' || k ELSE '' END AS body FROM i""")
def c17_selectors(spark, sf):
    k = F.col("k")
    begin = F.when(k % 6 == 0, "<div class='x content y'>").when(k % 6 == 1, "<div id=article class=q>").when(k % 6 == 2, "<div class='col-sm-8 col-xs-12'>").when(k % 6 == 3, "<section class=story><div data-x='a>b' class='inner wide'>").when(k % 6 == 4, "<main><div>").otherwise("<div class='contents'>")
    end = F.when(k % 6 == 3, "</div></section>").when(k % 6 == 4, "</div></main>").otherwise("</div>")
    page = text("<body><p>Above of all that counts ", k, "</p>", begin, "<p>Body of the page number ", k, "<div><div><p>Nested in it, number ", k, "</p></div></div><p>Short</p>", end, "<div class=inner><p>Below of all that counts ", k, "</p></div></body>")
    board, plain = F.lit("Federal Reserve Board"), F.lit(None).cast("string")
    own = {"Federal Reserve Board": P.SOURCE_SELECTORS["Federal Reserve Board"], "story": ("section.story > .inner.wide", "article")}
    return items(spark, sf).select("k", P.paragraphs(page, source=F.when(k % 6 == 2, board).when(k % 6 == 3, "story").otherwise(plain), by_source=own).alias("body"))


@query("p4_defaults", f"WITH {O} SELECT k, CASE WHEN k % 3 = 0 THEN 'given' ELSE '' END AS source, CASE WHEN k % 2 = 0 THEN 'REGIONAL' ELSE 'OFFICIAL' END AS source_type, '' AS text FROM i")
def p4(spark, sf):
    k = F.col("k")
    rows = items(spark, sf).select(
        k.alias("seq"), text("https://x.org/", k).alias("url"), F.lit("2008-01-01").alias("published_at"), F.lit("T").alias("title"), F.when(k % 3 == 0, "given").when(k % 3 == 1, "").alias("source"),
        F.when(k % 2 == 0, "REGIONAL").when(k % 4 == 1, "").alias("source_type"), F.lit(None).cast("string").alias("speaker_raw"), F.when(k % 5 == 0, "").alias("text"),
    )
    return K.all_sources(rows).select(F.col("seq").alias("k"), "source", "source_type", "text")


@query("j5_event_identity", f"WITH {U}, w AS (SELECT *, CASE WHEN seq % 3 = 0 THEN CAST(seq AS VARCHAR) ELSE CAST(d AS VARCHAR) || '|' || relevance || seq % 5 END AS identity FROM u), e AS (SELECT * FROM w WHERE relevance = 'MEDIUM' QUALIFY row_number() OVER (PARTITION BY member ORDER BY d DESC, seq) <= 3), x AS (SELECT * FROM w WHERE relevance IN ('MEDIUM', 'LOW') AND NOT EXISTS (SELECT 1 FROM e WHERE e.member = w.member AND e.identity = w.identity) QUALIFY row_number() OVER (PARTITION BY member ORDER BY d DESC, seq) <= 5) SELECT member, avg(score) AS aux_score, count(*) AS aux_count FROM x GROUP BY member")
def j5(spark, sf):
    u = utterances(spark, sf)
    w = u.withColumn("identity", S.event_identity(F.when(F.col("seq") % 3 == 0, F.col("seq")), F.col("d"), text(F.col("relevance"), F.col("seq") % 5)))
    used = S.newest(w.filter("relevance = 'MEDIUM'"), 3)
    return S.auxiliary_speech(w, used, F.lit("2024-12-31").cast("date"), 100_000, digits=None, identity="identity")


@query("a8_undated_clusters", f"WITH {U} SELECT member, CASE WHEN seq % 4 = 0 THEN 'UNKNOWN_DATE' ELSE CAST(d AS VARCHAR) END AS cluster_date, sum(score * CASE WHEN preferred THEN 15 ELSE 10 END) / CAST(sum(CASE WHEN preferred THEN 15 ELSE 10 END) AS DOUBLE) AS cluster_score, count(*) AS article_count, count(*) FILTER (preferred) AS preferred_count FROM u WHERE source_type = 'NEWS' AND score <> 0 GROUP BY 1, 2")
def a8(spark, sf):
    u = utterances(spark, sf).filter("source_type = 'NEWS'").withColumn("d", F.when(F.col("seq") % 4 != 0, F.col("d")))
    return S.news_clusters(u, None).drop("cluster_label")


@query("f18_grid_stances", f"WITH {A}, b AS (SELECT *, seq % 9 - 4 AS score FROM a) SELECT seq FROM b WHERE source_type = 'NEWS' AND score >= 1 AND source IN ('src1', 'src2', 'src5') AND contains(lower(title), 'an')")
def f18(spark, sf):
    a = articles(spark, sf).withColumns({"relevance": F.col("source_type"), "speaker": F.col("source"), "stance": C.stance(F.col("seq") % 9 - 4)})
    return a.filter(filters.grid(["NEWS"], ["HAWKISH", "NEUTRAL_HAWKISH"], ["src1", "src2", "src5"], "An")).select("seq")


@query("x13_customer_terms", "SELECT c_custkey, 'Ann ' || c_mktsegment || '|코' || c_custkey || '|chair|a1|b' || c_custkey || '|' || c_mktsegment AS terms FROM customer")
def x13(spark, sf):
    key = F.col("c_custkey")
    terms = search_terms(text("Ann ", F.col("c_mktsegment")), text("코", key), F.lit("chair"), F.lit(" "), text(" a1 | |b", key, "|chair"))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(terms, "|").alias("terms"))


@query("c24_date_policies", f"WITH {O} SELECT k, CASE WHEN k % 5 <> 0 AND k % 3 = 0 THEN strftime(d, '%Y-%m-%d') ELSE strftime(d - 1, '%Y-%m-%d') END AS event, CASE WHEN k % 5 = 0 THEN 'soon' WHEN k % 3 = 0 THEN strftime(d, '%Y-%m-%d') ELSE strftime(d - 1, '%Y-%m-%d') END AS model, strftime(d - 1, '%Y-%m-%d') AS export FROM i")
def c24(spark, sf):
    k, iso = F.col("k"), lambda c: F.date_format(c, "yyyy-MM-dd")
    rows = items(spark, sf).select(k, F.when(k % 5 == 0, "soon").when(k % 3 == 0, iso("d")).otherwise("").alias("actual_speech_date"), F.concat(iso(F.date_sub("d", 1)), F.lit("T09:00")).alias("published_at"))
    have = rows.columns
    return rows.select("k", D.resolved("event", have).alias("event"), F.substring(D.resolved("model", have), 1, 10).alias("model"), D.resolved("export", have).alias("export"))


@query("f11_signal_windows", f"WITH {O}, g AS (SELECT k, k % 500 AS g FROM i) SELECT k, g + 11 <= 250 AS before, g + 11 <= 450 AS after, k % 2 = 0 AS quoted FROM g")
def f11(spark, sf):
    k = F.col("k")
    gap = F.expr("repeat('x', cast(k % 500 as int))")
    told = lambda title, body: filters.direct_member_signal(title, body, ["Powell"], veto=["photo"], verbs=["said"], policy=["rate"])
    quote = F.when(k % 4 == 0, "Powell “steady”").when(k % 4 == 1, "Powell “steady”, a photo").when(k % 4 == 2, "“Go on”, Powell").otherwise("“Go on”, all")
    return items(spark, sf).select("k", told(F.lit(""), text("said rate ", gap, " Powell")).alias("before"), told(F.lit(""), text("Powell ", gap, " said rate")).alias("after"), told(quote, F.lit("")).alias("quoted"))
