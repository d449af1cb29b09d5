"""Crawls and searches as plans over tables of pages and feeds: link contexts, source variants, fall-backs, unions.

Fetching is outside; what a fetch gave is a table.  A row that cannot be read gives nulls, so one broken page or source never
stops the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.columns import any_of, clean_text, first_filled, markup_free
from ..functions.dates import english_date, iso_date, rss_date, spoken_date, url_date, year_of
from ..operators.fuzzy import ranked_containment
from ..functions.phrases import found_terms
from ..operators.filters import direct_member_signal, direct_term_signal, in_year, mentions, news_relevant, same_site, usable_link
from ..operators.score import quality_points
from .pages import REGISTRY, absolute_url, feed_items, links
from .tree import contexts

#: Titles of sections, which are no speeches.
SECTION_TITLES = ("monetary policy", "banking & financial markets", "macroeconomics", "regional economics", "the economy", "research", "speeches")
#: Elements whose text is a link's context, and the most characters that one may have.
CONTEXT_ELEMENTS, CONTEXT_CHARS = ("article", "li", "section", "div"), 2000


def link_contexts(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, base, pos, href, text, context) of all anchors: the context is the text of the elements around a link, each once,
    without those that are too long."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(k, base, pos, *row) for k, base, page in zip(*(c.to_pylist() for c in b.columns)) for pos, row in enumerate(contexts(page or "", CONTEXT_ELEMENTS, CONTEXT_CHARS))]
            columns = list(zip(*out)) if out else [()] * 6
            types = (b.schema.field(0).type, pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["k", "base", "pos", "href", "text", "context"])

    rows = pages.select(F.col(key).alias("k"), F.col(url).cast("string").alias("base"), F.col(html).alias("html"))
    return rows.mapInArrow(run, f"k {kind}, base string, pos int, href string, text string, context string").withColumnRenamed("k", key)


def member_named(text: Column, terms: Column) -> Column:
    """Whether a context names a member by any of the terms: names, a surname of four letters or more, aliases, role."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return (low != "") & F.exists(F.filter(terms, lambda t: F.trim(t) != ""), lambda t: low.contains(F.lower(t)))


def canonical(source: Column, title: Column, url: Column, published: Column, speaker: Column, text: Column) -> list[Column]:
    """The columns of a crawled row."""
    return [published.alias("published_at"), clean_text(title).alias("title"), speaker.alias("speaker_raw"), url.alias("url"), source.alias("source"), F.lit("OFFICIAL").alias("source_type"), F.coalesce(text, F.lit("")).alias("text")]


def once_per_url(df: DataFrame, key: Column, *order: str) -> DataFrame:
    w = W.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def speech_list(pages: DataFrame, registry=REGISTRY, members: Column | None = None, key: str = "page_id", source: str = "source", least: int = 3) -> DataFrame:
    """Speeches on list pages of all sources of a registry, in one pass: links that hold what the source's speeches hold, on
    its own site, with a title, and, where the source asks for it, with a member named around the link.

    pages have a column naming their source; pages of no registered source go.  The date is the URL's, else the title's or the
    context's.
    """
    config = pages.sparkSession.createDataFrame([(s, b, p, m) for s, b, p, m in registry], "_source string, _base string, _part string, _member boolean")
    rows = link_contexts(pages, key).join(pages.select(key, F.col(source).alias("_source"), *([members.alias("_terms")] if members is not None else [])), key)
    rows = rows.join(F.broadcast(config), "_source")  # a row for each source of the registry
    rows = rows.withColumn("url", absolute_url(F.col("_base"), F.col("href")))
    ok = usable_link(F.col("href"), [""]) & F.lower("href").contains(F.lower("_part")) & same_site(F.col("url"), F.col("_base")) & (F.length("text") >= least)
    if members is not None:
        ok = ok & (~F.col("_member") | member_named(F.col("context"), F.col("_terms")))
    date = F.coalesce(url_date(F.col("url")), english_date(F.col("text")), english_date(F.col("context")))
    return once_per_url(rows.filter(ok), F.col("url"), key, "pos").select(key, *canonical(F.col("_source"), F.col("text"), F.col("url"), date, F.lit(None).cast("string"), F.lit("")))


def dated_paths(pages: DataFrame, year: int, speaker: str, source: str = "Philadelphia Fed", base: str = "https://www.philadelphiafed.org", key: str = "page_id") -> DataFrame:
    """The variant whose paths hold a section and YYMMDD: rows of one year, without titles of sections, one each URL."""
    rows = links(pages, key).withColumn("_d", F.regexp_extract("href", r"(?i)/the-economy/[^/]+/(\d{6})[-/]", 1)).filter("_d <> ''")
    part = lambda at: F.substring("_d", at, 2).try_cast("int")
    rows = rows.filter((part(1) + 2000 == year) & part(3).between(1, 12) & part(5).between(1, 31))
    rows = rows.withColumn("url", absolute_url(F.lit(base), F.trim("href"))).withColumn("title", clean_text(F.col("text")))
    rows = rows.filter((F.col("title") != "") & ~F.lower("title").isin(*SECTION_TITLES))
    date = F.format_string("%04d-%02d-%02d", part(1) + 2000, part(3), part(5))
    return once_per_url(rows, F.col("url"), key, "pos").select(key, *canonical(F.lit(source), F.col("title"), F.col("url"), date, F.lit(speaker), F.lit("")))


def first_branch(branches: list[tuple[str, DataFrame]], by: str) -> DataFrame:
    """For each value of `by` the rows of the first branch that has any, with the branch's name: main page, feed, profile or
    sitemap in the order in which a source is tried."""
    tagged = None
    for k, (name, b) in enumerate(branches):
        b = b.withColumn("branch", F.lit(name)).withColumn("_b", F.lit(k))
        tagged = b if tagged is None else tagged.unionByName(b, allowMissingColumns=True)
    least = tagged.groupBy(by).agg(F.min("_b").alias("_least"))
    return tagged.join(least, by).filter("_b = _least").drop("_b", "_least")


def sitemap_urls(maps: DataFrame, xml: str = "xml") -> DataFrame:
    """(…, url, modified) of sitemap texts: one row a URL, told apart without case and closing slashes, the newest date."""
    entries = F.regexp_extract_all(F.coalesce(F.col(xml), F.lit("")), F.lit(r"(?is)<url\b[^>]*>(.*?)</url>"), F.lit(1))
    rest = [c for c in maps.columns if c != xml]
    rows = maps.select(*rest, F.posexplode(entries).alias("pos", "_e"))
    field = lambda tag: markup_free(F.regexp_extract("_e", rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1))
    rows = rows.select(*rest, "pos", field("loc").alias("url"), F.date_format(iso_date(field("lastmod")), "yyyy-MM-dd").alias("modified")).filter("url <> ''")
    same = F.rtrim(F.lower("url"), F.lit("/"))
    w = W.partitionBy(*rest, same).orderBy(F.col("modified").desc_nulls_last(), "pos")
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select(*rest, same.alias("url"), "modified")


def all_sources(rows: DataFrame, year: int | None = None, key: str = "seq") -> DataFrame:
    """Crawled rows of all sources as one list: defaults filled, rows of another year gone (rows of no known year stay), of
    each URL the fullest, newest first and undated last."""
    filled = rows.withColumns({
        "source": F.coalesce(first_filled(F.col("source")), F.lit("")), "source_type": F.coalesce(first_filled(F.col("source_type")), F.lit("OFFICIAL")),
        "text": F.coalesce("text", F.lit("")), "speaker_raw": first_filled(F.col("speaker_raw")),
    })
    if year is not None:
        filled = filled.filter(in_year(year_of(F.col("published_at"), F.col("url")), year))
    points = quality_points(F.col("published_at"), F.col("speaker_raw"), F.col("title"), F.col("text"))
    has = F.coalesce(F.col("url"), F.lit("")) != ""
    w = W.partitionBy("url").orderBy(points.desc(), key)
    best = filled.filter(has).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn").unionByName(filled.filter(~has))
    return best.orderBy(F.coalesce("published_at", F.lit("0000-00-00")).desc(), key)


def news_search(feeds: DataFrame, as_of: Column, days: int = 90, most: int = 10, outlets=L.PREFERRED_OUTLETS, member: str = "member", terms: Column | None = None) -> DataFrame:
    """News on members out of feed texts (member, xml): items of the look-back, titles without their outlet, that name the member
    and speak of policy; of like headlines the first by outlet and date, at most so many a member."""
    items = feed_items(feeds).withColumn("_at", rss_date(F.col("published")))
    items = items.filter(F.col("_at").isNull() | (F.col("_at") >= F.date_sub(as_of, days)))
    suffix = F.concat(F.lit(" - "), F.col("source"))
    items = items.withColumn("title", F.when((F.col("source") != "") & F.endswith("title", suffix), F.trim(F.substring(F.col("title"), F.lit(1), F.length("title") - F.length(suffix)))).otherwise(F.col("title")))
    named = mentions(F.concat_ws(" ", "title", "description"), terms if terms is not None else F.array(F.lower(F.col(member).cast("string"))))
    items = items.filter((F.col("title") != "") & named & news_relevant(F.col("title"), F.col("description")))
    rows = items.select(F.col(member).alias("member"), F.col("pos").alias("seq"), "title", "description", "url", "source", F.date_format("_at", "yyyy-MM-dd").alias("published_at"), F.col("source").isin(*outlets).alias("preferred"))
    return ranked_containment(rows, most)


def _wire_reports(candidates: DataFrame, year: int | None) -> DataFrame:
    """Reports of the wire service on policy, one each URL, of the year, with the day of the speech and the text to search."""
    rows = candidates.filter(F.col("source").contains("인포맥스") | F.col("source").contains("Infomax")).filter(F.coalesce("url", F.lit("")) != "")
    rows = once_per_url(rows, F.col("url"), "seq").withColumn("title", F.trim(F.replace(F.coalesce("title", F.lit("")), F.lit(" - 연합인포맥스"), F.lit(""))))
    rows = rows.withColumn("actual_speech_date", spoken_date(F.col("text"), F.col("published_at")))
    day = F.coalesce("actual_speech_date", "published_at")
    if year is not None:
        rows = rows.filter(F.coalesce(day, F.lit("")).isin("") | F.startswith(day, F.lit(str(year))))
    rows = rows.withColumn("_both", F.lower(F.concat_ws(" ", "title", "text")))
    return rows.filter(any_of(F.col("_both"), [p.lower() for p in L.WIRE_POLICY]))


_WIRE = {"source": "Yonhap Infomax", "source_type": "INFOMAX", "matched": True}


def wire_search(candidates: DataFrame, terms: list[str], year: int | None = None, most: int | None = 20) -> DataFrame:
    """Wire reports of a member's own words out of fetched candidates (seq, source, url, title, text, published_at): of the
    wire service, one each URL, of the year, naming the member, on policy, in direct speech; so many at most in the order of the
    search, the newest first."""
    rows = _wire_reports(candidates, year)
    rows = rows.filter(any_of(F.col("_both"), [t.lower() for t in terms]) & direct_member_signal(F.col("title"), F.col("text"), terms)).drop("_both")
    found = (rows if most is None else rows.orderBy("seq").limit(most)).withColumns({k: F.lit(v) for k, v in _WIRE.items()})
    return found.orderBy(F.coalesce(F.coalesce("actual_speech_date", "published_at"), F.lit("")).desc(), "seq")


#: Terms of a roster that make one automaton; a larger roster is gone through in slices of so many.
TERM_SLICE = 50_000


def wire_search_all(candidates: DataFrame, members: DataFrame, year: int | None = None, most: int | None = 20) -> DataFrame:
    """wire_search() for all members (member, terms) in one plan: (member, the report's columns), so many a member at most.

    Reports are cleaned once and read once for all terms; only the terms that a report holds meet their members.
    """
    reports = _wire_reports(candidates, year)
    terms = members.select("member", F.explode("terms").alias("t")).select("member", F.lower("t").alias("term")).filter(F.trim("term") != "").distinct()
    slices = max(1, -(-terms.select("term").distinct().count() // TERM_SLICE))
    held = None
    for k in range(slices):
        mine = terms.select("term").distinct().filter(F.pmod(F.xxhash64("term"), F.lit(slices)) == k)
        one = reports.withColumn("term", F.explode(found_terms(F.col("_both"), [r.term for r in mine.collect()])))  # a slice of the roster
        held = one if held is None else held.unionByName(one)
    direct = held.filter(direct_term_signal(F.col("title"), F.col("text"), F.col("term"))).drop("_both")
    found = direct.join(terms, "term").drop("term").dropDuplicates(["member", "seq"]).withColumns({k: F.lit(v) for k, v in _WIRE.items()})
    if most is not None:
        found = found.withColumn("_rn", F.row_number().over(W.partitionBy("member").orderBy("seq"))).filter(F.col("_rn") <= most).drop("_rn")
    return found.orderBy("member", F.coalesce(F.coalesce("actual_speech_date", "published_at"), F.lit("")).desc(), "seq")


def fetched_bodies(articles: DataFrame, bodies: DataFrame, levels: tuple[str, ...] = ("HIGH", "MEDIUM", "LOW"), most: int | None = None, least: int = 100, order: str = "seq") -> DataFrame:
    """articles with text, body_method and body_fetched: those of the wanted relevance (the first so many, if a cap is given) take
    the fetched body (url, body) where their own text is too short; all rows stay."""
    own = F.length(F.trim(F.coalesce("text", F.lit("")))) >= least
    rows = articles.withColumn("_want", F.coalesce(F.col("relevance").isin(*levels), F.lit(False)))
    if most is not None:
        first = rows.filter("_want").orderBy(order).limit(most).select(order, F.lit(True).alias("_in"))  # the cap is the feature
        rows = rows.join(first, order, "left").withColumn("_want", F.coalesce("_in", F.lit(False))).drop("_in")
    rows = rows.join(bodies.select("url", F.col("body").alias("_body")), "url", "left")
    long = F.length(F.trim(F.coalesce("_body", F.lit("")))) >= least
    method = F.when(~F.col("_want"), F.lit(None).cast("string")).when(own, "EXISTING").when(long, "DIRECT").otherwise("FAILED")
    return rows.withColumn("body_method", method).withColumn("text", F.when(method == "DIRECT", F.trim("_body")).otherwise(F.col("text"))).withColumn("body_fetched", method.isin("EXISTING", "DIRECT")).select(*articles.columns, "body_method", "body_fetched")
