"""Rows from raw pages and feeds: links, dates, article text, feed items, and fallbacks between sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clean_text, let, markup_free
from ..functions.dates import english_date, url_date
from ..operators.filters import same_site, usable_link
from .tree import paragraph_texts

#: List pages by source, what their links hold, and whether a member must be named beside a link.
REGISTRY = (
    ("Dallas Fed", "https://www.dallasfed.org", "/news/speeches/", False),
    ("Cleveland Fed", "https://www.clevelandfed.org", "/speeches", False),
    ("Minneapolis Fed", "https://www.minneapolisfed.org", "/speeches/", False),
    ("Chicago Fed", "https://www.chicagofed.org", "/publications/speeches/", False),
    ("Boston Fed", "https://www.bostonfed.org", "/speeches/", False),
    ("Richmond Fed", "https://www.richmondfed.org", "/press_room/speeches/", False),
    ("New York Fed", "https://www.newyorkfed.org", "/newsevents/speeches/", False),
    ("San Francisco Fed", "https://www.frbsf.org", "/speeches/", False),
    ("Philadelphia Fed", "https://www.philadelphiafed.org", "/the-economy/", False),
    ("Kansas City Fed", "https://www.kansascityfed.org", "/speeches/", True),
    ("St. Louis Fed", "https://www.stlouisfed.org", "/from-the-president/remarks", False),
)


def absolute_url(base: Column, href: Column) -> Column:
    """A link as seen from a page: whole, host-relative, root-relative or relative to the page's folder."""
    h = F.trim(F.coalesce(href, F.lit("")))
    root = F.regexp_extract(base, r"^(\w+://[^/?#]+)", 1)
    path = F.regexp_extract(F.regexp_extract(base, r"^(\w+://[^?#]*)", 1), r"^(\w+://[^/]+(?:/.*/|/|$))", 1)
    folder = F.when(F.endswith(path, F.lit("/")), path).otherwise(F.concat(path, F.lit("/")))
    return F.when(h.rlike(r"^\w[\w+.-]*:"), h).when(F.startswith(h, F.lit("//")), F.concat(F.regexp_extract(base, r"^(\w+:)", 1), h)).when(F.startswith(h, F.lit("/")), F.concat(root, h)).otherwise(F.concat(folder, h))


def links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page, pos, href, text) of all anchors, in order."""
    h = F.coalesce(F.col(html), F.lit(""))
    anchor = F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']+)[^>]*>.*?</a>""")
    rows = pages.select(key, F.col(url).alias("base"), F.posexplode(F.regexp_extract_all(h, anchor, F.lit(0))).alias("pos", "a"))
    head = F.regexp_extract("a", r"""(?is)^<a\s[^>]*?href\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", 1)
    inner = F.regexp_replace(F.regexp_replace("a", r"""(?is)^<a\s[^>]*?href\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']+)[^>]*>""", ""), r"(?i)</a>$", "")
    return rows.select(key, "base", "pos", F.regexp_replace(head, "^[\"']|[\"']$", "").alias("href"), markup_free(inner).alias("text"))


def speech_links(pages: DataFrame, parts: list[str], base: Column, least: int = 3, key: str = "page_id") -> DataFrame:
    """Links on the page's own site that hold any of the parts and a title, one row each URL, with the URL's date."""
    rows = links(pages, key).withColumn("url", absolute_url(F.col("base"), F.col("href")))
    rows = rows.filter(usable_link(F.col("href"), parts) & same_site(F.col("url"), base) & (F.length("text") >= least))
    first = rows.groupBy("url").agg(F.min_by(F.struct(key, "text"), F.struct(key, "pos")).alias("f"))
    return first.select("url", F.col("f.text").alias("title"), F.col(f"f.{key}").alias(key), url_date(F.col("url")).alias("published_at")).orderBy(F.col("published_at").desc_nulls_last(), "url")


#: Where the body of a page stands, in the order of the search, by default and by source.
SELECTORS = ("article", "main", ".article-content", ".entry-content", ".page-content", ".body-content", ".content", "#article", "#content")
SOURCE_SELECTORS = {
    "Federal Reserve Board": ("#article", ".col-xs-12.col-sm-8.col-md-8", ".col-xs-12.col-sm-8", "article", "main"),
    "Dallas Fed": ("article", "main", ".article-content", ".content", "#content"),
    "Cleveland Fed": ("article", "main", ".article-content", ".content", "#content"),
    "Minneapolis Fed": ("article", "main", ".article-content", ".entry-content", ".content", "#content"),
    "Chicago Fed": ("article", "main", ".article-content", ".content", "#content"),
    "Boston Fed": ("article", "main", ".article-content", ".content", "#content"),
    "Kansas City Fed": ("article", "main", ".article-content", ".content", "#content"),
    "Richmond Fed": ("article", "main", ".article-content", ".content", "#content"),
    "St. Louis Fed": ("article", "main", ".article-content", ".content", "#content"),
    "New York Fed": ("article", "main", ".article-content", ".content", "#content"),
    "Philadelphia Fed": ("article", "main", ".article-content", ".content", "#content"),
    "San Francisco Fed": ("article", "main", ".article-content", ".entry-content", ".content", "#content"),
}


def paragraphs(html: Column, least: int = 20, selectors: tuple[str, ...] = SELECTORS, source: Column | None = None, by_source=SOURCE_SELECTORS) -> Column:
    """Text of the body's paragraphs of at least `least` characters, each once whatever its case, one a line.

    The body is the first element that the first fitting selector takes, or the page; a source may have a list of its own.
    """
    lists = F.array(*(F.lit(s) for s in selectors))
    if source is not None:
        for name, own in by_source.items():
            lists = F.when(source == name, F.array(*(F.lit(s) for s in own))).otherwise(lists)
    long = F.filter(F.transform(paragraph_texts(html, lists), clean_text), lambda t: F.length(t) >= least)
    return let(long, lambda x: F.array_join(F.filter(x, lambda t, i: F.array_position(F.transform(x, F.lower), F.lower(t)) == i + 1), "\n"))


def heading(html: Column, closed: bool = False) -> Column:
    """The first h1, else the title element; `closed`: character references count with their semicolon only."""
    h = F.coalesce(html, F.lit(""))
    return F.coalesce(*(F.nullif(markup_free(F.regexp_extract(h, rf"(?is)<{t}\b[^>]*>(.*?)</{t}>", 1), closed), F.lit("")) for t in ("h1", "title")))


def page_date(html: Column) -> Column:
    """The date that a meta element or a time element gives, else the first that the page's text spells out."""
    h = F.coalesce(html, F.lit(""))
    meta = F.regexp_extract(h, r'(?is)<meta[^>]+(?:published_time|pubdate|dc\.date|"date")[^>]*content="(\d{4}-\d{2}-\d{2})', 1)
    turned = F.regexp_extract(h, r'(?is)<meta[^>]+content="(\d{4}-\d{2}-\d{2})[^"]*"[^>]*(?:published_time|pubdate|dc\.date|"date")', 1)
    time = F.regexp_extract(h, r'(?is)<time[^>]+datetime="(\d{4}-\d{2}-\d{2})', 1)
    return F.coalesce(F.nullif(meta, F.lit("")), F.nullif(turned, F.lit("")), F.nullif(time, F.lit("")), english_date(markup_free(h)))


def reader_text(c: Column) -> Column:
    """A text reader's output without its header lines."""
    lines = F.filter(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: ~F.trim(x).rlike(r"^(Title|URL Source|Published Time|Markdown Content|Warning):"))
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", "")


def feed_items(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """Items of RSS texts: title, link, source, published (as written), description."""
    fields = {"title": "title", "url": "link", "source": "source", "published": "pubDate", "description": "description"}
    items = F.expr(f"regexp_extract_all(coalesce({xml}, ''), '(?is)<item\\\\b[^>]*>(.*?)</item>', 1)")
    rows = feeds.select(*(c for c in feeds.columns if c != xml), F.posexplode(items).alias("pos", "_i"))
    get = lambda tag: markup_free(F.regexp_replace(F.regexp_extract(F.col("_i"), rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1), r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1"))
    return rows.select(*(c for c in rows.columns if c != "_i"), *(get(t).alias(n) for n, t in fields.items()))


def first_with_rows(*branches: DataFrame) -> DataFrame:
    """The rows of the first branch that has any, decided inside the plan."""
    tagged = reduce(DataFrame.unionByName, (b.withColumn("_b", F.lit(k)) for k, b in enumerate(branches)))
    least = tagged.agg(F.min("_b").alias("_least"))
    return tagged.join(F.broadcast(least), F.col("_b") == F.col("_least")).drop("_b", "_least")  # one row


def body_cascade(candidates: list[tuple[str, Column]], least: int = 100) -> Column:
    """struct(text, method, fetched) of the first candidate text that is long enough; FAILED if none is."""
    clean = [(name, F.trim(F.coalesce(c, F.lit("")))) for name, c in candidates]
    text = F.coalesce(*(F.when(F.length(c) >= least, c) for _, c in clean), F.lit(""))
    method = F.coalesce(*(F.when(F.length(c) >= least, F.lit(n)) for n, c in clean), F.lit("FAILED"))
    return F.struct(text.alias("text"), method.alias("method"), (method != "FAILED").alias("fetched"))


def search_queries(name_en: Column, name_ko: Column, aliases: Column, site: str) -> Column:
    """Distinct query strings for a member's names on a site."""
    names = F.filter(F.concat(F.array(name_ko, name_en), aliases), lambda n: n.isNotNull() & (F.trim(n) != ""))
    return F.array_distinct(F.transform(names, lambda n: F.concat(F.lit(f"site:{site} \""), F.trim(n), F.lit("\""))))
