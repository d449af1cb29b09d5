"""Element trees: selectors, nesting, broken markup, contexts in linear time."""

import time

import pytest
from pyspark.sql import functions as F

from tidemark.sources import pages as P
from tidemark.sources.tree import Tree, contexts, steps

PAGE = """<html><body class="a b"><div id=top><ul><li>one<li><a href=/2>two</a><ul><li>deep</ul></ul></div>
<article class="story  lead"><h1>Head</h1><p>First <b>bold</b> &amp; more<p class='x'>Second<div class=inner><p>In</p><article><p>Nested</p></article></div><script>var p = "<p>no</p>";</script><p>Last</p></article><main data-k="v w"><p>M</p></main></body></html>"""


def texts(selector):
    tree = Tree(PAGE)
    return [tree.text(n) for n in tree.select(selector)]


@pytest.mark.parametrize("selector,want", [
    ("h1", ["Head"]), (".lead h1", ["Head"]), ("p.x", ["Second"]), ("article > p", ["First bold & more", "Second", "Last", "Nested"]), (".story.lead .inner p", ["In", "Nested"]), ("#top > ul > li", ["one", "two deep"]),
    ("#top li li", ["deep"]), ("[data-k='v w'] p", ["M"]), ("[data-k]", ["M"]), ("article article p", ["Nested"]), ("h1, main", ["Head", "M"]), (".stor", []), ("body.b main", ["M"]), ("div *", None),
])
def test_selectors(selector, want):
    got = texts(selector)
    assert sorted(got) == sorted(want) if want is not None else len(got) > 5


def test_what_is_no_selector():
    for bad in ("", "p:first-child", "a$b"):
        with pytest.raises(ValueError):
            steps(bad)


def test_first_fitting_selector_in_order(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>Only a paragraph"), (4, "<div class=content><p>a</p></div><div id=content><p>b</p></div>")], "k int, h string")
    got = {r.k: r.t for r in df.select("k", P.paragraphs(F.col("h"), 1).alias("t")).collect()}
    assert got == {1: "First bold & more\nSecond\nIn\nNested\nLast", 2: "", 3: "Only a paragraph", 4: "a"}
    assert df.filter("k = 4").select(P.paragraphs(F.col("h"), 1, ("#content",)).alias("t")).first().t == "b"
    date = df.sparkSession.createDataFrame([("<meta content='x'><meta content=\"2024-05-06T10:00\" property=\"article:published_time\">",)], "h string")
    assert date.select(P.page_date(F.col("h")).alias("d")).first().d == "2024-05-06"


def test_contexts_and_links_agree_on_anchors(spark):
    html = "<ul><li>Mon <a href='/1'>One</a></li><li>Tue <a class=x href=\"/2\">Two <b>bold</b></a> end</li></ul>"
    assert list(contexts(html, ("article", "li", "section", "div"), 2000)) == [("/1", "One", "Mon One"), ("/2", "Two bold", "Tue Two bold end")]
    rows = P.links(spark.createDataFrame([(1, "https://x.org", html)], "page_id long, url string, html string")).orderBy("pos").collect()
    assert [(r.href, r.text) for r in rows] == [("/1", "One"), ("/2", "Two bold")]


@pytest.mark.parametrize("make", [
    lambda n: "<div>" + "".join(f"<a href=/{k}>link {k}</a> words between " for k in range(n)) + "</div>", lambda n: "<div>" * n + "x" + "</div>" * n, lambda n: "<a href='" * n, lambda n: "<p>text<li>" * n, lambda n: "<script " * n + "<!--" * n,
])
def test_linear_time(make):
    seconds = []
    for n in (4_000, 16_000):
        html, began = make(n), time.process_time()
        list(contexts(html, ("article", "li", "section", "div"), 2000))
        seconds.append(time.process_time() - began)
    assert seconds[1] < 10 * max(seconds[0], 0.05)
