"""The whole extent of articles: headings, leads, lists and sections stay, whatever the markup's names say."""

import random
import re
import time

import pytest

from tidemark.llm import extraction

LAYOUTS = {
    "lead and body": lambda k: [("h1", f"Head {k}"), ("p class=lead", f"Lead {k} of it"), ("div class=body", [("p", f"Body {k} {j} " + "long " * 9 + str(k * j)) for j in range(5)])],
    "list and section": lambda k: [("h1", f"Head {k}"), ("ul", [("li", f"Item {k} {j}") for j in range(3)]), ("section", [("p", f"Part {k} {j} " + "text " * 12 + str(k + j)) for j in range(5)])],
    "one long paragraph": lambda k: [("h1", f"Head {k}"), ("p", " ".join(f"w{k * 91 + j}" for j in range(80)))],
    "table and quote": lambda k: [("h2", f"Head {k}"), ("blockquote", f"Quote {k} here"), ("table", [("tr", [("td", f"Cell {k} {j}")]) for j in range(4)]), ("div", [("p", f"End {k} {j} " + "more " * 20 + str(k * j)) for j in range(6)])],
}


def markup(nodes):
    return "".join(f"<{t}>{x if isinstance(x, str) else markup(x)}</{t.split()[0]}>" for t, x in nodes)


def blocks(nodes):
    return [y for _, x in nodes for y in ([x] if isinstance(x, str) else blocks(x))]


def page(k, article, around="article"):
    menu = "".join(f"<li><a href=/{j}>Menu entry {j}</a></li>" for j in range(8))
    return (
        f"<html><head><title>t{k}</title></head><body><header><p>The site of {k % 2} things</p></header><nav><ul>{menu}</ul></nav><{around}>{markup(article)}</{around.split()[0]}>"
        f"<aside><p>Read also number {k}</p></aside><footer><p>Footer of the site</p></footer></body></html>"
    )


@pytest.mark.parametrize("name", LAYOUTS)
@pytest.mark.parametrize("around", ["article", "main", "div class=story"])
def test_all_of_the_article_stays(name, around):
    pages = [LAYOUTS[name](k) for k in range(12)]
    got = extraction.extract([page(k, a, around) for k, a in enumerate(pages)])
    for (text, by_template), a in zip(got, pages):
        assert by_template and text.split("\n") == [" ".join(x.split()) for x in blocks(a)]


def test_headings_beside_the_container_stay():
    make = lambda k: f"<html><body><nav><a href=x>Menu of all things here</a></nav><h1>Head {k}</h1><div class=text>{''.join(f'<p>Text {k} {j} of it</p>' for j in range(5))}</div><footer>Foot</footer></body></html>"
    for k, (text, by_template) in enumerate(extraction.extract([make(k) for k in range(9)])):
        assert by_template and text.split("\n") == [f"Head {k}"] + [f"Text {k} {j} of it" for j in range(5)]


def test_the_longest_of_many_articles_without_a_template():
    html = "".join(f"<article class=c{'abcdefghij'[k]}><p>short</p></article>" for k in range(9)) + f"<article class=last><p>{'long ' * 50}</p></article>"
    assert extraction.extract([html])[0][0] == ("long " * 50).strip()


@pytest.mark.parametrize("seed", range(4))
def test_renamed_markup(seed):
    """With tags and classes that say nothing the article is found as with them, by slots, constants and links."""
    rng = random.Random(seed)
    names = {t: f"x{rng.randrange(10**6)}-{t[0]}" for t in ("header", "nav", "article", "aside", "footer", "section", "ul", "li", "blockquote")}
    same = total = 0
    for name in ("lead and body", "list and section"):
        pages = [LAYOUTS[name](k) for k in range(12)]
        htmls = [page(k, a).replace("<aside><p>Read also number", "<aside><p><a href=y>Read also number").replace("</p></aside>", "</a></p></aside>") for k, a in enumerate(pages)]
        renamed = [re.sub(r"(</?)([a-z]+)", lambda m: m[1] + names.get(m[2], m[2]), h) for h in htmls]
        for (text, _), a in zip(extraction.extract(renamed), pages):
            want = [" ".join(x.split()) for x in blocks(a)]
            same += text.split("\n") == want
            total += 1
    assert same == total


def test_unclosed_raw_elements_take_linear_time():
    seconds = []
    for n in (100_000, 400_000):
        began = time.time()
        extraction.extract(["<p>text<script>" + "</script " * n])
        extraction.extract(["<p>text" + "<script></scripty" * n])
        extraction.extract(["<a b='" * n + "x"])
        seconds.append(time.time() - began)
    assert seconds[1] < 12 * max(seconds[0], 0.05)
    assert extraction.extract(["<p>one</p><script>a</SCRIPT x=1>two"])[0][0] == "one\ntwo"
