"""Main text of web pages by equivalence-class template deduction.

The pages of a host are dealt into groups of bounded size.  A page is a sequence of tokens: tags, told apart by the path of
open elements (with their classes and ids, digits left out), and words, told apart by the path that they stand in.  Tokens of
a group with the same occurrence vector (how often each distinct page holds them) form an equivalence class; a class is
kept if it is large and frequent enough, and of its tokens those that come in one order on every page.  Kept classes are the
template and nest by their elements; what lies between their tokens is a slot.  A block of text of which some word is no
template token is slot text, one of template tokens alone is constant.  The innermost template element that holds most of
the slots' text only says where the article is; its extent is the element around it: the outermost article, else main
element that it lies in, or else, for markup that has neither, the element that is reached by going out from it as long as
it comes several times on a page (a paragraph is part of something larger) or what the next element adds is slot text that
is no link list.  All slots and constant blocks of the extent are kept, headings that stand right before it too.  Constant
blocks in it are template text and go if their place, counted from the article's beginning or end, is the same on the pages
that hold them, and if these pages have more else than that: so copies of an article, or a line that many articles quote,
stay.

What only markup can tell, for slots vary in menus and adverts too, is taken from tags, roles and whole class names
(furniture).  A form that holds most of the page is none.  Where a group has no template (fewer than three distinct pages),
or a page lacks it, the page's own article or main element counts, or else everything outside furniture.

Edge cases: null or empty html gives the empty text and 0 characters; broken markup is read as browsers do (unclosed
paragraphs end at the next block), but an attribute whose quote does not close before the next tag ends with its tag; time
and memory grow in proportion to the html, however long or deeply nested; a page without a url is in a group of its own
kind; repeated rows are extracted alike, and equal pages count once in a template; an empty table gives no rows; only the
three columns named are read, so others cannot clash.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import lean, partitions, written

#: Pages and bytes of a group on average: a host has as many groups as it needs, whatever the table or cluster.
GROUP_PAGES, GROUP_BYTES = 200, 8 << 20
#: Hosts of several groups that are broadcast at most: some ten MB.
MAX_BROADCAST = 200_000
#: Classes of fewer tokens, or on a smaller share of the group's pages, are no template; nor are fewer distinct pages.
CLASS_TOKENS, CLASS_SHARE, LEAST_PAGES = 3, 0.5, 3
#: The element that marks where the article is holds this share of what the best one holds; constant text counts less
#: than slots do.
MARK, CONSTANT = 0.8, 0.3
#: What an element around the article adds is the article's if this share of it is slot text.
ADDED = 0.8

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"[^>\"']*")
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "select", "option", "canvas"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "strike", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
_FURNITURE = {"nav", "footer", "aside", "menu", "dialog", "button", "input", "head"} | _RAW
_CLOSED = ("p", "li", "dt", "dd", "td", "th", "tr", "option")
_KIND = r"(?:ads?|advert\w*|banner|promo\w*|sponsor\w*|nav\w*|menu\w*|breadcrumbs?|footer|sidebar|widget|related|recommend\w*|share|sharing|social|cookies?|consent|notices?|popup|modal|newsletter|subscribe|signup|login|comments?|replies|respond|disqus|discussion|toolbar|pagination|pager|masthead|topbar)"
_PART = r"(?:site|page|main|top|bottom|left|right|global|primary|secondary|box|bar|list|section|area|block|wrap\w*|container|links?|buttons?|posts?|items?|slot|unit|form|thread|header)"
_HINT = re.compile(rf"(?:{_PART}[_-]?)*{_KIND}(?:[_-]?(?:{_PART}|{_KIND}))*|(?:site|page)[_-]?header|skip[_-]?link\w*", re.I)
_ROLE = re.compile(r"navigation|banner|contentinfo|complementary|search|form|dialog|alert\w*|menu\w*", re.I)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?=[\s=]|$)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
_DIGITS = re.compile(r"\d+")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_SPACE = re.compile(r"\s+")


def tags(html: str) -> Iterator[tuple[int, int, str, str, bool]]:
    """(begin, end, name, attributes, whether it closes) of each tag, in one pass; comments and declarations have no name."""
    at, size = 0, len(html)
    quote = {'"': -1, "'": -1}  # where the next one is, found again only once it is passed

    def next_quote(q: str, start: int) -> int:
        if quote[q] < start:
            found = html.find(q, start)
            quote[q] = found if found >= 0 else size
        return quote[q]

    while True:
        lo = html.find("<", at)
        if lo < 0:
            return
        if html.startswith("<!--", lo):
            end = html.find("-->", lo + 4)
            at = size if end < 0 else end + 3
            yield lo, at, "", "", False
            continue
        if html[lo + 1 : lo + 2] in ("!", "?"):
            end = html.find(">", lo)
            at = size if end < 0 else end + 1
            yield lo, at, "", "", False
            continue
        m = _NAME.match(html, lo + 1)
        if not m:
            at = lo + 1
            continue
        to = m.end()
        while True:
            to = _PLAIN.match(html, to).end()
            if to >= size or html[to] == ">":
                break
            close = next_quote(html[to], to + 1)
            first = html.find(">", to, close + 1)
            if close >= size or (first >= 0 and html.find("<", first, close) >= 0):  # it does not close before the next tag
                end = html.find(">", to)
                to = size if end < 0 else end
                break
            to = close + 1
        at = min(to + 1, size)
        yield lo, at, m.group(1).lower(), html[m.end() : to], html[lo + 1] == "/"


def _signs(tag: str, attrs: str, inside: bool) -> tuple[bool, str]:
    """Whether an element is furniture by itself, and its class and id without digits."""
    odd, names = tag in _FURNITURE or (tag == "header" and not inside), ""
    for name, a, b, c in _ATTR.findall(attrs) if attrs else ():
        value, name = a or b or c, name.lower()
        if name in ("class", "id"):
            names += f".{_DIGITS.sub('', value)}"
            spaced = re.sub(r"([a-z])([A-Z])", r"\1-\2", value)
            if tag not in ("body", "html", "article", "main") and any(_HINT.fullmatch(x) for x in spaced.split()):
                odd = True
        elif name == "role":
            odd |= bool(_ROLE.fullmatch(value.strip()))
        else:
            odd |= name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and bool(_NONE.search(value)))
    return odd, names


class Page:
    """Elements (tag, key of the path, parent, furniture by itself), blocks of text (element, text) with the share of each that
    is links, and tokens in order."""

    def __init__(self, html: str, keys: dict):
        self.tag, self.key, self.parent, self.odd, self.inside = [""], [0], [0], [False], [False]
        self.blocks: list[tuple[int, str]] = []
        self.links: list[float] = []
        self.tokens: list[int] = []
        linked, in_link = 0, False
        now, at, run, open_tags = 0, 0, [], Counter()

        def key(*what) -> int:
            return keys.setdefault(what, len(keys) + 1)

        def close() -> None:
            nonlocal run, linked
            raw = "".join(run)
            text = _SPACE.sub(" ", unescape(raw)).strip()
            if text:
                self.blocks.append((now, text))
                self.links.append(linked / len(raw))
            linked = 0
            if text:
                self.tokens.extend(key(self.key[now], w) for w in text.split(" "))
            run = []

        skip = 0
        for lo, hi, tag, attrs, ends in tags(html):
            if lo < skip:
                continue
            run.append(html[at:lo])
            linked += lo - at if in_link else 0
            at = hi
            if not tag:
                continue
            if tag == "a":
                in_link = not ends
            if ends:
                if tag in _INLINE:
                    continue
                if not open_tags[tag]:
                    if tag == "p":
                        close()
                    continue
                close()
                while self.tag[now] != tag:
                    open_tags[self.tag[now]] -= 1
                    now = self.parent[now]
                open_tags[tag] -= 1
                self.tokens.append(key(self.key[now], "", "end"))
                now = self.parent[now]
                continue
            if tag in _INLINE:
                continue
            close()
            if tag in _VOID:
                self.tokens.append(key(self.key[now], "", tag))
                continue
            node = now  # a block ends an open paragraph, an item an open item
            while self.tag[node] in _CLOSED:
                if self.tag[node] in ("p", tag):
                    while now != node:
                        open_tags[self.tag[now]] -= 1
                        now = self.parent[now]
                    open_tags[self.tag[now]] -= 1
                    now = self.parent[now]
                    break
                node = self.parent[node]
            odd, names = _signs(tag, attrs, self.inside[now])
            self.tag.append(tag)
            self.key.append(key(self.key[now], tag, names, 0))
            self.parent.append(now)
            self.odd.append(odd)
            self.inside.append(self.inside[now] or tag in ("article", "main"))
            now = len(self.tag) - 1
            open_tags[tag] += 1
            self.tokens.append(self.key[now])
            if tag in _RAW:
                end = re.compile(rf"</{re.escape(tag)}(?![^\s/>])", re.I).search(html, at)
                at = html.find(">", end.end()) + 1 if end else 0
                at = skip = at or len(html)
                open_tags[tag] -= 1
                now = self.parent[now]
        run.append(html[at:])
        close()
        size = [0] * len(self.tag)
        for node, text in self.blocks:
            size[node] += len(text)
        for node in range(len(size) - 1, 0, -1):
            size[self.parent[node]] += size[node]
        self.size = size
        self.furniture = self.odd[:]
        for node in range(1, len(self.tag)):  # parents come first
            self.furniture[node] |= self.furniture[self.parent[node]] or (self.tag[node] == "form" and 2 * size[node] < size[0])

    def within(self, wanted: set[int]) -> list[bool]:
        """Of each element, whether its path or one that it lies in is wanted."""
        out = [k in wanted for k in self.key]
        for node in range(1, len(out)):
            out[node] |= out[self.parent[node]]
        return out


def _in_order(orders: list[list[int]]) -> list[int]:
    """Of tokens that come once on each page, those of the first page's order that all pages keep."""
    kept = orders[0]
    for other in orders[1:]:
        if other == kept:
            continue
        place = {t: k for k, t in enumerate(other)}
        tails, at, before = [], [], []  # a longest rising run of places
        seq = [place[t] for t in kept]
        for k, x in enumerate(seq):
            j = bisect_left(tails, x)
            tails[j : j + 1], at[j : j + 1] = [x], [k]
            before.append(at[j - 1] if j else -1)
        k, chain = at[-1] if at else -1, []
        while k >= 0:
            chain.append(kept[k])
            k = before[k]
        kept = chain[::-1]
    return kept


def template(pages: list[Page]) -> list[list[int]]:
    """Valid equivalence classes of the tokens of distinct pages, each in its order."""
    n = len(pages)
    found = [np.unique(np.array(p.tokens, np.int64), return_counts=True) for p in pages]
    token, count = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    page = np.repeat(np.arange(n), [len(f[0]) for f in found])
    value, inverse, support = np.unique(token, return_inverse=True, return_counts=True)
    often = support >= max(2, CLASS_SHARE * n)
    number = np.cumsum(often) - 1
    vectors = np.zeros((int(often.sum()), n), np.int32)
    some = often[inverse]
    vectors[number[inverse[some]], page[some]] = count[some]
    classes: dict[bytes, list[int]] = defaultdict(list)
    for t, v in zip(value[often].tolist(), vectors):
        classes[v.tobytes()].append(t)
    valid = []
    for vector, members in classes.items():
        if len(members) < CLASS_TOKENS:
            continue
        counts = np.frombuffer(vector, np.int32)
        wanted = set(members)
        orders = [[t for t in pages[k].tokens if t in wanted] for k in np.flatnonzero(counts).tolist()]
        if counts.max() == 1:
            order = _in_order(orders)
        else:  # whole rounds in one order
            order = orders[0][: len(members)]
            if any(o != order * (len(o) // len(members)) for o in orders):
                continue
        if len(order) >= CLASS_TOKENS:
            valid.append(order)
    return valid


def article_slot(pages: list[Page], classes: list[list[int]]) -> tuple[int | None, set[int]]:
    """The path of the template's innermost element that holds most of the slots' text, and the template's tokens."""
    fixed = {t for order in classes for t in order}
    weight: Counter[int] = Counter()
    depth: dict[int, int] = {}
    for p in pages:
        own, level = [0.0] * len(p.tag), [0] * len(p.tag)
        for (node, text), constant in zip(p.blocks, p.constant):
            if not p.furniture[node]:
                own[node] += len(text) * (CONSTANT if constant else 1)
        for node in range(1, len(p.tag)):
            level[node] = level[p.parent[node]] + 1
        for node in range(len(own) - 1, 0, -1):
            own[p.parent[node]] += own[node]
            if p.key[node] in fixed and own[node]:
                weight[p.key[node]] += own[node]
                depth[p.key[node]] = level[node]
    most = max(weight.values(), default=0)
    return max((k for k, w in weight.items() if w >= MARK * most), key=lambda k: (depth[k], -k), default=None), fixed


def extent(pages: list[Page], mark: int) -> int:
    """The path of the element that the article fills, around the one that marks it."""
    parent, tag, places = {}, {}, Counter()
    inside: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0])
    on: Counter[int] = Counter()
    for p in pages:
        own = [[0.0, 0.0] for _ in p.tag]
        for (node, text), constant, linked in zip(p.blocks, p.constant, p.links):
            own[node][0] += len(text)
            own[node][1] += len(text) * (not constant and not p.furniture[node] and linked < 0.5)
        for node in range(len(p.tag) - 1, 0, -1):
            k, up = p.key[node], p.parent[node]
            for j in (0, 1):
                own[up][j] += own[node][j]
                inside[k][j] += own[node][j]
            parent[k], tag[k] = p.key[up], p.tag[node]
            places[k] += 1
        on.update(set(p.key[1:]))
    chain = [mark]
    while parent.get(chain[-1]):
        chain.append(parent[chain[-1]])
    for name in ("article", "main"):
        named = [k for k in chain if tag[k] == name]
        if named:
            return named[-1]
    for now, up in zip(chain, chain[1:]):
        if places[now] > 1.5 * on[now]:
            continue
        total, slots = (inside[up][j] - inside[now][j] for j in (0, 1))
        if tag[up] in ("body", "html") or slots < ADDED * total:
            return now
    return chain[-1]


_HEADINGS = {f"h{k}" for k in range(1, 7)}


def chosen(page: Page, use: list[bool] | None) -> list[int]:
    """Indices of the page's blocks that are no furniture and lie in the wanted elements, or in headings right before them."""
    plain = [i for i, (node, _) in enumerate(page.blocks) if not page.furniture[node]]
    if use is None:
        return plain
    kept = [i for i in plain if use[page.blocks[i][0]]]
    if kept:
        at = plain.index(kept[0])
        while at and page.tag[page.blocks[plain[at - 1]][0]] in _HEADINGS:
            at -= 1
            kept.insert(0, plain[at])
    return kept


def extract(htmls: list[str]) -> list[tuple[str, bool]]:
    """Main texts of a group of pages of one host, and whether the template says which they are."""
    keys: dict = {}
    distinct: dict[str, Page] = {}
    for h in htmls:
        if (h or "") not in distinct:
            distinct[h or ""] = Page(h or "", keys)
    pages = [p for p in distinct.values() if p.blocks]
    slot, gone = None, set()
    if len(pages) >= LEAST_PAGES:
        classes = template(pages)
        fixed = {t for order in classes for t in order}
        for p in pages:
            p.constant = [all(keys[(p.key[node], w)] in fixed for w in text.split(" ")) for node, text in p.blocks]
        slot, _ = article_slot(pages, classes)
        if slot is not None:
            slot = extent(pages, slot)
            gone = _template_text(pages, slot)
    texts = {}
    for h, p in distinct.items():
        use = p.within({slot}) if slot is not None else None
        decided = use is not None and any(use[node] and not p.furniture[node] for node, _ in p.blocks)
        if not decided:
            use = None
            for tag in ("article", "main"):
                named: Counter[int] = Counter()
                for k, t, n in zip(p.key, p.tag, p.size):
                    if t == tag:
                        named[k] += n
                if named:
                    use = p.within({max(named, key=lambda k: named[k])})
                    break
        kept = [(p.key[p.blocks[i][0]], p.blocks[i][1]) for i in chosen(p, use)]
        texts[h] = ("\n".join(t for b in kept for t in (b[1],) if not (decided and b in gone)), decided)
    return [texts[h or ""] for h in htmls]


def _template_text(pages: list[Page], slot: int) -> set[tuple[int, str]]:
    """Constant blocks of the article, as (path, text), that are the template's: at one place, on pages of other text."""
    places, held = defaultdict(list), []
    for k, p in enumerate(pages):
        inside = p.within({slot})
        own = [((p.key[node], t), c) for (node, t), c in zip(p.blocks, p.constant) if inside[node] and not p.furniture[node]]
        fixed = sum(len(b[1]) for b, c in own if c)
        held.append(fixed <= 0.5 * sum(len(b[1]) for b, _ in own))
        for i, (b, c) in enumerate(own):
            if c:
                places[b].append((k, i, len(own) - i))
    out = set()
    for b, at in places.items():
        on = {k for k, _, _ in at}
        if len(on) >= max(LEAST_PAGES, CLASS_SHARE * len(pages)) and sum(held[k] for k in on) >= 0.9 * len(on):
            for side in (1, 2):
                if Counter(x[side] for x in at).most_common(1)[0][1] >= 0.9 * len(at):
                    out.add(b)
    return out


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", group_pages: int = GROUP_PAGES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(page_id, url, text, n_chars, by_template) of every page; by_template: whether the group's template says where its
    article is, not the page's own markup."""
    n = partitions(pages.sparkSession)
    kind, url_kind = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))
    # the host of urls without a scheme is their first part; it only groups pages
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?/*([^/?#]*)", 1))
    named = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("u"), F.col(html_col).alias("h"), host.alias("host"))
    # a host of more than one group is dealt by a hash of its pages; such hosts are broadcast while they are few, and else
    # joined, where Spark splits the hot ones
    size = F.greatest(F.count(F.lit(1)) / F.lit(group_pages), F.sum(F.length("h")) / F.lit(group_bytes))
    counts = named.groupBy("host").agg(F.ceil(size).cast("int").alias("parts")).filter("parts > 1")
    counts = written(counts, "hosts")
    if counts.count() <= MAX_BROADCAST:
        counts = F.broadcast(counts)
    spread = F.pmod(F.xxhash64("id", "u"), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = named.join(counts, "host", "left").withColumn("part", spread)

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, urls, htmls, types = None, [], [], [], None
        same: dict[str, str] = {}

        def out() -> Iterator[pa.RecordBatch]:
            if ids:
                texts = extract(htmls)
                for lo in range(0, len(ids), group_pages):
                    part = slice(lo, lo + group_pages)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[part], types[0]), pa.array(urls[part], types[1]), pa.array([t for t, _ in texts[part]], pa.string()), pa.array([len(t) for t, _ in texts[part]], pa.int64()), pa.array([d for _, d in texts[part]], pa.bool_())],
                        names=["id", "u", "text", "n_chars", "by_template"],
                    )

        for batch in batches:
            types = (batch.schema.field(2).type, batch.schema.field(3).type)
            for host_, part, i, u, h in zip(*(c.to_pylist() for c in batch.columns)):
                if (host_, part) != now:
                    yield from out()
                    now, ids, urls, htmls, same = (host_, part), [], [], [], {}
                ids.append(i)
                urls.append(u)
                htmls.append(same.setdefault(h or "", h or ""))  # copies are held once
        yield from out()

    ordered = dealt.select("host", "part", "id", "u", "h").repartition(n, "host", "part").sortWithinPartitions("host", "part", "id")
    return ordered.mapInArrow(run, f"id {kind}, u {url_kind}, text string, n_chars long, by_template boolean").withColumnsRenamed({"id": id_col, "u": url_col})
