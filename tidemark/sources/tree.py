"""Pages as element trees, and selectors on them.

A page is read once, by one pattern, into flat lists: of each element its tag, classes, id, parent and the range of text pieces
that it holds, and of the pieces their running lengths.  An element's text is a range, its length a difference, so texts
that are too long are refused without being joined, and time grows in proportion to the page.  Pages come as Arrow batches.

Markup is read as browsers do where it matters here: a paragraph ends at the next block, list items and cells end at the next of
their kind, scripts and styles hold no text, and an attribute's quote that does not close before the next tag ends with it.
"""

from __future__ import annotations

import functools
import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"<]*"|'[^'<]*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^<>]*)>?""", re.S)
_ATTR = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
_ALONE = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "td": ("table", "tr"), "th": ("table", "tr"), "tr": ("table",), "option": ("select",)}
_SILENT = {"script", "style"}
_PART = re.compile(r"([.#]?)([\w-]+)|\[([\w:-]+)(?:=[\"']?([^\"'\]]*)[\"']?)?\]|\*")


class Tree:
    """tag, attributes, parent, first (piece) and last (piece, exclusive) of each element in order; 0 is the page."""

    def __init__(self, html: str) -> None:
        self.tag, self.attrs, self.parent, self.first, self.last = ["" ], [{}], [-1], [0], [0]
        self.pieces: list[str] = []
        self.sums = [0]
        self.around: dict[int, dict[str, int]] = {}  # of each link, the nearest open element of each tag
        self.open, self.stacks = [0], defaultdict(list)
        at, size = 0, len(html)
        while at < size:
            m = _TOKEN.search(html, at)
            self._text(html[at : m.start() if m else size])
            if not m:
                break
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            if m[1] or m[4]:
                self._end(name)
                continue
            self._begin(name, m[3] if m[2] else m[6])
            if name in _SILENT:
                end = re.compile(rf"</{name}(?![^\s/>])", re.I).search(html, at)
                at = end.start() if end else size
        while len(self.open) > 1:
            self._close()
        self.last[0] = len(self.pieces)

    def _text(self, raw: str) -> None:
        text = " ".join(unescape(raw).split())
        if text:
            self.pieces.append(text)
            self.sums.append(self.sums[-1] + len(text))

    def _close(self) -> None:
        node = self.open.pop()
        self.stacks[self.tag[node]].pop()
        self.last[node] = len(self.pieces)

    def _end(self, name: str) -> None:
        if self.stacks[name]:
            while self.tag[self.open[-1]] != name:
                self._close()
            self._close()

    def _begin(self, name: str, attrs: str) -> None:
        if name in _BLOCK and self.stacks["p"]:
            self._end("p")
        if name in _ALONE and self.stacks[name]:
            mine = self.stacks[name][-1]
            if all(not self.stacks[t] or self.stacks[t][-1] < mine for t in _ALONE[name]):
                self._end(name)
        node = len(self.tag)
        self.tag.append(name)
        self.attrs.append({a.lower(): unescape(x or y or z) for a, x, y, z in _ATTR.findall(attrs)} if attrs and not attrs.isspace() else {})
        self.parent.append(self.open[-1])
        self.first.append(len(self.pieces))
        self.last.append(len(self.pieces))
        if name == "a" and "href" in self.attrs[node]:
            self.around[node] = {t: s[-1] for t, s in self.stacks.items() if s}
        if name not in _VOID:
            self.open.append(node)
            self.stacks[name].append(node)

    def length(self, node: int) -> int:
        n = self.last[node] - self.first[node]
        return self.sums[self.last[node]] - self.sums[self.first[node]] + max(0, n - 1)

    def text(self, node: int) -> str:
        return " ".join(self.pieces[self.first[node] : self.last[node]])

    def select(self, selector: str) -> Iterator[int]:
        """Elements that a selector takes, in the page's order; alternatives stand between commas, an ancestor before its
        descendant with a space between, a parent before its child with `>`."""
        ways = [steps(x) for x in selector.split(",")]
        for node in range(1, len(self.tag)):
            if any(self._fits(node, way) for way in ways):
                yield node

    def _fits(self, node: int, way: tuple) -> bool:
        if not self._is(node, way[-1][1]):
            return False
        waiting = {node}  # where the part behind may stand
        for (_, test), (direct, _) in zip(way[-2::-1], way[:0:-1]):
            found = set()
            for n in waiting:
                up = self.parent[n]
                while up > 0:
                    if self._is(up, test):
                        found.add(up)
                    if direct:
                        break
                    up = self.parent[up]
            if not found:
                return False
            waiting = found
        return True

    def _is(self, node: int, test: tuple) -> bool:
        attrs = self.attrs[node]
        for kind, name, value in test:
            if kind == "" and self.tag[node] != name or kind == "#" and attrs.get("id") != name or kind == "." and name not in attrs.get("class", "").split() or kind == "[" and (name not in attrs or (value is not None and attrs[name] != value)):
                return False
        return True


@functools.lru_cache(maxsize=256)
def steps(selector: str) -> tuple:
    """((whether it must be the child of the part before, ((kind, name, value), ...)), ...)"""
    out, direct = [], False
    for part in re.findall(r"(?:\[[^\]]*\]|[^\s>\[\]])+|>|\S", selector):
        if part == ">":
            direct = True
            continue
        found = [m for m in _PART.finditer(part)]
        if "".join(m[0] for m in found) != part:
            raise ValueError(f"no selector: {selector}")
        test = tuple(("[", m[3].lower(), m[4]) if m[3] else (m[1], m[2] if m[1] else m[2].lower(), None) for m in found if m[0] != "*")
        out.append((direct, test))
        direct = False
    if not out:
        raise ValueError(f"no selector: {selector!r}")
    return tuple(out)


def paragraph_texts(html: Column, selectors: Column) -> Column:
    """Texts of the paragraphs in the first element of the first selector that a page has, or in all of the page."""

    @F.arrow_udf("array<string>")
    def find(pages: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for page, wanted in zip(pages.to_pylist(), lists.to_pylist()):
            tree = Tree(page or "")
            top = next((n for s in wanted or () for n in [next(tree.select(s), None)] if n is not None), 0)
            out.append([tree.text(n) for n in range(top, len(tree.tag)) if tree.tag[n] == "p" and tree.first[n] >= tree.first[top] and tree.last[n] <= tree.last[top]])
        return pa.array(out, pa.list_(pa.string()))

    return find(html, selectors)


def contexts(html: str, elements: tuple[str, ...], most: int) -> Iterator[tuple[str, str, str]]:
    """(href, text, context) of all links: the context is the text of the parent and of the nearest of each kind of element, each
    text once, without those of more than so many characters."""
    tree = Tree(html)
    texts: dict[int, str] = {}
    for link, near in tree.around.items():
        seen = []
        for node in (tree.parent[link], *(near.get(t, 0) for t in elements)):
            if node > 0 and tree.length(node) <= most:
                if node not in texts:
                    texts[node] = tree.text(node)
                text = texts[node]
                if text and text not in seen:
                    seen.append(text)
        yield tree.attrs[link]["href"], tree.text(link), " | ".join(seen)
