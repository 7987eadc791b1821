"""A small per-page helper: texts of elements that match simple selectors."""

from __future__ import annotations

import re
from html.parser import HTMLParser

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_CLOSES_P = {
    "address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4",
    "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul",
}
_PART = re.compile(r"([.#]?)([\w-]+)|\[([\w-]+)(?:([*^$]?)=['\"]?([^'\"\]]*)['\"]?)?\]")


class Node:
    __slots__ = ("tag", "attrs", "parent", "start", "end")

    def __init__(self, tag, attrs, parent, start):
        self.tag, self.attrs, self.parent, self.start, self.end = tag, attrs, parent, start, start


class Page(HTMLParser):
    """Elements in document order; an element's text is one slice of the page's text."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes: list[Node] = []
        self.open: list[Node] = []
        self.pieces: list[str] = []
        self.size = 0
        self.by: dict[tuple[str, str], list[Node]] | None = None
        self.feed(html)
        self.close()
        self._close_to(0)
        self.text = "".join(self.pieces)

    def _close_to(self, depth: int) -> None:
        while len(self.open) > depth:
            self.open.pop().end = self.size

    def _close_last(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth].tag == tag:
                self._close_to(depth)
                return

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSES_P:
            self._close_last("p")
        elif tag == "li":
            for depth in range(len(self.open) - 1, -1, -1):
                if self.open[depth].tag in ("ul", "ol"):
                    break
                if self.open[depth].tag == "li":
                    self._close_to(depth)
                    break
        node = Node(tag, dict(attrs), self.open[-1] if self.open else None, self.size)
        self.nodes.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        self._close_last(tag)

    def handle_data(self, data):
        self.pieces.append(data)
        self.size += len(data)

    def _index(self) -> dict[tuple[str, str], list[Node]]:
        """Elements by tag, class, id and attribute name, each in document order."""
        found: dict[tuple[str, str], list[Node]] = {}
        for node in self.nodes:
            keys = {("", node.tag)} | {("[", name) for name in node.attrs}
            keys |= {(".", name) for name in (node.attrs.get("class") or "").split()}
            if node.attrs.get("id") is not None:
                keys.add(("#", node.attrs["id"]))
            for key in keys:
                found.setdefault(key, []).append(node)
        return found

    def select(self, selector: str) -> list[Node]:
        """Elements that match; only those with the tag, class, id or attribute of the last step are looked at."""
        steps = [list(_PART.finditer(step)) for step in selector.split()]
        if not steps or not steps[-1]:
            return [n for n in self.nodes if _matches(n, steps)] if steps else []
        if self.by is None:
            self.by = self._index()
        kind, name, attr = steps[-1][0].group(1, 2, 3)
        key = ("[", attr) if attr else (kind, name) if kind else ("", name.lower())
        return [n for n in self.by.get(key, ()) if _matches(n, steps)]

    def text_of(self, node: Node) -> str:
        return self.text[node.start : node.end]


def _matches_step(node: Node, step) -> bool:
    for part in step:
        kind, name, attr, op, value = part.groups()
        if attr:
            have = node.attrs.get(attr)
            if have is None:
                return False
            value = value or ""
            ok = {None: True, "": have == value, "*": value in have, "^": have.startswith(value), "$": have.endswith(value)}
            if not ok[op]:
                return False
        elif kind == ".":
            if name not in (node.attrs.get("class") or "").split():
                return False
        elif kind == "#":
            if node.attrs.get("id") != name:
                return False
        elif node.tag != name.lower():
            return False
    return True


def _matches(node: Node, steps) -> bool:
    if not _matches_step(node, steps[-1]):
        return False
    up, wanted = node.parent, len(steps) - 2
    while wanted >= 0 and up is not None:
        if _matches_step(up, steps[wanted]):
            wanted -= 1
        up = up.parent
    return wanted < 0


def inside(node: Node, ancestor: Node) -> bool:
    up = node.parent
    while up is not None:
        if up is ancestor:
            return True
        up = up.parent
    return False
