"""A forgiving HTML tree on the standard parser: void elements, no implied end tags, an end tag closes the nearest open element of its name."""

from __future__ import annotations

import re
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {"script", "style", "template"}


class Node:
    __slots__ = ("tag", "attrs", "items", "parent", "source")

    def __init__(self, tag: str, attrs: dict | None = None, parent: "Node | None" = None):
        self.tag, self.attrs, self.items, self.parent = tag, attrs or {}, [], parent

    def get(self, name: str, default=None):
        return self.attrs.get(name, default)

    def walk(self, skip: tuple[str, ...] = ()):
        """All elements below but those of the tags in skip and what they hold, in document order; without recursion, since pages may nest without end."""
        stack = [iter(self.items)]
        while stack:
            for x in stack[-1]:
                if isinstance(x, Node) and x.tag not in skip:
                    yield x
                    stack.append(iter(x.items))
                    break
            else:
                stack.pop()

    def find_all(self, *tags: str, skip: tuple[str, ...] = ()):
        return [n for n in self.walk(skip) if n.tag in tags]

    def find(self, *tags: str, skip: tuple[str, ...] = ()):
        return next((n for n in self.walk(skip) if n.tag in tags), None)

    def strings(self, skip: tuple[str, ...] = ()):
        """Text pieces below; what scripts, styles and templates hold counts only when asked of them."""
        stack = [iter(self.items)]
        while stack:
            for x in stack[-1]:
                if isinstance(x, str):
                    yield x
                elif x.tag not in _RAW and x.tag not in skip:
                    stack.append(iter(x.items))
                    break
            else:
                stack.pop()

    def text(self, sep: str = "", strip: bool = False, skip: tuple[str, ...] = ()) -> str:
        if strip:
            return sep.join(s for s in (x.strip() for x in self.strings(skip)) if s)
        return sep.join(self.strings(skip))

    def up(self):
        n = self.parent
        while n is not None:
            yield n
            n = n.parent

    def siblings(self, step: int):
        """Elements after (1) or before (-1) this one, the nearest first."""
        if self.parent is None:
            return
        at = next((i for i, x in enumerate(self.parent.items) if x is self), None)
        if at is None:
            return
        rest = self.parent.items[at + 1:] if step > 0 else self.parent.items[:at][::-1]
        yield from (x for x in rest if isinstance(x, Node))

    def around(self) -> tuple[list, list]:
        """What its parent holds before and after it, pieces of text included, each the nearest first."""
        items = self.parent.items if self.parent is not None else [self]
        at = next(i for i, x in enumerate(items) if x is self)
        return items[:at][::-1], items[at + 1:]

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("[document]")
        self.open: dict[str, int] = {}
        self.comments: list[str] = []

    def updatepos(self, i, j):  # nobody asks for lines and columns
        return j

    def handle_starttag(self, tag, attrs):
        n = Node(tag, {k: v if v is not None else "" for k, v in attrs}, self.at)  # the last of equal names counts
        self.at.items.append(n)
        if tag not in VOID:
            self.at = n
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not self.open.get(tag):
            return
        while True:
            n = self.at
            self.open[n.tag] -= 1
            self.at = n.parent
            if n.tag == tag:
                return

    def handle_data(self, data):
        if self.at.items and isinstance(self.at.items[-1], str):
            self.at.items[-1] += data
        else:
            self.at.items.append(data)

    def handle_comment(self, data):
        self.comments.append(data)


def soup(html: "str | bytes | Node | None") -> Node:
    """The tree of a page; of bytes as UTF-8, else Latin-1. What the parser can't read ends the page there. A tree is given back as it is."""
    if isinstance(html, Node):
        return html
    if isinstance(html, bytes):
        try:
            html = html.decode("utf-8")
        except UnicodeDecodeError:
            html = html.decode("latin-1")
    b = _Builder()
    b.root.source = html or ""
    try:
        b.feed(html or "")
        b.close()
    except AssertionError:
        pass
    return b.root


def squash(s: str) -> str:
    return re.sub(r"\s+", " ", s).strip()
