"""Elements of storage markup with their places in the text, so that whatever isn't changed stays byte for byte."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

VOID = frozenset(["br", "hr", "img", "meta", "input", "link", "area", "base", "col", "embed", "source", "track", "wbr"])
_TOKEN = re.compile(r"<!\[CDATA\[.*?\]\]>|<!--.*?-->|<(?P<close>/?)(?P<name>[A-Za-z][\w:.-]*)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTRIBUTE = re.compile(r"([\w:.-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")

Edit = tuple[int, int, str]


class Element:
    """``text[start:end]`` is the element, ``text[inner:stop]`` its content. One that never closes is its tag alone."""

    __slots__ = ("attrs", "children", "end", "inner", "name", "start", "stop")

    def __init__(self, name: str, attrs: dict[str, str], start: int, end: int):
        self.name, self.attrs, self.start = name, attrs, start
        self.inner = self.stop = self.end = end
        self.children: list[Element] = []

    def walk(self) -> Iterator[Element]:
        yield self
        yield from walk(self.children)

    def child(self, name: str, **attrs: str) -> Element | None:
        return next((c for c in self.children if c.name == name and all(c.attrs.get(k.replace("_", ":")) == v for k, v in attrs.items())), None)


def walk(found: Iterable[Element]) -> Iterator[Element]:
    for e in found:
        yield from e.walk()


def tokens(text: str) -> Iterator[re.Match]:
    """Tags, comments and marked sections; only tags have a ``name``."""
    return _TOKEN.finditer(text)


def elements(text: str) -> list[Element]:
    """The outermost elements. Surplus end tags count for nothing; what an unclosed element held moves up beside it."""
    root = Element("", {}, 0, 0)
    open_ = [root]

    def abandon(down_to: int) -> None:
        while len(open_) > down_to:
            e = open_.pop()
            open_[-1].children += e.children
            e.children = []

    for m in tokens(text):
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["close"]:
            depth = next((i for i in range(len(open_) - 1, 0, -1) if open_[i].name == name), 0)
            if depth:
                abandon(depth + 1)
                e = open_.pop()
                e.stop, e.end = m.start(), m.end()
            continue
        e = Element(name, {k: a or b for k, a, b in _ATTRIBUTE.findall(m["rest"])}, m.start(), m.end())
        open_[-1].children.append(e)
        if name not in VOID and not m["rest"].endswith("/"):
            open_.append(e)
    abandon(1)
    return root.children


def outermost(found: Iterable[Element], test: Callable[[Element], bool]) -> Iterator[Element]:
    for e in found:
        if test(e):
            yield e
        else:
            yield from outermost(e.children, test)


def edited(text: str, edits: Iterable[Edit]) -> str:
    """The text with edits put in that don't overlap."""
    out, at = [], 0
    for start, end, new in sorted(edits):
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]])


def between(text: str, opaque: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What lies outside the opaque spans and outside all tags, comments and marked sections."""
    spans = sorted([*opaque, *(m.span() for m in tokens(text))])
    at = 0
    for start, end in [*spans, (len(text), len(text))]:
        if start > at:
            yield at, start
        at = max(at, end)
