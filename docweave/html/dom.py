"""A small tolerant HTML tree on the standard library's tokenizer."""

from __future__ import annotations

import html as _html
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"])
_RAW = ("script", "style")
# An opening tag ends open elements of these names, up to the nearest barrier.
_ENDS = {"li": ({"li"}, {"ul", "ol"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}
_ENDS_P = frozenset(["p", "div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "section", "article", "main", "nav", "footer", "header", "aside", "dl", "hr", "figure"])


class Node:
    """An element, a text or a comment. ``tag`` is ``#text`` or ``#comment`` for the latter two."""

    __slots__ = ("attrs", "children", "parent", "tag", "text")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, text: str = ""):
        self.tag, self.attrs, self.text = tag, attrs or {}, text
        self.children: list[Node] = []
        self.parent: Node | None = None

    @property
    def element(self) -> bool:
        return self.tag[0] != "#"

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def get(self, name: str, default: str = "") -> str:
        return self.attrs.get(name, default)

    def add(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child

    def walk(self) -> Iterator[Node]:
        """All nodes below this one, in document order; the tree may change behind the walk."""
        for c in list(self.children):
            yield c
            yield from c.walk()

    def find_all(self, test: str | tuple | Callable[[Node], bool]) -> list[Node]:
        names = (test,) if isinstance(test, str) else test
        return [n for n in self.walk() if n.element and (n.tag in names if isinstance(names, tuple) else names(n))]

    def find(self, test) -> Node | None:
        return next(iter(self.find_all(test)), None)

    def texts(self) -> list[Node]:
        return [n for n in self.walk() if n.tag == "#text"]

    def get_text(self, strip: bool = False) -> str:
        parts = [self.text] if self.tag in ("#text", "#comment") else [n.text for n in self.texts()]
        return "".join(p.strip() for p in parts) if strip else "".join(parts)

    def parents(self) -> Iterator[Node]:
        n = self.parent
        while n is not None:
            yield n
            n = n.parent

    def within(self, ancestor: Node) -> bool:
        return any(p is ancestor for p in self.parents())

    def index(self) -> int:
        return next(i for i, c in enumerate(self.parent.children) if c is self)

    def remove(self) -> Node:
        if self.parent is not None:
            del self.parent.children[self.index()]
            self.parent = None
        return self

    def replace(self, *nodes: Node) -> None:
        parent, at = self.parent, self.index()
        parent.children[at : at + 1] = nodes
        for n in nodes:
            n.parent = parent
        self.parent = None

    def insert_before(self, node: Node) -> None:
        self.parent.children.insert(self.index(), node)
        node.parent = self.parent

    def take_children(self) -> list[Node]:
        out, self.children = self.children, []
        for c in out:
            c.parent = None
        return out

    def to_html(self) -> str:
        if self.tag == "#text":
            raw = self.parent is not None and self.parent.tag in _RAW
            return self.text if raw else _html.escape(self.text, quote=False)
        if self.tag == "#comment":
            return f"<!--{self.text}-->"
        inner = "".join(c.to_html() for c in self.children)
        if self.tag == "#root":
            return inner
        attrs = "".join(f' {k}="{_html.escape(v)}"' for k, v in self.attrs.items())
        return f"<{self.tag}{attrs}/>" if self.tag in VOID or (":" in self.tag and not self.children) else f"<{self.tag}{attrs}>{inner}</{self.tag}>"


def text_node(value: str) -> Node:
    return Node("#text", text=value)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _ENDS_P:
            self._end_up_to({"p"}, {"table", "td", "th", "li", "blockquote", "section", "article", "div"})
        if tag in _ENDS:
            self._end_up_to(*_ENDS[tag])
        node = self.open[-1].add(Node(tag, {k: v or "" for k, v in attrs}))
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag and (":" in tag or tag in ("path", "use")):
            self.open.pop()
        elif tag not in VOID and ":" not in tag:
            self.open.pop()

    def _end_up_to(self, ended: set, barriers: set) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in barriers and self.open[i].tag not in ended:
                return
            if self.open[i].tag in ended:
                del self.open[i:]
                return

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        last = self.open[-1].children[-1] if self.open[-1].children else None
        if last is not None and last.tag == "#text":
            last.text += data
        else:
            self.open[-1].add(text_node(data))

    def handle_comment(self, data: str) -> None:
        self.open[-1].add(Node("#comment", text=data))


def parse(source: str) -> Node:
    """The tree of any text: missing and surplus end tags are mended, nothing raises."""
    builder = _Builder()
    # The tokenizer gives up on marked sections that it doesn't know; as text they do no harm.
    builder.feed(re.sub(r"<!\[(?!CDATA\[)", "&lt;![", source or ""))
    builder.close()
    return builder.root


def has_class(name: str) -> Callable[[Node], bool]:
    return lambda n: name in n.classes


def class_like(pattern: str) -> Callable[[Node], bool]:
    rx = re.compile(pattern)
    return lambda n: bool(rx.search(n.get("class"))) if "class" in n.attrs else False


def generator(root: Node) -> str:
    meta = root.find(lambda n: n.tag == "meta" and n.get("name").lower() == "generator")
    return meta.get("content").lower() if meta else ""
