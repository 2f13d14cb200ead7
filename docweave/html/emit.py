"""Markdown from an HTML tree."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from ..text import reflow
from . import math as M
from .dom import Node, parse
from .normalise import extract_title, normalise

DROPPED = ("script", "style", "nav", "footer", "iframe", "noscript", "meta", "link", "head", "template")
# Parts of encyclopedia pages that are no content.
WIKI_CHROME = ("mw-editsection", "mw-editsection-like", "mw-pt-languages", "interlanguage-link", "mw-pt-languages-label", "mw-pt-languages-list", "mw-pt-translate-header", "mw-pt-progress", "mw-pt-tools")
_CONTENT = re.compile(r"\b(?:content|article|post|entry)\b", re.I)
_BLOCK = frozenset(["address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"])


class Emitter:
    """Block and inline content of a tree as Markdown. ``language`` names the language of a ``pre`` element."""

    def __init__(self, language: Callable[[Node], str] | None = None):
        self.language = language or (lambda pre: "")

    def markdown(self, node: Node) -> str:
        return re.sub(r"\n{3,}", "\n\n", self.blocks(node)).strip("\n") + "\n"

    def blocks(self, node: Node) -> str:
        """Children as blocks with a blank line between; runs of inline children form paragraphs."""
        out: list[str] = []
        run: list[Node] = []

        def flush() -> None:
            text = self.inline_run(run)
            run.clear()
            if text:
                out.append(text)

        for c in node.children:
            if c.element and (c.tag in _BLOCK or self._holds_block(c)):
                flush()
                if made := self.block(c).strip("\n"):
                    out.append(made)
            else:
                run.append(c)
        flush()
        return "\n\n".join(out)

    def _holds_block(self, node: Node) -> bool:
        return node.tag not in ("a", "code") and any(n.element and n.tag in _BLOCK for n in node.walk())

    def inline_run(self, nodes: list[Node]) -> str:
        text = "".join(self.inline(n) for n in nodes)
        lines = [re.sub(r"[ \t]+", " ", x).strip(" \t") + ("  " if x.endswith("  ") else "") for x in text.split("\n")]
        return "\n".join(lines).strip("\n ")

    def block(self, n: Node) -> str:
        handler = getattr(self, f"_block_{n.tag}", None)
        if handler:
            return handler(n)
        if re.fullmatch("h[1-6]", n.tag):
            text = " ".join(self.inline_run(n.children).split())
            return f"{'#' * int(n.tag[1])} {text}" if text else ""
        if n.tag in DROPPED:
            return ""
        return self.blocks(n)

    def _block_hr(self, n: Node) -> str:
        return "---"

    def _block_pre(self, n: Node) -> str:
        text = n.get_text()
        text = text[1:] if text.startswith("\n") else text
        longest = max((len(x) for x in re.findall("`+", text)), default=0)
        mark = "`" * max(3, longest + 1)
        return f"{mark}{self.language(n)}\n{text.rstrip(chr(10))}\n{mark}"

    def _block_blockquote(self, n: Node) -> str:
        inner = self.blocks(n)
        return "\n".join(f"> {x}".rstrip() for x in inner.split("\n")) if inner else ""

    def _list(self, n: Node, mark: Callable[[int], str]) -> str:
        out = []
        for c in n.children:
            if not c.element:
                continue
            inner = self._item(c)
            sign = mark(len(out))
            pad = " " * len(sign)
            out.append(sign + inner.replace("\n", f"\n{pad}"))
        return "\n".join(re.sub(r"(?m)^[ \t]+$", "", x) for x in out)

    def _item(self, n: Node) -> str:
        parts: list[str] = []
        tight = self.blocks(n).split("\n\n") if n.tag != "ul" else [self.blocks(n)]
        for p in tight:
            parts.append(p)
        joined = "\n\n".join(parts)
        return re.sub(r"\n\n(?=(?:[-*+]|\d+\.) )", "\n", joined)

    def _block_ul(self, n: Node) -> str:
        return self._list(n, lambda i: "- ")

    def _block_ol(self, n: Node) -> str:
        start = int(n.get("start")) if n.get("start").isdigit() else 1
        return self._list(n, lambda i: f"{start + i}. ")

    def _block_dt(self, n: Node) -> str:
        return self.inline_run(n.children)

    def _block_dd(self, n: Node) -> str:
        inner = self.blocks(n)
        return ":   " + inner.replace("\n", "\n    ") if inner else ""

    def _block_table(self, n: Node) -> str:
        rows = [r for r in n.find_all("tr") if next((p for p in r.parents() if p.tag == "table"), None) is n]
        table = [[self._cell(c) for c in r.children if c.tag in ("td", "th")] for r in rows]
        table = [r for r in table if r]
        if not table:
            return self.blocks(n)
        width = max(map(len, table))
        table = [r + [""] * (width - len(r)) for r in table]
        first = [c for c in rows[0].children if c.tag in ("td", "th")]
        headed = bool(first) and (all(c.tag == "th" for c in first) or rows[0].parent.tag == "thead")
        head, body = (table[0], table[1:]) if headed else ([""] * width, table)
        lines = [head, ["---"] * width, *body]
        caption = n.find("caption")
        text = "\n".join("| " + " | ".join(r) + " |" for r in lines)
        return f"{self.inline_run(caption.children)}\n\n{text}" if caption else text

    def _cell(self, n: Node) -> str:
        return " ".join(self.blocks(n).split())

    def inline(self, n: Node) -> str:
        if n.tag == "#text":
            return n.text if "$$\n" in n.text else re.sub(r"[ \t\r\n]+", " ", n.text)
        if n.tag == "#comment" or n.tag in DROPPED:
            return ""
        handler = getattr(self, f"_inline_{n.tag}", None)
        return handler(n) if handler else "".join(self.inline(c) for c in n.children)

    def _wrapped(self, n: Node, mark: str) -> str:
        text = "".join(self.inline(c) for c in n.children)
        core = text.strip()
        if not core:
            return text
        return text[: len(text) - len(text.lstrip())] + mark + core + mark + text[len(text.rstrip()) :]

    def _inline_b(self, n: Node) -> str:
        return self._wrapped(n, "**")

    _inline_strong = _inline_b

    def _inline_i(self, n: Node) -> str:
        return self._wrapped(n, "*")

    _inline_em = _inline_i

    def _inline_del(self, n: Node) -> str:
        return self._wrapped(n, "~~")

    _inline_s = _inline_del

    def _inline_code(self, n: Node) -> str:
        text = " ".join(n.get_text().split("\n"))
        longest = max((len(x) for x in re.findall("`+", text)), default=0)
        mark = "`" * (longest + 1)
        pad = " " if text.startswith("`") or text.endswith("`") else ""
        return f"{mark}{pad}{text}{pad}{mark}" if text else ""

    _inline_kbd = _inline_samp = _inline_code

    def _inline_br(self, n: Node) -> str:
        return "  \n"

    def _inline_a(self, n: Node) -> str:
        text = " ".join("".join(self.inline(c) for c in n.children).split())
        href = n.get("href")
        if not href or not text:
            return text
        title = n.get("title")
        shown = f' "{title}"' if title else ""
        target = f"<{href}>" if " " in href else href
        return f"[{text}]({target}{shown})"

    def _inline_img(self, n: Node) -> str:
        src = n.get("src") or n.get("data-src")
        title = n.get("title")
        shown = f' "{title}"' if title else ""
        return f"![{n.get('alt')}]({f'<{src}>' if ' ' in src else src}{shown})" if src else n.get("alt")


def content_root(root: Node) -> Node:
    """Where the page's content is: article, main, a content class or id, body, or everything."""
    return (
        root.find("article")
        or root.find("main")
        or root.find(lambda n: any(_CONTENT.search(c) for c in n.classes))
        or root.find(lambda n: bool(_CONTENT.search(n.get("id"))))
        or root.find("body")
        or root
    )


class Page(NamedTuple):
    title: str
    markdown: str
    formulas: int
    inline: int
    display: int
    review: int
    links: int
    placeholders: int
    images: list[str]


def to_markdown(root: Node, url: str, images: dict[str, str] | None = None, assets: str = "assets") -> str:
    """Markdown of the content; ``images`` maps sources to the local names that replace them."""
    wiki = "wikipedia.org" in url or "wikimedia.org" in url
    for img in root.find_all("img"):
        local = (images or {}).get(img.get("src") or img.get("data-src"))
        if local:
            img.attrs["src"] = f"./{assets}/{local}"
    content = content_root(root)
    for n in content.find_all(DROPPED):
        n.remove()
    if wiki:
        for n in content.find_all(lambda n: not set(WIKI_CHROME).isdisjoint(n.classes) or n.get("id") == "p-lang-btn"):
            n.remove()
    text = Emitter().markdown(content)
    text = reflow.isolate_display(reflow.table_spacing(reflow.definition_tables(text)))
    if wiki:
        text = re.sub(r"\[\[(?:edit|编辑)\]\([^)]*\)\]", "", text)
        text = re.sub(r"\n*\[Edit links\]\([^)]*\).*?\n", "\n", text)
    return text


def convert(source: str, url: str, images: dict[str, str] | None = None, cells_inline: bool = True) -> Page:
    """A page's title and Markdown with counts: normalise, take formulas, convert bare TeX, emit. Null counts as empty."""
    root = parse(source or "")
    title = extract_title(root)
    counts = normalise(root, url or "", title)
    formulas = M.replace_formulas(root)
    bare = M.convert_bare_tex(root, cells_inline)
    found = [i.get("src") or i.get("data-src") for i in root.find_all("img")]
    text = to_markdown(root, url or "", images)
    return Page(title, text, formulas, bare.inline, bare.display, bare.review, counts["links"], counts["placeholders"], [x for x in found if x])
