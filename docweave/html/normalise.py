"""Tree normalisation before any formula is taken out: site chrome, headings, links, placeholders."""

from __future__ import annotations

import re
from urllib.parse import urljoin

from .dom import Node, generator, has_class, text_node

CODE_LIKE = frozenset(["code", "pre", "script", "style", "math"])
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_PLACEHOLDER = re.compile(r"(<[A-Za-z][^<>\n]*>)")
# Characters without width or meaning that sites put into titles.
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00a0\u200e\u200f\uf0c1"


def is_sphinx(root: Node) -> bool:
    return "sphinx" in generator(root) or root.find(lambda n: n.tag == "a" and "headerlink" in n.classes) is not None


def is_gitbook(root: Node) -> bool:
    return "gitbook" in generator(root) or root.find(lambda n: n.get("id") == "book-search-results") is not None


def is_math(n: Node) -> bool:
    return n.element and (n.tag == "math" or (n.tag == "script" and "math/tex" in n.get("type")) or not {"math", "mwe-math-element"}.isdisjoint(n.classes))


def is_opaque(n: Node) -> bool:
    """Text below code, scripts or formulas."""
    return any(p.tag in CODE_LIKE or is_math(p) for p in n.parents())


def drop_book_chrome(root: Node) -> int:
    """The header bar and the search templates; never their container, which holds the body."""

    def chrome(n: Node) -> bool:
        in_search = any(p.get("id") == "book-search-results" for p in n.parents())
        return "book-header" in n.classes or (in_search and not {"has-results", "no-results"}.isdisjoint(n.classes))

    found = root.find_all(chrome)
    for n in found:
        n.remove()
    return len(found)


def clean_title(text: str) -> str:
    from ..functions.latex import title_text

    return title_text(text.translate(dict.fromkeys(map(ord, INVISIBLE))))


def drop_repeated_h1(root: Node, title: str | None) -> int:
    h1 = root.find("h1") if title else None
    if h1 is None or any(n.tag in CODE_LIKE or is_math(n) for n in h1.find_all(lambda n: True)) or clean_title(h1.get_text(strip=True)) != title:
        return 0
    h1.remove()
    return 1


def link_headings(root: Node, base: str) -> int:
    """A heading's permalink moves onto its text, unless the heading has another link."""
    count = 0
    for heading in root.find_all(HEADINGS):
        mark = heading.find(lambda n: n.tag == "a" and "headerlink" in n.classes)
        if mark is None or not mark.get("href"):
            continue
        mark.remove()
        if heading.find("a") is None:
            link = Node("a", {"href": urljoin(base, mark.get("href"))})
            for child in heading.take_children():
                link.add(child)
            heading.add(link)
            count += 1
    return count


def absolute_links(root: Node, base: str, fragments: bool) -> int:
    """Links become absolute; fragment-only ones only where ``fragments``, none within formulas."""
    count = 0
    for link in root.find_all(lambda n: n.tag == "a" and "href" in n.attrs):
        href = link.get("href").strip()
        if not href or href.startswith(("data:", "javascript:", "mailto:", "tel:")) or (href[0] == "#" and not fragments) or any(is_math(p) for p in link.parents()):
            continue
        whole = urljoin(base, href)
        if whole != href:
            link.attrs["href"] = whole
            count += 1
    return count


def guard_placeholders(root: Node) -> int:
    """Text such as ``<name>`` becomes inline code."""
    count = 0
    for node in root.texts():
        parts = _PLACEHOLDER.split(node.text)
        if len(parts) == 1 or is_opaque(node):
            continue
        made = []
        for i, part in enumerate(parts):
            if i % 2:
                made.append(Node("code"))
                made[-1].add(text_node(part))
                count += 1
            elif part:
                made.append(text_node(part))
        node.replace(*made)
    return count


def normalise(root: Node, base: str, title: str | None = None) -> dict[str, int]:
    """All steps in their order; it must come before formulas are replaced."""
    sphinx = is_sphinx(root)
    if is_gitbook(root):
        drop_book_chrome(root)
    return {
        "repeated_h1": drop_repeated_h1(root, title),
        "headings": link_headings(root, base) if sphinx else 0,
        "links": absolute_links(root, base, sphinx),
        "placeholders": guard_placeholders(root),
    }


def extract_title(root: Node) -> str:
    """First non-empty h1, else the social titles, else the title element up to a bar, else ``untitled``."""
    for h1 in root.find_all("h1"):
        if found := clean_title(h1.get_text(strip=True)):
            return found
    for key in ("og:title", "twitter:title"):
        meta = root.find(lambda n, key=key: n.tag == "meta" and key in (n.get("property"), n.get("name")))
        if meta and (found := clean_title(meta.get("content").strip())):
            return found
    title = root.find("title")
    return (clean_title(title.get_text(strip=True).split(" | ")[0]) if title else "") or "untitled"


__all__ = ["HEADINGS", "absolute_links", "clean_title", "drop_book_chrome", "drop_repeated_h1", "extract_title", "guard_placeholders", "has_class", "is_gitbook", "is_math", "is_opaque", "is_sphinx", "link_headings", "normalise"]
