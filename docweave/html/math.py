"""Formulas of a page: known carriers become ``$`` text, bare TeX delimiters are converted where that is safe."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from ..text.scan import balanced
from .dom import Node, has_class, text_node
from .normalise import CODE_LIKE, is_math, is_opaque

# Names that TeX sets upright, and operators.
FUNCTIONS = ["sin", "cos", "tan", "cot", "sec", "csc", "arcsin", "arccos", "arctan", "sinh", "cosh", "tanh", "coth", "log", "ln", "lg", "exp", "lim", "sup", "inf", "max", "min", "det", "dim", "gcd", "deg", "arg", "ker", "hom", "Pr", "mod"]
OPERATORS = {"−": "-", "×": r"\times ", "→": r"\to ", "≤": r"\leq ", "≥": r"\geq ", "≠": r"\neq ", "≈": r"\approx ", "≡": r"\equiv ", "∝": r"\propto ", "∈": r"\in ", "±": r"\pm ", "∞": r"\infty ", "⋅": r"\cdot ", "…": r"\dots ", "\u2061": "", "\u2062": "", "\u2063": "", "\u2064": ""}
ACCENTS = {"¯": "bar", "→": "vec", "⟶": "vec", "^": "hat", "\u0302": "hat", "˜": "tilde", "~": "tilde", "\u0303": "tilde", "¨": "ddot"}
_SPLIT_NAME = re.compile(r"(?<!\\)\b(" + "|".join(sorted((f for f in FUNCTIONS if f != "Pr"), key=len, reverse=True)) + r")(?=[(\s]|$)")


def dollars(latex: str, display: bool) -> str:
    return f"$$\n{latex}\n$$" if display else f"${latex}$"


# --- MathML ---------------------------------------------------------------------------------------------------------

_PATTERNS = {"msub": "{0}_{{{1}}}", "msup": "{0}^{{{1}}}", "msubsup": "{0}_{{{1}}}^{{{2}}}", "mfrac": r"\frac{{{0}}}{{{1}}}", "mroot": r"\sqrt[{1}]{{{0}}}", "munder": r"\underset{{{1}}}{{{0}}}", "munderover": r"\underset{{{1}}}{{\overset{{{2}}}{{{0}}}}}"}


def mathml(node: Node) -> str:
    """LaTeX of a MathML element; unknown elements give their content."""
    if not node.element:
        return node.text if node.tag == "#text" else ""
    inner = "".join(mathml(c) for c in node.children).strip()
    parts = [mathml(c) for c in node.children if c.element]
    match node.tag:
        case "mi":
            return f"\\{inner} " if inner in FUNCTIONS else inner
        case "mo":
            return OPERATORS.get(inner, inner)
        case "mtext":
            return rf"\text{{{inner}}}" if inner else " "
        case "mspace":
            return " "
        case "msqrt":
            return rf"\sqrt{{{inner}}}"
        case "menclose":
            return rf"\boxed{{{inner}}}"
        case "mover":
            mark = node.find("mo")
            return rf"\{ACCENTS.get(mark.get_text().strip() if mark else '', 'dot')}{{{parts[0] if parts else ''}}}"
        case "mtable":
            return _table(node) or inner
        case "mtr":
            return " & ".join(parts) + r" \\"
        case "mlabeledtr":
            return " & ".join(parts[1:]) + r" \\"
    if node.tag in _PATTERNS:
        return _PATTERNS[node.tag].format(*parts, "", "", "")
    return inner


def _table(node: Node) -> str:
    rows = [r for r in node.children if r.tag == "mtr"] or node.find_all("mtr")
    cells = [[mathml(c) for c in ([c for c in r.children if c.tag == "mtd"] or r.find_all("mtd"))] for r in rows]
    cells = [c for c in cells if c]
    if not cells:
        return ""
    if max(map(len, cells)) == 1 and len(cells) <= 4:
        return ", ".join(c[0].strip() for c in cells)
    return "\\begin{bmatrix}\n" + " \\\\\n".join(" & ".join(c) for c in cells) + "\n\\end{bmatrix}"


# --- known carriers -------------------------------------------------------------------------------------------------


def _annotation(node: Node) -> str | None:
    found = node.find(lambda n: n.tag == "annotation" and n.get("encoding") == "application/x-tex")
    return found.get_text().strip() or None if found else None


def encyclopedia_latex(node: Node) -> str | None:
    """The balanced, then longest, of a formula's annotation and its image's alternative text."""
    image = node.find("img")
    found = [x for x in (_annotation(node), image.get("alt").strip() if image else None) if x]
    return max([x for x in found if balanced(x)] or found, key=len, default=None)


def _encyclopedia(root: Node) -> Iterator[tuple[Node, str | None, bool]]:
    for n in root.find_all(has_class("mwe-math-element")):
        wrapper = n.find(lambda c: any("mwe-math-mathml" in k for k in c.classes))
        yield n, encyclopedia_latex(n), bool(wrapper and "display" in wrapper.classes[0])


def _classed(root: Node) -> Iterator[tuple[Node, str | None, bool]]:
    for n in root.find_all(lambda n: any(re.search(r"\bmath\b", c) for c in n.classes)):
        text = n.get_text().strip()
        whole = re.fullmatch(r"\\\[(.*)\\\]|\\\((.*)\\\)", text, re.S)
        if whole:
            yield n, text[2:-2], text[1] == "["
        elif r"\[" in text or r"\(" in text:
            yield n, text, True
        elif re.search(r"[\\{}^_]", text):
            yield n, text, n.tag == "div"


def _scripts(root: Node) -> Iterator[tuple[Node, str | None, bool]]:
    for n in root.find_all(lambda n: n.tag == "script" and "math/tex" in n.get("type")):
        yield n, n.get_text().strip(), "mode=display" in n.get("type")


def _annotated(root: Node) -> Iterator[tuple[Node, str | None, bool]]:
    for n in root.find_all("math"):
        yield n, _annotation(n), n.get("display") == "block" or n.get("mode") == "display" or n.get("displaystyle") == "true"


def _containers(root: Node) -> Iterator[tuple[Node, str | None, bool]]:
    for n in root.find_all("mjx-container"):
        assistive = n.find("mjx-assistive-mml")
        inner = assistive.find("math") if assistive else None
        latex = mathml(inner) if inner else ""
        yield n, _SPLIT_NAME.sub(lambda m: f"\\{m[1]} ", latex), n.get("display") == "true"


CARRIERS = (_encyclopedia, _classed, _scripts, _annotated, _containers)


def replace_formulas(root: Node) -> int:
    """Formulas in known carriers, one kind after another, become text between dollars. Returns their number."""
    count = 0
    for carrier in CARRIERS:
        for node, latex, display in list(carrier(root)):
            if latex and node.parent is not None:
                node.replace(text_node(dollars(latex, display)))
                count += 1
    return count


# --- bare delimiters ------------------------------------------------------------------------------------------------

BLOCKS = frozenset(["p", "li", "td", "th", "dt", "dd", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "figcaption", "div"])
MAX_NODES, MAX_CHARS = 12, 2000
_DELIMITER = re.compile(r"\\(.)", re.S)


class Mark(NamedTuple):
    node: Node
    at: int
    sign: str


class BareCounts(NamedTuple):
    inline: int
    display: int
    review: int


def _marks(node: Node) -> list[Mark]:
    """Unescaped delimiters of a text node: a pair of backslashes is consumed as one escape."""
    return [Mark(node, m.start(), m[1]) for m in _DELIMITER.finditer(node.text) if m[1] in "()[]"]


def _block(node: Node) -> Node | None:
    return next((p for p in node.parents() if p.tag in BLOCKS), None)


def _in_cell(node: Node) -> bool:
    return any(p.tag in ("td", "th") for p in node.parents())


def _within_node(text: str, cell: bool) -> tuple[str, int, int]:
    """Pairs inside one text node."""
    out, at, inline, display = [], 0, 0, 0
    for m in re.finditer(r"(?<!\\)\\([\[(])", text):
        if m.start() < at:
            continue
        close = re.compile(r"(?<!\\)\\" + ("\\)" if m[1] == "(" else "\\]")).search(text, m.end())
        if close is None:
            continue
        short = m[1] == "(" or cell
        sign = "$" if short else "$$"
        out += [text[at : m.start()], sign, text[m.end() : close.start()], sign]
        inline, display = inline + short, display + (not short)
        at = close.end()
    return "".join([*out, text[at:]]), inline, display


def _neutral_between(root: Node, first: Node, last: Node, block: Node) -> bool:
    """Only spans and text lie between the two nodes, and above them up to the block."""
    between, inside = [], False
    for n in block.walk():
        if n is first:
            inside = True
        elif n is last:
            break
        elif inside:
            between.append(n)
    spans = all(n.tag in ("#text", "span") and not is_math(n) for n in between)

    def above(n: Node) -> bool:
        for p in n.parents():
            if p is block:
                return True
            if p.tag != "span" or is_math(p):
                return False
        return False

    texts = [first, *(n for n in between if n.tag == "#text"), last]
    return spans and len(texts) <= MAX_NODES and all(above(n) for n in texts)


def _across_nodes(root: Node, cells_inline: bool) -> tuple[int, int]:
    inline = display = 0
    tried: set[tuple[int, int]] = set()
    while True:
        marks = [m for n in root.texts() if not is_opaque(n) for m in _marks(n)]
        blocks = [_block(m.node) for m in marks]
        for i, m in enumerate(marks):
            if m.sign not in "([" or blocks[i] is None or (id(m.node), m.at) in tried:
                continue
            j = next((k for k in range(i + 1, len(marks)) if blocks[k] is blocks[i]), None)
            if j is None or marks[j].node is m.node or marks[j].sign != {"(": ")", "[": "]"}[m.sign] or not _neutral_between(root, m.node, marks[j].node, blocks[i]):
                continue
            end = marks[j]
            inner = [n for n in blocks[i].texts()]
            a, b = (next(k for k, n in enumerate(inner) if n is x) for x in (m.node, end.node))
            latex = m.node.text[m.at + 2 :] + "".join(n.text for n in inner[a + 1 : b]) + end.node.text[: end.at]
            if len(latex) > MAX_CHARS:
                tried.add((id(m.node), m.at))
                continue
            short = m.sign == "(" or (cells_inline and (blocks[i].tag in ("td", "th") or _in_cell(blocks[i])))
            sign = "$" if short else "$$"
            m.node.text = m.node.text[: m.at] + sign + latex + sign
            for n in inner[a + 1 : b]:
                n.text = ""
            end.node.text = end.node.text[end.at + 2 :]
            inline, display = inline + short, display + (not short)
            break
        else:
            return inline, display


def convert_bare_tex(root: Node, cells_inline: bool = True) -> BareCounts:
    r"""``\(..\)`` and ``\[..\]`` in text become ``$`` and ``$$``, in table cells always ``$``; what stays open is counted for review.

    A pair may reach over at most 12 text nodes and 2000 characters of one block, with nothing but neutral spans between.
    """
    inline = display = 0
    for node in root.texts():
        if ("\\(" in node.text or "\\[" in node.text) and not is_opaque(node):
            node.text, i, d = _within_node(node.text, cells_inline and _in_cell(node))
            inline, display = inline + i, display + d
    i, d = _across_nodes(root, cells_inline)
    review = sum(m.sign in "([" for n in root.texts() if not is_opaque(n) for m in _marks(n))
    return BareCounts(inline + i, display + d, review)


__all__ = ["CODE_LIKE", "BareCounts", "convert_bare_tex", "dollars", "encyclopedia_latex", "mathml", "replace_formulas"]
