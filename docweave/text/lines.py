"""Physical lines, Markdown line classes, and the parts of a line that carry prose."""

from __future__ import annotations

import re
from itertools import accumulate
from typing import NamedTuple

from .scan import Span, closing_bracket, closing_paren, next_unescaped

# Fixed patterns of the Markdown dialect.
FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
DELIMITER_ROW = re.compile(r"^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)*\|?\s*$")
UNDERLINE = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
REFERENCE = re.compile(r"^ {0,3}\[([^\]^][^\]]*)\]:[ \t]*(.+)$")
FOOTNOTE = re.compile(r"^( {0,3}\[\^[^\]]+\]:[ \t]*)(.*)$")
RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
INDENTED = re.compile(r"^(?: {4,}| {0,3}\t)")


class Line(NamedTuple):
    number: int
    start: int
    content_end: int
    end: int
    content: str
    newline: str


def split_lines(text: str) -> list[Line]:
    """Lines ended by CRLF, LF or CR, with offsets; an empty text is one empty line."""
    out: list[Line] = []
    parts = re.split(r"(\r\n|\n|\r)", text)
    at = 0
    for content, newline in zip(parts[::2], [*parts[1::2], ""], strict=True):
        if content or newline or not out:
            end = at + len(content)
            out.append(Line(len(out) + 1, at, end, end + len(newline), content, newline))
        at += len(content) + len(newline)
    return out


def reference_id(label: str) -> str:
    return " ".join(label.lower().split())


def reference_ids(lines: list[Line]) -> set[str]:
    return {reference_id(m[1]) for line in lines if (m := REFERENCE.match(line.content))}


def without_quote(content: str) -> str:
    """The line without its quote prefix (``>`` marks, each with a space or tab, and up to three more spaces)."""
    m = re.match(r" {0,3}(?:>[ \t]? {0,3})+", content)
    return content[m.end() :] if m else content


def _fence_end(lines: list[Line], i: int) -> int | None:
    opened = FENCE.match(without_quote(lines[i].content))
    if not opened:
        return None
    for k in range(i + 1, len(lines)):
        mark = FENCE.match(without_quote(lines[k].content))
        if mark and mark[1].startswith(opened[1]) and not mark[2].strip():
            return k + 1
    return len(lines)


def _formula_end(lines: list[Line], i: int) -> int | None:
    start = without_quote(lines[i].content).strip()
    closer = {"$$": "$$", "\\[": "\\]"}.get(start[:2])
    if closer is None or closer in start[2:]:
        return None
    return next((k + 1 for k in range(i + 1, len(lines)) if (at := lines[k].content.find(closer)) >= 0 and next_unescaped(lines[k].content, closer, at) == at), len(lines))


def _markup_end(lines: list[Line], i: int) -> int | None:
    inner = without_quote(lines[i].content).lower()
    for opener, closer in (("script", "</script>"), ("style", "</style>"), ("pre", "</pre>"), ("code", "</code>"), ("!--", "-->")):
        at = inner.find("<" + opener)
        while at >= 0 and opener[0] != "!" and inner[at + len(opener) + 1 : at + len(opener) + 2] not in (" ", "\t", ">"):
            at = inner.find("<" + opener, at + 1)
        if at >= 0:
            # A comment closes after its opener, an element anywhere on the line.
            if closer in (inner[at:] if opener[0] == "!" else inner):
                return i + 1
            return next((k + 1 for k in range(i + 1, len(lines)) if closer in lines[k].content.lower()), len(lines))
    return None


REGIONS = (_fence_end, _formula_end, _markup_end)


def protected(lines: list[Line]) -> set[int]:
    """Indices of lines that hold no prose: front matter, code, display formulas, raw HTML, rules, table and heading marks.

    Regions are intervals of lines, each from its opener to its closer or the end; between them lines stand for themselves.
    """
    at = 0
    if lines and lines[0].content.strip() == "---":
        at = next((i for i in range(1, len(lines)) if lines[i].content.strip() in ("---", "...")), len(lines) - 1) + 1
    found = set(range(at))
    while at < len(lines):
        alone = INDENTED.match(without_quote(lines[at].content)) or any(p.match(lines[at].content) for p in (RULE, DELIMITER_ROW, UNDERLINE, REFERENCE))
        end = None if alone and not FENCE.match(without_quote(lines[at].content)) else next((e for region in REGIONS if (e := region(lines, at)) is not None), None)
        if alone or end is not None:
            found.update(range(at, end or at + 1))
        at = end or at + 1
    return found


def table_rows(lines: list[Line]) -> set[int]:
    """Indices of the header line before and the body lines after each delimiter row."""
    bars = ["|" in line.content for line in lines]
    # For each line the first one from it on that has no bar: a body ends there.
    reach = list(accumulate(range(len(lines) - 1, -1, -1), lambda r, i: r if bars[i] else i, initial=len(lines)))[::-1]
    marks = [i for i, line in enumerate(lines) if DELIMITER_ROW.match(line.content)]
    found = {k for i in marks for k in range(i + 1, reach[i + 1])}
    return found | {i - 1 for i in marks if i and bars[i - 1]}


def underlined(lines: list[Line]) -> dict[int, int]:
    """Index and level of each heading that the next line underlines (``=`` 1, ``-`` 2)."""
    out = {}
    for i, (line, below) in enumerate(zip(lines, lines[1:], strict=False)):
        m = UNDERLINE.match(below.content)
        if m and line.content.strip():
            out[i] = 1 if m[1][0] == "=" else 2
    return out


def footnote_lines(lines: list[Line]) -> set[int]:
    """Indices of indented lines that continue a footnote definition: neither they nor blank lines end it."""

    def kind(line: Line) -> str:
        if FOOTNOTE.match(line.content):
            return "note"
        return "deep" if line.content.startswith(("    ", "\t")) and line.content.strip() else "text" if line.content.strip() else "blank"

    kinds = [kind(line) for line in lines]
    owner = accumulate(kinds, lambda last, k: k if k in ("note", "text") else last, initial="text")
    return {i for i, (k, o) in enumerate(zip(kinds, owner, strict=False)) if k == "deep" and o == "note"}


_CELL_TOKEN = re.compile(r"\\\(|\\\[|\\.|`+|\$\$|\$|!?\[|\|", re.S)


def pipes(text: str) -> list[int]:
    """Offsets of ``|`` that separate cells: not escaped, not within code, formulas or links."""
    found, at = [], 0
    while m := _CELL_TOKEN.search(text, at):
        token, at = m[0], m.end()
        if token == "|":
            found.append(m.start())
        elif token[0] == "`" or token in ("$", "$$"):
            close = next_unescaped(text, token, at)
            if close >= 0:
                at = close + len(token)
            elif len(token) > 1:
                at = m.start() + 1
        elif token.endswith("[") and token[0] != "\\":
            at = _after_link(text, m.end() - 1) or at
    return found


def _after_link(text: str, opener: int) -> int | None:
    close = closing_bracket(text, opener)
    if close < 0 or close + 1 >= len(text):
        return None
    if text[close + 1] == "(" and (end := closing_paren(text, close + 1)) >= 0:
        return end + 1
    if text[close + 1] == "[" and (end := text.find("]", close + 2)) >= 0:
        return end + 1
    return None


def cells(content: str) -> list[Span]:
    """Trimmed, non-empty cells of a table row."""
    at = pipes(content)
    if not at:
        return []
    edges = [-1, *at, len(content)] if at[0] else [*at, len(content)]
    out = []
    for low, high in zip(edges, edges[1:], strict=False):
        own = content[low + 1 : high]
        if own.strip(" \t"):
            start = low + 1 + len(own) - len(own.lstrip(" \t"))
            out.append(Span(start, start + len(own.strip(" \t"))))
    return out


_PREFIX = re.compile(r"[ \t]*(?P<quote>(?:>[ \t]?(?: {0,3}(?=>))?)*)(?P<item>(?:[-+*]|\d+[.)])[ \t]+(?:\[[ xX]\][ \t]+)?)?(?P<head>#{1,6}[ \t]+)?")


class Payload(NamedTuple):
    start: int
    end: int
    heading: bool
    own_line: bool


def payload(content: str) -> Payload | None:
    """The prose of a line between its quote, list, task and heading marks and its trailing marks; None if there is none."""
    m = _PREFIX.match(content)
    start = m.end()
    end = len(content.rstrip(" \t"))
    if m["head"] and (tail := re.search(r"[ \t]+#+$", content[start:end])):
        end = start + tail.start()
    body = content[start:end]
    if body.endswith("\\") and (len(body) - len(body.rstrip("\\"))) % 2 == 1:
        end -= 1
    if end <= start:
        return None
    return Payload(start, end, bool(m["head"]), bool(m["quote"] or m["item"]))
