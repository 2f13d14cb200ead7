"""Translation units: prose spans of a Markdown text, their protected inline syntax, blocks of units, and rendering."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import asdict, dataclass, field

from . import lines as L
from .scan import closing_bracket, closing_paren, next_unescaped

KEEP = re.compile(r"@@KEEP:[0-9]+:[0-9]+@@")
SEGMENT = re.compile(r"^@@SEG:(block-[0-9]+):([0-9]+)@@$")
SEGMENT_ANYWHERE = re.compile(r"@@SEG:[^@\r\n]+@@")
RESERVED = re.compile(r"@@(?:KEEP|SEG):")
LATIN = re.compile(r"[A-Za-z]")
MOJIBAKE = re.compile(r"\ufffd|Ã|Â|â€|ðŸ|锟斤拷")
SYNTAX = re.compile(r"[`*_\[\]<>|\\$]")
BLOCK_MARK = re.compile(r"^(?: {0,3}(?:#{1,6}(?:[ \t]+|$)|[-+*][ \t]+|>[ \t]?|\d+[.)][ \t]+|(?:=+|-+)[ \t]*$)|(?: {4,}| {0,3}\t)[ \t]*\S)")
DIRECTIVE = re.compile(r"^(?P<prefix>\s*(?:>[ \t]?)*)(?P<mark>:::\{?[\w-]+\}?|!!![\w-]*|\?\?\?[\w-]*|\[![\w-]+\])[ \t]+(?P<text>.*?)[ \t]*$", re.A)
MAX_BLOCK_CHARS = 16000
MAX_ATTEMPTS = 3

_INLINE = re.compile(
    r"""(?P<template>\{\{)|(?P<code>`+)|(?P<math>\$\$|\\\(|\\\[|\$)|(?P<escape>\\.)
    |(?P<autolink><(?:https?://[^<>\s]+|mailto:[^<>\s]+|[^<>\s@]+@[^<>\s@]+)>)
    |(?P<html_comment><!--.*?-->)|(?P<html_tag></?[A-Za-z][A-Za-z0-9:-]*(?:\s[^<>]*?)?/?>)
    |(?P<entity>&(?:\#[0-9]+|\#x[0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]+);)|(?P<raw_url>https?://[^\s<>"']+)
    |(?P<bracket>!?\[)|(?P<format>\*\*\*|___|\*\*|__|~~|\*|_)""",
    re.S | re.X,
)
_CLOSERS = {"$$": "$$", "$": "$", r"\(": r"\)", r"\[": r"\]"}


@dataclass
class Token:
    marker: str
    value: str
    kind: str
    pair_id: str | None = None
    pair_role: str | None = None


@dataclass
class Unit:
    id: str
    kind: str
    start: int
    end: int
    line_start: int
    line_end: int
    source_text: str
    template: str
    tokens: list[Token]
    section: str
    context_before: str = ""
    context_after: str = ""

    @property
    def chars(self) -> int:
        return len(visible(self.template))


@dataclass
class Region:
    """A line whose prose, if any, someone has to point out."""

    id: str
    line: int
    start: int
    end: int
    raw: str
    section: str
    suggested: list[tuple[int, int, str]]
    context_before: str = ""
    context_after: str = ""


def visible(template: str) -> str:
    return KEEP.sub("", template)


def trim_url(url: str) -> str:
    """A raw URL without trailing punctuation and without closing parentheses that it never opened."""
    url = url.rstrip(".,;:!?")
    while url.endswith(")") and url.count("(") < url.count(")"):
        url = url[:-1]
    return url


class Template:
    """Replaces inline syntax by markers; the text is read token by token, labels recursively."""

    def __init__(self, text: str, number: int, references: set[str]):
        self.number, self.references = number, references
        self.tokens: list[Token] = []
        self.text = self._read(text)
        self._pair()

    def _keep(self, value: str, kind: str) -> str:
        self.tokens.append(Token(f"@@KEEP:{self.number}:{len(self.tokens) + 1}@@", value, kind))
        return self.tokens[-1].marker

    def _read(self, text: str) -> str:
        out, at = [], 0
        while m := _INLINE.search(text, at):
            out.append(text[at : m.start()])
            made, at = getattr(self, f"_on_{m.lastgroup}", self._on_plain)(text, m)
            out.append(made)
        return "".join([*out, text[at:]])

    def _on_plain(self, text: str, m: re.Match) -> tuple[str, int]:
        return self._keep(m[0], m.lastgroup), m.end()

    def _on_template(self, text: str, m: re.Match) -> tuple[str, int]:
        end = text.find("}}", m.end())
        return (self._keep(text[m.start() : end + 2], "template"), end + 2) if end >= 0 else ("{", m.start() + 1)

    def _on_code(self, text: str, m: re.Match) -> tuple[str, int]:
        end = next_unescaped(text, m[0], m.end())
        return (self._keep(text[m.start() : end + len(m[0])], "inline_code"), end + len(m[0])) if end >= 0 else ("`", m.start() + 1)

    def _on_math(self, text: str, m: re.Match) -> tuple[str, int]:
        for opener in dict.fromkeys((m[0], m[0][0])):
            closer = _CLOSERS.get(opener)
            end = next_unescaped(text, closer, m.start() + len(opener)) if closer else -1
            if end >= 0:
                return self._keep(text[m.start() : end + len(closer)], "math"), end + len(closer)
        if m[0][0] == "\\":
            return self._keep(m[0], "escape"), m.end()
        return "$", m.start() + 1

    def _on_raw_url(self, text: str, m: re.Match) -> tuple[str, int]:
        url = trim_url(m[0])
        return self._keep(url, "raw_url"), m.start() + len(url)

    def _on_bracket(self, text: str, m: re.Match) -> tuple[str, int]:
        image, opener = m[0] == "![", m.end() - 1
        close = closing_bracket(text, opener)
        if close < 0:
            return m[0][0], m.start() + 1
        label, after = text[m.end() : close], close + 1
        if not image and label[:1] in ("^", "@"):
            return self._keep(text[m.start() : after], "reference"), after
        target, kind = -1, ""
        if text.startswith("(", after):
            target, kind = closing_paren(text, after), "link_target"
        elif text.startswith("[", after):
            target, kind = text.find("]", after + 1), "reference_target"
        if target < 0 and not image and L.reference_id(label) in self.references:
            return self._keep(text[m.start() : after], "shortcut_reference"), after
        end = target + 1 if target >= 0 else after
        opening = self._keep(text[m.start() : m.end()], "image_open" if image else "link_open" if target >= 0 else "bracket_open")
        return opening + self._read(label) + self._keep(text[close:end], kind if target >= 0 else "bracket_close"), end

    def _pair(self) -> None:
        waiting: dict[str, list[Token]] = {}
        number = 0
        for t in self.tokens:
            key = t.value if t.kind == "format" else "structure"
            stack = waiting.setdefault(key, [])
            closes = bool(stack) if t.kind == "format" else t.kind in ("link_target", "reference_target", "bracket_close") and bool(stack)
            if closes:
                number += 1
                other = stack.pop()
                other.pair_id = t.pair_id = f"pair-{number}"
                other.pair_role, t.pair_role = "open", "close"
            elif t.kind == "format" or t.kind in ("link_open", "image_open", "bracket_open"):
                stack.append(t)
        self._unpair_crossed()

    def _unpair_crossed(self) -> None:
        """Pairs that cross in the source itself bind nothing; else no translation, not even the source, could be accepted."""
        open_: list[str] = []
        loose: set[str] = set()
        for t in self.tokens:
            if t.pair_role == "open":
                open_.append(t.pair_id)
            elif t.pair_role == "close":
                if open_[-1] != t.pair_id:
                    loose.add(t.pair_id)
                open_.remove(t.pair_id)
        for t in self.tokens:
            if t.pair_id in loose:
                t.pair_id = t.pair_role = None


class ReservedMarker(ValueError):
    pass


@dataclass
class Extraction:
    units: list[Unit] = field(default_factory=list)
    regions: list[Region] = field(default_factory=list)


def extract(text: str) -> Extraction:
    """The units and ambiguous regions of a text, in order. Text that holds a reserved marker raises ReservedMarker."""
    lines = L.split_lines(text)
    references = L.reference_ids(lines)
    notes = L.footnote_lines(lines)
    hidden = L.protected(lines) - notes
    rows, heads = L.table_rows(lines), L.underlined(lines)
    out = Extraction()
    section = ""
    run: list[tuple[L.Line, int, int]] = []  # consecutive prose lines: one paragraph

    def add(start: int, end: int, kind: str, first: L.Line, last: L.Line) -> Unit | None:
        number = len(out.units) + 1
        t = Template(text[start:end], number, references)
        if not LATIN.search(visible(t.text)):
            return None
        bare = t.text
        for token in t.tokens:
            bare = bare.replace(token.marker, "", 1)
        if RESERVED.search(bare):
            raise ReservedMarker("the text holds a reserved marker")
        unit = Unit(f"unit-{number:04d}", kind, start, end, first.number, last.number, text[start:end], t.text, t.tokens, section)
        out.units.append(unit)
        return unit

    def close_paragraph() -> None:
        if run:
            add(run[0][1], run[-1][2], "text", run[0][0], run[-1][0])
            run.clear()

    for i, line in enumerate(lines):
        content, base = line.content, line.start
        if i in hidden:
            close_paragraph()
            continue
        note = FOOTNOTE_START(content) if i not in notes else re.match(r"[ \t]*", content).end()
        if note is not None:
            close_paragraph()
            end = len(content.rstrip(" \t"))
            if note < end:
                add(base + note, base + end, "footnote", line, line)
            continue
        directive = DIRECTIVE.match(content)
        if directive and LATIN.search(directive["text"]):
            close_paragraph()
            span = base + directive.start("text"), base + directive.end("text")
            out.regions.append(Region(f"unknown-{len(out.regions) + 1:04d}", line.number, base, line.content_end, content, section, [(*span, text[slice(*span)])]))
            continue
        if i in rows:
            close_paragraph()
            for s, e in L.cells(content):
                add(base + s, base + e, "table_cell", line, line)
            continue
        p = L.payload(content)
        if p is None:
            close_paragraph()
            continue
        start, end = base + p.start, base + p.end
        if p.heading or i in heads:
            close_paragraph()
            title = visible(Template(text[start:end], 0, references).text).strip()
            unit = add(start, end, "heading", line, line)
            section = title or section
            if unit:
                unit.section = section
        elif p.own_line:
            close_paragraph()
            add(start, end, "text", line, line)
        else:
            if run and run[-1][0].end != base:
                close_paragraph()
            run.append((line, start, end))
    close_paragraph()
    _add_context(out)
    return out


def FOOTNOTE_START(content: str) -> int | None:
    m = L.FOOTNOTE.match(content)
    return len(m[1]) if m else None


def _add_context(found: Extraction) -> None:
    """Nearest item on either side, by offset; items that begin at the same place are no neighbours."""
    items = sorted([(u.start, u.template, u) for u in found.units] + [(r.start, r.raw, r) for r in found.regions], key=lambda x: x[0])
    starts = [x[0] for x in items]
    from bisect import bisect_left, bisect_right

    for start, _, item in items:
        low, high = bisect_left(starts, start), bisect_right(starts, start)
        item.context_before = items[low - 1][1] if low else ""
        item.context_after = items[high][1] if high < len(items) else ""


# --- blocks ---------------------------------------------------------------------------------------------------------


def segment(block: str, number: int) -> str:
    return f"@@SEG:{block}:{number:04d}@@"


def surface(block: str, templates: list[str]) -> str:
    return "".join(f"{segment(block, i)}\n{t}\n" for i, t in enumerate(templates, 1))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def blocks(units: list[Unit], limit: int = MAX_BLOCK_CHARS) -> list[dict]:
    """Blocks of units: a block never crosses a heading and exceeds ``limit`` visible characters only with one unit."""
    if limit <= 0:
        raise ValueError("the limit must be positive")
    groups: list[list[Unit]] = []
    room = 0
    for u in units:
        if not groups or u.kind == "heading" or u.chars > room:
            groups.append([])
            room = limit
        groups[-1].append(u)
        room -= u.chars
    out = []
    for n, group in enumerate(groups, 1):
        name = f"block-{n:04d}"
        shown = surface(name, [u.template for u in group])
        named = [u.section for u in group if u.section]
        out.append(
            {"id": name, "unit_ids": [u.id for u in group], "unit_count": len(group), "line_start": group[0].line_start, "line_end": group[-1].line_end, "section_start": named[0] if named else "", "section_end": named[-1] if named else "",
             "translatable_chars": sum(u.chars for u in group), "surface_bytes": len(shown.encode()), "surface_sha256": sha(shown), "surface": shown}
        )
    return out


# --- validation -----------------------------------------------------------------------------------------------------


def introduced_syntax(before: str, after: str, kind: str = "text") -> list[str]:
    """Rules that ``after`` breaks by having more Markdown syntax than ``before``."""
    had, has = Counter(SYNTAX.findall(before)), Counter(SYNTAX.findall(after))
    broken = [f"syntax {c}" for c in sorted(has) if has[c] > had[c]]
    broken += [f"syntax {p}" for p in ("{{", "}}", "~~") if after.count(p) > before.count(p)]

    def marks(t: str) -> int:
        return sum(bool(BLOCK_MARK.match(line)) for line in t.split("\n"))

    if kind == "text" and marks(after) > marks(before):
        broken.append("block mark")
    return broken


def template_errors(unit: Unit, translated: str) -> list[str]:
    """Why a translation of the unit's template is rejected; empty if it is accepted."""
    order = KEEP.findall(translated)
    if Counter(order) != Counter(t.marker for t in unit.tokens):
        return ["markers differ"]
    place = {m: i for i, m in enumerate(order)}
    pairs: dict[str, dict[str, int]] = {}
    for t in unit.tokens:
        if t.pair_id:
            pairs.setdefault(t.pair_id, {})[t.pair_role] = place[t.marker]
    spans = sorted((p.get("open", -1), p.get("close", -1)) for p in pairs.values())
    if any(o < 0 or c <= o for o, c in spans):
        return ["pair reversed"]
    ends: list[int] = []
    for o, c in spans:  # nested pairs close inside out
        while ends and ends[-1] < o:
            ends.pop()
        if ends and ends[-1] < c:
            return ["pairs crossed"]
        ends.append(c)
    return introduced_syntax(visible(unit.template), visible(translated), unit.kind)


def fill(unit: Unit, translated: str) -> str:
    for t in unit.tokens:
        translated = translated.replace(t.marker, t.value)
    return translated


def parse_surface(block: dict, units: dict[str, Unit], answer: str) -> tuple[dict[str, str], str]:
    """(translations by unit, first error or '') of a translated block."""
    if MOJIBAKE.search(answer):
        return {}, "mojibake"
    found: dict[str, list[str]] = {}
    expected = [(segment(block["id"], i), u) for i, u in enumerate(block["unit_ids"], 1)]
    queue, own = list(reversed(expected)), None
    for line in answer.splitlines():
        if SEGMENT.match(line):
            if not queue or queue[-1][0] != line:
                return {}, "extra content" if not queue else "segments out of order"
            own = queue.pop()[1]
            found[own] = []
        elif own is None:
            return {}, "segments out of order"
        else:
            found[own].append(line)
    if queue:
        return {}, "segments out of order"
    for name, content in found.items():
        if not "".join(content).strip():
            return {}, f"{name} is empty"
        if any(SEGMENT_ANYWHERE.search(c) for c in content):
            return {}, f"{name} holds a segment mark"
        if any(not c.strip() for c in content):
            return {}, f"{name} changes paragraphs"
        if errors := template_errors(units[name], "\n".join(content)):
            return {}, f"{name}: {errors[0]}"
    return {k: "\n".join(v) for k, v in found.items()}, ""


# --- rendering ------------------------------------------------------------------------------------------------------


def line_ending(text: str) -> str:
    m = re.search(r"\r?\n", text)
    return m[0] if m else "\n"


def splice(text: str, edits: list[tuple[int, int, str]]) -> str:
    """``text`` with the edits (start, end, value), which must not overlap and must lie inside it."""
    out, at = [], 0
    for start, end, value in sorted(edits, key=lambda e: e[:2]):
        if start < at or end < start or end > len(text):
            raise ValueError("edits overlap or lie outside the text")
        out += [text[at:start], value]
        at = end
    return "".join([*out, text[at:]])


def render(text: str, found: Extraction, translations: dict[str, str], decisions: dict[str, dict] | None = None) -> str:
    """The text with every unit replaced by its translation and every region by what was decided for it.

    ``decisions`` gives each region ``{"decision": "protect"}`` or ``{"decision": "translate", "spans": [(start, end, text)]}``;
    the translation of its n-th span has the id ``region:n``. Missing, unexpected or invalid ones raise ValueError.
    """
    edits, used = [], set()
    for u in found.units:
        if u.id not in translations:
            raise ValueError(f"no translation of {u.id}")
        if errors := template_errors(u, translations[u.id]):
            raise ValueError(f"{u.id}: {errors[0]}")
        value = fill(u, translations[u.id]).replace("\r\n", "\n").replace("\n", line_ending(u.source_text))
        edits.append((u.start, u.end, value))
        used.add(u.id)
    for r in found.regions:
        decided = (decisions or {}).get(r.id)
        if decided is None:
            raise ValueError(f"no decision on {r.id}")
        for n, (start, end, own) in enumerate(decided.get("spans", []) if decided["decision"] == "translate" else []):
            name = f"{r.id}:{n}"
            value = translations.get(name)
            if value is None or re.search(r"[\r\n]", value) or KEEP.search(value) or introduced_syntax(own, value):
                raise ValueError(f"{name} has no valid translation")
            edits.append((start, end, value))
            used.add(name)
    if extra := sorted(set(translations) - used):
        raise ValueError(f"unexpected translations: {extra[:10]}")
    return splice(text, edits)


def as_rows(found: Extraction) -> list[dict]:
    return [asdict(u) | {"chars": u.chars} for u in found.units]
