"""A structure report per document: headings, sections, code and formula totals, the block plan."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from ..text import lines as L
from ..text import units
from .rows import map_rows


def _headings(lines: list[L.Line]) -> tuple[list[tuple[int, str, int]], list[tuple[int, int]]]:
    """((level, text, start) of headings outside fences, (start, end) of fences)."""
    heads, fences = [], []
    under = L.underlined(lines)
    opened = None
    for i, line in enumerate(lines):
        fence = L.FENCE.match(line.content)
        if opened:
            if fence and fence[1][0] == opened[0][0] and len(fence[1]) >= len(opened[0]):
                fences.append((opened[1], line.end))
                opened = None
        elif fence:
            opened = fence[1], line.start
        elif i in under:
            heads.append((under[i], line.content.strip(), line.start))
        elif m := re.match(r"^ {0,3}(#{1,6})[ \t]+(.*)$", line.content):
            heads.append((len(m[1]), re.sub(r"[ \t]+#+$", "", m[2].rstrip()), line.start))
    if opened:
        fences.append((opened[1], lines[-1].end))
    return heads, fences


def summarise(text: str, limit: int = units.MAX_BLOCK_CHARS) -> dict:
    lines = L.split_lines(text)
    heads, fences = _headings(lines)
    found = units.extract(text).units
    marks = [m.start() for m in re.finditer(r"\$\$", text)]
    formulas = list(zip(marks[::2], marks[1::2], strict=False))
    nodes = [(0, "", 0), *heads]
    chars = [0] * len(nodes)
    for u in found:
        chars[max(i for i, n in enumerate(nodes) if n[2] <= u.start)] += u.chars
    shown: dict[int, int] = {}
    last = 0
    for i, n in enumerate(nodes):
        last = i if n[0] <= 3 else last
        shown[last] = shown.get(last, 0) + chars[i]
    number, sections = [0, 0, 0], []
    for i, n in shown.items():
        level, title, _ = nodes[i]
        if level:
            number = [*number[: level - 1], number[level - 1] + 1, *[0] * (3 - level)]
        sections.append({"number": ".".join(map(str, number[:level])), "level": level, "title": title, "chars": n, "fits": n <= limit})
    blocks = units.blocks(found, limit)
    lines_of = [f"# Structure\n\n- characters to translate: {sum(chars)}\n- code characters: {sum(e - s for s, e in fences)}\n- formula characters: {sum(b + 2 - a for a, b in formulas)}\n\n## Sections\n"]
    lines_of += [f"{'  ' * max(0, s['level'] - 1)}- {s['number']} {s['title'] or '(before the first heading)'}: {s['chars']}{'' if s['fits'] else ' (over the limit)'}" for s in sections]
    lines_of += ["\n## Blocks\n", "| block | section | characters |", "| --- | --- | --- |", *(f"| {b['id']} | {b['section_start'] or '-'} | {b['translatable_chars']} |" for b in blocks)]
    return {
        "level_1": sum(h[0] == 1 for h in heads),
        "level_2": sum(h[0] == 2 for h in heads),
        "level_3": sum(h[0] == 3 for h in heads),
        "chars": sum(chars),
        "fence_chars": sum(e - s for s, e in fences),
        "formula_chars": sum(b + 2 - a for a, b in formulas),
        "blocks": len(blocks),
        "sections": sections,
        "report": "\n".join(lines_of) + "\n",
    }


def summaries(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = units.MAX_BLOCK_CHARS) -> DataFrame:
    """One summary and report per document. A text with a reserved marker is summarised as without units."""

    def make(k, t):
        try:
            return {key: k} | summarise(t or "", limit)
        except units.ReservedMarker:
            return {key: k, "report": ""}

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs, [key, text], make, f"{key} {kind}, level_1 int, level_2 int, level_3 int, chars int, fence_chars int, formula_chars int, blocks int, sections array<struct<number:string,level:int,title:string,chars:int,fits:boolean>>, report string")
