"""Scanners over document rows: code masks, formulas, units, regions, blocks, contracts, rendering, reflow."""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import DataFrame

from ..text import lines as L
from ..text import reflow, scan, units
from .rows import flat_map, map_rows

SPAN = "struct<start:int,end:int>"
TOKEN = "struct<marker:string,value:string,kind:string,pair_id:string,pair_role:string>"


def _spans(found: Iterable) -> list[dict]:
    return [{"start": s, "end": e} for s, e in found]


def code_regions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fenced and inline code, the offset of an unclosed fence, and the text with its code blanked."""

    def make(k, t):
        t = t or ""
        fenced, open_ = scan.fences(t)
        inline = scan.inline_code(t, fenced)
        return {key: k, "fenced": _spans(fenced), "inline": _spans(inline), "unclosed_fence": open_, "masked": scan.blank(t, sorted([*fenced, *inline]))}

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs, [key, text], make, f"{key} {kind}, fenced array<{SPAN}>, inline array<{SPAN}>, unclosed_fence int, masked string")


def formulas(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per formula outside code, and one with null end for an opener without closer."""

    def make(k, t):
        masked = scan.mask_code(t or "")
        found, open_ = scan.formulas(masked)
        for f in found:
            yield {key: k, "start": f.start, "end": f.end, "latex": f.latex, "display": f.display, "line": masked.count("\n", 0, f.start) + 1}
        for at in open_:
            yield {key: k, "start": at, "end": None, "latex": None, "display": None, "line": masked.count("\n", 0, at) + 1}

    kind = docs.schema[key].dataType.simpleString()
    return flat_map(docs, [key, text], make, f"{key} {kind}, start int, end int, latex string, display boolean, line int")


def repaired(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Formula repair and reflow: escapes fixed, display formulas promoted, paragraphs joined, each as its own column."""

    def make(k, t):
        t = t or ""
        listed, promoted = scan.promotions(t)
        return {
            key: k,
            "unescaped": scan.outside_code(t, scan.unescape_formulas),
            "promoted": promoted,
            "promotions": [{"line": p.line, "reasons": p.reasons, "apply": p.apply} for p in listed],
            "merged": reflow.merge_paragraphs(t),
            "tables": reflow.table_spacing(reflow.definition_tables(t)),
            "isolated": reflow.isolate_display(t),
        }

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs, [key, text], make, f"{key} {kind}, unescaped string, promoted string, promotions array<struct<line:int,reasons:array<string>,apply:boolean>>, merged string, tables string, isolated string")


def missed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    def make(k, t):
        return ({key: k, "line": n, "kind": kind, "match": m} for n, kind, m in scan.missed_formulas(t or ""))

    return flat_map(docs, [key, text], make, f"{key} {docs.schema[key].dataType.simpleString()}, line int, kind string, match string")


def extracted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Units and regions of each document in one pass; a reserved marker in a text gives an error and no units.

    A text's own byte order mark is kept as a flag. Downstream operators explode ``units`` and ``regions``.
    """

    def make(k, t):
        t = t or ""
        bom = t.startswith("\ufeff")
        body = t[1:] if bom else t
        base = {key: k, "bom": bom, "error": "", "units": [], "regions": [], "sha256": units.sha(body)}
        try:
            found = units.extract(body)
        except units.ReservedMarker as e:
            return base | {"error": str(e)}
        regions = [
            {"id": r.id, "line": r.line, "start": r.start, "end": r.end, "raw": r.raw, "section": r.section, "suggested": [{"source_start": a, "source_end": b, "text": x} for a, b, x in r.suggested], "context_before": r.context_before, "context_after": r.context_after}
            for r in found.regions
        ]
        return base | {"units": units.as_rows(found), "regions": regions}

    unit = f"struct<id:string,kind:string,start:int,end:int,line_start:int,line_end:int,source_text:string,template:string,tokens:array<{TOKEN}>,section:string,context_before:string,context_after:string,chars:int>"
    region = "struct<id:string,line:int,start:int,end:int,raw:string,section:string,suggested:array<struct<source_start:int,source_end:int,text:string>>,context_before:string,context_after:string>"
    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs, [key, text], make, f"{key} {kind}, bom boolean, error string, units array<{unit}>, regions array<{region}>, sha256 string")


def planned(docs: DataFrame, limit: int = units.MAX_BLOCK_CHARS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per block of each document's units, with its surface; a reserved marker in a text gives one row with the error."""

    def make(k, t):
        try:
            found = units.extract((t or "").removeprefix("\ufeff")).units
        except units.ReservedMarker as e:
            return [{key: k, "error": str(e)}]
        return ({key: k, "error": ""} | b for b in units.blocks(found, limit))

    kind = docs.schema[key].dataType.simpleString()
    return flat_map(docs, [key, text], make, f"{key} {kind}, error string, id string, unit_ids array<string>, unit_count int, line_start int, line_end int, section_start string, section_end string, translatable_chars int, surface_bytes int, surface_sha256 string, surface string")


def rendered(docs: DataFrame, key: str = "doc_id", text: str = "text", translations: str | None = None) -> DataFrame:
    """The text with units replaced by ``translations`` (a map column by unit id; without it, by themselves)."""

    def make(k, t, *given):
        t = t or ""
        mark = "\ufeff" * t.startswith("\ufeff")
        body = t.removeprefix("\ufeff")
        try:
            found = units.extract(body)
            answers = dict(given[0]) if given and given[0] is not None else {u.id: u.template for u in found.units}
            out, error = mark + units.render(body, found, answers, {r.id: {"decision": "protect"} for r in found.regions}), ""
        except ValueError as e:
            out, error = None, str(e)
        return {key: k, "rendered": out, "error": error, "sha256": units.sha(out) if out is not None else None, "source_sha256": units.sha(t)}

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs, [key, text, *([translations] if translations else [])], make, f"{key} {kind}, rendered string, error string, sha256 string, source_sha256 string")


@lru_cache(maxsize=4)
def _planned_once(text: str, limit: int) -> tuple[dict, dict]:
    found = units.extract(text.removeprefix("\ufeff"))
    return {u.id: u for u in found.units}, {x["id"]: x for x in units.blocks(found.units, limit)}


def answers_checked(blocks: DataFrame, key: str = "doc_id", text: str = "text", block: str = "block_id", answer: str = "answer", limit: int = units.MAX_BLOCK_CHARS) -> DataFrame:
    """Translated blocks against their contract: key, block, accepted, error, and the translations by unit.

    Blocks of one text that follow one another share its extraction. A reserved marker in a text is an error of its blocks.
    """

    def make(k, t, b, a):
        try:
            by_id, own = _planned_once(t or "", limit)
        except units.ReservedMarker as e:
            return {key: k, block: b, "accepted": False, "error": str(e), "translations": {}}
        if b not in own:
            return {key: k, block: b, "accepted": False, "error": "unknown block", "translations": {}}
        made, error = units.parse_surface(own[b], by_id, a or "")
        return {key: k, block: b, "accepted": not error, "error": error, "translations": made}

    kind = blocks.schema[key].dataType.simpleString()
    return map_rows(blocks, [key, text, block, answer], make, f"{key} {kind}, {block} string, accepted boolean, error string, translations map<string,string>")


def cells(rows: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """Cells of table rows, split outside code, formulas and links."""

    def make(k, n, c):
        return ({key: k, "number": n, "start": s, "end": e, "cell": c[s:e]} for s, e in L.cells(c or ""))

    return flat_map(rows, [key, "number", content], make, f"{key} {rows.schema[key].dataType.simpleString()}, number int, start int, end int, cell string")
