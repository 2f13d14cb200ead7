"""Scanners: hand-written cases, and properties over arbitrary text."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docweave.text import lines, reflow, scan, units

MARKUP = st.text(st.sampled_from("ab \n\r`$*_[]()<>|\\#-=~!{}:1.@&;"), max_size=120)


@settings(max_examples=300, deadline=None)
@given(MARKUP)
def test_identity_translation_gives_the_source_back(text):
    try:
        found = units.extract(text)
    except units.ReservedMarker:
        return
    answers = {u.id: u.template for u in found.units}
    made = units.render(text, found, answers, {r.id: {"decision": "protect"} for r in found.regions})
    assert made.replace("\r\n", "\n").replace("\r", "\n") == text.replace("\r\n", "\n").replace("\r", "\n")


@settings(max_examples=300, deadline=None)
@given(MARKUP)
def test_masks_keep_length_and_line_breaks(text):
    masked = scan.mask_code(text)
    assert len(masked) == len(text)
    assert [i for i, c in enumerate(text) if c in "\r\n"] == [i for i, c in enumerate(masked) if c in "\r\n"]


@settings(max_examples=300, deadline=None)
@given(MARKUP)
def test_lines_cover_the_text(text):
    found = lines.split_lines(text)
    assert "".join(x.content + x.newline for x in found) == text
    assert all(a.end == b.start for a, b in zip(found, found[1:], strict=False))


@settings(max_examples=200, deadline=None)
@given(MARKUP)
def test_reflow_and_repairs_never_raise(text):
    reflow.merge_paragraphs(text), reflow.table_spacing(text), reflow.isolate_display(text), scan.promotions(text), scan.unescape_formulas(text)


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("a {{v}} b", ["template"]),
        ("`c` $x$ \\* <http://u.v> <!-- c --> <b> &amp; http://u.v", ["inline_code", "math", "escape", "autolink", "html_comment", "html_tag", "entity", "raw_url"]),
        ("![a](b) [c](d) [e][f] [g] [^h]", ["image_open", "link_target", "link_open", "link_target", "link_open", "reference_target", "bracket_open", "bracket_close", "reference"]),
        ("**b** *i* ~~s~~", ["format"] * 6),
    ],
)
def test_inline_kinds(text, kinds):
    assert [t.kind for t in units.Template(text, 1, set()).tokens] == kinds


def test_pairs_and_shortcut_references():
    t = units.Template("*a [b] c* [r]", 1, {"r"})
    assert [(k.kind, k.pair_id, k.pair_role) for k in t.tokens] == [("format", "pair-2", "open"), ("bracket_open", "pair-1", "open"), ("bracket_close", "pair-1", "close"), ("format", "pair-2", "close"), ("shortcut_reference", None, None)]


def test_protected_lines():
    text = "---\nt: x\n---\n```\ncode\n```\n    indented\n$$\nx\n$$\n<pre>\ny\n</pre>\n<!-- a\nb -->\n***\nplain\n"
    found = lines.split_lines(text)
    assert [x.content for i, x in enumerate(found) if i not in lines.protected(found)] == ["plain"]


def test_blocks_break_at_headings_and_limits():
    found = units.extract("# A\n\nxxxx\n\nyyyy\n\n# B\n\nzzzzzzzzzzzz\n").units
    assert [b["unit_ids"] for b in units.blocks(found, 6)] == [["unit-0001", "unit-0002"], ["unit-0003"], ["unit-0004"], ["unit-0005"]]
    with pytest.raises(ValueError, match="positive"):
        units.blocks(found, 0)


def test_reserved_marker_is_refused():
    with pytest.raises(units.ReservedMarker):
        units.extract("text @@KEEP:1:1@@ here")
    assert units.extract("safe `@@KEEP:1:1@@` here").units


def test_render_refuses_overlap_and_unexpected():
    with pytest.raises(ValueError, match="overlap"):
        units.splice("abc", [(0, 2, "x"), (1, 3, "y")])
    found = units.extract("abc")
    with pytest.raises(ValueError, match="unexpected"):
        units.render("abc", found, {"unit-0001": "x", "unit-0009": "y"})


def test_region_decisions():
    text = "!!! note Read this\n"
    found = units.extract(text)
    span = found.regions[0].suggested[0]
    assert units.render(text, found, {"unknown-0001:0": "lies das"}, {"unknown-0001": {"decision": "translate", "spans": [span]}}) == "!!! lies das\n"
    with pytest.raises(ValueError, match="no decision"):
        units.render(text, found, {})


def test_merge_keeps_mixed_line_ends():
    assert reflow.merge_paragraphs("a\r\nb\nc\r\n\r\n\r\n# h\n") == "a b c\r\n\r\n# h\n"
    assert reflow.paragraph_stats("a\nb\n\nlong\n\n# h\n- i\n$$\nx\n$$\n") == (1, 2)


def test_definition_tables_and_spacing():
    assert reflow.definition_tables(":   | a |\n    | b |\nx") == "| a |\n| b |\nx"
    assert reflow.table_spacing("| a |\nb") == "| a |\n\nb"


def test_reserved_markers_are_rows_not_crashes(spark):
    from docweave.operators import documents

    d = spark.createDataFrame([(1, "text @@KEEP:1:1@@ here", "block-0001", "x"), (2, "fine", "block-0001", "x"), (3, None, "block-0009", "x")], "doc_id int, text string, block_id string, answer string")
    assert {r["doc_id"]: bool(r["error"]) for r in documents.planned(d).collect()} == {1: True, 2: False}
    assert {r["doc_id"]: r["accepted"] for r in documents.answers_checked(d).collect()} == {1: False, 2: False, 3: False}


def test_packing_of_units_is_one_pass(spark):
    from docweave.operators import blocks

    sizes = [3, 4, 4, 9, 1, 2, 8, 30, 1]
    u = spark.createDataFrame([(k, i, n) for k in (1, 2) for i, n in enumerate(sizes)], "doc_id int, unit int, chars int")
    got = {(r["doc_id"], r["unit"]): r["block"] for r in blocks.pack(u, 10, ["doc_id"]).collect()}
    assert [got[2, i] for i in range(9)] == [got[1, i] for i in range(9)] == [1, 1, 2, 3, 3, 4, 4, 5, 6]
