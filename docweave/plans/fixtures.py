"""Queries over literal rows for what the driver's tables don't hold: formulas, navigation, storage markup, plans, state.

The oracles are literal results too, written down from the rules.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import blocks, documents, gates, lines, pages, secrets, state, wiki
from ..sources import files, rest, sinks
from .catalog import expected, query, rows

TICKS = "`" * 3

# --- scalars --------------------------------------------------------------------------------------------------------

_NAMES = [(1, " a/b: c?\n", "a-b- c-", "ab c"), (2, "...", "untitled", "untitled"), (3, "con.txt", "_con.txt", "_con.txt"), (4, "x" * 90, "x" * 80, "x" * 90), (5, "Tab\there. ", "Tab here", "Tab here")]


@query(expected("id int, file_name string, export_name string", [(i, a, b) for i, _, a, b in _NAMES]))
def scalar_names(spark, sf_dir):
    r = rows(spark, "id int, title string", [(i, t) for i, t, _, _ in _NAMES])
    return r.select("id", C.file_name(F.col("title")).alias("file_name"), C.export_name(F.col("title")).alias("export_name"))


_LATEX = [(1, "{a}{b}", True), (2, "}{", False), (3, r"\{ {x}", True), (4, "{", False), (5, r"\\{x}", True)]


@query(expected("id int, balanced boolean", [(i, b) for i, _, b in _LATEX]))
def latex_balance(spark, sf_dir):
    return rows(spark, "id int, latex string", [(i, t) for i, t, _ in _LATEX]).select("id", C.balanced_latex(F.col("latex")).alias("balanced"))


_TITLES = [(1, r"The \( \alpha \) filter", "The α filter"), (2, r"\alphabet \rightarrow x", r"\alphabet → x"), (3, "a\t b", "a b")]


@query(expected("id int, title string", [(i, b) for i, _, b in _TITLES]))
def title_math(spark, sf_dir):
    return rows(spark, "id int, t string", [(i, t) for i, t, _ in _TITLES]).select("id", C.title_math(F.col("t")).alias("title"))


_URLS = [(1, "http://a.b/c).", "http://a.b/c"), (2, "http://a.b/(c)", "http://a.b/(c)"), (3, "http://a.b/(c)))!", "http://a.b/(c)")]


@query(expected("id int, url string", [(i, b) for i, _, b in _URLS]))
def raw_urls(spark, sf_dir):
    return rows(spark, "id int, t string", [(i, t) for i, t, _ in _URLS]).select("id", C.trim_raw_url(F.col("t")).alias("url"))


_IMAGES = [(1, "http://h/a.PNG?x=1", "", ".png"), (2, "http://h/a", "image/jpeg; q=1", ".jpg"), (3, "http://h/a.exe", "text/html", ".png"), (4, "http://h/v1.2/pic.webp#f", None, ".webp")]


@query(expected("id int, extension string", [(i, e) for i, _, _, e in _IMAGES]))
def image_extensions(spark, sf_dir):
    r = rows(spark, "id int, url string, mime string", [(i, u, m) for i, u, m, _ in _IMAGES])
    return r.select("id", C.image_extension(F.col("url"), F.col("mime")).alias("extension"))


_PLACEHOLDERS = [(1, "", True), (2, "<token>", True), (3, "${X}", True), (4, "your-key", True), (5, "a8f3b2", False), (6, "NoCheck", True)]


@query(expected("id int, placeholder boolean", [(i, p) for i, _, p in _PLACEHOLDERS]))
def placeholders(spark, sf_dir):
    return rows(spark, "id int, v string", [(i, v) for i, v, _ in _PLACEHOLDERS]).select("id", C.looks_placeholder(F.col("v")).alias("placeholder"))


# --- Markdown scanners ----------------------------------------------------------------------------------------------

_CODE = [(1, "a `b` c", "a     c", None), (2, "``a`b`` x", "        x", None), (3, r"\`a` b", r"\`a` b", None), (4, f"x\n{TICKS}\ny", "x\n   \n ", 2)]


@query(expected("id int, masked string, unclosed_fence int", [(i, m, u) for i, _, m, u in _CODE]))
def code_mask(spark, sf_dir):
    r = rows(spark, "id int, text string", [(i, t) for i, t, _, _ in _CODE])
    return documents.code_regions(r, "id").select("id", "masked", "unclosed_fence")


@query(expected("id int, start int, stop int, latex string, display boolean", [(1, 2, 5, "x", False), (1, 8, 13, "y", True), (2, 6, None, None, None)]))
def math_spans(spark, sf_dir):
    r = rows(spark, "id int, text string", [(1, "a $x$ b $$y$$"), (2, "\\$ abc$x"), (3, "none")])
    return documents.formulas(r, "id").select("id", "start", F.col("end").alias("stop"), "latex", "display")


_ISSUES = [
    (1, "$a\\_b$", "escaped underscore"),
    (2, "a $x", "unpaired dollar"),
    (3, "t $$x$$", "display mark not alone"),
    (4, f"{TICKS}\nx", "unclosed fence"),
    (5, "${a$", "unbalanced braces"),
    (6, "see <name> here", "bare placeholder"),
    (7, "| a | b |\n|---|---|\n| c |\n", "unequal columns"),
    (8, "| a |\n|---|\n| c |\ntext", "no blank line after table"),
    (9, "| a |\n| b |", "table without separator"),
    (10, "**Command Syntax**\n\n> run it", "command syntax quoted"),
    (11, "$\\begin{aligned}x$", "damaged aligned"),
    (12, ":   | a |", "table in a definition list"),
]


@query(expected("id int, rule string", [(i, r) for i, _, r in _ISSUES]))
def math_issues(spark, sf_dir):
    r = rows(spark, "id int, text string", [(i, t) for i, t, _ in _ISSUES] + [(99, "fine $x$ and `<a>` <b>x</b> <http://x>\n\n| a |\n|---|\n| b |\n")])
    return gates.markdown_issues(r, "id").select("id", "rule")


@query(expected("id int, failures int, reviews int, verdict string", [(1, 1, 0, "fail"), (9, 0, 1, "review"), (99, 0, 0, "pass")]).replace("INTEGER) AS failures", "BIGINT) AS failures").replace("INTEGER) AS reviews", "BIGINT) AS reviews"))
def verify_verdict(spark, sf_dir):
    r = rows(spark, "id int, text string", [(i, t) for i, t, _ in _ISSUES if i in (1, 9)] + [(99, "fine")])
    return gates.verdict(r, gates.markdown_issues(r, "id"), "id")


@query(expected("id int, promoted string, n int", [(1, "a\n\n$$\n\\begin{cases}x\\end{cases}\n$$\n\n b", 1), (2, "| $\\begin{array}x$ | y |", 1), (3, "plain $x$", 0)]))
def math_promote(spark, sf_dir):
    r = rows(spark, "id int, text string", [(1, "a$\\begin{cases}x\\end{cases}$ b"), (2, "| $\\begin{array}x$ | y |"), (3, "plain $x$")])
    return documents.repaired(r, "id").select("id", "promoted", F.size("promotions").alias("n"))


@query(expected("id int, fixed string", [(1, "a\\_b $a_b$ `$\\_$`"), (2, "$$x*y$$")]))
def math_escape_fix(spark, sf_dir):
    r = rows(spark, "id int, text string", [(1, "a\\_b $a\\_b$ `$\\_$`"), (2, "$$x\\*y$$")])
    return documents.repaired(r, "id").select("id", F.col("unescaped").alias("fixed"))


@query(expected("id int, merged string", [(1, "one two\n\nthree\n"), (2, "- a b\n- c\n"), (3, f"{TICKS}\na\nb\n{TICKS}\nx y\n"), (4, "a b\r\n\r\nc")]))
def merge_paragraphs(spark, sf_dir):
    r = rows(spark, "id int, text string", [(1, "one\ntwo\n\n\nthree\n\n"), (2, "- a\n  b\n- c\n"), (3, f"{TICKS}\na\nb\n{TICKS}\nx\ny\n"), (4, "a\nb\r\n\r\nc")])
    return documents.repaired(r, "id").select("id", "merged")


@query(expected("id int, line int, kind string, match string", [(1, 1, "italic", "*x*2"), (1, 1, "bold", "**i**+")]))
def missed_formulas(spark, sf_dir):
    r = rows(spark, "id int, text string", [(1, "see *x*2 and **i**+ $*y*3$\n| *z*4 |\n# *w*5")])
    return documents.missed(r, "id")


@query(expected("id int, unit string, kind string, line_start int, line_end int, template string", [(1, "unit-0001", "heading", 1, 1, "Head"), (1, "unit-0002", "text", 3, 4, "one @@KEEP:2:1@@\ntwo"), (1, "unit-0003", "table_cell", 6, 6, "A"), (1, "unit-0004", "table_cell", 8, 8, "x"), (1, "unit-0005", "footnote", 10, 10, "note")]))
def md_units(spark, sf_dir):
    r = rows(spark, "id int, text string", [(1, "# Head\n\none `c`\ntwo\n\n| A | 1 |\n|---|---|\n| x | 2 |\n\n[^1]: note\n")])
    found = documents.extracted(r, "id").select("id", F.explode("units").alias("u"))
    return found.select("id", F.col("u.id").alias("unit"), "u.kind", "u.line_start", "u.line_end", "u.template")


_DOC = "# T\n\nHello *big* world\n"
_ANSWERS = [
    (1, "@@SEG:block-0001:0001@@\nT\n@@SEG:block-0001:0002@@\nHallo @@KEEP:2:1@@gross@@KEEP:2:2@@ x\n", True, ""),
    (2, "@@SEG:block-0001:0002@@\nx\n", False, "segments out of order"),
    (3, "@@SEG:block-0001:0001@@\nT\n@@SEG:block-0001:0002@@\n\n", False, "unit-0002 is empty"),
    (4, "@@SEG:block-0001:0001@@\nT\n@@SEG:block-0001:0002@@\nHallo x\n", False, "unit-0002: markers differ"),
    (5, "@@SEG:block-0001:0001@@\nT\n@@SEG:block-0001:0002@@\n@@KEEP:2:2@@a@@KEEP:2:1@@\n", False, "unit-0002: pair reversed"),
    (6, "@@SEG:block-0001:0001@@\nT\n@@SEG:block-0001:0002@@\n@@KEEP:2:1@@a@@KEEP:2:2@@ **b**\n", False, "unit-0002: syntax *"),
    (7, "@@SEG:block-0001:0001@@\nT\n@@SEG:block-0001:0002@@\n- @@KEEP:2:1@@a@@KEEP:2:2@@\n", False, "unit-0002: block mark"),
    (8, "Ã@@SEG:block-0001:0001@@", False, "mojibake"),
]


@query(expected("id int, accepted boolean, error string", [(i, ok, e) for i, _, ok, e in _ANSWERS]))
def translated_blocks(spark, sf_dir):
    r = rows(spark, "id int, text string, block_id string, answer string", [(i, _DOC, "block-0001", a) for i, a, _, _ in _ANSWERS])
    return documents.answers_checked(r, "id").select("id", "accepted", "error")


@query(expected("id int, rendered string, error string", [(1, "# T\r\n\r\nEins *x*\r\nzwei\r\n", ""), (2, None, "no translation of unit-0002")]))
def render_translated(spark, sf_dir):
    text = "# T\r\n\r\nOne *x*\r\ntwo\r\n"
    r = rows(spark, "id int, text string, t map<string,string>", [(1, text, {"unit-0001": "T", "unit-0002": "Eins @@KEEP:2:1@@x@@KEEP:2:2@@\nzwei"}), (2, text, {"unit-0001": "T"})])
    return documents.rendered(r, "id", translations="t").select("id", "rendered", "error")


@query(expected("unit_id string, pair_id string, rule string", [("a", "p1", "crossed"), ("c", "p5", "reversed")]))
def contract_pairs(spark, sf_dir):
    r = rows(spark, "unit_id string, pair_id string, open int, close int", [("a", "p1", 0, 2), ("a", "p2", 1, 3), ("b", "p3", 0, 3), ("b", "p4", 1, 2), ("c", "p5", 4, 1)])
    return gates.crossed_pairs(r).select("unit_id", "pair_id", "rule")


@query(expected("id int, markers_kept boolean", [(1, True), (2, False), (3, False)]))
def contract_markers(spark, sf_dir):
    r = rows(spark, "id int, before string, after string", [(1, "@@KEEP:1:1@@ a @@KEEP:1:2@@", "@@KEEP:1:2@@@@KEEP:1:1@@"), (2, "@@KEEP:1:1@@", "x"), (3, "@@KEEP:1:1@@", "@@KEEP:1:1@@@@KEEP:1:1@@")])
    return gates.markers_differ(r).select("id", "markers_kept")


@query(expected("id int, more_marks boolean", [(1, True), (2, False)]))
def contract_block_marks(spark, sf_dir):
    return gates.introduced_block_marks(rows(spark, "id int, before string, after string", [(1, "a", "# a"), (2, "- a\nb", "c\n- d")])).select("id", "more_marks")


@query(expected("region_id string, start int, reason string", [("r1", 2, "text differs"), ("r2", 0, "outside the suggestion"), ("r3", None, "translate without a span"), ("r4", 0, "protect with a span")]))
def decision_contract(spark, sf_dir):
    d = rows(spark, "region_id string, decision string, start int, end int, text string", [("r1", "translate", 2, 4, "zz"), ("r2", "translate", 0, 4, "abcd"), ("r3", "translate", None, None, None), ("r4", "protect", 0, 2, "ab"), ("r5", "translate", 2, 4, "cd")])
    s = rows(spark, "region_id string, s_start int, s_end int", [(f"r{i}", 2, 6) for i in (1, 2, 3, 5)] + [("r4", 0, 6)])
    return gates.decision_spans(d, s, rows(spark, "region_id string, source string", [(f"r{i}", "abcdef") for i in range(1, 6)]))


_CLASSES = "Head\n====\nx | y\n--- | ---\n1 | 2\nplain\n[^1]: n\n    more\n\nend\n[Ref  A]: u\n> > quoted"


@query(expected("kind string, number int, value string", [("heading", 1, "Head"), ("table", 3, "x | y"), ("table", 5, "1 | 2"), ("footnote", 8, "    more"), ("reference", None, "ref a"), ("quote", 12, "quoted")]))
def line_classes(spark, sf_dir):
    found = lines.explode_lines(rows(spark, "doc_id int, text string", [(1, _CLASSES)]))
    parts = [
        lines.underlined_headings(found).where("level = 1").select(F.lit("heading").alias("kind"), "number", F.col("title").alias("value")),
        lines.table_rows(found).select(F.lit("table"), "number", "content"),
        lines.footnote_continuations(found).select(F.lit("footnote"), "number", "content"),
        lines.reference_ids(found).select(F.lit("reference"), F.lit(None).cast("int"), "reference"),
        found.where(F.col("content").startswith(">")).select(F.lit("quote"), "number", lines.without_quote(F.col("content"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query(expected("doc_id int, rule string, detail string", [(1, "missing link", "b/none.md"), (1, "missing image", "img/a (1).png"), (1, "site-relative image", "/x.png"), (1, "old anchor", "#cmd-x")]))
def verify_links(spark, sf_dir):
    d = rows(spark, "doc_id int, text string", [(1, '[a](b/c.md) [n](b/none.md) ![i](img/a (1).png "t") ![s](/x.png) [o](#cmd-x) [h](http://z/a.b) `[q](q.md)` ![k](./img/k.png)')])
    f = rows(spark, "doc_id int, path string", [(1, "b/c.md"), (1, "img/k.png")])
    return gates.missing_targets(gates.references(d), f).select("doc_id", "rule", "detail")


@query(expected("doc_id int, number int, cell string", [(1, 1, "a"), (1, 1, "`|`"), (1, 1, "[l](u|v)"), (1, 1, "$x|y$")]))
def table_cells(spark, sf_dir):
    return documents.cells(rows(spark, "doc_id int, number int, content string", [(1, 1, "| a | `|` | [l](u|v) | $x|y$ |")])).select("doc_id", "number", "cell")


# --- HTML -----------------------------------------------------------------------------------------------------------

_MATHML = [
    (1, "<math><mfrac><mi>a</mi><mn>2</mn></mfrac></math>", r"\frac{a}{2}"),
    (2, "<math><msup><mi>x</mi><mn>2</mn></msup><mo>≤</mo><mi>sin</mi></math>", r"x^{2}\leq \sin"),
    (3, "<math><mtable><mtr><mtd><mi>a</mi></mtd></mtr><mtr><mtd><mi>b</mi></mtd></mtr></mtable></math>", "a, b"),
    (4, "<math><mover><mi>v</mi><mo>→</mo></mover></math>", r"\vec{v}"),
    (5, "<math><mtable><mtr><mtd><mi>a</mi></mtd><mtd><mi>b</mi></mtd></mtr></mtable></math>", "\\begin{bmatrix}\na & b\n\\end{bmatrix}"),
    (6, "<math><msqrt><mi>x</mi></msqrt><mtext>if</mtext></math>", r"\sqrt{x}\text{if}"),
]


@query(expected("id int, latex string", [(i, x) for i, _, x in _MATHML]))
def mathml_latex(spark, sf_dir):
    return pages.mathml(rows(spark, "id int, xml string", [(i, x) for i, x, _ in _MATHML]))


_TEX = [
    (1, '<p><span class="math">\\(x\\)</span></p>', "$x$", 1, 0, 0, 0),
    (2, "<p>a \\(x\\) b \\[y\\]</p>", "a $x$ b $$y$$", 0, 1, 1, 0),
    (3, "<table><tr><td>\\[y\\]</td></tr></table>", "$y$", 0, 1, 0, 0),
    (4, "<p>\\(a<span>b\\)</span></p>", "$ab$", 0, 1, 0, 0),
    (5, "<p>\\(a<b>b\\)</b></p>", "\\(ab\\)", 0, 0, 0, 1),
    (6, "<p>\\(a</p><p>b\\)</p>", "\\(ab\\)", 0, 0, 0, 1),
    (7, '<script type="math/tex; mode=display">z</script>', "$$\nz\n$$", 1, 0, 0, 0),
    (8, "<code>\\(x\\)</code>", "\\(x\\)", 0, 0, 0, 0),
]


@query(expected("id int, text string, carriers int, inline_formulas int, display_formulas int, review int", [(i, *r) for i, _, *r in _TEX]))
def html_math(spark, sf_dir):
    return pages.formula_passes(rows(spark, "id int, html string", [(i, h) for i, h, *_ in _TEX]))


_PAGE = '<html><head><meta name="generator" content="Sphinx"></head><body><nav><a href="x.html">n</a></nav><div class="content"><h1>T<a class="headerlink" href="#t">\uf0c1</a></h1><h2>S<a class="headerlink" href="#s">\uf0c1</a></h2><p>Use &lt;v&gt; <a href="b.html">l</a><img src="i.png" alt="A"></p><script>x</script></div></body></html>'


@query(expected("page_id long, title string, markdown string, links int, placeholders int", [(1, "T", "## [S](http://h/d/a.html#s)\n\nUse `<v>` [l](http://h/d/b.html)![A](i.png)\n", 2, 1)]))
def page_markdown_fixture(spark, sf_dir):
    r = rows(spark, "page_id long, url string, html string", [(1, "http://h/d/a.html", _PAGE)])
    return pages.markdown(r).select("page_id", "title", F.concat(F.regexp_replace("markdown", "\n+$", ""), F.lit("\n")).alias("markdown"), "links", "placeholders")


_NAV = '<ul><li class="toctree-l1"><a href="#">Cur</a><ul><li><a href="c1.html">C1</a><ul><li><a href="g1.html">G1</a></li></ul></li><li><a href="c2.html">C2</a></li><li><a href="c2.html#x">again</a></li><li><a href="http://other/z.html">Z</a></li></ul></li></ul>'
_VP = '<div class="VPSidebar"><section class="level-0"><div class="item"><a href="/d/p.html">P</a></div><div class="items"><div class="level-1"><div class="item"><a href="/d/q.html">Q</a></div></div></div></section></div>'


@query(expected("page_id long, structure string, level int, title string, parent_url string", [(1, "sphinx", 1, "C1", None), (1, "sphinx", 2, "G1", "http://h/d/c1.html"), (1, "sphinx", 1, "C2", None), (2, "vitepress", 1, "Q", None)]))
def nav_children(spark, sf_dir):
    r = rows(spark, "page_id long, url string, html string", [(1, "http://h/d/cur.html", _NAV), (2, "http://h/d/p.html", _VP), (3, "http://h/d/x.html", "<p>none</p>")])
    return pages.navigation(r).select("page_id", "structure", "level", "title", "parent_url")


@query(expected("page_id long, url string, accepted boolean", [(1, "http://h/v1/a/b.html", True), (1, "http://h/v2/a.html", False), (1, "https://h/v1/a.html", False)]))
def nav_validate(spark, sf_dir):
    p = rows(spark, "page_id long, url string", [(1, "http://h/v1/x/y.html")])
    e = rows(spark, "page_id long, level int, url string", [(1, 1, "http://h/v1/a/b.html"), (1, 1, "http://h/v2/a.html"), (1, 2, "https://h/v1/a.html")])
    return pages.in_scope(e, p).select("page_id", "url", "accepted")


@query(expected("page_id long, reason string", [(1, ""), (2, "an address of the snapshot differs"), (3, "the snapshot names no address"), (4, "")]))
def snapshot_identity(spark, sf_dir):
    r = rows(spark, "page_id long, url string, html string, declared_url string", [(1, "http://h/a.html", '<link rel="canonical" href="/a">', None), (2, "http://h/a.html", '<meta property="og:url" content="http://h/b">', "http://h/a"), (3, "http://h/a", "<p>", None), (4, "http://h/d/a", '<base href="http://h/d/">', None)])
    return pages.snapshot_reasons(r)


@query(expected("page_id long, url string, source string", [(1, "s1", "static"), (2, "r2", "rendered")]))
def nav_sources(spark, sf_dir):
    s = rows(spark, "page_id long, url string", [(1, "s1")])
    r = rows(spark, "page_id long, url string", [(1, "r1"), (2, "r2"), (3, "r3")])
    return pages.merged_navigation(s, r, rows(spark, "page_id long, reason string", [(1, ""), (2, ""), (3, "differs")]))


@query(expected("page_id long, ord int, name string", [(1, 0, "a.png"), (1, 1, "a_1.png"), (1, 3, "b.jpg")]))
def image_file_names(spark, sf_dir):
    r = rows(spark, "page_id long, url string, images array<string>", [(1, "u", ["http://h/a.png", "http://g/a.png?x", "data:image/png;x", "/z/b.jpg"])])
    return pages.image_names(r).select("page_id", "ord", "name")


@query(expected("manifest_id int, line int, depth int, title string, url string, parent_url string", [(1, 2, 0, "A", "http://a", None), (1, 3, 1, "B", "http://b", "http://a"), (1, 5, 0, "http://c", "http://c", None)]))
def nav_manifest(spark, sf_dir):
    text = "# c\n- A | http://a | note\n  - B | <http://b>\n    - deep | http://d\n* | http://c\n- none\n"
    return files.children_manifest(rows(spark, "manifest_id int, text string", [(1, text), (2, "  - orphan | http://o")]))


@query(expected("page_id int, block string", [(1, "\n\n## Sub-pages\n\n- [A](<./a b/a.md>)\n  - [B](<./b.md>)\n")]))
def nav_block(spark, sf_dir):
    return sinks.nav_block(rows(spark, "page_id int, ord int, level int, title string, rel string", [(1, 0, 1, "A", "a b/a.md"), (1, 1, 2, "B", "b.md")]))


# --- storage --------------------------------------------------------------------------------------------------------

_INLINE = '<ac:structured-macro ac:name="mathinline" ac:schema-version="1"><ac:parameter ac:name="body">{}</ac:parameter></ac:structured-macro>'
_BLOCK = '<ac:structured-macro ac:name="mathblock" ac:schema-version="1"><ac:parameter ac:name="alignment">left</ac:parameter><ac:plain-text-body><![CDATA[{}]]></ac:plain-text-body></ac:structured-macro>'
_STORAGE = [
    (1, "a $x<y$ b", f"<p>a {_INLINE.format('x&lt;y')} b</p>"),
    (2, "$$\nz\n$$", _BLOCK.format("z")),
    (3, "`$x$` ==hi== $PWD / $OLDPWD", "<p><code>$x$</code> <strong>hi</strong> $PWD / $OLDPWD</p>"),
    (4, "# T\n\n- a\n- b", "<h1>T</h1>\n\n<ul>\n<li>a</li>\n<li>b</li>\n</ul>"),
    (5, f"{TICKS}py\nx\n{TICKS}", '<ac:structured-macro ac:name="code"><ac:parameter ac:name="language">python</ac:parameter><ac:parameter ac:name="theme">Confluence</ac:parameter><ac:parameter ac:name="linenumbers">false</ac:parameter><ac:plain-text-body><![CDATA[x\n]]></ac:plain-text-body></ac:structured-macro>'),
    (6, "a & b [l](http://u) **s**", '<p>a &amp; b <a href="http://u">l</a> <strong>s</strong></p>'),
]


@query(expected("id int, storage string, balance string", [(i, s, "") for i, _, s in _STORAGE]))
def md_to_storage(spark, sf_dir):
    return wiki.to_storage(rows(spark, "id int, markdown string", [(i, m) for i, m, _ in _STORAGE])).select("id", "storage", "balance")


_EXPORTS = [
    (1, f"<p>a {_INLINE.format('x&lt;y')}</p>{_BLOCK.format('z')}", "a $x<y$\n\n$$z$$\n"),
    (2, "<table><tr><th>a</th></tr><tr><td>b|c</td></tr></table>", "| a |\n| --- |\n| b\\|c |\n"),
    (3, '<h1><ac:structured-macro ac:name="toc"/>H</h1><pre> </pre>', "[toc]\n\n# H\n"),
    (4, '<p><ac:link><ri:page ri:content-id="7" ri:content-title="P"/></ac:link> <ac:link><ri:user ri:userkey="u"/></ac:link></p>', "[P](http://w/pages/viewpage.action?pageId=7) u\n"),
    (5, '<ac:structured-macro ac:name="info"><ac:rich-text-body><p>n</p></ac:rich-text-body></ac:structured-macro>', "> n\n"),
    (6, '<ac:structured-macro ac:name="code"><ac:parameter ac:name="language">sql</ac:parameter><ac:plain-text-body><![CDATA[a\n\n\nb]]></ac:plain-text-body></ac:structured-macro>', f"{TICKS}sql\na\n\n\nb\n{TICKS}\n"),
    (7, '<ac:image ac:alt="A"><ri:url ri:value="http://i"/></ac:image>', "![A](http://i)\n"),
]


@query(expected("page_id int, markdown string", [(i, m) for i, _, m in _EXPORTS]))
def storage_to_md(spark, sf_dir):
    return wiki.to_markdown(rows(spark, "page_id int, storage string", [(i, s) for i, s, _ in _EXPORTS]), "http://w").select("page_id", "markdown")


@query(expected("page_id int, inline int, block int, latex int, upgraded int, spans int, passed boolean, residuals string", [(1, 1, 1, 0, 0, 1, True, ""), (2, 0, 1, 0, 1, 0, True, ""), (3, 0, 0, 0, 0, 0, True, "")]))
def math_upgrade(spark, sf_dir):
    r = rows(spark, "page_id int, storage string", [(1, '<p><span class="math">$x$</span> $$y$$</p>'), (2, "<p>$abc = 123456789 + 123456789$</p>"), (3, "<code>$x$</code>$ a $")])
    return wiki.upgraded(r).select("page_id", "inline", "block", "latex", "upgraded", "spans", "passed", F.array_join("residuals", " ").alias("residuals"))


_BALANCE = [(1, "<p><b>x</b></p><br>", ""), (2, "<p><b></p>", "surplus </p> at 6"), (3, "<p><![CDATA[<x>]]>", "unclosed ['p']"), (4, "<ac:x/><ri:y a=\"b\"/>", "")]


@query(expected("id int, balance string", [(i, b) for i, _, b in _BALANCE]))
def xhtml_balance(spark, sf_dir):
    from ..operators.rows import map_rows
    from ..storage.convert import balance

    return map_rows(rows(spark, "id int, storage string", [(i, s) for i, s, _ in _BALANCE]), ["id", "storage"], lambda i, s: {"id": i, "balance": balance(s)}, "id int, balance string")


@query(expected("page_id int, attached string, missing string, embedded int", [(1, "a.png", "no.png", 1)]))
def storage_images(spark, sf_dir):
    p = rows(spark, "page_id int, storage string", [(1, '![x](i/a.png{width=9}) <img src="no.png"> ![d](data:z) <code>![q](q.png)</code>')])
    a = rows(spark, "page_id int, path string, name string", [(1, "i/a.png", "a.png")])
    return wiki.attach_images(p, a).select("page_id", F.array_join("attached", ",").alias("attached"), F.array_join("missing", ",").alias("missing"), "embedded")


@query(expected("path string, content string", [("7_A B/A B.md", '---\ntitle: "A: \\"B\\""\ndate: 2024\nmath: true\n---\n\nx')]))
def export_files(spark, sf_dir):
    return sinks.export_files(rows(spark, "page_id string, title string, when string, markdown string", [("7", 'A: "B"', "2024", "x"), ("7", 'A: "B"', "2024", "x")]))


# --- tree, index, state ---------------------------------------------------------------------------------------------

_INDEX = [("1", "Home", 3, None), ("2", "Guide", 1, "1"), ("3", "guide", 1, "9"), ("4", "Dup", 1, "1"), ("5", "Dup", 2, "1"), ("6", "Deep", 4, "2")]


def _index(spark):
    return rows(spark, "id string, title string, version int, parent_id string", _INDEX)


@query(expected("node_id string, lookup string, page_id string, version int", [("a", "FOUND", "1", 3), ("b", "FOUND", "2", 1), ("c", "ERROR", None, None), ("d", "NOT_FOUND", None, None), ("e", "FOUND", "6", 4), ("f", "ERROR", None, None), ("g", "NOT_FOUND", None, None), ("h", "FOUND", "1", 3)]))
def page_lookup(spark, sf_dir):
    w = [("a", "Home", None, None, False, True), ("b", "Guide", None, "1", False, True), ("c", "Dup", None, "1", False, True), ("d", "None", None, None, True, True), ("e", "Deep", None, "1", False, True), ("f", "x", "99", None, False, False), ("g", "Deep", None, "1", False, False), ("h", "HOME", None, None, False, True)]
    return wiki.lookup(rows(spark, "node_id string, title string, wanted_id string, parent_id string, any_parent boolean, allow_move boolean", w), _index(spark))


_NODES = [("t", None, "Home", True), ("t/g", "t", "Guide", True), ("t/d", "t", "Dup", True), ("t/n", "t", "New", True), ("t/n/x", "t/n", "Deep", True), ("t/f", "t", "Folder", False), ("t/f/y", "t/f", "Other", True)]


@query(expected("node_id string, status string, page_id string, version int, target_parent_id string, depth int", [("t", "update", "1", 3, None, 0), ("t/g", "update", "2", 1, "1", 1), ("t/d", "error", None, None, "1", 1), ("t/n", "new", None, None, "1", 1), ("t/n/x", "move", "6", 4, None, 2), ("t/f", "skip", None, None, "1", 1), ("t/f/y", "new", None, None, "1", 1)]))
def tree_plan(spark, sf_dir):
    nodes = rows(spark, "node_id string, parent_node_id string, title string, has_page boolean", _NODES)
    return wiki.plan(nodes, _index(spark)).select("node_id", "status", "page_id", "version", "target_parent_id", "depth")


@query("SELECT true AS has_move, true AS has_error, CAST(0 AS BIGINT) AS duplicates")
def tree_gates(spark, sf_dir):
    nodes = rows(spark, "node_id string, parent_node_id string, title string, has_page boolean", _NODES)
    return wiki.gates(wiki.plan(nodes, _index(spark)))


@query(expected("id string, depth int", [("1", 0), ("2", 1), ("4", 1), ("5", 1), ("6", 2)]))
def tree_descendants(spark, sf_dir):
    return wiki.descendants(_index(spark), "1")


@query(expected("parent_id string, id string, title string", [("1", "2", "Guide"), ("9", "3", "guide"), ("1", "4", "Dup"), ("1", "5", "Dup"), ("2", "6", "Deep")]))
def child_pages(spark, sf_dir):
    return wiki.children(_index(spark))


@query(expected("node_id string, parent_node_id string, md_path string, has_page boolean", [("r", None, "r/r.md", True), ("r/a", "r", "r/a/one.md", True), ("r/b", "r", None, False), ("r/x/c", "r", "r/x/c/c.md", True)]))
def tree_scan(spark, sf_dir):
    f = [("r", "r.md"), ("r", "z.md"), ("r/a", "one.md"), ("r/b", "p.md"), ("r/b", "q.md"), ("r/x", "pic.png"), ("r/x/c", "c.md"), ("r/r.assets", "i.md")]
    return files.scan_tree(rows(spark, "dir string, name string", f)).select("node_id", "parent_node_id", "md_path", "has_page")


@query(expected("node_id string, target string, ready boolean", [("b", "10", True), ("c", None, False), ("d", None, True)]))
def resume_pending(spark, sf_dir):
    p = rows(spark, "node_id string, title string, status string, parent_node_id string, page_id string", [("a", "A", "new", None, None), ("b", "B", "new", "a", None), ("c", "C", "new", "b", None), ("d", "D", "update", None, "5"), ("s", "S", "skip", None, None)])
    return wiki.pending(p, rows(spark, "node_id string, page_id string", [("a", "10")])).select("node_id", "target", "ready")


@query(expected("node_id string, number string", [("a", "1"), ("b", "2"), ("a1", "1.1"), ("a2", "1.2"), ("b1", "2.1"), ("b1x", "2.1.1")]))
def hierarchical_numbers(spark, sf_dir):
    return wiki.numbered(rows(spark, "node_id string, parent_node_id string, ord int", [("a", None, 1), ("b", None, 5), ("a1", "a", 2), ("a2", "a", 3), ("b1", "b", 6), ("b1x", "b1", 7)]))


@query(expected("id string, title string, version int, parent_id string", [("1", "A", 2, None), ("2", "B", 5, "1")]))
def wiki_records(spark, sf_dir):
    body = ['{"id":"1","title":"A","version":{"number":2},"ancestors":[]}', '{"id":"2","title":"B","version":{"number":5},"ancestors":[{"id":"0"},{"id":"1"}]}']
    return rest.page_records(rows(spark, "body string", [(b,) for b in body])).select("id", "title", "version", "parent_id")


def _fetch(url: str) -> dict:
    if "start=0" in url:
        return {"results": [{"id": "1"}, {"id": "2"}], "_links": {"next": "more"}} if "linked" in url else {"results": [{"id": "1"}]}
    return {"results": [{"id": "3"}]} if url == "more" else {"results": []}


@query(expected("url string, ord int, id string", [("linked", 0, "1"), ("linked", 1, "2"), ("linked", 2, "3"), ("plain", 0, "1")]))
def paged_results(spark, sf_dir):
    spark.dataSource.register(rest.paged_source("docweave_paged", _fetch))
    found = spark.read.format("docweave_paged").option("urls", "linked plain").load()
    return found.select("url", "ord", F.get_json_object("body", "$.id").alias("id"))


@query(expected("block_id string, status string, attempts int, revisions int, last_error string", [("a", "accepted", 1, 0, ""), ("b", "failed", 3, 0, "bad"), ("c", "accepted", 1, 0, ""), ("d", "failed", 3, 0, "old"), ("e", "pending", 0, 0, "")]))
def manifest_transition(spark, sf_dir):
    m = rows(spark, "block_id string, status string, attempts int, revisions int, last_error string", [("a", "pending", 0, 0, ""), ("b", "failed", 2, 0, "old"), ("c", "accepted", 1, 0, ""), ("d", "failed", 3, 0, "old"), ("e", "pending", 0, 0, "")])
    return state.transition(m, rows(spark, "block_id string, valid boolean, error string", [("a", True, ""), ("b", False, "bad"), ("c", False, "bad"), ("d", True, "")]))


@query(expected("block_id string, status string", [("a", "accepted"), ("b", "pending"), ("c", "pending")]))
def manifest_replan(spark, sf_dir):
    m = rows(spark, "block_id string, surface_sha256 string, status string, attempts int, revisions int, last_error string", [("a", "1", "accepted", 1, 0, ""), ("b", "2", "accepted", 1, 0, "")])
    return state.replanned(m, rows(spark, "block_id string, surface_sha256 string", [("a", "1"), ("b", "9"), ("c", "3")])).select("block_id", "status")


@query(expected("doc_id int, stage string, sha256 string", [(1, "merge", "m"), (1, "render", "r2"), (2, "merge", "m"), (2, "render", "r"), (2, "verify", "v")]))
def completion_invalidate(spark, sf_dir):
    done = [(d, s, s, s[0]) for d in (1, 2) for s in ("merge", "render", "verify")]
    return state.record_stage(rows(spark, "doc_id int, stage string, artifact string, sha256 string", done), rows(spark, "doc_id int, stage string, artifact string, sha256 string", [(1, "render", "render", "r2")])).select("doc_id", "stage", "sha256")


@query(expected("doc_id int, stage string, reason string", [(1, "render", "artifact changed"), (1, "verify", "artifact gone"), (1, "review", "missing")]))
def completion_gaps(spark, sf_dir):
    c = rows(spark, "doc_id int, stage string, artifact string, sha256 string", [(1, "merge", "m", "1"), (1, "render", "r", "1"), (1, "verify", "v", "1")])
    return state.completion_gaps(rows(spark, "doc_id int", [(1,)]), c, rows(spark, "artifact string, sha256 string", [("m", "1"), ("r", "2")]))


@query(expected("doc_id int, reason string", [(1, "not verified"), (2, "another artifact"), (3, "empty review")]))
def review_gate(spark, sf_dir):
    c = rows(spark, "doc_id int, stage string, artifact string, sha256 string", [(d, "verify", "a", "1") for d in (2, 3, 4)])
    return state.reviewable(c, rows(spark, "doc_id int, sha256 string, review string", [(1, "1", "x"), (2, "2", "x"), (3, "1", " "), (4, "1", "ok")]))


@query(expected("region_id string, decision string, event_no int", [("r1", "protect", 3), ("r2", "translate", 2)]))
def latest_decisions(spark, sf_dir):
    log = [(1, "ambiguity_decision", "r1", "translate", "passed"), (2, "ambiguity_decision", "r2", "translate", "passed"), (3, "ambiguity_decision", "r1", "protect", "passed"), (4, "ambiguity_decision", "r1", "translate", "failed"), (5, "run_started", None, None, None)]
    return state.latest_decisions(rows(spark, "event_no int, event string, region_id string, decision string, status string", log))


@query(expected("term string, translation string, state string", [("a", "1", "kept"), ("b", "2", "same"), ("c", "3", "conflict"), ("d", "9", "added")]))
def glossary_merge(spark, sf_dir):
    old = rows(spark, "term string, translation string", [("a", "1"), ("b", "2"), ("c", "3")])
    return state.merge_glossary(old, rows(spark, "term string, translation string", [("b", "2"), ("c", "8"), ("d", "9")]))


@query(expected("id int, n int", [(2, 1)]))
def glossary_errors(spark, sf_dir):
    g = rows(spark, "id int, terms map<string,string>", [(1, {"a": "b"}), (2, {"a": " ", "c": "d"})])
    return gates.glossary_errors(g).select("id", F.size("bad").alias("n"))


@query(expected("grp string, key string, state string", [("common", "b", "missing"), ("common", "z", "extra"), ("common", "c", "type"), ("debug", None, "missing group")]))
def config_drift(spark, sf_dir):
    a = rows(spark, "grp string, key string, type string", [("common", "a", "str"), ("common", "b", "int"), ("common", "c", "bool"), ("debug", "d", "int")])
    return state.drift(a, rows(spark, "grp string, key string, type string", [("common", "a", "str"), ("common", "c", "str"), ("common", "z", "int")]))


@query(expected("id string, wait_seconds double", [("a", 1.0), ("b", 7.0), ("c", None)]))
def retry_schedule(spark, sf_dir):
    return state.retry_schedule(rows(spark, "id string, attempt int, retry_after int", [("a", 0, None), ("b", 1, 7), ("c", 3, None)])).select("id", "wait_seconds")


@query(expected("path string, rule string", [("a/.git/config", "folder"), ("x/.env.local", "file"), ("k.pem", "suffix"), ("api-key.txt", "name")]))
def path_gate(spark, sf_dir):
    r = rows(spark, "path string", [("a/.git/config",), ("x/.env.local",), ("k.pem",), ("api-key.txt",), ("docs/a.md",)])
    return r.select("path", secrets.forbidden_reason(F.col("path")).alias("rule")).where("rule is not null")


@query(expected("path string, rule string, detail string", [("a.md", "assignment", "api_token")]))
def publication_gate(spark, sf_dir):
    value = "q7" * 12
    r = rows(spark, "path string, content string", [("a.md", f'api_token = "{value}"'), ("b.md", 'token = "your-token"'), ("c.md", "plain")])
    return secrets.publication(r)


@query(expected("block_id string, surface string", [("block-0001", "@@SEG:block-0001:0001@@\nA\n@@SEG:block-0001:0002@@\nneu\n")]))
def apply_translations(spark, sf_dir):
    b = rows(spark, "block_id string, surface string", [("block-0001", "@@SEG:block-0001:0001@@\nA\n@@SEG:block-0001:0002@@\nB\n")])
    return files.apply_segments(b, rows(spark, "block_id string, number int, translation string", [("block-0001", 2, "neu")]))


@query(expected("page_id string, action string, version string", [("1", "update", "4"), ("2", "refused", None), ("3", "gone", None)]))
def update_payloads(spark, sf_dir):
    r = rows(spark, "page_id string, title string, new_storage string, version int, now_version int, state string", [("1", "A", "x", 3, 3, "ok"), ("2", "B", "x", 3, 4, "conflict"), ("3", "C", "x", 3, None, "gone")])
    return sinks.update_payloads(r).select("page_id", "action", F.get_json_object("payload", "$.version.number").alias("version"))


@query(expected("name string", [("12_b.png",), ("3_file",)]))
def attachment_names(spark, sf_dir):
    r = rows(spark, "id string, file string", [("12", "../a/b.png"), ("3", "..")])
    return r.select(sinks.attachment_file(F.col("id"), F.col("file")).alias("name"))


@query(expected("id int, budget int, within boolean, relative string, table_row boolean, marker string, reference string, latex string, stamp string, line string", [(1, 55, True, "b/c.md", True, "@@SEG:block-0001:0007@@", "ref one", "a*b &lt;", "20240102T030405+0000", "two"), (2, 55, False, "/x/c.md", False, "@@SEG:block-0001:0012@@", "r", "x", "20240102T030405+0000", "two")]))
def scalar_misc(spark, sf_dir):
    r = rows(spark, "id int, root string, path string, line string, n int, label string, latex string", [(1, "/a", "/a/b/c.md", " | x | y", 7, " Ref \t One ", "a\\*b <"), (2, "/a", "/x/c.md", "| x", 12, "R", "x")])
    text = F.lit("one\ntwo\nthree")
    return r.select(
        "id", C.name_budget(F.lit(40)).alias("budget"), C.is_within(F.col("path"), F.col("root")).alias("within"), C.relative_path(F.col("path"), F.col("root")).alias("relative"), C.in_table_row(F.col("line")).alias("table_row"),
        C.segment_marker(F.lit("block-0001"), F.col("n")).alias("marker"), C.reference_id(F.col("label")).alias("reference"), C.escape_xml(C.clean_latex(F.col("latex"))).alias("latex"),
        C.timestamp_text(F.lit("2024-01-02 03:04:05").cast("timestamp")).alias("stamp"), C.line_at(text, F.lit(5)).alias("line"),
    )


@query(expected("folder string, bytes int", [("a", 30), ("b", 5)]).replace("INTEGER) AS bytes", "BIGINT) AS bytes"))
def folder_sizes(spark, sf_dir):
    r = rows(spark, "path string, bytes int", [("a/x", 10), ("a/y/z", 20), ("b/x", 5)])
    return r.groupBy(F.substring_index("path", "/", 1).alias("folder")).agg(F.sum("bytes").alias("bytes"))


@query(expected("page_id int, changed boolean", [(1, True), (2, False)]))
def change_audit(spark, sf_dir):
    before = rows(spark, "page_id int, storage string", [(1, "$x$"), (2, "plain")])
    return sinks.audit(before, wiki.upgraded(before)).select("page_id", "changed")


@query(expected("id int, isolated string, tables string", [(1, "a\n\n$$\n\nx\n\n$$\n\nb", "a$$x$$b"), (2, "| a |\nb", "| a |\n\nb")]))
def markdown_spacing(spark, sf_dir):
    r = rows(spark, "id int, text string", [(1, "a$$x$$b"), (2, "| a |\nb")])
    return documents.repaired(r, "id").select("id", "isolated", "tables")


# --- attachments, assets, contexts ----------------------------------------------------------------------------------


@query(expected("page_id string, name string, action string, attachment_id string, link string", [("1", "a.png", "created", None, "/download/attachments/1/a.png"), ("1", "b.png", "update", "a7", "/download/attachments/1/b.png"), ("1", "c.png", "failed", None, None), ("2", "b.png", "failed", None, None), ("2", "d.png", "update", "a9", "/download/attachments/2/d.png")]))
def attachment_uploads(spark, sf_dir):
    uploads = rows(spark, "page_id string, name string, status int", [("1", "a.png", 200), ("1", "b.png", 400), ("1", "c.png", 409), ("2", "b.png", 500), ("2", "d.png", 409)])
    return sinks.attachment_actions(uploads, rows(spark, "page_id string, attachment_id string, name string", [("1", "a7", "b.png"), ("1", "a8", "b.png"), ("2", "a5", "b.png"), ("2", "a9", "d.png")]))


@query(expected("doc_id int, source string, target string, action string, files long", [(1, "s/Guide.assets", "out/Guide.assets", "copy", 2), (2, "s/None.assets", None, "none", 0), (3, "s/Own.assets", "s/Own.assets", "in place", 1), (4, "s/Old.assets", "out/Old.assets", "refused", 1)]))
def asset_copies(spark, sf_dir):
    d = rows(spark, "doc_id int, source string, output string", [(1, "s/Guide.md", "out/Guide.de.md"), (2, "s/None.md", "out/None.md"), (3, "s/Own.md", "s/Own.de.md"), (4, "s/Old.md", "out/Old.md")])
    f = rows(spark, "path string", [("s/Guide.assets/x.png",), ("s/Guide.assets/sub/y.png",), ("s/Own.assets/z.png",), ("s/Old.assets/a",), ("out/Old.assets/a",), ("s/Guide.md",)])
    return sinks.asset_plan(d, f)


@query(expected("doc_id int, start int, kind string, context_before string, context_after string", [(1, 0, "unit", "", "r"), (1, 5, "region", "a", "b"), (1, 9, "unit", "r", "")]))
def merged_context(spark, sf_dir):
    u = rows(spark, "doc_id int, start int, value string", [(1, 9, "b"), (1, 0, "a")])
    found = blocks.merged_context(u, rows(spark, "doc_id int, start int, value string", [(1, 5, "r")]))
    return found.select("doc_id", "start", "kind", "context_before", "context_after")

