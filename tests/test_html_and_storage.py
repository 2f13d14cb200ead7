"""HTML pages, formulas and storage markup: hand-written cases and round trips."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docweave.html import emit, math, nav
from docweave.html.dom import parse
from docweave.html.normalise import extract_title
from docweave.storage import convert, export

SOUP = st.text(st.sampled_from("<>/abpdivultrh1=\"' &;!-\n$\\()[]"), max_size=120)


@settings(max_examples=300, deadline=None)
@given(SOUP)
def test_any_text_is_a_page(source):
    emit.convert(source, "http://h/a")
    nav.collect(parse(source), "http://h/a")
    export.to_markdown(source)


def markdown(html):
    return emit.convert(f"<body>{html}</body>", "http://h/d/a.html").markdown.strip()


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<h2>A</h2><p>b <b>c</b> <i>d</i></p>", "## A\n\nb **c** *d*"),
        ("<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>", "- a\n  - b\n- c"),
        ("<ol><li>a</li><li>b</li></ol>", "1. a\n2. b"),
        ("<blockquote><p>a</p><p>b</p></blockquote>", "> a\n>\n> b"),
        ("<pre><code>x\n  y</code></pre>", "```\nx\n  y\n```"),
        ("<p>a<br>b</p>", "a  \nb"),
        ("<table><tr><th>a</th><th>b</th></tr><tr><td>1</td></tr></table>", "| a | b |\n| --- | --- |\n| 1 |  |"),
        ("<p>a<p>b", "a\n\nb"),
        ("<p>x</p><script>y</script><nav>z</nav>", "x"),
        ("<p><code>a`b</code></p>", "``a`b``"),
    ],
)
def test_markdown(html, text):
    assert markdown(html) == text


def test_titles():
    assert extract_title(parse("<title>A | B</title>")) == "A"
    assert extract_title(parse("<h1> </h1><meta property='og:title' content='O'>")) == "O"
    assert extract_title(parse("<p>x")) == "untitled"


def test_encyclopedia_prefers_balanced_source():
    node = parse('<span class="mwe-math-element"><annotation encoding="application/x-tex">{a</annotation><img alt="{a}"></span>').find("span")
    assert math.encyclopedia_latex(node) == "{a}"


def test_book_chrome_goes_but_the_body_stays():
    html = '<meta name="generator" content="GitBook"><div class="book-header">H</div><div id="book-search-results"><div class="search-noresults"><p>Body</p></div><div class="has-results">R</div></div>'
    assert markdown(html) == "Body"


def test_strategies_can_be_extended():
    nav.STRATEGIES.append(nav.Strategy("own", lambda root: root.find("ownnav") is not None, True))
    try:
        assert nav.collect(parse("<ownnav></ownnav>"), "http://h/a").structure == "own"
    finally:
        nav.STRATEGIES.pop()


@pytest.mark.parametrize("text", ["# T\n\na $x$ **b**\n", "- a\n- b\n", "```sql\nselect 1\n\n\nx\n```\n", "$$z$$\n", "| a | b |\n| --- | --- |\n| 1 | 2 |\n", "[l](http://u/v) and `c`\n"])
def test_round_trip(text):
    assert export.to_markdown(convert.to_storage(text)).markdown == text


def test_code_is_protected_from_everything():
    made = convert.to_storage("`$x$ ==y== ![a](b)`\n\n```\n[toc]\n$$z$$\n```\n")
    assert "mathinline" not in made and "mathblock" not in made and "<strong>" not in made and '"toc"' not in made


def test_alignment_is_idempotent():
    once = convert.align_blocks(convert.block_macro("x", "center"), "left")
    assert once == (convert.block_macro("x", "left"), 1)
    assert convert.align_blocks(once[0], "left") == (once[0], 0)
    assert convert.align_blocks(once[0], "center") == (convert.block_macro("x", "center"), 1)


def test_nested_math_spans_stay():
    html = '<span class="math">a<span>b</span></span>'
    assert convert.strip_math_spans(html) == (html, 0)


def test_residuals_have_positions():
    assert convert.residuals("<p>x</p>\n<p>$$a$$ $b$</p>") == ["inline@2:10", "block@2:4"]


def test_unknown_macros_are_kept_as_comments():
    e = export.to_markdown('<ac:structured-macro ac:name="zap"><ac:rich-text-body><p>b</p></ac:rich-text-body></ac:structured-macro>')
    assert e.unknown_macros == ["zap"] and "macro not converted: zap" in e.markdown and e.markdown.rstrip().endswith("b")


def test_images_are_reported():
    e = export.to_markdown('<ac:image><ri:attachment ri:filename="a.png"/></ac:image><ac:image><ri:attachment ri:filename="b.png"/></ac:image>', attachments={"a.png": "1_a.png"})
    assert e.images == ["1_a.png"] and e.failed_images == 1
