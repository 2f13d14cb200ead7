"""Tags matched by depth, and references resolved, as columns: equal to the scanner and to the standard library."""

import random
import time
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from docweave.functions import nesting
from docweave.functions.urljoin import url_join
from docweave.storage import convert

FIXED = [
    None, "", "plain", "<p>a</p>", "<p><b>x</p>", "</p>", "<p><br><hr/></p>", "<a href='x>y'>z</a>", "<p><![CDATA[</p><b>]]></p>", "<!-- <b> --><i>x</i>", "<p><![CDATA[ open </p>", "<!-- <b>", "<a><b><c><d><e><f><g>", "<ac:structured-macro ac:name=\"code\"><ac:plain-text-body><![CDATA[<x>]]></ac:plain-text-body></ac:structured-macro>",
    "<P>x</p>", "<a></b></a>", "<!-- a --></i>", "é<!-- 日 -->日</i>", "<a/><b /></b>", "<!-- <![CDATA[ --></a>]]>", "<p></p/>", "<1><p>", "< p></p>",
]


def random_markup(n=500):
    rng = random.Random(5)
    parts = ["<p>", "</p>", "<b>", "</b>", "<i x='1'>", "</i>", "<br>", "<hr/>", "<a/>", "<![CDATA[", "]]>", "<!--", "-->", "x", " ", "é", "<script>", "</script>"]
    return ["".join(rng.choice(parts[: rng.choice([6, 18])]) for _ in range(rng.randrange(16))) for _ in range(n)]


def nested(rng, depth=0):
    name = rng.choice("abcd")
    inner = "".join(nested(rng, depth + 1) if depth < 5 and rng.random() < 0.6 else rng.choice(["t", "", "<br>"]) for _ in range(rng.randrange(4)))
    return f"<{name}>{inner}</{name}>"


def test_balance_equals_the_stack(spark):
    rng = random.Random(9)
    texts = FIXED + random_markup() + [nested(rng) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    found = {r["i"]: r["b"] for r in df.select("i", nesting.balance(nesting.nesting(F.col("t"))).alias("b")).collect()}
    for i, t in enumerate(texts):
        assert found[i] == convert.balance(t or ""), repr(t)


def test_elements_depth_and_opaque_text(spark):
    html = '<html><script>var a="</p><b>";</script><div><pre>a<code>b</code></pre><PRE>c</PRE></div></html>'
    n = nesting.nesting(F.lit(html), ("script", "style"), True)
    r = spark.range(1).select(n.alias("n")).select("n.*", nesting.outermost(F.col("n"), ("pre", "code")).alias("held")).first()
    assert (r["surplus"], r["unclosed"], r["deepest"], r["tags"]) == (None, [], 4, 12)
    assert sorted((html[e["start"] : e["end"]], e["depth"]) for e in r["elements"] if e["depth"] > 2) == [("<PRE>c</PRE>", 3), ("<code>b</code>", 4), ("<pre>a<code>b</code></pre>", 3)]
    assert [html[e["start"] : e["end"]] for e in r["held"]] == ["<pre>a<code>b</code></pre>", "<PRE>c</PRE>"]


def test_deep_and_unclosed_markup_takes_linear_time(spark):
    texts = ["<div>" * 50_000 + "</div>" * 50_000, "<![CDATA[" * 100_000, "<b>" * 100_000, "<!--" * 100_000 + "</i>"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4).cache()
    df.count()
    began = time.time()
    found = {r["i"]: (r["n"]["deepest"], r["b"]) for r in df.select("i", nesting.nesting(F.col("t")).alias("n")).select("i", "n", nesting.balance(F.col("n")).alias("b")).collect()}
    assert found == {0: (50_000, ""), 1: (0, ""), 2: (100_000, "unclosed ['b', 'b', 'b', 'b', 'b']"), 3: (0, "surplus </i> at 400000")}
    assert time.time() - began < 40


BASES = ["http://a/b/c/d;p?q", "https://Ex.org", "https://ex.org/", "http://ex.org/a/b/", "http://ex.org/a//b/../c?x#f", "", "file:///a/b", "mailto:x@y", "//h/p", "a/b", "http://h/;x", "ftp://h/a;b/c;d"]
REFERENCES = [
    "g:h", "g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", "g;x?y#s", "", ".", "./", "..", "../", "../g", "../..", "../../", "../../g", "../../../g", "../../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g", "./../g", "./g/.", "g/./h", "g/../h", "g;x=1/./y", "g;x=1/../y",
    "g?y/./x", "g?y/../x", "g#s/./x", "http:g", "HTTP://X/y", "https://z", "mailto:a@b", "javascript:void(0)", " \tg\n", "a\nb", "//", "///x", "////x", "a//b", "/a//b/", "..;p", "日本/é?ü#ß", "?", "#", "a?#", "1:2", ":x", "x:y/../z", "../a/../../b/./c/..",
]


def test_references_resolve_as_the_standard_library_does(spark):
    rng = random.Random(3)
    more = ["".join(rng.choice(["..", ".", "a", "/", "/", "b;c", "?", "#", "%20", "//"]) for _ in range(rng.randrange(9))) for _ in range(300)]
    pairs = [(b, r) for b in BASES for r in REFERENCES + more]
    df = spark.createDataFrame([(i, b, r) for i, (b, r) in enumerate(pairs)], "i int, b string, r string").repartition(4)
    found = {r["i"]: r["u"] for r in df.select("i", url_join(F.col("b"), F.col("r")).alias("u")).collect()}
    wrong = [(b, r, found[i], urljoin(b, r)) for i, (b, r) in enumerate(pairs) if found[i] != urljoin(b, r)]
    assert not wrong, (len(wrong), wrong[:5])


def test_references_without_a_value(spark):
    df = spark.createDataFrame([(None, "x"), ("http://h/a", None)], "b string, r string")
    assert [r["u"] for r in df.select(url_join(F.col("b"), F.col("r")).alias("u")).collect()] == [None, None]


@pytest.mark.parametrize("n", [1, 20_000])
def test_long_paths(spark, n):
    reference = "a/../" * n + "../" * n + "x"
    assert spark.range(1).select(url_join(F.lit("http://h/p/q"), F.lit(reference)).alias("u")).first()["u"] == "http://h/x"
