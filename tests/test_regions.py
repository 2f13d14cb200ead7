"""Code and formula regions by folds, equal to the scanner on odd texts."""

import random
import time

import pytest

from docweave.operators import regions
from docweave.text import scan

FIXED = [
    None, "", "`a` b ``c ` d`` e", "a `b", "\\`a` b`", "```\ncode $x$\n```\n$y$ and `$z$`", "~~~ info `x`\n```\n~~~\nafter `c`", "```a`b\n`x`\n", "> ```\n> x\n> ```\n", "````\n```\n````  \n$a$$b$$c$", "$$a$b$$ $c", "\\$a$b\\\\$c$", "$$$a$$$", "$$", "$", "$a `$` b$", "```\nopen `x` $y$",
    "```\r\nx\r\n```\r\n`y`", "```\x0bx\n```\x0b`a`\n```\n", "a ```", "```", "x ``` y", "``` ~~~\n~~~\n```", "$a\n```\n$\n```\nb$", "`a\n\n```\n`\n```\n`b`", "日本`語`$é$ 🎉`x`",
]


def random_texts(n=700):
    rng = random.Random(11)
    parts = ["`", "``", "```", "\n```\n", "\n~~~\n", "\n````", "$", "$$", "\\", "\\$", "\\`", "a", " ", "\n", "\r\n", "\n> ```", "\n```py\n", "\n~~~~ x\n", "\x0b", "\x85", "é"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(n)]


@pytest.fixture(scope="module")
def found(spark):
    texts = FIXED + random_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4).cache()
    code = {i: [] for i in range(len(texts))}
    for r in regions.code_regions(df).collect():
        code[r["doc_id"]].append((r["kind"], r["start"], r["end"], r["closed"]))
    formulas = {i: [] for i in range(len(texts))}
    for r in regions.formula_regions(df).collect():
        formulas[r["doc_id"]].append((r["start"], r["end"], r["display"], r["latex"]))
    return texts, code, formulas


def test_code_equals_the_scanner(found):
    texts, code, _ = found
    for i, t in enumerate(texts):
        fenced, unclosed = scan.fences(t or "")
        want = [("fence", s.start, s.end, s.start != unclosed) for s in fenced] + [("inline", s.start, s.end, True) for s in scan.inline_code(t or "", fenced)]
        assert sorted(code[i]) == sorted(want), repr(t)


def test_formulas_equal_the_scanner(found):
    texts, _, formulas = found
    for i, t in enumerate(texts):
        closed, opened = scan.formulas(scan.mask_code(t or ""))
        assert sorted(x[:3] for x in formulas[i] if x[1] is not None) == [(f.start, f.end, f.display) for f in closed], repr(t)
        assert [x[0] for x in formulas[i] if x[1] is None] == opened, repr(t)
        for start, end, display, latex in formulas[i]:
            assert end is None or latex == t[start + 1 + display : end - 1 - display]


def test_many_open_marks_take_linear_time(spark):
    texts = ["`" + " ``" * 20_000 + " $" * 20_001, "\n```x\n" * 20_000, "$$ " * 20_001, "\\" * 100_000 + "$a$"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").cache()
    df.count()
    began = time.time()
    assert regions.formula_regions(df).count() == 20_001 + 2
    assert regions.code_regions(df).where("kind = 'fence' and not closed").count() == 1
    assert time.time() - began < 40
