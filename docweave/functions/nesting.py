"""Tags of markup matched by depth, as column expressions: no stack, no recursion, no rescan.

Tags come out in one pass. Depth is a running sum of +1 for an opening and -1 for a closing tag, and a closing tag belongs
to the opening one that comes right before it among the tags of its depth. That holds up to the first tag that closes
nothing or something else, which is what a check reports. Comments, CDATA sections and the text of ``opaque`` elements hold
no tags. Everything is one fold and one sort of a text's tags.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fold import bind, states, tokens

TAG = r"<(?:/?)[a-zA-Z][a-zA-Z0-9:_\-]*(?:\s[^>]*)?/?>"
MARK = rf"<!\[CDATA\[|\]\]>|<!--|-->|{TAG}"
# Elements that have no end.
VOID = ("br", "hr", "img", "meta", "input", "link", "area", "base", "col", "embed", "source", "track", "wbr")

_ELEMENT = "struct<name:string,start:int,end:int,depth:int>"


def _read(text: Column, fold_case: bool) -> Column:
    """start, end, kind (+ opens, - closes, else a mark), name of each mark."""

    def one(x: Column) -> Column:
        value = x["value"]
        name = F.regexp_extract(value, r"\A</?([a-zA-Z][^\s/>]*)", 1)
        name = F.lower(name) if fold_case else name
        kind = F.when(name == "", value).when(value.startswith("</"), "-").when(value.endswith("/>") | name.isin(*VOID), "").otherwise("+")
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), kind.alias("kind"), name.alias("name"))

    return F.transform(tokens(F.coalesce(text, F.lit("")), MARK), one)


def _counted(marks: Column, opaque: Sequence[str]) -> Column:
    """The tags outside comments, CDATA and opaque text, with ``removed``: characters of comments and CDATA before them."""
    last = lambda kind: F.array_max(F.transform(F.filter(marks, lambda x: x["kind"] == kind), lambda x: x["start"]))

    def walked(end: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            outside = s["mode"] == ""
            comment = outside & (x["kind"] == "<!--") & (x["start"] < end["comment"])
            cdata = outside & (x["kind"] == "<![CDATA[") & (x["start"] < end["cdata"])
            left = ((s["mode"] == "<!--") & (x["kind"] == "-->")) | ((s["mode"] == "<![CDATA[") & (x["kind"] == "]]>"))
            raw = outside & (x["kind"] == "+") & x["name"].isin(*opaque) if opaque else F.lit(False)
            told = (s["mode"] == x["name"]) & (x["kind"] == "-") & (x["name"] != "")
            mode = F.when(comment | cdata, x["kind"]).when(raw, x["name"]).when(left | told, "").otherwise(s["mode"])
            return F.struct(mode.alias("mode"), F.when(comment | cdata, x["start"]).otherwise(s["since"]).alias("since"), (s["removed"] + F.when(left, x["end"] - s["since"]).otherwise(0)).alias("removed"))

        begin = F.struct(F.lit("").alias("mode"), F.lit(0).alias("since"), F.lit(0).alias("removed"))

        def kept(s: Column) -> Column:
            both = F.transform(marks, lambda x, i: x.withField("free", (s[i]["mode"] == "") | (s[i]["mode"] == x["name"])).withField("removed", s[i]["removed"]))
            return F.filter(both, lambda x: x["free"] & x["kind"].isin("+", "-"))

        return bind(states(marks, begin, step, "struct<mode:string,since:int,removed:int>"), kept)

    ends = F.struct(F.coalesce(last("-->"), F.lit(-1)).alias("comment"), F.coalesce(last("]]>"), F.lit(-1)).alias("cdata"))
    return bind(ends, walked)


def _levelled(tags: Column) -> Column:
    """The tags in order of their level (the depth of their element), then of place, each with the tag before it there."""
    after = states(tags, F.lit(0), lambda n, x: n + F.when(x["kind"] == "+", 1).otherwise(-1), "int")

    def ordered(n: Column) -> Column:
        at = F.transform(tags, lambda x, i: F.struct(F.greatest(n[i], n[i + 1]).alias("level"), i.alias("i"), x.alias("x")))
        return F.array_sort(at)

    def partnered(own: Column) -> Column:
        def one(y: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(own, i - 1))
            after = F.get(own, i + 1)
            pair = (y["x"]["kind"] == "-") & F.coalesce((before["level"] == y["level"]) & (before["x"]["kind"] == "+") & (before["x"]["name"] == y["x"]["name"]), F.lit(False))
            return F.struct(
                y["level"].alias("level"), y["i"].alias("i"), y["x"].alias("x"), F.when(pair, before["x"]["start"]).alias("opened"),
                ((y["x"]["kind"] == "-") & ~pair).alias("wrong"), ((y["x"]["kind"] == "+") & ~F.coalesce(after["level"] == y["level"], F.lit(False))).alias("open"),
            )

        return F.transform(own, one)

    return bind(bind(after, ordered), partnered)


def nesting(text: Column, opaque: Sequence[str] = (), fold_case: bool = False) -> Column:
    """tags, deepest, first (number of the first tag that closes nothing or something else, null if none), surplus, at,
    unclosed and elements of markup; a null text has no tags.

    ``at`` is where the surplus tag stands once comments and CDATA are taken out. ``unclosed`` are the names of the last
    five elements still open, where nothing is surplus. ``elements`` are (name, start, end, depth) of all that closed before
    the first wrong tag, by their code points in the text; ``tags`` counts opening and closing ones without void elements.
    """

    def judged(own: Column) -> Column:
        first = F.array_min(F.transform(F.filter(own, lambda y: y["wrong"]), lambda y: F.struct(y["i"].alias("i"), y["x"]["name"].alias("name"), (y["x"]["start"] - y["x"]["removed"]).alias("at"))))

        def told(w: Column) -> Column:
            fine = F.filter(own, lambda y: w.isNull() | (y["i"] < w["i"]))
            open_ = F.transform(F.filter(own, lambda y: w.isNull() & y["open"]), lambda y: y["x"]["name"])
            elements = F.transform(F.filter(fine, lambda y: y["opened"].isNotNull()), lambda y: F.struct(y["x"]["name"].alias("name"), y["opened"].alias("start"), y["x"]["end"].alias("end"), y["level"].alias("depth")))
            return F.struct(
                F.size(own).alias("tags"), F.coalesce(F.array_max(F.transform(fine, lambda y: y["level"])), F.lit(0)).alias("deepest"), w["i"].alias("first"), w["name"].alias("surplus"), w["at"].alias("at"),
                bind(open_, lambda o: F.when(F.size(o) > 5, F.slice(o, -5, 5)).otherwise(o)).alias("unclosed"), elements.alias("elements"),
            )

        return bind(first, told)

    return bind(bind(bind(_read(text, fold_case), lambda m: _counted(m, opaque)), _levelled), judged)


def balance(found: Column) -> Column:
    """What is wrong, in words, of the result of ``nesting``: empty if all tags close in order."""
    names = F.array_join(F.transform(found["unclosed"], lambda n: F.concat(F.lit("'"), n, F.lit("'"))), ", ")
    return F.when(found["surplus"].isNotNull(), F.concat(F.lit("surplus </"), found["surplus"], F.lit("> at "), found["at"].cast("string"))).when(F.size(found["unclosed"]) > 0, F.concat(F.lit("unclosed ["), names, F.lit("]"))).otherwise("")


def outermost(found: Column, names: Sequence[str]) -> Column:
    """Spans of the elements of these names that lie in none of them: what is protected as a whole.

    Elements of a nested list are either apart or inside each other, so one pass in order of their starts, with the
    furthest end so far, finds the outer ones.
    """
    own = F.array_sort(F.transform(F.filter(found["elements"], lambda e: e["name"].isin(*names)), lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"))))

    def outer(s: Column) -> Column:
        return bind(states(s, F.lit(0), lambda far, e: F.greatest(far, e["end"]), "int"), lambda far: F.filter(s, lambda e, i: e["start"] >= far[i]))

    return bind(own, outer)
