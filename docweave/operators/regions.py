"""Code and formula regions of Markdown texts by folds over their delimiters, without a scanner and without a shuffle.

All delimiters of a text come out in one pass: fence lines, runs of backticks, dollar signs, each with the backslashes
before it. A state machine runs over them in parts (``fold.states``); what a delimiter does follows from the state before
it. Nothing is rescanned, whatever is nested or left open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fold import bind, states

# The line ends of Python's str.splitlines, which the scanner of these regions uses.
_ENDS = r"\n\r\x0B\x0C\x1C-\x1E\u0085  "
# A fence line begins with the line end before it, so that most places in a text are passed over by their first character.
_FENCE = rf"(?:\A|[{_ENDS}])[ \t>]*+(?:`{{3,}}+[^`{_ENDS}]*+(?=[{_ENDS}]|\z)|~{{3,}}+[^{_ENDS}]*+)"
DELIMITER = rf"{_FENCE}|\\*+`++|\\*+\$"
_LED = rf"\A[{_ENDS}]"
_BLANK = rf"\A[{_ENDS}]?[ \t>]*(?:`+|~+)[ \t]*\z"

_MAYBE = rf"\A(?:[{_ENDS} \t>]|`{{3}}|~{{3}})"
_SPANS = "array<struct<start:int,end:int>>"
_MARKS = "array<struct<start:int,end:int,kind:string,size:int,char:string,blank:boolean,live:boolean,double:boolean>>"


def _delimiters(text: Column) -> Column:
    """start, end (without the backslashes before), kind (fence, run, dollar), size, char, blank, live, double."""
    found = F.regexp_extract_all(text, F.lit(DELIMITER), F.lit(0))
    pieces = F.transform(F.arrays_zip(F.split(text, DELIMITER, -1).alias("gap"), found.alias("value")), lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.substr(x["gap"], F.lit(1), F.lit(2)).alias("head"), F.coalesce(x["value"], F.lit("")).alias("value")))

    def placed(own: Column) -> Column:
        def read(ends: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                after, value, start, end = F.get(own, i + 1), x["value"], ends[i] + x["gap"], ends[i + 1]
                led = value.rlike(_LED)
                fence = led | ((start == 0) & value.rlike(r"\A[ \t>]*(?:`{3}|~{3})"))
                # What follows a fence line is a line end or nothing; a run of backticks at the front is followed by neither.
                ahead = F.concat(after["head"], F.substr(after["value"], F.lit(1), F.lit(1)))
                closed = F.when(ahead.startswith("\r\n"), 2).when(ahead.rlike(_LED), 1).otherwise(0)
                line = fence & (led | (closed > 0) | (ahead == ""))
                mark = F.regexp_extract(value, "`{3,}|~{3,}", 0)
                size = F.when(line, F.length(mark)).otherwise(F.length(F.ltrim(value, F.lit("\\"))))
                full = F.struct(
                    F.when(line, start + led.cast("int")).otherwise(end - size).alias("start"),
                    (end + F.when(line, closed).otherwise(0)).alias("end"),
                    F.when(line, "fence").when(F.endswith(value, F.lit("$")), "dollar").otherwise("run").alias("kind"),
                    size.alias("size"),
                    F.when(line, F.substr(mark, F.lit(1), F.lit(1))).otherwise("").alias("char"),
                    (line & value.rlike(_BLANK) & ((closed == 0) | ahead.rlike(r"\A[\r\n]"))).alias("blank"),
                    (line | ((F.length(value) - size) % 2 == 0)).alias("live"),
                )
                # Most are single signs, for which two look-ups do.
                sign = F.ltrim(value, F.lit("\\"))
                plain = F.struct(
                    (end - F.length(sign)).alias("start"), end.alias("end"), F.when(sign == "$", "dollar").otherwise("run").alias("kind"), F.length(sign).alias("size"),
                    F.lit("").alias("char"), F.lit(False).alias("blank"), ((F.length(value) - F.length(sign)) % 2 == 0).alias("live"),
                )
                return F.when(value.rlike(_MAYBE), full).otherwise(plain)

            return F.transform(F.slice(own, F.lit(1), F.size(own) - 1), one)

        return bind(states(own, F.lit(0), lambda at, x: at + x["gap"] + F.length(x["value"]), "int"), read)

    def doubled(own: Column) -> Column:
        def more(x: Column, i: Column) -> Column:
            after = F.get(own, i + 1)
            # The second of two signs has no backslash before it, so it begins where the first ends.
            twice = (x["kind"] == "dollar") & F.coalesce((after["kind"] == "dollar") & (after["start"] == x["end"]), F.lit(False))
            return x.withField("double", twice)

        return F.transform(own, more)

    return F.when(F.size(found) > 0, bind(bind(pieces, placed), doubled)).otherwise(F.array().cast(_MARKS))


def _fenced(marks: Column) -> Column:
    """(marks, fences): the delimiters outside fenced code, with the number of their gap, and the fenced regions."""

    def step(s: Column, x: Column) -> Column:
        fence = x["kind"] == "fence"
        opens = fence & (s["size"] == 0)
        closes = fence & (s["size"] > 0) & (x["char"] == s["char"]) & (x["size"] >= s["size"]) & x["blank"]
        size = F.when(opens, x["size"]).when(closes, 0).otherwise(s["size"])
        return F.struct(F.when(opens, x["char"]).otherwise(s["char"]).alias("char"), size.alias("size"), (s["gap"] + opens.cast("int")).alias("gap"))

    begin = F.struct(F.lit("").alias("char"), F.lit(0).alias("size"), F.lit(0).alias("gap"))
    state = states(marks, begin, step, "struct<char:string,size:int,gap:int>")

    def split(s: Column) -> Column:
        both = F.transform(marks, lambda x, i: F.struct(x.alias("x"), s[i]["size"].alias("before"), s[i + 1]["size"].alias("after"), s[i]["gap"].alias("gap")))

        def parts(b: Column) -> Column:
            outside = F.filter(b, lambda y: (y["before"] == 0) & (y["x"]["kind"] != "fence"))
            opened = F.transform(F.filter(b, lambda y: (y["before"] == 0) & (y["after"] > 0)), lambda y: y["x"]["start"])
            closed = F.transform(F.filter(b, lambda y: (y["before"] > 0) & (y["after"] == 0)), lambda y: y["x"]["end"])
            fences = bind(closed, lambda ends: F.transform(opened, lambda at, i: F.struct(at.alias("start"), F.get(ends, i).alias("end"))))
            return F.struct(F.transform(outside, lambda y: y["x"].withField("gap", y["gap"])).alias("marks"), fences.alias("fences"))

        return bind(both, parts)

    # Without a fence line there is one gap, and nothing to fold.
    bare = F.struct(F.transform(marks, lambda x: x.withField("gap", F.lit(0))).alias("marks"), F.array().cast(_SPANS).alias("fences"))
    return F.when(F.exists(marks, lambda x: x["kind"] == "fence"), bind(state, split)).otherwise(bare)


def _paired(marks: Column) -> Column:
    """The live delimiters with ``again``: a run of the same size follows in the same gap."""
    runs = F.filter(marks, lambda x: (x["kind"] == "run") & x["live"])
    order = F.array_sort(F.transform(runs, lambda x: F.struct(x["gap"].alias("gap"), x["size"].alias("size"), x["start"].alias("start"), x["end"].alias("end"))))

    def marked(own: Column) -> Column:
        def again(x: Column, i: Column) -> Column:
            after = F.get(own, i + 1)
            return F.coalesce((after["gap"] == x["gap"]) & (after["size"] == x["size"]), F.lit(False))

        return F.transform(own, lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit("run").alias("kind"), x["size"].alias("size"), again(x, i).alias("flag")))

    dollars = F.transform(F.filter(marks, lambda x: (x["kind"] == "dollar") & x["live"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit("dollar").alias("kind"), x["size"].alias("size"), x["double"].alias("flag")))
    return F.array_sort(F.concat(bind(order, marked), dollars))


# States of formulas: none, after $, after $$; and those two after the first sign of a pair, whose second is passed over.
_NONE, _SINGLE, _DOUBLE, _CLOSED, _OPENED = range(5)


def _matched(marks: Column) -> Column:
    """(code, formulas): inline code, and formulas (display where between double signs; no end where none closes)."""

    def step(s: Column, x: Column) -> Column:
        run, twice = x["kind"] == "run", x["flag"]
        code = F.when(run & (s["code"] == 0) & twice, x["size"]).when(run & (s["code"] == x["size"]), 0).otherwise(s["code"])
        f = s["formula"]
        moved = F.when(f == _NONE, F.when(twice, _OPENED).otherwise(_SINGLE)).when(f == _DOUBLE, F.when(twice, _CLOSED).otherwise(_DOUBLE)).when(f == _OPENED, _DOUBLE).otherwise(_NONE)
        return F.struct(code.alias("code"), F.when(run | (s["code"] > 0), f).otherwise(moved).alias("formula"))

    state = states(marks, F.struct(F.lit(0).alias("code"), F.lit(_NONE).alias("formula")), step, "struct<code:int,formula:int>")

    def read(s: Column) -> Column:
        both = F.transform(marks, lambda x, i: F.struct(x.alias("x"), s[i].alias("a"), s[i + 1].alias("b")))

        def parts(b: Column) -> Column:
            opened = F.filter(b, lambda y: (y["a"]["code"] == 0) & (y["b"]["code"] > 0))
            closed = F.filter(b, lambda y: (y["a"]["code"] > 0) & (y["b"]["code"] == 0))
            code = bind(closed, lambda ends: F.transform(opened, lambda y, i: F.struct(y["x"]["start"].alias("start"), F.get(ends, i)["x"]["end"].alias("end"))))
            moved = F.filter(b, lambda y: y["a"]["formula"] != y["b"]["formula"])
            begins = F.filter(moved, lambda y: y["a"]["formula"] == _NONE)
            ends = F.filter(moved, lambda y: y["a"]["formula"].isin(_SINGLE, _DOUBLE))

            def paired(last: Column) -> Column:
                def formula(y: Column, i: Column) -> Column:
                    display = y["b"]["formula"] == _OPENED
                    return F.struct(y["x"]["start"].alias("start"), (F.get(last, i)["x"]["end"] + display.cast("int")).alias("end"), display.alias("display"))

                return F.transform(begins, formula)

            return F.struct(code.alias("code"), bind(ends, paired).alias("formulas"))

        return bind(both, parts)

    return bind(state, read)


def regions(text: Column) -> Column:
    """fences, code and formulas of a text: arrays of spans by code points; a null text has none.

    A fence's end is null where it isn't closed (the region then runs to the end), a formula's where no sign closes it.
    Formulas are looked for outside code; one may reach over code.
    """
    fenced = lambda d: bind(_fenced(d), lambda f: F.struct(f["fences"].alias("fences"), bind(_paired(f["marks"]), _matched).alias("inner")))
    found = bind(_delimiters(F.coalesce(text, F.lit(""))), fenced)
    none = F.struct(F.array().cast(_SPANS).alias("fences"), F.array().cast(_SPANS).alias("code"), F.array().cast("array<struct<start:int,end:int,display:boolean>>").alias("formulas"))
    # Most texts have no delimiter at all.
    return F.when(text.rlike(r"[`$]|~{3}"), bind(found, lambda x: F.struct(x["fences"].alias("fences"), x["inner"]["code"].alias("code"), x["inner"]["formulas"].alias("formulas")))).otherwise(none)


def code_regions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, kind (fence or inline), start, end, closed of each code region."""
    t = F.col(text)
    found = docs.select(F.col(key), F.length(t).alias("__n"), regions(t).alias("__r"))
    fences = F.transform("__r.fences", lambda x: F.struct(F.lit("fence").alias("kind"), x["start"].alias("start"), F.coalesce(x["end"], F.col("__n")).alias("end"), x["end"].isNotNull().alias("closed")))
    code = F.transform("__r.code", lambda x: F.struct(F.lit("inline").alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.lit(True).alias("closed")))
    return found.select(key, F.explode(F.concat(fences, code)).alias("x")).select(key, "x.*")


def formula_regions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start, end, display, latex of each formula outside code; end and latex are null where no sign closes it."""
    t = F.col(text)
    found = docs.select(F.col(key), t.alias("__t"), F.explode(regions(t)["formulas"]).alias("x"))
    width = F.when(F.col("x.display"), 2).otherwise(1)
    latex = F.substr("__t", F.col("x.start") + width + 1, F.col("x.end") - F.col("x.start") - 2 * width)
    return found.select(key, "x.start", "x.end", "x.display", latex.alias("latex"))
