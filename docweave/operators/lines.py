"""Physical lines as rows, and what windows over them give: sections, paragraphs, tables, parity of regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import strip

BREAK = r"\r\n|\n|\r"
DELIMITER_ROW = r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)*\|?[ \t]*$"
UNDERLINE = r"^ {0,3}(?:=+|-+)[ \t]*$"
REFERENCE = r"^ {0,3}\[([^\]^][^\]]*)\]:[ \t]*.+$"
FOOTNOTE = r"^ {0,3}\[\^[^\]]+\]:"


def explode_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, number, start, content_end, end, content, newline of every physical line (CRLF, LF and CR end one).

    Offsets are code points. An empty or null text is one empty line; a line break at the end opens no further line.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    contents, breaks = F.split(t, BREAK, -1), F.regexp_extract_all(t, F.lit(BREAK), F.lit(0))
    zipped = F.arrays_zip(contents.alias("c"), breaks.alias("b"))
    rows = docs.select(F.col(key), F.posexplode(zipped).alias("i", "x")).select(key, (F.col("i") + 1).alias("number"), F.col("x.c").alias("content"), F.coalesce("x.b", F.lit("")).alias("newline"))
    rows = rows.where((F.col("content") != "") | (F.col("newline") != "") | (F.col("number") == 1))
    size = F.length("content") + F.length("newline")
    w = Window.partitionBy(key).orderBy("number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(size).over(w))
    start = F.col("end") - size
    return rows.select(key, "number", start.alias("start"), (start + F.length("content")).alias("content_end"), "end", "content", "newline")


def _running(key: str) -> Window:
    return Window.partitionBy(key).orderBy("number").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def sections(lines: DataFrame, is_heading: Column, key: str = "doc_id") -> DataFrame:
    """Adds section_no (0 before the first heading) and section: the text of the last heading that isn't blank."""
    w = _running(key)
    named = F.when(is_heading & (strip(F.col("content")) != ""), strip(F.col("content")))
    return lines.withColumn("section_no", F.sum(is_heading.cast("int")).over(w)).withColumn("section", F.coalesce(F.last(named, ignorenulls=True).over(w), F.lit("")))


def paragraphs(lines: DataFrame, breaks: Column, key: str = "doc_id") -> DataFrame:
    """Islands of lines between breaks: key, paragraph, first, last, lines, longest, start, content_end."""
    island = F.sum(breaks.cast("int")).over(_running(key))
    rows = lines.withColumn("island", island).where(~breaks)
    grouped = rows.groupBy(key, "island").agg(F.min("number").alias("first"), F.max("number").alias("last"), F.count("*").alias("lines"), F.max(F.length("content")).alias("longest"), F.min("start").alias("start"), F.max("content_end").alias("content_end"))
    w = Window.partitionBy(key).orderBy("island")
    return grouped.withColumn("paragraph", F.row_number().over(w)).drop("island")


def formula_parity(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds in_formula: the line opens, closes or lies within a display formula. Marks are counted line by line."""
    marks = F.regexp_count(F.regexp_replace("content", r"\\.", ""), F.lit(r"\$\$"))
    before = F.sum(marks).over(_running(key)) - marks
    return lines.withColumn("in_formula", (before % 2 == 1) | (marks > 0))


def paragraph_stats(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, chopped, total: paragraphs that look hard-wrapped (two lines or more, all under 80 characters) and all."""
    s = strip(F.col("content"))
    mark = s.startswith("$$")
    before = F.sum(mark.cast("int")).over(_running(key)) - mark.cast("int")
    lines = lines.withColumn("inside", before % 2 == 1)
    structure = s.rlike(r"^(#|>|!\[|[-*+] )") | (s == "")
    indented = F.col("content").rlike(r"^ \s*\s\S")
    found = paragraphs(lines.where(mark | ~F.col("inside")).where(mark | structure | ~indented), mark | structure, key)
    chopped = (F.col("lines") >= 2) & (F.col("longest") < 80)
    return found.groupBy(key).agg(F.sum(chopped.cast("long")).alias("chopped"), F.count("*").alias("total"))


def table_rows(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines of tables: the header before a delimiter row, and the rows after it up to one without a bar."""
    w = Window.partitionBy(key).orderBy("number")
    bar = F.col("content").contains("|")
    mark = F.col("content").rlike(DELIMITER_ROW)
    lines = lines.withColumn("is_mark", mark).withColumn("is_bar", bar & (strip(F.col("content")) != ""))
    last_mark = F.last(F.when(F.col("is_mark"), F.col("number")), ignorenulls=True).over(_running(key))
    last_gap = F.last(F.when(~F.col("is_bar") & ~F.col("is_mark"), F.col("number")), ignorenulls=True).over(_running(key))
    body = F.col("is_bar") & (last_mark < F.col("number")) & (F.coalesce(last_gap, F.lit(0)) < last_mark)
    header = F.col("is_bar") & F.coalesce(F.lead("is_mark").over(w), F.lit(False))
    rows = lines.withColumn("is_body", body).withColumn("is_header", header)
    return rows.where((F.col("is_body") | F.col("is_header")) & (~F.col("is_mark") | F.col("is_body"))).select(key, "number", "content", "is_header")


def underlined_headings(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines that the next line underlines, with their level."""
    below = F.lead("content").over(Window.partitionBy(key).orderBy("number"))
    rows = lines.withColumn("below", below)
    return rows.where(F.col("below").rlike(UNDERLINE) & (strip(F.col("content")) != "")).select(key, "number", strip(F.col("content")).alias("title"), F.when(F.ltrim("below").startswith("="), 1).otherwise(2).alias("level"))


def footnote_continuations(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Indented lines under a footnote definition; a plain line ends it, a blank one doesn't."""
    c = F.col("content")
    state = F.when(c.rlike(FOOTNOTE), 2).when(strip(c) == "", None).when(c.rlike(r"^( {4}|\t)"), None).otherwise(0)
    active = F.last(state, ignorenulls=True).over(_running(key))
    rows = lines.withColumn("active", active)
    return rows.where((F.col("active") == 2) & c.rlike(r"^( {4}|\t)") & (strip(c) != "")).select(key, "number", "content")


def reference_ids(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    from ..functions.columns import reference_id

    found = lines.where(F.col("content").rlike(REFERENCE))
    return found.select(key, reference_id(F.regexp_extract("content", REFERENCE, 1)).alias("reference")).distinct()


def without_quote(content: Column) -> Column:
    return F.regexp_replace(content, r"^ {0,3}(?:>[ \t]? {0,3})+", "")


def next_non_blank(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds the number and text of the next line that isn't blank."""
    below = Window.partitionBy(key).orderBy(F.desc("number")).rowsBetween(Window.unboundedPreceding, -1)
    filled = F.when(strip(F.col("content")) != "", F.struct("number", "content"))
    return lines.withColumn("next", F.last(filled, ignorenulls=True).over(below))


def missed_formulas(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Emphasised single letters that look like formulas, one row each; code must be masked before."""
    from ..text.scan import BOLD_FORMULA, ITALIC_FORMULA

    s = strip(F.col("content"))
    plain = F.regexp_replace(F.regexp_replace(s, r"\$\$[\s\S]*?\$\$", ""), r"\$[^$]+?\$", "")
    rows = lines.where((s != "") & ~s.rlike(r"^(\||#|\$\$|>|!\[)"))
    both = F.concat(*(F.transform(F.regexp_extract_all(plain, F.lit(p), F.lit(0)), _tagged(k)) for k, p in (("italic", ITALIC_FORMULA), ("bold", BOLD_FORMULA))))
    return rows.select(key, "number", F.explode(both).alias("m")).select(key, "number", "m.kind", "m.match")


def _tagged(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("match"))
