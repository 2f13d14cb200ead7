"""Scanners over page rows: Markdown, navigation, images, formula passes. A page is parsed once per call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..html import emit, math, nav
from ..html.dom import parse
from .rows import flat_map, map_rows

PAGE = "page_id long, url string, title string, markdown string, formulas int, inline_formulas int, display_formulas int, review_formulas int, links int, placeholders int, images array<string>"


def markdown(pages: DataFrame, cells_inline: bool = True) -> DataFrame:
    """Title, Markdown, counts and image references of each page (page_id, url, html)."""

    def make(page_id, url, html):
        p = emit.convert(html, url, cells_inline=cells_inline)
        return {"page_id": page_id, "url": url, "title": p.title, "markdown": p.markdown, "formulas": p.formulas, "inline_formulas": p.inline, "display_formulas": p.display, "review_formulas": p.review, "links": p.links, "placeholders": p.placeholders, "images": p.images}

    return map_rows(pages, ["page_id", "url", "html"], make, PAGE)


def navigation(pages: DataFrame) -> DataFrame:
    """Sub-pages of each page: page_id, structure, ord, level, title, url, parent_url. Pages without any give no row."""

    def make(page_id, url, html):
        found = nav.collect(parse(html or ""), url or "")
        for i, e in enumerate(found.entries):
            yield {"page_id": page_id, "structure": found.structure, "ord": i, "level": e.level, "title": e.title, "url": e.url, "parent_url": e.parent}

    return flat_map(pages, ["page_id", "url", "html"], make, "page_id long, structure string, ord int, level int, title string, url string, parent_url string")


def navigation_notes(pages: DataFrame) -> DataFrame:
    def make(page_id, url, html):
        found = nav.collect(parse(html or ""), url or "")
        return {"page_id": page_id, "structure": found.structure, "entries": len(found.entries), "notes": found.notes}

    return map_rows(pages, ["page_id", "url", "html"], make, "page_id long, structure string, entries int, notes array<string>")


def in_scope(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """``entries`` with accepted: the page's scheme and host, its scope prefix, and two levels at most."""
    own = pages.select("page_id", F.col("url").alias("page_url"))
    prefix = C.scope_prefix(C.url_path(F.col("page_url")))
    ok = (C.url_scheme(F.col("url")) == C.url_scheme(F.col("page_url"))) & (C.url_host(F.col("url")) == C.url_host(F.col("page_url"))) & C.url_path(F.col("url")).startswith(prefix) & (F.col("level") <= 2)
    return entries.join(own, "page_id").withColumn("accepted", ok).drop("page_url")


def merged_navigation(static: DataFrame, rendered: DataFrame, trusted: DataFrame) -> DataFrame:
    """Static entries win; rendered ones stand in where there are none and the snapshot's identity was verified.

    ``trusted`` is (page_id, reason) with an empty reason for verified snapshots.
    """
    have = static.select("page_id").distinct()
    ok = trusted.where("reason = ''").select("page_id")
    extra = rendered.join(have, "page_id", "left_anti").join(ok, "page_id", "left_semi")
    return static.withColumn("source", F.lit("static")).unionByName(extra.withColumn("source", F.lit("rendered")))


def snapshot_reasons(snapshots: DataFrame) -> DataFrame:
    """(page_id, reason) of rendered snapshots (page_id, url, html, declared_url)."""

    def make(page_id, url, html, declared):
        return {"page_id": page_id, "reason": nav.snapshot_identity(parse(html or ""), url or "", declared)}

    return map_rows(snapshots, ["page_id", "url", "html", "declared_url"], make, "page_id long, reason string")


def image_names(found: DataFrame) -> DataFrame:
    """page_id, ord, src, name: local names of a page's images; equal names get _1, _2 in order. Data URIs are skipped."""
    rows = found.select("page_id", "url", F.posexplode("images").alias("ord", "src")).where(~F.col("src").startswith("data:"))
    stem = F.regexp_extract(C.url_path(F.col("src")), r"([^/]*?)(?:\.[^./]*)?$", 1)
    name = F.concat(C.file_name(stem, 60), F.lit("\u0000"), C.image_extension(F.col("src"), F.lit("")))
    rows = rows.withColumn("name", name)
    n = F.row_number().over(Window.partitionBy("page_id", "name").orderBy("ord")) - 1
    tail = F.when(n > 0, F.concat(F.lit("_"), n.cast("string"))).otherwise(F.lit(""))
    return rows.select("page_id", "ord", "src", F.replace("name", F.lit("\u0000"), tail).alias("name"))


def output_names(pages: DataFrame, title: str = "title", longest: int = 80) -> DataFrame:
    """page_id, name: file names of titles; where several pages share one, all but the first get a hash of their URL.

    The first is the one whose canonical URL is smallest, so the outcome doesn't depend on arrival.
    """
    rows = pages.select("page_id", C.file_name(F.col(title), longest).alias("base"), C.canonical_url(F.col("url")).alias("canonical"), F.col(title).alias("t"))
    # The least of each name is aggregated before it is dealt out, so that a name of very many pages is one row of a task.
    least = rows.groupBy("base").agg(F.min(F.struct("canonical", "page_id")).alias("least"))
    suffix = F.concat(F.lit("-"), F.substring(C.sha256(F.col("canonical")), 1, 8))
    named = rows.join(least, "base").withColumn("first", F.struct("canonical", "page_id") == F.col("least"))
    # The cut names of the others are made by a generator: with the join's expressions they exceed what one generated method may hold.
    cut = named.select("page_id", "first", "base", F.inline(F.array(F.struct(F.concat(C.file_name(F.col("t"), longest - 9), suffix).alias("cut")))))
    return cut.select("page_id", F.when(F.col("first"), F.col("base")).otherwise(F.col("cut")).alias("name"))


def formula_passes(rows: DataFrame) -> DataFrame:
    """(id, html) → text after the known carriers and the bare delimiters were converted, with the counts of both."""

    def make(i, html):
        root = parse(html or "")
        n = math.replace_formulas(root)
        c = math.convert_bare_tex(root)
        return {"id": i, "text": root.get_text(), "carriers": n, "inline_formulas": c.inline, "display_formulas": c.display, "review": c.review}

    return map_rows(rows, ["id", "html"], make, "id int, text string, carriers int, inline_formulas int, display_formulas int, review int")


def mathml(rows: DataFrame) -> DataFrame:
    def make(i, xml):
        node = parse(xml or "").find("math")
        return {"id": i, "latex": math.mathml(node) if node else ""}

    return map_rows(rows, ["id", "xml"], make, "id int, latex string")


def title_by_pattern(html: Column) -> Column:
    """The first h1's text by pattern alone, tags removed: no parsing, runs in the JVM."""
    return F.regexp_replace(F.regexp_extract(html, r"(?s)<h1[^>]*>(.*?)</h1>", 1), r"<[^>]*>", "")
