"""Queries over pages: titles, addresses, names, navigation, Markdown."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import pages, state, wiki
from ..sources import sinks
from ..sources.shared import shared_folder
from ..streaming import incremental
from . import scanner_sql as S
from .catalog import query, table

_TITLE = "regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')"
_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_QUERY = "regexp_extract(url, '^[^?#]*\\?([^#]*)', 1)"
_CANONICAL = f"regexp_extract(url, '^[a-z]+', 0) || '://' || {_HOST} || {_PATH} || CASE WHEN {_QUERY} <> '' THEN '?' || {_QUERY} ELSE '' END"


@query(f"SELECT page_id, {_TITLE} AS title FROM pages")
def page_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", pages.title_by_pattern(F.col("html")).alias("title"))


@query(f"SELECT page_id, {_CANONICAL} AS canonical, {_HOST} AS host, regexp_replace(regexp_replace(regexp_replace({_PATH}, '/+$', ''), '(/index\\.html|/index|\\.html)$', ''), '/+$', '') AS path, {_QUERY} AS query, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', ''), '(/index\\.html|/index|\\.html)$', ''), '/+$', '') AS nav FROM pages")
def page_url_identity(spark, sf_dir):
    u = F.col("url")
    i = C.page_identity(u)
    return table(spark, sf_dir, "pages").select("page_id", C.canonical_url(u).alias("canonical"), i["host"].alias("host"), i["path"].alias("path"), i["query"].alias("query"), C.nav_url(u).alias("nav"))


@query(f"WITH p AS (SELECT page_id, path, list_filter(string_split(path, '/'), lambda x: x <> '') AS s FROM (SELECT page_id, {_PATH} AS path FROM pages)), v AS (SELECT *, list_max(list_transform(range(1, len(s) + 1), lambda i: CASE WHEN regexp_full_match(s[i], '(?i)(v?\\d+([._-]\\d+)*([-_]?(alpha|beta|rc)\\d*)?|latest|stable|current|main|master|dev|nightly)') THEN i END)) AS k FROM p) SELECT page_id, '/' || list_aggregate(list_transform(s[1:coalesce(k, CASE WHEN ends_with(path, '/') OR (len(s) = 1 AND NOT contains(s[1], '.') AND lower(s[1]) <> 'index') THEN len(s) ELSE greatest(len(s) - 1, 0) END)], lambda x: x || '/'), 'string_agg', '') AS prefix FROM v")
def page_scope_prefix(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", C.scope_prefix(C.url_path(F.col("url"))).alias("prefix"))


_NAV = "SELECT page_id, generate_subscripts(h, 1) AS ord, unnest(h) AS href, unnest(t) AS title FROM (SELECT page_id, regexp_extract_all(n, '<a href=\"([^\"]*)\">([^<]*)</a>', 1) AS h, regexp_extract_all(n, '<a href=\"([^\"]*)\">([^<]*)</a>', 2) AS t FROM (SELECT page_id, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS n FROM pages))"


_NAV_KEY = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', ''), '(/index\\.html|/index|\\.html)$', ''), '/+$', '')"


def _nav_links(spark, sf_dir):
    nav = F.regexp_extract("html", "(?s)<nav>(.*?)</nav>", 1)
    pattern = F.lit('<a href="([^"]*)">([^<]*)</a>')
    both = F.arrays_zip(F.regexp_extract_all(nav, pattern, F.lit(1)).alias("href"), F.regexp_extract_all(nav, pattern, F.lit(2)).alias("title"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(both).alias("i", "x"))
    return rows.select("page_id", (F.col("i") + 1).alias("ord"), F.col("x.href").alias("href"), F.col("x.title").alias("title"))


@query(f"SELECT page_id, CAST(ord AS INTEGER) AS ord, href, title FROM ({_NAV})")
def page_nav_links(spark, sf_dir):
    return _nav_links(spark, sf_dir)


@query(f"SELECT page_id, href, arg_min(title, ord) AS title FROM (SELECT page_id, ord, lower(href) AS href, title FROM ({_NAV})) GROUP BY page_id, href")
def first_link_wins(spark, sf_dir):
    rows = _nav_links(spark, sf_dir).withColumn("href", F.lower("href"))
    n = F.row_number().over(Window.partitionBy("page_id", "href").orderBy("ord"))
    return rows.withColumn("n", n).where("n = 1").select("page_id", "href", "title")


@query(f"WITH p AS (SELECT page_id, {_HOST} AS host, {_CANONICAL} AS c FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY c, page_id) AS n FROM p) SELECT page_id, CASE WHEN n = 1 THEN host ELSE host || '-' || substr(sha256(c), 1, 8) END AS name FROM r")
def page_output_name(spark, sf_dir):
    return pages.output_names(table(spark, sf_dir, "pages").withColumn("host", C.url_host(F.col("url"))), "host")


@query(S.PAGE_MARKDOWN)
def page_markdown(spark, sf_dir):
    return pages.markdown(table(spark, sf_dir, "pages")).withColumn("images", F.array_join("images", "\n"))


@query(S.page_markdown_stats(_HOST, _PATH))
def page_markdown_stats(spark, sf_dir):
    found = pages.markdown(table(spark, sf_dir, "pages"))
    rows = found.select(C.url_host(F.col("url")).alias("host"), F.regexp_extract(C.url_path(F.col("url")), "^/([a-z]{2})/", 1).alias("section"), F.length("markdown").alias("chars"), (F.col("title") == "untitled").cast("int").alias("untitled"), "formulas", "links")
    return rows.groupBy("host", "section").agg(F.count("*").alias("pages"), F.sum("chars").alias("chars"), F.sum("untitled").alias("untitled"), F.sum("formulas").alias("formulas"), F.sum("links").alias("links"))


@query(S.page_navigation(_NAV, _NAV_KEY))
def page_navigation(spark, sf_dir):
    return pages.navigation_notes(table(spark, sf_dir, "pages")).select("page_id", "structure", "entries")


@query(S.page_files(_CANONICAL))
def page_files(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    found = pages.markdown(p)
    return sinks.page_files(found.join(pages.output_names(found), "page_id")).select("path", C.sha256(F.col("content")).alias("sha256"))


@query("SELECT page_id, CASE WHEN k >= 4 THEN '<ac:structured-macro ac:name=\"toc\" ac:schema-version=\"1\" data-layout=\"default\"/>' ELSE '' END || repeat('<h2>x</h2>', CAST(k AS INTEGER)) AS storage FROM (SELECT page_id, page_id % 7 AS k FROM pages)")
def toc_insert(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.repeat(F.lit("<h2>x</h2>"), (F.col("page_id") % 7).cast("int")).alias("html"))
    return p.select("page_id", wiki.with_toc(F.col("html")).alias("storage"))


@query("SELECT p.page_id, CASE WHEN p.page_id % 3 = 2 THEN 'gone' WHEN p.page_id % 3 = 1 THEN 'conflict' ELSE 'ok' END AS state, CASE WHEN p.page_id % 3 = 0 THEN 2 END AS next_version FROM pages p")
def stale_check(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("storage"))
    updates = p.select("page_id", F.lit(1).alias("version"), F.sha2(F.col("storage").cast("binary"), 256).alias("body_sha256"))
    current = p.where("page_id % 3 <> 2").select("page_id", F.lit(1).alias("version"), F.when(F.col("page_id") % 3 == 1, F.concat("storage", F.lit("!"))).otherwise(F.col("storage")).alias("storage"))
    return wiki.stale(updates, current).select("page_id", "state", "next_version")


@query(f"WITH p AS (SELECT {_HOST} AS host, page_id, strlen(html) AS bytes FROM pages), t AS (SELECT *, row_number() OVER (ORDER BY page_id DESC) AS k, count(*) OVER () AS n, sum(bytes) OVER () AS total FROM p) SELECT CAST(page_id AS VARCHAR) AS path FROM t WHERE (n > 20 OR total > 52428800) AND k > 20")
def retention(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.lpad(F.col("page_id").cast("string"), 12, "0").alias("ts"), F.octet_length("html").alias("bytes"))
    return state.to_delete(p).select("path")


@query(f"SELECT page_id, {_TITLE} AS title FROM pages")
def stream_page_titles(spark, sf_dir):
    """The same titles through a stream that reads whatever is new, once. The path is a pattern, so that it may be a file or a folder."""
    at = shared_folder(spark, "stream")
    source = incremental.stream(spark, f"{sf_dir}/pages.parque[t]", "page_id long, url string, html string")
    incremental.run(source, lambda p: p.select("page_id", pages.title_by_pattern(F.col("html")).alias("title")), f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.schema("page_id long, title string").parquet(f"{at}/out")
