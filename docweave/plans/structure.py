"""Queries on the structure of pages and texts: nesting, references, regions, runs, spans and trees, by built-in functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nesting
from ..functions.urljoin import url_join
from ..operators import prefix, regions, spans, trees
from ..sources import files
from .catalog import query, table

# --- pages ----------------------------------------------------------------------------------------------------------

_VOID = ", ".join(f"'{x}'" for x in nesting.VOID)
_TAGS = rf"""
    c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>', '', 'g'), '(?is)<script(\s[^>]*)?>.*?</script>', '<script></script>', 'g'), '(?is)<style(\s[^>]*)?>.*?</style>', '<style></style>', 'g') AS h FROM pages),
    t AS (SELECT page_id, unnest(m) AS v, generate_subscripts(m, 1) AS i FROM (SELECT page_id, regexp_extract_all(coalesce(h, ''), '</?[a-zA-Z][a-zA-Z0-9:_-]*(?:\s[^>]*)?/?>') AS m FROM c)),
    n AS (SELECT page_id, i, v, lower(regexp_extract(v, '^</?([a-zA-Z][^\s/>]*)', 1)) AS name, CASE WHEN starts_with(v, '</') THEN -1 ELSE 1 END AS step FROM t),
    k AS (SELECT page_id, name, step, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS i FROM n WHERE step = -1 OR NOT (ends_with(v, '/>') OR name IN ({_VOID}))),
    l AS (SELECT *, sum(step) OVER (PARTITION BY page_id ORDER BY i) + CASE WHEN step < 0 THEN 1 ELSE 0 END AS level FROM k),
    p AS (SELECT *, lag(step) OVER w AS before_step, lag(name) OVER w AS before_name, lead(i) OVER w AS later FROM l WINDOW w AS (PARTITION BY page_id, level ORDER BY i)),
    f AS (SELECT page_id, min(i) FILTER (WHERE step < 0 AND NOT coalesce(before_step = 1 AND before_name = name, false)) AS first, count(*) AS tags FROM p GROUP BY page_id)
"""


@query(rf"""
    WITH {_TAGS},
    o AS (SELECT p.page_id, array_to_string(list(name ORDER BY level)[-5:], ', ') AS names FROM p JOIN f USING (page_id) WHERE first IS NULL AND step = 1 AND later IS NULL GROUP BY p.page_id),
    d AS (SELECT p.page_id, max(level) FILTER (WHERE first IS NULL OR i < first) AS deepest, max(name) FILTER (WHERE i = first) AS surplus FROM p JOIN f USING (page_id) GROUP BY p.page_id)
    SELECT g.page_id, CASE WHEN first IS NOT NULL THEN 'surplus' WHEN o.names IS NOT NULL THEN 'unclosed' ELSE '' END AS problem, coalesce(surplus, o.names, '') AS names, CAST(first AS INTEGER) AS nth, CAST(coalesce(tags, 0) AS INTEGER) AS tags, CAST(coalesce(deepest, 0) AS INTEGER) AS deepest
    FROM pages g LEFT JOIN f ON f.page_id = g.page_id LEFT JOIN d ON d.page_id = g.page_id LEFT JOIN o ON o.page_id = g.page_id
""")
def page_tag_balance(spark, sf_dir):
    n = nesting.nesting(F.col("html"), ("script", "style"), True)
    found = table(spark, sf_dir, "pages").select("page_id", n.alias("n"))
    open_ = F.array_join("n.unclosed", ", ")
    problem = F.when(F.col("n.first").isNotNull(), "surplus").when(open_ != "", "unclosed").otherwise("")
    return found.select("page_id", problem.alias("problem"), F.coalesce("n.surplus", open_).alias("names"), F.col("n.first").alias("nth"), "n.tags", "n.deepest")


@query(rf"""
    WITH {_TAGS}
    SELECT p.page_id, name, CAST(count(*) AS BIGINT) AS elements, CAST(max(level) AS INTEGER) AS deepest FROM p JOIN f USING (page_id)
    WHERE step = -1 AND (first IS NULL OR i < first) GROUP BY p.page_id, name
""")
def page_elements(spark, sf_dir):
    n = nesting.nesting(F.col("html"), ("script", "style"), True)
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(n["elements"]).alias("e"))
    return rows.groupBy("page_id", F.col("e.name").alias("name")).agg(F.count("*").alias("elements"), F.max("e.depth").alias("deepest"))


_ORIGIN = "regexp_extract(url, '^([A-Za-z]+)://', 1) || '://' || regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)"
_UP = "regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[^/]*$', ''), '[^/]+/$', '')"


@query(rf"""
    WITH l AS (SELECT page_id, url, unnest(h) AS href, generate_subscripts(h, 1) AS ord FROM (SELECT page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages)),
    u AS (SELECT page_id, url, CAST(ord AS INTEGER) AS ord, replace(href, '&amp;', '&') AS href FROM l)
    SELECT page_id, ord, href, {_ORIGIN} || href AS absolute, {_ORIGIN} || CASE WHEN {_UP} = '' THEN '/' ELSE {_UP} END || href[2:] AS beside FROM u
""")
def page_links_absolute(spark, sf_dir):
    """Every link of a page seen from its address; ``beside`` is the same name looked for one folder up."""
    hrefs = F.transform(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)), lambda h: F.replace(h, F.lit("&amp;"), F.lit("&")))
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(hrefs).alias("i", "href"))
    above = F.concat(F.lit("../"), F.substr("href", F.lit(2)))
    return rows.select("page_id", (F.col("i") + 1).alias("ord"), "href", url_join(F.col("url"), F.col("href")).alias("absolute"), url_join(F.col("url"), above).alias("beside"))


_PLAIN = "NOT regexp_matches(html, '[^\\x00-\\x7F]')"


@query(f"""
    WITH p AS (SELECT page_id, page_id % 5 AS k, CASE WHEN page_id % 5 = 4 THEN regexp_replace(html, '[^\\x00-\\x{{FF}}]', '?', 'g') ELSE html END AS html FROM pages)
    SELECT page_id, CASE WHEN k = 0 THEN 'utf-8' WHEN k = 2 THEN 'utf-16le' WHEN k = 3 THEN 'utf-16be' WHEN {_PLAIN} THEN 'us-ascii' WHEN k = 1 THEN 'utf-8' ELSE 'windows-1252' END AS encoding,
        CASE WHEN k IN (0, 2) THEN 'mark' WHEN k = 3 THEN 'zeros' WHEN k = 1 OR {_PLAIN} THEN 'bytes' ELSE 'rest' END AS reason, sha256(html) AS sha256 FROM p
""")
def page_encodings(spark, sf_dir):
    """Pages as bytes in five encodings, two of them without a mark, most with a declaration that is wrong; read back as texts."""
    k, html = F.pmod("page_id", F.lit(5)), F.col("html")
    latin = F.encode(F.regexp_replace(html, r"[^\x00-\xFF]", "?"), "ISO-8859-1")
    made = (
        F.when(k == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(html, "UTF-8")))
        .when(k == 1, F.encode(html, "UTF-8"))
        .when(k == 2, F.concat(F.unhex(F.lit("FFFE")), F.encode(html, "UTF-16LE")))
        .when(k == 3, F.encode(html, "UTF-16BE"))
        .otherwise(latin)
    )
    found = files.decoded_pages(table(spark, sf_dir, "pages").select("page_id", made.alias("content")))
    return found.select("page_id", "encoding", "reason", F.sha2(F.col("html").cast("binary"), 256).alias("sha256"))


# --- regions --------------------------------------------------------------------------------------------------------

_MARKED = [("&&&", "`"), ("%%%", "``"), ("###", "\n```\n"), ("***", "\\$"), (" the ", " `the` "), (" de ", " $d"), (" und ", " `` ")]


def _marked(text):
    """The documents' runs of signs and some of their words turned into code and formula delimiters."""
    for sign, mark in _MARKED:
        text = F.replace(text, F.lit(sign), F.lit(mark))
    return text


def _marked_sql(text: str) -> str:
    for sign, mark in _MARKED:
        text = f"replace({text}, '{sign}', '{mark.replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39))}')"
    return text


# The tables' texts have no line ends but line feeds. Delimiters are taken line by line, then states run over them row by row.
_DELIMITERS = rf"""
    m AS (SELECT doc_id, {_marked_sql("text")} AS t FROM documents WHERE text IS NOT NULL),
    y AS (SELECT doc_id, unnest(y) AS line, generate_subscripts(y, 1) AS n, len(y) AS total FROM (SELECT doc_id, string_split(t, chr(10)) AS y FROM m)),
    z AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n) - length(line) - 1 AS pos, regexp_full_match(line, '[ \t>]*(`{{3,}}[^`]*|~{{3,}}.*)') AS fence FROM y),
    e AS (SELECT doc_id, pos, generate_subscripts(g, 1) AS j, unnest(g) AS gap, unnest(v) AS v FROM (SELECT doc_id, pos, regexp_split_to_array(line, '\\*`+|\\*\$') AS g, regexp_extract_all(line, '\\*`+|\\*\$') AS v FROM z WHERE NOT fence)),
    s AS (SELECT *, pos + sum(length(gap) + coalesce(length(v), 0)) OVER (PARTITION BY doc_id, pos ORDER BY j) AS stop FROM e),
    d AS (
        SELECT doc_id, pos AS start, pos + length(line) + CASE WHEN n < total THEN 1 ELSE 0 END AS stop, 'fence' AS kind, length(regexp_extract(line, '`{{3,}}|~{{3,}}')) AS size, regexp_extract(line, '`|~') AS sign, regexp_full_match(line, '[ \t>]*(`+|~+)[ \t]*') AS bare FROM z WHERE fence
        UNION ALL
        SELECT doc_id, stop - length(ltrim(v, '\')), stop, CASE WHEN ends_with(v, '$') THEN 'dollar' ELSE 'run' END, length(ltrim(v, '\')), '', false FROM s WHERE v IS NOT NULL AND (length(v) - length(ltrim(v, '\'))) % 2 = 0
    ),
    q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS i FROM d),
    a AS (
        SELECT doc_id, CAST(0 AS BIGINT) AS i, '' AS sign, 0 AS size, 0 AS gap, '' AS did FROM m
        UNION ALL
        SELECT q.doc_id, q.i, CASE WHEN q.kind = 'fence' AND a.size = 0 THEN q.sign ELSE a.sign END,
            CAST(CASE WHEN q.kind <> 'fence' THEN a.size WHEN a.size = 0 THEN q.size WHEN q.sign = a.sign AND q.size >= a.size AND q.bare THEN 0 ELSE a.size END AS INTEGER),
            a.gap + CASE WHEN q.kind = 'fence' AND a.size = 0 THEN 1 ELSE 0 END,
            CASE WHEN q.kind <> 'fence' THEN CASE WHEN a.size = 0 THEN 'free' ELSE '' END WHEN a.size = 0 THEN 'open' WHEN q.sign = a.sign AND q.size >= a.size AND q.bare THEN 'close' ELSE '' END
        FROM a JOIN q ON q.doc_id = a.doc_id AND q.i = a.i + 1
    ),
    b AS (SELECT q.*, a.gap, a.did FROM q JOIN a ON a.doc_id = q.doc_id AND a.i = q.i),
    r AS (
        SELECT doc_id, start, stop, kind, size, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS i,
            CASE kind WHEN 'run' THEN lead(start) OVER (PARTITION BY doc_id, kind, gap, size ORDER BY start) IS NOT NULL ELSE coalesce(lead(start) OVER (PARTITION BY doc_id, kind ORDER BY start) = stop, false) END AS flag
        FROM b WHERE did = 'free'
    ),
    x AS (
        SELECT doc_id, CAST(0 AS BIGINT) AS i, 0 AS code, 0 AS f, 0 AS code_before, 0 AS f_before FROM m
        UNION ALL
        SELECT r.doc_id, r.i, CAST(CASE WHEN r.kind = 'run' THEN CASE WHEN x.code = 0 AND r.flag THEN r.size WHEN x.code = r.size THEN 0 ELSE x.code END ELSE x.code END AS INTEGER),
            CASE WHEN r.kind = 'run' OR x.code > 0 THEN x.f WHEN x.f = 0 THEN CASE WHEN r.flag THEN 4 ELSE 1 END WHEN x.f = 2 THEN CASE WHEN r.flag THEN 3 ELSE 2 END WHEN x.f = 4 THEN 2 ELSE 0 END, x.code, x.f
        FROM x JOIN r ON r.doc_id = x.doc_id AND r.i = x.i + 1
    ),
    w AS (SELECT r.*, x.code, x.f, x.code_before, x.f_before FROM r JOIN x ON x.doc_id = r.doc_id AND x.i = r.i)
"""


@query(rf"""
    WITH RECURSIVE {_DELIMITERS},
    o AS (SELECT doc_id, did, start, stop, row_number() OVER (PARTITION BY doc_id, did ORDER BY start) AS n FROM b WHERE did IN ('open', 'close')),
    c AS (SELECT doc_id, code > 0 AS opens, start, stop, row_number() OVER (PARTITION BY doc_id, code > 0 ORDER BY start) AS n FROM w WHERE code <> code_before)
    SELECT o.doc_id, 'fence' AS kind, CAST(o.start AS INTEGER) AS start, CAST(coalesce(e.stop, length(t)) AS INTEGER) AS "end", e.stop IS NOT NULL AS closed FROM o JOIN m ON m.doc_id = o.doc_id LEFT JOIN o e ON e.doc_id = o.doc_id AND e.n = o.n AND e.did = 'close' WHERE o.did = 'open'
    UNION ALL SELECT c.doc_id, 'inline', CAST(c.start AS INTEGER), CAST(e.stop AS INTEGER), true FROM c JOIN c e ON e.doc_id = c.doc_id AND e.n = c.n AND NOT e.opens WHERE c.opens
""")
def doc_code_regions(spark, sf_dir):
    return regions.code_regions(table(spark, sf_dir, "documents").select("doc_id", _marked(F.col("text")).alias("text")))


@query(rf"""
    WITH RECURSIVE {_DELIMITERS},
    o AS (SELECT doc_id, f_before = 0 AS opens, f = 4 AS display, start, stop, row_number() OVER (PARTITION BY doc_id, f_before = 0 ORDER BY start) AS n FROM w WHERE f <> f_before AND f_before IN (0, 1, 2)),
    p AS (SELECT o.doc_id, o.start, e.stop + CASE WHEN o.display THEN 1 ELSE 0 END AS stop, o.display FROM o LEFT JOIN o e ON e.doc_id = o.doc_id AND e.n = o.n AND NOT e.opens WHERE o.opens)
    SELECT p.doc_id, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS "end", display, substr(t, CAST(start + 1 + CASE WHEN display THEN 2 ELSE 1 END AS BIGINT), CAST(stop - start - 2 * CASE WHEN display THEN 2 ELSE 1 END AS BIGINT)) AS latex FROM p JOIN m ON m.doc_id = p.doc_id
""")
def doc_formula_regions(spark, sf_dir):
    return regions.formula_regions(table(spark, sf_dir, "documents").select("doc_id", _marked(F.col("text")).alias("text")))


# --- runs over the whole corpus as one text -------------------------------------------------------------------------

_LIMIT = 6000
_LINES = "SELECT doc_id, unnest(y) AS content, generate_subscripts(y, 1) AS number FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS y FROM documents)"


def _corpus_lines(spark, sf_dir):
    """All lines of all documents as one sequence, by document and line; a document is below 2^32 lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("i", "content"))
    place = F.shiftleft(F.col("doc_id"), 32) + F.col("i")
    return rows.select(F.lit(0).alias("corpus"), place.alias("place"), "doc_id", (F.col("i") + 1).alias("number"), F.length("content").alias("chars"), F.col("content").rlike("^[A-Z][^ ]*[.!?]$").alias("heading"), F.regexp_count("content", F.lit(r"\$\$")).alias("marks"))


_WIDE = 1 << 38  # 64 documents a chunk


@query(f"""
    WITH RECURSIVE l AS (SELECT row_number() OVER (ORDER BY doc_id, number) AS i, doc_id, length(content) AS chars FROM ({_LINES})),
    s AS (SELECT *, sum(chars) OVER (ORDER BY i) AS stop FROM l),
    n AS MATERIALIZED (SELECT a.i, min(b.i) AS after FROM s a JOIN s b ON b.i > a.i AND b.stop > a.stop - a.chars + {_LIMIT} GROUP BY a.i),
    b AS (SELECT CAST(1 AS BIGINT) AS first, 1 AS block UNION ALL SELECT n.after, block + 1 FROM b JOIN n ON n.i = b.first),
    r AS (SELECT block, first, coalesce(lead(first) OVER (ORDER BY block), 9223372036854775807) AS stop FROM b)
    SELECT CAST(r.block AS INTEGER) AS block, CAST(count(*) AS BIGINT) AS lines, CAST(sum(chars) AS BIGINT) AS chars, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM r JOIN s ON s.i >= r.first AND s.i < r.stop GROUP BY r.block
""")
def corpus_blocks(spark, sf_dir):
    """The corpus as one text in blocks of 6000 characters at most, by the serial rule, without a serial task."""
    placed = prefix.packed(_corpus_lines(spark, sf_dir).select("corpus", "place", "doc_id", "chars"), ["corpus"], "place", _LIMIT, "chars", width=_WIDE)
    return placed.groupBy("block").agg(F.count("*").alias("lines"), F.sum("chars").cast("long").alias("chars"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


@query(f"""
    WITH l AS (SELECT row_number() OVER (ORDER BY doc_id, number) AS i, doc_id, number, regexp_matches(content, '^[A-Z][^ ]*[.!?]$') AS heading, len(regexp_extract_all(content, '\\$\\$')) AS marks FROM ({_LINES})),
    s AS (SELECT *, CAST(sum(CASE WHEN heading THEN 1 ELSE 0 END) OVER w AS BIGINT) AS section, max(CASE WHEN heading THEN i END) OVER w AS owner, sum(marks) OVER w - marks AS before FROM l WINDOW w AS (ORDER BY i))
    SELECT s.doc_id, CAST(s.number AS INTEGER) AS number, s.section, o.doc_id AS owner_doc, s.before % 2 = 1 AS inside FROM s LEFT JOIN s o ON o.i = s.owner
""")
def corpus_sections(spark, sf_dir):
    """Sections, their heading's document, and formula parity that run through the whole corpus, each line with its state."""
    rows = _corpus_lines(spark, sf_dir).select("corpus", "place", "doc_id", "number", "heading", "marks")
    rows = prefix.running_sum(rows, ["corpus"], "place", F.col("heading").cast("long"), "section", _WIDE)
    rows = prefix.running_last(rows, ["corpus"], "place", F.when(F.col("heading"), F.col("doc_id")), "owner_doc", _WIDE)
    rows = prefix.automaton(rows, ["corpus"], "place", F.col("marks") % 2, [[0, 1], [1, 0]], width=_WIDE >> 4)
    return rows.select("doc_id", "number", "section", "owner_doc", (F.col("state") == 1).alias("inside"))


# --- spans ----------------------------------------------------------------------------------------------------------

_WORDS = "SELECT doc_id, unnest(y) AS w, generate_subscripts(y, 1) - 1 AS i FROM (SELECT doc_id, string_split(replace(coalesce(text, ''), chr(10), ' '), ' ') AS y FROM documents)"


def _words(spark, sf_dir):
    """doc_id and the words of each document as an array; what is needed of them is taken out before it becomes rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.split(F.translate(F.coalesce("text", F.lit("")), "\n", " "), " ", -1).alias("w"))


def _places(pattern):
    """(i, w) of the words that match."""
    found = F.transform("w", lambda w, i: F.when(w.rlike(pattern), F.struct(i.alias("i"), w.alias("w"))))
    return F.filter(found, lambda x: x.isNotNull())


@query(f"""
    WITH w AS ({_WORDS}), u AS (SELECT *, coalesce(sum(CASE WHEN regexp_matches(w, '[.!?]$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM w),
    o AS (SELECT doc_id, min(i) AS s, max(i) + 1 AS e FROM u GROUP BY doc_id, k),
    q AS (SELECT doc_id, i AS s, i + length(w) AS e FROM w WHERE regexp_matches(w, '^[A-Z]')),
    r AS (SELECT q.doc_id, q.s, q.e, EXISTS (SELECT 1 FROM o WHERE o.doc_id = q.doc_id AND o.s <= q.s AND q.e <= o.e) AS inside, EXISTS (SELECT 1 FROM q z WHERE z.doc_id = q.doc_id AND z.s <> q.s AND z.s < q.e AND q.s < z.e) AS "overlaps" FROM q)
    SELECT doc_id, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end", inside, "overlaps" FROM r
""")
def doc_span_containment(spark, sf_dir):
    """Spans that begin at a capital word and reach over as many words as it has letters, against sentences and each other."""
    w = _words(spark, sf_dir)
    stops = F.transform(_places("[.!?]$"), lambda x: x["i"] + 1)
    bounds = F.array_distinct(F.concat(F.array(F.lit(0)), stops, F.array(F.size("w"))))
    sentences = w.select("doc_id", bounds.alias("b")).select("doc_id", F.explode(F.arrays_zip(F.slice("b", F.lit(1), F.size("b") - 1).alias("start"), F.slice("b", F.lit(2), F.size("b") - 1).alias("end"))).alias("x")).select("doc_id", "x.*")
    own = w.select("doc_id", F.explode(_places("^[A-Z]")).alias("x")).select("doc_id", F.col("x.i").alias("start"), (F.col("x.i") + F.length("x.w")).alias("end"))
    return spans.overlapping(spans.contained(own, sentences, "doc_id"), "doc_id")


@query(f"""
    WITH w AS ({_WORDS}), p AS (SELECT doc_id, w AS name, min(i) AS a, max(i) AS b FROM w WHERE regexp_matches(w, '^[A-Z]') GROUP BY doc_id, w HAVING min(i) < max(i)),
    x AS (SELECT p.doc_id, p.name, z.name AS other, p.b AS "at", z.a AS c FROM p JOIN p z ON z.doc_id = p.doc_id AND p.a < z.a AND z.a < p.b AND p.b < z.b)
    SELECT doc_id, arg_min(name, ("at", -c)) AS name, arg_min(other, ("at", -c)) AS other, CAST(min("at") AS INTEGER) AS "at" FROM x GROUP BY doc_id
""")
def doc_first_crossing(spark, sf_dir):
    """Each capital word that occurs twice in a document spans from its first to its last place; where such spans cross first."""
    rows = _words(spark, sf_dir).select("doc_id", F.explode(_places("^[A-Z]")).alias("x"))
    pairs = rows.groupBy("doc_id", F.col("x.w").alias("name")).agg(F.min("x.i").alias("open"), F.max("x.i").alias("close"))
    return spans.first_crossing(pairs, "doc_id", "name")


# --- trees ----------------------------------------------------------------------------------------------------------


def _tree(spark, sf_dir, parent):
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id")).where("node_id is not null")
    return ids.select("node_id", F.when(F.col("node_id") > 0, F.expr(parent)).alias("parent_node_id"), F.col("node_id").alias("ord"))


def _tree_sql(parent: str) -> str:
    return f"""
        n AS (SELECT DISTINCT doc_id AS id, CASE WHEN doc_id > 0 THEN {parent} END AS up FROM documents WHERE doc_id IS NOT NULL),
        v AS (SELECT n.id, m.id AS up, row_number() OVER (PARTITION BY m.id ORDER BY n.id) AS k FROM n LEFT JOIN n m ON m.id = n.up),
        r AS (SELECT id, [id] AS path, CAST(k AS VARCHAR) AS number FROM v WHERE up IS NULL UNION ALL SELECT v.id, list_append(r.path, v.id), r.number || '.' || v.k FROM v JOIN r ON v.up = r.id)
    """


@query(f"""
    WITH RECURSIVE {_tree_sql("doc_id * 15 // 16")},
    z AS (SELECT a AS id, count(*) AS size FROM (SELECT unnest(path) AS a FROM r) GROUP BY a),
    o AS (SELECT r.id, len(path) - 1 AS depth, row_number() OVER (ORDER BY path) - 1 AS pre, size FROM r JOIN z ON z.id = r.id)
    SELECT id AS node_id, CAST(depth AS BIGINT) AS depth, CAST(pre AS BIGINT) AS pre, CAST(pre + size - 1 - depth AS BIGINT) AS post, CAST(size AS BIGINT) AS size FROM o
""")
def doc_tree_order(spark, sf_dir):
    """Documents as a deep tree, each below the one at fifteen sixteenths of its id: depth, pre- and post-order, subtree size."""
    return trees.ordered(_tree(spark, sf_dir, "node_id * 15 div 16"))


@query(f"WITH RECURSIVE {_tree_sql('(doc_id - 1) // 4')} SELECT id AS node_id, number FROM r")
def doc_tree_numbers(spark, sf_dir):
    """Documents as a tree of four children each, with numbers such as 1.2.3."""
    return trees.numbers(_tree(spark, sf_dir, "(node_id - 1) div 4"))
