"""DuckDB statements for the scanners' queries, written from the rules and sharing no code with the scanners.

SQL has no parser, so each statement covers the syntax that the driver's tables hold. Where it sees other syntax that it knows of,
it gives a null or a row of no scanner, so that the row shows as a difference. Two details were settled by comparing with the
scanners' output: a page's Markdown ends without a line break, and file names guard reserved device names.
"""

from __future__ import annotations

# --- pages: an article of one heading and of paragraphs that may begin in bold -------------------------------------------

# What the statement doesn't cover: formulas, code, lists, tables, images, quotes, rules, headings below the first.
_OTHER = r"<(math|code|pre|ul|ol|dl|table|img|blockquote|hr|h[2-6]|i|em|strong|del|s|kbd|a|span|div|section)[ >]"


def _entities(text: str) -> str:
    """Entities of HTML as characters; a reference may lack its semicolon."""
    out = text
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        out = f"regexp_replace({out}, '&{name};?', '{char}', 'g')"
    return out


_PAGE_PARTS = rf"""a AS (
  SELECT page_id, url, html, regexp_extract(html, '(?s)<article><h1>(.*?)</h1>(.*?)</article>', ['h', 'b']) AS x FROM pages
), parts AS (
  SELECT page_id, generate_subscripts(p, 1) AS n, unnest(p) AS p FROM (SELECT page_id, string_split_regex(x.b, '</?p>') AS p FROM a)
), blocks AS (
  SELECT page_id, n, starts_with(p, '<b>') AS bold, trim(regexp_replace({_entities("regexp_replace(p, '^<b>|<br>$', '', 'g')")}, '[ \t\r\n]+', ' ', 'g'), ' ') AS p FROM parts
), bodies AS (
  SELECT page_id, string_agg(CASE WHEN bold THEN '**' || p || '**' ELSE p END, chr(10) || chr(10) ORDER BY n) AS body FROM blocks WHERE p <> '' GROUP BY page_id
), markdown AS (
  SELECT a.page_id, url, coalesce(nullif(trim(regexp_replace({_entities("x.h")}, '\s+', ' ', 'g'), ' '), ''), 'untitled') AS title,
    CASE WHEN NOT regexp_matches(x.b, '{_OTHER}') THEN regexp_replace(regexp_replace(regexp_replace(coalesce(body, ''), '([^\n])\$\$', '\1' || chr(10) || chr(10) || '$$', 'g'), '\$\$([^\n])', '$$' || chr(10) || chr(10) || '\1', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') END AS markdown,
    CASE WHEN NOT regexp_matches(html, '<math|math/tex|mwe-math|katex|MathJax|\\[(\[]') THEN 0 END AS formulas,
    len(list_filter(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1), lambda h: h <> '' AND NOT regexp_matches(h, '^(#|data:|javascript:|mailto:|tel:|[a-z]+://)'))) AS links,
    CASE WHEN NOT regexp_matches(x.b, '&lt;[A-Za-z]') THEN 0 END AS placeholders,
    array_to_string(regexp_extract_all(html, '<img[^>]* src="([^"]*)"', 1), chr(10)) AS images
  FROM a LEFT JOIN bodies USING (page_id)
)"""

PAGE_MARKDOWN = f"WITH {_PAGE_PARTS} SELECT page_id, url, title, markdown, formulas, formulas AS inline_formulas, formulas AS display_formulas, formulas AS review_formulas, CAST(links AS INTEGER) AS links, placeholders, images FROM markdown"


def page_markdown_stats(host: str, path: str) -> str:
    return f"""WITH {_PAGE_PARTS} SELECT {host} AS host, regexp_extract({path}, '^/([a-z]{{2}})/', 1) AS section, count(*) AS pages, CAST(sum(length(markdown)) AS BIGINT) AS chars, CAST(sum(CASE WHEN title = 'untitled' THEN 1 ELSE 0 END) AS BIGINT) AS untitled, CAST(sum(formulas) AS BIGINT) AS formulas, CAST(sum(links) AS BIGINT) AS links
    FROM markdown GROUP BY ALL"""


def _name(text: str, longest: int) -> str:
    """File names of titles."""
    plain = f"regexp_replace(trim(regexp_replace(translate({text}, '\\/:*?\"<>|', '---------'), '[ \\t\\r\\n\\f\\v]+', ' ', 'g'), ' '), '^\\.+|\\.+$', '', 'g')"
    cut = f"CASE WHEN length({plain}) > {longest} THEN regexp_replace(substr({plain}, 1, {longest}), '[ .]+$', '') ELSE {plain} END"
    name = f"coalesce(nullif({cut}, ''), 'untitled')"
    # Names that Windows reserves.
    device = f"regexp_matches(upper(regexp_replace(split_part({name}, '.', 1), '[ .]+$', '')), '^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$')"
    return f"CASE WHEN {device} THEN regexp_replace(substr('_' || {name}, 1, {longest}), '[ .]+$', '') ELSE {name} END"


def page_files(canonical: str) -> str:
    return f"""WITH {_PAGE_PARTS}, k AS (SELECT *, {_name("title", 80)} AS base, {canonical} AS c FROM markdown),
    f AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY base ORDER BY c, page_id) = 1 THEN base ELSE {_name("title", 71)} || '-' || substr(sha256(c), 1, 8) END AS name FROM k)
    SELECT name || '/' || name || '.md' AS path, sha256('# ' || title || chr(10) || chr(10) || '> Source: [' || url || '](' || url || ')' || chr(10) || chr(10) || markdown || chr(10)) AS sha256 FROM f"""


def page_navigation(links: str, nav: str) -> str:
    """Generic navigation is one flat list here: the current page, if linked at all, is a leaf of it and has no sub-pages."""
    return f"""WITH l AS ({links}), c AS (SELECT p.page_id, bool_or({nav.replace("url", "(regexp_extract(p.url, '^[a-zA-Z]+://[^/?#]*') || l.href)")} = {nav.replace("url", "p.url")}) AS here FROM pages p LEFT JOIN l ON l.page_id = p.page_id GROUP BY p.page_id)
    SELECT p.page_id, CASE WHEN regexp_matches(html, '(?i)sphinx|docutils|toctree|headerlink') THEN 'sphinx' WHEN regexp_matches(html, 'VPSidebar|class="item|level-') THEN 'vitepress' ELSE 'generic' END AS structure,
      CASE WHEN NOT coalesce(here, false) OR NOT regexp_matches(html, '(?s)<li>([^<]|<a [^>]*>|</a>)*<(ul|ol|div)') THEN 0 END AS entries
    FROM pages p JOIN c USING (page_id)"""


# --- documents: formulas between dollar signs, without code and escapes ---------------------------------------------------

# One formula a step, from the left: a mark of one or two signs and the next mark that is as long.
_FORMULAS = r"""docs AS (
  SELECT doc_id, text, CASE WHEN NOT regexp_matches(text, '[`\\]|~~~') THEN text END AS t FROM documents WHERE contains(text, '$')
), opened AS (
  SELECT doc_id, t, CAST(instr(t, '$') AS BIGINT) AS s, CASE WHEN substr(t, instr(t, '$'), 2) = '$$' THEN 2 ELSE 1 END AS w FROM docs
), walk AS (
  SELECT doc_id, t, s, w, CAST(instr(substr(t, s + w), repeat('$', w)) AS BIGINT) AS gap FROM opened
  UNION ALL
  SELECT doc_id, t, s, w, CAST(instr(substr(t, s + w), repeat('$', w)) AS BIGINT) AS gap FROM (
    SELECT doc_id, t, s, CASE WHEN substr(t, s, 2) = '$$' THEN 2 ELSE 1 END AS w FROM (
      SELECT doc_id, t, s + 2 * w + gap - 1 + instr(substr(t, s + 2 * w + gap - 1), '$') - 1 AS s FROM walk WHERE gap > 0 AND instr(substr(t, s + 2 * w + gap - 1), '$') > 0))
), formula AS (
  SELECT doc_id, CAST(s - 1 AS INTEGER) AS "start", CAST(CASE WHEN gap > 0 THEN s + 2 * w + gap - 2 END AS INTEGER) AS "end", CASE WHEN gap > 0 THEN substr(t, s + w, gap - 1) END AS latex, CASE WHEN gap > 0 THEN w = 2 END AS display,
    CAST(1 + length(substr(t, 1, s - 1)) - length(replace(substr(t, 1, s - 1), chr(10), '')) AS INTEGER) AS line FROM walk
)"""

DOC_FORMULAS = f"WITH RECURSIVE {_FORMULAS} SELECT * FROM formula"

# The rules on formulas and their marks; braces are counted, glyphs and tables that begin with a bar are looked for.
_ISSUES = rf"""{_FORMULAS}, lines AS (
  SELECT doc_id, CAST(generate_subscripts(l, 1) AS INTEGER) AS n, unnest(l) AS l, len(l) AS lines FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM docs)
), issue AS (
  SELECT doc_id, 'unpaired dollar' AS rule, line, '' AS detail FROM formula WHERE "end" IS NULL
  UNION ALL
  SELECT doc_id, 'unbalanced braces', line, '' FROM formula WHERE length(replace(latex, '{{', '')) <> length(replace(latex, '}}', ''))
  UNION ALL
  SELECT doc_id, 'display mark not alone', n, '' FROM lines WHERE contains(l, '$$') AND trim(l) <> '$$'
  UNION ALL
  SELECT doc_id, 'odd display marks', CAST(max(lines) AS INTEGER), '' FROM lines GROUP BY doc_id HAVING count(*) FILTER (trim(l) = '$$') % 2 = 1
  UNION ALL
  SELECT doc_id, 'permalink glyph', CAST(NULL AS INTEGER), '' FROM documents WHERE contains(text, chr(61633))
  UNION ALL
  SELECT doc_id, 'table', CAST(NULL AS INTEGER), '' FROM documents WHERE regexp_matches(text, '(?m)^[ \t]*\|')
  UNION ALL
  SELECT doc_id, 'placeholder or code', CAST(NULL AS INTEGER), '' FROM documents WHERE regexp_matches(text, '<[A-Za-z]|[`\\]|~~~')
)"""

DOC_ISSUES = f"WITH RECURSIVE {_ISSUES} SELECT doc_id, rule, 'FAIL' AS severity, line, detail FROM issue"
DOC_VERDICTS = f"""WITH RECURSIVE {_ISSUES}, n AS (SELECT doc_id, count(*) AS failures FROM issue GROUP BY doc_id)
  SELECT d.doc_id, coalesce(failures, 0) AS failures, CAST(0 AS BIGINT) AS reviews, CASE WHEN failures > 0 THEN 'fail' ELSE 'pass' END AS verdict FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN n USING (doc_id)"""

# Formats of known tokens; where a sign must not stand before one, the sign is matched along with it, as there is no look-behind.
_TOKENS = (
    ("openai", r"(?:^|[^A-Za-z0-9_-])(sk-(?:proj-)?[A-Za-z0-9_-]{20,})"),
    ("github", r"(?:^|[^A-Za-z0-9])(gh[pousr]_[A-Za-z0-9]{20,})"),
    ("aws", r"(AKIA[0-9A-Z]{16})"),
    ("jwt", r"(?:^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,})"),
    ("bearer", r"\b([Bb][Ee][Aa][Rr][Ee][Rr][ \t\n\v\f\r]+[A-Za-z0-9._~+/=-]{20,})"),
)
KNOWN_TOKENS = " UNION ALL ".join(f"SELECT doc_id, '{kind}' AS kind, unnest(regexp_extract_all(text, '{pattern}', 1)) AS value FROM documents" for kind, pattern in _TOKENS)

# Repairs of texts without escapes, code, lists and tables. Dollar marks as letters, D for two and S for one, show inline formulas:
# a pair of S outside D...D. Lines outside display formulas are joined until a blank line, a formula's line or a structure's.
_ISOLATED = r"regexp_replace(regexp_replace(regexp_replace(text, '([^\n])\$\$', '\1' || chr(10) || chr(10) || '$$', 'g'), '\$\$([^\n])', '$$' || chr(10) || chr(10) || '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"
DOC_REPAIRS = rf"""WITH plain AS (
  SELECT doc_id, text, CASE WHEN NOT regexp_matches(text, '[`\\\r]|~~~') THEN text END AS t,
    replace(replace(replace(regexp_replace(text, '[^$]+', '.', 'g'), '$$', 'D'), '$', 'S'), '.', '') AS marks FROM documents
), l AS (
  SELECT doc_id, generate_subscripts(x, 1) AS n, unnest(x) AS l, len(x) AS lines FROM (SELECT doc_id, string_split(t, chr(10)) AS x FROM plain)
), k AS (
  SELECT *, (length(l) - length(replace(l, '$$', ''))) // 2 AS m FROM l
), r AS (
  SELECT *, trim(l) = '' AS empty, m > 0 OR (sum(m) OVER (PARTITION BY doc_id ORDER BY n) - m) % 2 = 1 AS kept, regexp_matches(l, '^\s*(#|>|!\[|: |\||---$)') AS alone, regexp_matches(l, '^\s*([-*+]|[0-9]+[.)])\s|^  +\S') AS other FROM k
), f AS (
  SELECT *, kept OR empty OR alone AS fixed, empty AND NOT kept AND n > 1 AND lag(empty AND NOT kept) OVER (PARTITION BY doc_id ORDER BY n) AS again FROM r
), g AS (
  SELECT *, sum(CASE WHEN fixed OR n = 1 THEN 1 ELSE 0 END) OVER w + CASE WHEN fixed THEN 0 ELSE sum(CASE WHEN fixed THEN 1 ELSE 0 END) OVER w END AS island FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY n)
), j AS (
  SELECT doc_id, fixed, island, min(n) AS n, max(n) = max(lines) AS final, bool_or(again) AS again, bool_or(other AND NOT kept) AS other, bool_or(empty AND NOT kept) AS empty,
    CASE WHEN count(*) = 1 THEN any_value(l) ELSE string_agg(CASE WHEN starts_with(l, ' ') AND n = 1 THEN rtrim(l) ELSE trim(l) END, ' ' ORDER BY n) END AS l FROM g GROUP BY doc_id, fixed, island
), merged AS (
  SELECT doc_id, bool_or(other OR (final AND empty)) AS other, string_agg(l || CASE WHEN final THEN '' ELSE chr(10) END, '' ORDER BY n) FILTER (NOT again) AS merged FROM j GROUP BY doc_id
)
SELECT doc_id, sha256(t) AS unescaped, sha256(t) AS promoted, CASE WHEN NOT contains(regexp_replace(regexp_replace(marks, 'DS*D', 'X', 'g'), 'DS*$', 'X'), 'SS') THEN 0 END AS promotions,
  CASE WHEN NOT other THEN sha256(merged) END AS merged, CASE WHEN NOT regexp_matches(text, '(?m)^[ \t:]*\||\n$') THEN CAST(length(text) AS INTEGER) END AS tables, CAST(length({_ISOLATED}) AS INTEGER) AS isolated
FROM plain LEFT JOIN merged USING (doc_id)"""
