"""Scalar rules as column expressions: names, URLs, hashes, LaTeX, markers. All run inside the JVM.

White space is always an explicit class: the engines' own trims disagree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .latex import TITLE_SYMBOLS

WS = r"[ \t\r\n\f\x0B]"
# Names that Windows reserves.
DEVICES = r"^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$"
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".bmp", ".ico", ".tiff", ".tif")
IMAGE_TYPES = {"image/png": ".png", "image/jpeg": ".jpg", "image/gif": ".gif", "image/svg+xml": ".svg", "image/webp": ".webp", "image/bmp": ".bmp", "image/x-icon": ".ico", "image/vnd.microsoft.icon": ".ico", "image/tiff": ".tiff"}
INVISIBLE = "[\u200b\u200c\u200d\u2060\ufeff\u00a0\u200e\u200f\uf0c1]"
KEEP = "@@KEEP:[0-9]+:[0-9]+@@"
VERSION = r"(?i)^(v?\d+([._-]\d+)*([-_]?(alpha|beta|rc)\d*)?|latest|stable|current|main|master|dev|nightly)$"
PLACEHOLDER_WORDS = ("placeholder", "your-", "your_", "example", "fixture", "test-token", "env-token", "file-token", "sample-token")


def _rx(c: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(c, pattern, to)


def strip(c: Column, chars: str = WS) -> Column:
    return _rx(c, rf"^{chars}+|{chars}+$")


def _stem_is_device(c: Column) -> Column:
    stem = _rx(F.substring_index(c, ".", 1), r"[ .]+$")
    return F.upper(stem).rlike(DEVICES)


def file_name(c: Column, longest: int = 80) -> Column:
    """A page's file name: control characters and runs of space collapse, reserved signs become ``-``, devices get ``_``."""
    c = F.translate(_rx(c, r"[\r\n\t]+", " "), '\\/:*?"<>|', "-" * 9)
    c = _rx(strip(_rx(c, rf"{WS}+", " ")), r"^\.+|\.+$")
    c = F.when(F.length(c) > longest, _rx(F.substring(c, 1, longest), r"[ .]+$")).otherwise(c)
    c = F.when(c == "", "untitled").otherwise(c)
    guarded = _rx(F.substring(F.concat(F.lit("_"), c), 1, longest), r"[ .]+$")
    return F.when(_stem_is_device(c), F.when(guarded == "", "_").otherwise(guarded)).otherwise(c)


def export_name(c: Column) -> Column:
    """The export's file name: reserved signs are removed instead."""
    c = strip(F.translate(c, '<>:"/\\|?*', ""))
    c = _rx(_rx(c, rf"{WS}+", " "), r"[ .]+$")
    c = F.when(c == "", "untitled").otherwise(c)
    stem = F.upper(F.substring_index(c, ".", 1))
    return F.when(stem.rlike(DEVICES), F.concat(F.lit("_"), c)).otherwise(c)


def url_scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def url_host(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def url_path(u: Column) -> Column:
    return F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def url_query(u: Column) -> Column:
    return F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)


def canonical_url(u: Column) -> Column:
    """Lower-case scheme and host, path and query as they are, no fragment."""
    q = url_query(u)
    return F.concat(url_scheme(u), F.lit("://"), url_host(u), url_path(u), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))


def page_path(u: Column) -> Column:
    """The path that all spellings of a page share."""
    return _rx(_rx(_rx(url_path(u), "/+$"), r"(?:/index\.html|/index|\.html)$"), "/+$")


def page_identity(u: Column) -> Column:
    return F.struct(url_scheme(u).alias("scheme"), url_host(u).alias("host"), page_path(u).alias("path"), url_query(u).alias("query"))


def nav_url(u: Column) -> Column:
    """A navigation link without fragment, trailing slash and index or html endings."""
    return _rx(_rx(_rx(_rx(u, "#.*$"), "/+$"), r"(?:/index\.html|/index|\.html)$"), "/+$")


def scope_prefix(path: Column) -> Column:
    """What a page's sub-pages share: the path up to its last version-like part, else its folder."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    last_version = F.array_max(F.transform(parts, lambda p, i: F.when(p.rlike(VERSION), i + 1)))
    n = F.size(parts)
    last = F.lower(F.try_element_at(parts, F.lit(-1)))
    alone = (n == 1) & ~last.contains(".") & (last != "index")
    keep = F.coalesce(last_version, F.when(path.endswith("/") | alone, n).otherwise(F.greatest(n - 1, F.lit(0))))
    kept = F.slice(parts, F.lit(1), keep)
    return F.concat(F.lit("/"), F.array_join(F.transform(kept, lambda p: F.concat(p, F.lit("/"))), ""))


def name_budget(root_length: Column, limit: int = 240) -> Column:
    """Characters left for a page's name when it occurs twice in a path."""
    return F.floor((F.lit(limit) - root_length - 90) / 2).cast("int")


def image_extension(url: Column, mime: Column) -> Column:
    """An allowed extension of the path, else that of the type, else .png."""
    ext = F.lower(F.regexp_extract(url_path(url), r"[^/.](\.[^./]*)$", 1))
    table = F.create_map(*(F.lit(x) for kv in IMAGE_TYPES.items() for x in kv))
    of_type = F.try_element_at(table, F.lower(F.regexp_extract(mime, r"^\s*([^;\s]+)", 1)))
    return F.when(ext.isin(*IMAGE_EXTENSIONS), ext).otherwise(F.coalesce(of_type, F.lit(".png")))


def clean_invisible(c: Column) -> Column:
    return _rx(c, INVISIBLE)


def title_math(c: Column) -> Column:
    r"""Titles without TeX delimiters, known commands as characters, white space collapsed."""
    c = _rx(c, r"\\[()\[\]]", " ")
    table = F.array(*(F.struct(F.lit(rf"(?<![A-Za-z])\\{k}(?![A-Za-z])").alias("k"), F.lit(v).alias("v")) for k, v in TITLE_SYMBOLS.items()))
    found = F.when(c.contains("\\"), F.aggregate(table, c, lambda acc, x: F.regexp_replace(acc, x["k"], x["v"]))).otherwise(c)
    return strip(_rx(found, rf"{WS}+", " "))


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def unescaped_count(c: Column, sign: str) -> Column:
    """Occurrences of a sign that no backslash escapes: escapes are consumed in pairs first."""
    return F.regexp_count(_rx(c, r"(?s)\\."), F.lit(sign))


def balanced_latex(c: Column) -> Column:
    """Unescaped braces match and never close too early."""
    braces = F.regexp_extract_all(_rx(c, r"(?s)\\."), F.lit("[{}]"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(True).alias("ok"))

    def step(acc: Column, x: Column) -> Column:
        depth = acc["depth"] + F.when(x == "{", 1).otherwise(-1)
        return F.struct(depth.alias("depth"), (acc["ok"] & (depth >= 0)).alias("ok"))

    return F.aggregate(braces, start, step, lambda acc: acc["ok"] & (acc["depth"] == 0))


def trim_raw_url(c: Column) -> Column:
    """Trailing punctuation goes, then closing parentheses that were never opened."""
    c = _rx(c, "[.,;:!?]+$")
    tail = F.length(F.regexp_extract(c, r"(\)*)$", 1))
    surplus = F.regexp_count(c, F.lit(r"\)")) - F.regexp_count(c, F.lit(r"\("))
    return F.substr(c, F.lit(1), F.length(c) - F.greatest(F.lit(0), F.least(tail, surplus)))


def reference_id(c: Column) -> Column:
    return strip(_rx(F.lower(c), rf"{WS}+", " "))


def visible_text(template: Column) -> Column:
    return _rx(template, KEEP)


def translatable_chars(template: Column) -> Column:
    return F.length(visible_text(template))


def segment_marker(block: Column, number: Column) -> Column:
    return F.concat(F.lit("@@SEG:"), block, F.lit(":"), F.lpad(number.cast("string"), 4, "0"), F.lit("@@"))


def line_ending(c: Column) -> Column:
    """CRLF if the first line break is one, else LF."""
    crlf, lf = F.instr(c, "\r\n"), F.instr(c, "\n")
    return F.when((crlf > 0) & (crlf + 1 <= lf), F.lit("\r\n")).otherwise(F.lit("\n"))


def clean_latex(c: Column) -> Column:
    return F.replace(c, F.lit("\\*"), F.lit("*"))


def escape_xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def looks_placeholder(c: Column) -> Column:
    """Values in place of secrets: empty, in angle brackets, a variable, or with a telling word."""
    low = F.lower(strip(c))
    telling = F.lit(False)
    for w in PLACEHOLDER_WORDS:
        telling |= low.contains(w)
    return (low == "") | low.isin("no-check", "nocheck") | (low.startswith("<") & low.endswith(">")) | low.contains("${") | telling


def is_within(path: Column, root: Column) -> Column:
    root = _rx(root, "/+$")
    return (path == root) | path.startswith(F.concat(root, F.lit("/")))


def relative_path(path: Column, root: Column) -> Column:
    root = _rx(root, "/+$")
    return F.when(path == root, F.lit(".")).when(is_within(path, root), F.substr(path, F.length(root) + 2)).otherwise(path)


def in_table_row(line: Column) -> Column:
    return strip(line).rlike(r"^\|.*\|")


def line_at(text: Column, at: Column) -> Column:
    """The line that holds the character with zero-based offset ``at``."""
    before = F.substring_index(F.substr(text, F.lit(1), at), "\n", -1)
    return F.concat(before, F.substring_index(F.substr(text, at + 1), "\n", 1))


def timestamp_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmssxx")


def block_macro(latex: Column, align: Column) -> Column:
    left = F.lit('<ac:parameter ac:name="alignment">left</ac:parameter>')
    head = F.lit('<ac:structured-macro ac:name="mathblock" ac:schema-version="1">')
    return F.concat(head, F.when(align == "left", left).otherwise(F.lit("")), F.lit("<ac:plain-text-body><![CDATA["), latex, F.lit("]]></ac:plain-text-body></ac:structured-macro>"))


def placeholder(kind: str, document: Column, number: Column) -> Column:
    """A placeholder that depends on the document alone."""
    return F.concat(F.lit(f"@@{kind}:"), F.substring(sha256(document), 1, 8), F.lit(":"), number.cast("string"), F.lit("@@"))


def front_matter(title: Column, when: Column) -> Column:
    quoted = F.regexp_extract(F.to_json(F.struct(title.alias("t"))), r'^\{"t":(.*)\}$', 1)
    return F.concat(F.lit("---\ntitle: "), quoted, F.lit("\ndate: "), when, F.lit("\nmath: true\n---\n\n"))
