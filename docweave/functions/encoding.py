"""The encoding of bytes, found by their mark, their own pattern and what they declare, and their text, as column expressions.

In this order: a byte order mark; zero bytes on one side of most pairs, which only two-byte encodings of mostly Latin text
have; bytes that are UTF-8; the encoding that a ``meta`` tag or an XML declaration in the first 1024 bytes names, if the
bytes can be read in it; else windows-1252, which reads any bytes. What UTF-8 can't be is so never taken for it, whatever
a page declares. All of it runs on the bytes seen as Latin-1 characters, one for each byte.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fold import bind

PRESCAN = 1024
_DECLARED = r"""(?is)<meta\s[^>]*?charset\s*=\s*["']?\s*([a-z0-9_:.\-]+)|\A\s*<\?xml\s[^>]*?encoding\s*=\s*["']([a-z0-9_:.\-]+)"""

# The characters of windows-1252 at the bytes 0x80 to 0x9F; five are not assigned and stay as they are.
_CP1252 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
# Names that pages give to the encodings known here.
NAMES = {
    "utf-8": ("utf-8", "utf8"),
    "utf-16le": ("utf-16le", "utf-16", "utf16"),
    "utf-16be": ("utf-16be",),
    "us-ascii": ("us-ascii", "ascii"),
    "windows-1252": ("windows-1252", "cp1252", "iso-8859-1", "latin1", "latin-1", "iso8859-1"),
}


def _latin(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1")


def declared(content: Column) -> Column:
    """The name that the first bytes declare, in lower case; null without one."""
    head = _latin(F.substring(content, 1, PRESCAN))
    name = lambda h: F.coalesce(F.nullif(F.regexp_extract(h, _DECLARED, 1), F.lit("")), F.nullif(F.regexp_extract(h, _DECLARED, 2), F.lit("")))
    return F.lower(bind(head, name))


def detected(content: Column) -> Column:
    """(encoding, mark, reason): the encoding by one of the names above, the length of its mark, and what told it; null bytes give null."""

    def told(encoding: str, mark: int, reason: str) -> Column:
        return F.struct(F.lit(encoding).alias("encoding"), F.lit(mark).alias("mark"), F.lit(reason).alias("reason"))

    begins = lambda mark: F.substring(content, 1, len(mark)) == F.lit(mark)
    bytes_ = F.octet_length(content)
    head = _latin(F.substring(content, 1, 4 * PRESCAN))

    def zeros(text: Column) -> Column:
        pairs = F.regexp_extract_all(text, F.lit(r"(?s)..|.\z"), F.lit(0))
        return F.struct(F.size(pairs).alias("n"), F.size(F.filter(pairs, lambda p: p.rlike(r"(?s)\A[^\x00]\x00\z"))).alias("le"), F.size(F.filter(pairs, lambda p: p.rlike(r"(?s)\A\x00[^\x00]\z"))).alias("be"))

    valid = F.is_valid_utf8(content.cast("string"))
    ascii_ = ~_latin(content).rlike(r"[^\x00-\x7F]")

    def judged(z: Column) -> Column:
        named = F.coalesce(declared(content), F.lit(""))
        return (
            F.when(content.isNull(), F.lit(None))
            .when(begins(b"\xef\xbb\xbf") & valid, told("utf-8", 3, "mark"))
            .when(begins(b"\xff\xfe") & (bytes_ % 2 == 0), told("utf-16le", 2, "mark"))
            .when(begins(b"\xfe\xff") & (bytes_ % 2 == 0), told("utf-16be", 2, "mark"))
            .when((bytes_ % 2 == 0) & (z["le"] * 2 > z["n"]), told("utf-16le", 0, "zeros"))
            .when((bytes_ % 2 == 0) & (z["be"] * 2 > z["n"]), told("utf-16be", 0, "zeros"))
            .when(ascii_, told("us-ascii", 0, "bytes"))
            .when(valid, told("utf-8", 0, "bytes"))
            .when(named.isin(*NAMES["windows-1252"]), told("windows-1252", 0, "declared"))
            .otherwise(told("windows-1252", 0, "rest"))
        )

    return bind(bind(head, zeros), judged)


def text_of(content: Column, found: Column) -> Column:
    """The text of ``content`` in the encoding ``found`` (from ``detected``), without its mark."""
    body = F.substring(content, found["mark"] + 1, F.octet_length(content))
    signs = "".join(chr(0x80 + i) for i in range(32))
    e = found["encoding"]
    return (
        F.when(e == "utf-16le", F.decode(body, "UTF-16LE"))
        .when(e == "utf-16be", F.decode(body, "UTF-16BE"))
        .when(e == "windows-1252", F.translate(_latin(body), signs, _CP1252))
        .when(e.isNotNull(), F.decode(body, "UTF-8"))
    )
