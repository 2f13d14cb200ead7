"""Relative references resolved against a base URL (RFC 3986), as a column expression.

Dot segments are removed from the right: a name goes away if more ``..`` than names follow it, so a counter takes the
place of a stack and work is linear in the path.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fold import bind, states

# Schemes whose references may be relative, and those whose last path segment may carry parameters.
RELATIVE = ("", "http", "https", "ftp", "file", "ws", "wss", "sftp")
WITH_PARAMETERS = ("", "http", "https", "ftp")

_URL = r"(?s)\A(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z"
_PARAMETERS = r"(?s)\A((?:.*/)?[^/;]*);([^/]*)\z"


def split_url(url: Column, scheme: Column | None = None) -> Column:
    """scheme, host, path, parameters, query, fragment; what is absent is empty. ``scheme`` is that of a reference without one.

    Leading blanks and control characters go, and tabs and line breaks anywhere. Escapes stay as they are.
    """
    clean = F.regexp_replace(F.regexp_replace(url, r"\A[\x00-\x20]+", ""), r"[\t\r\n]", "")

    def parts(u: Column) -> Column:
        own = F.lower(F.regexp_extract(u, _URL, 1))
        named = own if scheme is None else F.when(own == "", scheme).otherwise(own)
        path = F.regexp_extract(u, _URL, 3)
        has = named.isin(*WITH_PARAMETERS) & path.rlike(_PARAMETERS)
        return F.struct(
            named.alias("scheme"),
            F.regexp_extract(u, _URL, 2).alias("host"),
            F.when(has, F.regexp_extract(path, _PARAMETERS, 1)).otherwise(path).alias("path"),
            F.when(has, F.regexp_extract(path, _PARAMETERS, 2)).otherwise("").alias("parameters"),
            F.regexp_extract(u, _URL, 4).alias("query"),
            F.regexp_extract(u, _URL, 5).alias("fragment"),
        )

    return bind(clean, parts)


def without_dots(segments: Column) -> Column:
    """Path segments without ``.`` and ``..`` and the names that these take back; a path that ends in one ends in a slash."""

    def kept(turned: Column) -> Column:
        step = lambda n, s: F.when(s == "..", n + 1).when(s == ".", n).otherwise(F.greatest(n - 1, F.lit(0)))
        owed = states(turned, F.lit(0), step, "int")
        return bind(owed, lambda n: F.filter(F.transform(turned, lambda s, i: F.when(~s.isin(".", "..") & (n[i] == 0), s)), lambda s: s.isNotNull()))

    tail = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.reverse(bind(F.reverse(segments), kept)), tail)


def _written(scheme: Column, host: Column, path: Column, parameters: Column, query: Column, fragment: Column) -> Column:
    whole = F.when(parameters != "", F.concat(path, F.lit(";"), parameters)).otherwise(path)
    rooted = F.when((whole != "") & ~whole.startswith("/"), F.concat(F.lit("/"), whole)).otherwise(whole)
    named = (scheme != "") & scheme.isin(*RELATIVE)
    local = F.when(whole.startswith("//") | (named & ((whole == "") | whole.startswith("/"))), F.concat(F.lit("//"), whole)).otherwise(whole)
    front = F.when(host != "", F.concat(F.lit("//"), host, rooted)).otherwise(local)

    def optional(sign: str, value: Column, before: bool = False) -> Column:
        both = F.concat(value, F.lit(sign)) if before else F.concat(F.lit(sign), value)
        return F.when(value != "", both).otherwise("")

    return F.concat(optional(":", scheme, True), front, optional("?", query), optional("#", fragment))


def url_join(base: Column, reference: Column) -> Column:
    """``reference`` as an absolute URL, seen from ``base``; null if either is null.

    An empty reference is the base, an empty base leaves the reference. A reference of another scheme, or one whose scheme
    isn't among ``RELATIVE``, stays as it is.
    """

    def resolved(b: Column) -> Column:
        def from_base(u: Column) -> Column:
            folder = bind(F.split(b["path"], "/", -1), lambda s: F.when(F.element_at(s, -1) != "", F.slice(s, F.lit(1), F.size(s) - 1)).otherwise(s))
            both = F.concat(folder, F.split(u["path"], "/", -1))
            # Empty segments in between would become double slashes.
            relative = bind(both, lambda s: F.filter(s, lambda x, i: (x != "") | (i == 0) | (i == F.size(s) - 1)))
            segments = F.when(u["path"].startswith("/"), F.split(u["path"], "/", -1)).otherwise(relative)
            joined = F.array_join(bind(segments, without_dots), "/")
            path = F.when(joined == "", "/").otherwise(joined)
            here = (u["path"] == "") & (u["parameters"] == "")
            same = _written(u["scheme"], b["host"], b["path"], b["parameters"], F.when(u["query"] == "", b["query"]).otherwise(u["query"]), u["fragment"])
            other = bind(path, lambda p: _written(u["scheme"], b["host"], p, u["parameters"], u["query"], u["fragment"]))
            away = _written(u["scheme"], u["host"], u["path"], u["parameters"], u["query"], u["fragment"])
            foreign = (u["scheme"] != b["scheme"]) | ~u["scheme"].isin(*RELATIVE)
            return F.when(foreign, reference).when(u["host"] != "", away).when(here, same).otherwise(other)

        return bind(split_url(reference, b["scheme"]), from_base)

    return F.when(base == "", reference).when(reference == "", base).otherwise(bind(split_url(base), resolved))
