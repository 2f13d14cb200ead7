"""URL identity and scope, as plain functions; ``columns`` has the same as column expressions."""

from __future__ import annotations

import re
from urllib.parse import urlsplit

VERSION = re.compile(r"^(?:v?\d+(?:[._-]\d+)*(?:[-_]?(?:alpha|beta|rc)\d*)?|latest|stable|current|main|master|dev|nightly)$", re.I)


def identity_of(url: str) -> tuple[str, str, str, str] | None:
    """(scheme, host, path, query) that all spellings of a page share; None for what is no URL."""
    try:
        u = urlsplit(url)
    except ValueError:
        return None
    path = re.sub(r"(?:/index\.html|/index|\.html)$", "", u.path.rstrip("/")).rstrip("/")
    return u.scheme.lower(), u.netloc.lower(), path, u.query


def scope_prefix(path: str) -> str:
    """The part of a path that a page's sub-pages share: up to the last version-like segment, else its folder."""
    parts = [p for p in path.split("/") if p]
    versions = [i for i, p in enumerate(parts) if VERSION.match(p)]
    if versions:
        kept = parts[: versions[-1] + 1]
    elif path.endswith("/") or (len(parts) == 1 and "." not in parts[0] and parts[0].lower() != "index"):
        kept = parts
    else:
        kept = parts[:-1]
    return "/" + "".join(f"{p}/" for p in kept)
