"""Secret and path gates before publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import looks_placeholder

KEYS = r"(?:token|api[_-]?key|secret|password|passwd)"
# Dialects differ in their keys and in how long a bare value must be.
DIALECTS = {
    "page": (rf"(?i)\b((?:[a-z0-9]+[_-])*{KEYS}(?:[_-][a-z0-9]+)*)[\"']?[ \t]*[:=][ \t]*(?:\"([^\"\r\n]*)\"|'([^'\r\n]*)'|([^\s,;#`\"']+))", 1),
    "translation": (r"(?i)\b((?:[a-z0-9]+[_-])*(?:api[_-]?(?:key|token)|access[_-]?token|auth[_-]?token|token|secret|password|server[_-]?url|username|account)(?:[_-][a-z0-9]+)*)[\"']?[ \t]*[:=][ \t]*(?:\"([^\"\r\n]+)\"|'([^'\r\n]+)'|([^\s,;#`\"']{12,}))", 12),
    "wiki": (r"(?i)\b((?:[a-z0-9]+[_-])*(?:token|api[_-]?key)(?:[_-][a-z0-9]+)*)[\"']?[ \t]*[:=][ \t]*(?:\"([^\"\r\n]+)\"|'([^'\r\n]+)'|([^\s#,}\"']+))", 1),
}
# Formats of known tokens.
KNOWN = {
    "openai": r"(?<![A-Za-z0-9_-])sk-(?:proj-)?[A-Za-z0-9_-]{20,}",
    "github": r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{20,}",
    "aws": r"AKIA[0-9A-Z]{16}",
    "jwt": r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}",
    "bearer": r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{20,}",
}
FORBIDDEN_DIRS = (".git", "__pycache__", "node_modules", ".venv", "venv", ".idea", ".vscode", "logs", "cache")
FORBIDDEN_FILES = (".env", "config.py", "credentials.json", "id_rsa")
FORBIDDEN_SUFFIXES = (".pyc", ".pyo", ".log", ".tmp", ".bak", ".pem", ".key", ".p12", ".sqlite", ".db")


def _groups(text: Column, pattern: str) -> Column:
    """All matches as (key, value): value is whichever of the three value groups matched."""
    g = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2, 3, 4)]
    return F.transform(F.arrays_zip(*(x.alias(n) for x, n in zip(g, "kabc", strict=True))), lambda x: F.struct(x["k"].alias("key"), F.concat(x["a"], x["b"], x["c"]).alias("value")))


def assignments(docs: DataFrame, dialect: str = "page", key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, name, value of sensitive assignments whose value is no placeholder. Texts without a sign of one are skipped early."""
    pattern, _ = DIALECTS[dialect]
    t = F.col(text)
    rows = docs.where(t.rlike("(?i)token|key|secret|passw|url|user|account")).select(F.col(key), F.explode(_groups(t, pattern)).alias("x"))
    return rows.select(key, F.lower("x.key").alias("name"), F.col("x.value").alias("value")).where(~looks_placeholder(F.col("value")))


def known_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    def of(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    rows = docs.select(F.col(key), F.explode(F.concat(*(of(k, p) for k, p in KNOWN.items()))).alias("x"))
    return rows.select(key, "x.kind", "x.value")


def forbidden_reason(path: Column) -> Column:
    """Why a path may not be published, null if it may; content need not be read."""
    parts = F.split(F.lower(path), "/")
    folders, name = F.slice(parts, F.lit(1), F.size(parts) - 1), F.element_at(parts, -1)
    bad_dir = F.exists(folders, lambda p: p.isin(*FORBIDDEN_DIRS) | p.endswith("_cache") | p.endswith("-cache"))
    suffix = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    secret_name = F.regexp_replace(name, r"\.[^.]*$", "").rlike(r"(?:^|[_-])(?:token|api[_-]?key)(?:$|[_-])")
    return F.when(bad_dir, "folder").when(name.isin(*FORBIDDEN_FILES) | name.startswith(".env."), "file").when(suffix.isin(*FORBIDDEN_SUFFIXES), "suffix").when(secret_name, "name")


def publication(files: DataFrame) -> DataFrame:
    """Findings (path, rule, detail) of files (path, content); if any path is forbidden only those are reported."""
    paths = files.select("path").withColumn("rule", forbidden_reason(F.col("path"))).where("rule is not null").select("path", "rule", F.lit(None).cast("string").alias("detail"))
    if not paths.isEmpty():
        return paths
    docs = files.select("path", "content")
    found = assignments(docs, "wiki", "path", "content").select("path", F.lit("assignment").alias("rule"), F.col("name").alias("detail"))
    return found.unionByName(known_tokens(docs, "path", "content").select("path", F.lit("token").alias("rule"), F.col("kind").alias("detail")))
