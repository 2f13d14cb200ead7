"""Files and texts as tables."""

from __future__ import annotations

import ast
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import encoding

STATE = "schema_version int, source struct<path:string,sha256:string,bom:boolean>, units array<struct<id:string,kind:string,start:int,end:int,line_start:int,line_end:int,source_text:string,template:string,section:string>>"


def read_markdown(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """path, text, bom, sha256, valid of Markdown files. Invalid UTF-8 gives a null text and valid false, never a replacement."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return decoded(raw.select("path", "content")).drop("content")


def decoded(rows: DataFrame) -> DataFrame:
    """``rows`` with text, bom, sha256 and valid of their ``content``; the mark goes from the text and stays in the hash."""
    bom = F.coalesce(F.substring("content", 1, 3) == F.lit(b"\xef\xbb\xbf"), F.lit(False))
    valid = F.coalesce(F.is_valid_utf8(F.col("content").cast("string")), F.lit(False))
    body = F.when(bom, F.expr("substr(content, 4)")).otherwise(F.col("content"))
    return rows.select("*", F.when(valid, F.decode(body, "UTF-8")).alias("text"), bom.alias("bom"), F.sha2("content", 256).alias("sha256"), valid.alias("valid"))


def decoded_pages(rows: DataFrame, content: str = "content") -> DataFrame:
    """``rows`` with encoding, reason and html of their bytes: pages in whatever encoding they came; null bytes give nulls."""
    found = rows.withColumn("__found", encoding.detected(F.col(content)))
    html = encoding.text_of(F.col(content), F.col("__found"))
    return found.withColumns({"encoding": F.col("__found.encoding"), "reason": F.col("__found.reason"), "html": html}).drop("__found")


def read_pages(spark: SparkSession, path: str, pattern: str = "*.html") -> DataFrame:
    """path, encoding, reason, html of the pages below a folder."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return decoded_pages(raw.select("path", "content")).drop("content")


def read_state(spark: SparkSession, path: str, version: int = 5) -> DataFrame:
    """Extraction states from JSON with an explicit schema; rows of another schema version are left out."""
    return spark.read.schema(STATE).option("multiLine", "true").json(path).where(F.col("schema_version") == version)


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An append-only log of JSON lines."""
    return spark.read.schema(schema).json(path)


def translation_map(rows: DataFrame, column: str = "json") -> DataFrame:
    """``rows`` with translations, a map of strings; null where the JSON is anything else."""
    parsed = F.from_json(column, "map<string,string>")
    strict = F.to_json(parsed) == F.regexp_replace(column, r'\s*([{}:,])\s*(?=(?:[^"]*"[^"]*")*[^"]*$)', "$1")
    return rows.withColumn("translations", F.when(strict, parsed))


def children_manifest(rows: DataFrame, key: str = "manifest_id", text: str = "text") -> DataFrame:
    """key, line, depth, title, url, parent_url of a text manifest ``- title | url | note``.

    Two spaces of indent make a grandchild. Comments, deeper lines, lines without a URL and orphans are left out.
    """
    t = rows.select(F.col(key), F.posexplode(F.split(text, r"\r\n|\n|\r")).alias("i", "raw"))
    pattern = r"^(\s*)[-*]\s+(.*)$"
    t = t.where(F.col("raw").rlike(pattern) & ~F.col("raw").rlike(r"^\s*#"))
    parts = F.split(F.regexp_extract("raw", pattern, 2), r"\|")
    url = F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")), r"^[\s<]+|[\s>]+$", "")
    title = F.regexp_replace(F.element_at(parts, 1), r"^\s+|\s+$", "")
    depth = F.floor(F.length(F.regexp_extract("raw", pattern, 1)) / 2).cast("int")
    t = t.select(key, (F.col("i") + 1).alias("line"), depth.alias("depth"), title.alias("title"), url.alias("url")).where((F.col("url") != "") & (F.col("depth") <= 1))
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parent = F.last(F.when(F.col("depth") == 0, F.col("url")), ignorenulls=True).over(w)
    t = t.withColumn("parent_url", F.when(F.col("depth") == 1, parent))
    return t.where((F.col("depth") == 0) | F.col("parent_url").isNotNull()).withColumn("title", F.when(F.col("title") == "", F.col("url")).otherwise(F.col("title")))


def scan_tree(files: DataFrame) -> DataFrame:
    """node_id, parent_node_id, title, md_path, has_page, ambiguous from a listing (dir, name) of files.

    A folder with a Markdown file is a page: the file of the folder's own name, else the sole one, else it is ambiguous.
    Asset folders are no nodes; folders without any page below disappear; a node hangs from its nearest folder that is one.
    """
    f = files.where(~F.col("dir").rlike(r"(^|/)[^/]*\.assets(/|$)"))
    md = f.where(F.lower("name").endswith(".md")).withColumn("stem", F.regexp_replace("name", r"\.[^.]*$", "")).withColumn("folder", F.substring_index("dir", "/", -1))
    by = md.groupBy("dir", "folder").agg(F.count("*").alias("n"), F.max(F.when(F.col("stem") == F.col("folder"), F.col("name"))).alias("same"), F.min("name").alias("one"))
    chosen = F.coalesce("same", F.when(F.col("n") == 1, F.col("one")))
    nodes = by.select(F.col("dir").alias("node_id"), F.col("folder").alias("title"), F.when(chosen.isNotNull(), F.concat("dir", F.lit("/"), chosen)).alias("md_path"), chosen.isNotNull().alias("has_page"), chosen.isNull().alias("ambiguous"))
    up = F.filter(F.transform(F.sequence(F.lit(1), F.size(F.split("node_id", "/"))), lambda i: F.array_join(F.slice(F.split("node_id", "/"), F.lit(1), i), "/")), lambda p: p != F.col("node_id"))
    above = nodes.select("node_id", F.posexplode(up).alias("depth", "p")).join(nodes.select(F.col("node_id").alias("p")), "p").groupBy("node_id").agg(F.max_by("p", "depth").alias("parent_node_id"))
    return nodes.join(above, "node_id", "left").select("node_id", "parent_node_id", "title", "md_path", "has_page", "ambiguous")


def visible_segments(blocks: DataFrame, key: str = "block_id", surface: str = "surface") -> DataFrame:
    """key, number, segment of a block's surface: the text between segment marks."""
    parts = F.split(surface, r"(?m)^@@SEG:[^@\r\n]+@@\n?")
    rows = blocks.select(F.col(key), F.posexplode(parts).alias("number", "segment")).where("number > 0")
    return rows.select(key, "number", F.regexp_replace("segment", r"\n$", "").alias("segment"))


def apply_segments(blocks: DataFrame, translations: DataFrame, key: str = "block_id", surface: str = "surface") -> DataFrame:
    """key, surface with segments (key, number, translation) put back; others stay."""
    rows = visible_segments(blocks, key, surface).join(translations, [key, "number"], "left")
    line = F.concat(F.lit("@@SEG:"), F.col(key), F.lit(":"), F.lpad(F.col("number").cast("string"), 4, "0"), F.lit("@@\n"), F.coalesce("translation", "segment"), F.lit("\n"))
    made = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("number", line.alias("line")))).alias("x"))
    return made.select(key, F.array_join(F.transform("x", lambda r: r["line"]), "").alias("surface"))


@dataclass(frozen=True)
class Options:
    """Settings with their defaults; unknown keys of a file are ignored."""

    timeout: int = 30
    collect_children: bool = False
    merge_paragraphs: bool = False
    table_formula_inline: bool = True
    page_nav: bool = True
    max_block_chars: int = 16000
    toc_enabled: bool = True
    toc_min_headings: int = 4
    math_align: str = "left"
    fix_hierarchy: str = "confirm"


def literal_group(source: str, name: str) -> dict:
    """A dictionary assigned to ``name`` in Python source, read as a literal and never executed."""
    found = [n for n in ast.parse(source).body if isinstance(n, ast.Assign) and any(isinstance(t, ast.Name) and t.id == name for t in n.targets)]
    if len(found) != 1:
        raise ValueError(f"{name} must be assigned exactly once")
    value = ast.literal_eval(found[0].value)
    if not isinstance(value, dict) or not all(isinstance(k, str) for k in value):
        raise ValueError(f"{name} must be a dictionary with string keys")
    return value


def options(source: str | None, name: str = "config", environment: dict[str, str] | None = None) -> Options:
    """Defaults, overridden by a literal configuration, overridden by environment values; types must agree."""
    given = (literal_group(source, name) if source else {}) | (environment or {})
    chosen = {}
    for f in fields(Options):
        if f.name in given:
            if type(given[f.name]) is not type(f.default):
                raise ValueError(f"{f.name} must be {type(f.default).__name__}")
            chosen[f.name] = given[f.name]
    return Options(**chosen)
