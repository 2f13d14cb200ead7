"""What is written: page files, navigation blocks, exports, payloads, logs and audits. Spark's commit makes writes atomic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def page_file(title: Column, url: Column, markdown: Column) -> Column:
    """A page's file: its title as heading, its source as quote, the body."""
    return F.concat(F.lit("# "), title, F.lit("\n\n> Source: ["), url, F.lit("]("), url, F.lit(")\n\n"), markdown, F.lit("\n"))


def page_files(pages: DataFrame) -> DataFrame:
    """path, content for each converted page (name, title, url, markdown)."""
    return pages.select(F.concat("name", F.lit("/"), "name", F.lit(".md")).alias("path"), page_file(F.col("title"), F.col("url"), F.col("markdown")).alias("content"))


def nav_block(entries: DataFrame, key: str = "page_id") -> DataFrame:
    """key, block: a nested list of sub-pages (key, ord, level, title, rel), links in angle brackets."""
    line = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), F.lit("- ["), "title", F.lit("](<./"), "rel", F.lit(">)"))
    rows = entries.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("x"))
    return rows.select(key, F.concat(F.lit("\n\n## Sub-pages\n\n"), F.array_join(F.transform("x", lambda r: r["line"]), "\n"), F.lit("\n")).alias("block"))


def export_files(pages: DataFrame) -> DataFrame:
    """path, content of exported pages (page_id, title, when, markdown); each page once, as it was last, equal times by title."""
    once = pages.groupBy("page_id").agg(F.max(F.struct("when", "title", "markdown")).alias("x")).select("page_id", "x.*")
    name = C.export_name(F.col("title"))
    return once.select(F.concat("page_id", F.lit("_"), name, F.lit("/"), name, F.lit(".md")).alias("path"), F.concat(C.front_matter(F.col("title"), F.col("when")), "markdown").alias("content"))


def update_payloads(checked: DataFrame, force: bool = False) -> DataFrame:
    """page_id, payload, action: an update carries the next version; a conflict is refused, or retried on the latest version if forced."""
    version = F.when(F.col("state") == "ok", F.col("version") + 1).when(F.lit(force) & (F.col("state") == "conflict"), F.col("now_version") + 1)
    payload = F.to_json(F.struct(F.col("page_id").alias("id"), "title", F.struct(version.alias("number")).alias("version"), F.struct(F.struct(F.col("new_storage").alias("value"), F.lit("storage").alias("representation")).alias("storage")).alias("body")))
    return checked.select("page_id", F.when(version.isNotNull(), payload).alias("payload"), F.when(F.col("state") == "gone", "gone").when(version.isNull(), "refused").otherwise("update").alias("action"))


def attachment_file(attachment_id: Column, name: Column) -> Column:
    """A local name that stays within its folder: safe id and base name."""
    base = F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r'[<>:"|?*\x00-\x1f]', "")
    return F.concat(F.regexp_replace(attachment_id, r"[^A-Za-z0-9_-]", ""), F.lit("_"), F.when(base.isin("", ".", ".."), "file").otherwise(base))


def attachment_actions(uploads: DataFrame, existing: DataFrame) -> DataFrame:
    """page_id, name, action, attachment_id, link for uploads (page_id, name, status of the attempt to create it).

    A created attachment is done. Where the name is taken (400 or 409) the one that ``existing`` (page_id, attachment_id, name)
    lists first gets the new data; without one, and after any other status, the upload failed.
    """
    have = existing.groupBy("page_id", "name").agg(F.min("attachment_id").alias("attachment_id"))
    made, taken = F.col("status").between(200, 299), F.col("status").isin(400, 409) & F.col("attachment_id").isNotNull()
    action = F.when(made, "created").when(taken, "update").otherwise("failed")
    link = F.when(action != "failed", F.concat(F.lit("/download/attachments/"), F.col("page_id"), F.lit("/"), F.col("name")))
    return uploads.join(have, ["page_id", "name"], "left").select("page_id", "name", action.alias("action"), F.when(taken, F.col("attachment_id")).alias("attachment_id"), link.alias("link"))


def asset_plan(docs: DataFrame, files: DataFrame) -> DataFrame:
    """doc_id, source, target, action, files: what happens to the assets folder beside each document (doc_id, source, output).

    ``files`` (path) is all there is. Assets go beside the output under the source's name; a target that exists is neither
    merged nor overwritten.
    """
    stem = F.regexp_extract("source", r"([^/]*?)(?:\.[^./]*)?$", 1)

    def folder(c: str) -> Column:
        return F.concat(F.regexp_extract(c, r"^(.*/)?", 0), stem, F.lit(".assets"))

    have = files.select(F.regexp_extract("path", r"^(.*?\.assets)/", 1).alias("folder")).where("folder <> ''").groupBy("folder").agg(F.count("*").alias("n"))
    rows = docs.select("doc_id", folder("source").alias("source"), folder("output").alias("target"))
    rows = rows.join(have.select(F.col("folder").alias("source"), "n"), "source", "left").join(have.select(F.col("folder").alias("target"), F.col("n").alias("m")), "target", "left")
    action = F.when(F.col("n").isNull(), "none").when(F.col("source") == F.col("target"), "in place").when(F.col("m").isNotNull(), "refused").otherwise("copy")
    return rows.select("doc_id", "source", F.when(action != "none", F.col("target")).alias("target"), action.alias("action"), F.coalesce("n", F.lit(0)).alias("files"))


def audit(before: DataFrame, after: DataFrame, key: str = "page_id", column: str = "storage") -> DataFrame:
    """key, before, after, their hashes and whether anything changed."""
    b = before.select(key, F.col(column).alias("before"))
    a = after.select(key, F.col(column).alias("after"))
    return b.join(a, key).select(key, "before", "after", C.sha256(F.col("before")).alias("before_sha256"), C.sha256(F.col("after")).alias("after_sha256"), (~F.col("before").eqNullSafe(F.col("after"))).alias("changed"))


def append_events(events: DataFrame, path: str) -> None:
    """Append to a log of JSON lines."""
    events.write.mode("append").json(path)


def write_files(files: DataFrame, path: str) -> None:
    """Contents by path as Parquet; the consumer that needs single files writes them from here."""
    files.write.mode("overwrite").parquet(path)


def latest_by(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key: what a log amounts to."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))
    return rows.withColumn("__n", n).where("__n = 1").drop("__n")
