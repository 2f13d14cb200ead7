"""Storage markup operators and the page tree: lookup, plan, gates, descendants, sync."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import held
from ..storage import convert, export
from .rows import map_rows


def to_storage(docs: DataFrame, key: str = "id", text: str = "markdown", options: convert.Options = convert.Options()) -> DataFrame:
    """Storage markup, balance error and macro count of Markdown rows."""

    def make(k, t):
        made = convert.to_storage(t or "", options)
        return {key: k, "storage": made, "balance": convert.balance(made), "macros": convert.macro_count(made)}

    return map_rows(docs, [key, text], make, f"{key} {docs.schema[key].dataType.simpleString()}, storage string, balance string, macros int")


def to_markdown(pages: DataFrame, base_url: str = "", key: str = "page_id", attachments: str | None = None) -> DataFrame:
    """Markdown of storage rows; ``attachments`` is a map column from file names to saved names."""

    def make(k, s, *a):
        e = export.to_markdown(s or "", base_url, dict(a[0]) if a and a[0] else None)
        return {key: k, "markdown": e.markdown, "images": e.images, "failed_images": e.failed_images, "unknown_macros": e.unknown_macros}

    return map_rows(pages, [key, "storage", *([attachments] if attachments else [])], make, f"{key} {pages.schema[key].dataType.simpleString()}, markdown string, images array<string>, failed_images int, unknown_macros array<string>")


def upgraded(pages: DataFrame, align: str = "left", key: str = "page_id") -> DataFrame:
    """Storage with formulas as macros, the counts, and the verification. A page that fails to convert carries its error."""

    def make(k, s):
        try:
            u = convert.upgrade(s or "", align)
            v = convert.verify(s or "", u)
        except Exception as e:
            return {key: k, "error": f"{type(e).__name__}: {e}"}
        return {key: k, "storage": u.storage, "inline": u.inline, "block": u.block, "latex": u.latex, "upgraded": u.upgraded, "old_macros": u.old_macros, "spans": u.spans, "realigned": u.realigned, "balance": v.balance, "residuals": v.residuals, "passed": v.passed, "error": ""}

    return map_rows(pages, [key, "storage"], make, f"{key} {pages.schema[key].dataType.simpleString()}, storage string, inline int, block int, latex int, upgraded int, old_macros int, spans int, realigned int, balance string, residuals array<string>, passed boolean, error string")


def with_toc(html: Column, least: int = 4) -> Column:
    """A table of contents in front where there are enough sub-headings and none yet."""
    has = html.rlike(r"""<ac:structured-macro\b[^>]*ac:name=["']toc["']""")
    return F.when((F.regexp_count(html, F.lit(r"<h[2-6][\s>]")) >= least) & ~has, F.concat(F.lit(convert.TOC), html)).otherwise(html)


def attach_images(pages: DataFrame, attachments: DataFrame, key: str = "page_id") -> DataFrame:
    """Image references resolved against (page_id, path, name): storage, attached, missing, embedded."""
    known = attachments.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("path", "name"))).alias("__known"))

    def make(k, s, m):
        i = convert.attach_images(s or "", dict(m) if m else {})
        return {key: k, "storage": i.storage, "attached": i.attached, "missing": i.missing, "embedded": i.embedded}

    return map_rows(pages.join(known, key, "left"), [key, "storage", "__known"], make, f"{key} {pages.schema[key].dataType.simpleString()}, storage string, attached array<string>, missing array<string>, embedded int")


# --- lookup and plan ------------------------------------------------------------------------------------------------


def lookup(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """node_id, lookup (FOUND, NOT_FOUND, ERROR), page_id, version for each wanted page.

    ``wanted`` is (node_id, title, wanted_id, parent_id, any_parent, allow_move), ``index`` (id, title, version, parent_id).
    An id must exist exactly once. Else exact titles come before titles that differ in case; the parent narrows them
    (null is the root); a sole candidate elsewhere counts if moves are allowed. Several candidates are an error.
    """
    i = index.select(F.col("id").alias("i_id"), F.col("title").alias("i_title"), F.col("version").alias("i_version"), F.nullif("parent_id", F.lit("")).alias("i_parent"))
    by_id = wanted.where("wanted_id is not null").join(i, F.col("wanted_id") == F.col("i_id"), "left")
    ids = by_id.groupBy("node_id").agg(F.count("i_id").alias("n"), F.first("i_id").alias("page_id"), F.first("i_version").alias("version"))
    ids = ids.select("node_id", F.when(F.col("n") == 1, "FOUND").otherwise("ERROR").alias("lookup"), F.when(F.col("n") == 1, F.col("page_id")).alias("page_id"), F.when(F.col("n") == 1, F.col("version")).alias("version"))
    titled = wanted.where("wanted_id is null").withColumn("parent", F.nullif("parent_id", F.lit("")))
    pairs = titled.join(i, F.lower("title") == F.lower("i_title"), "left").withColumn("exact", F.col("title") == F.col("i_title"))
    pairs = pairs.withColumn("any_exact", F.coalesce(F.max("exact").over(Window.partitionBy("node_id")), F.lit(False)))
    used = F.col("i_id").isNotNull() & (F.col("exact") | ~F.col("any_exact"))
    scoped = used & F.col("parent").eqNullSafe(F.col("i_parent"))
    n, m = F.count_if(used), F.count_if(scoped)
    found = pairs.groupBy("node_id", "any_parent", "allow_move").agg(
        n.alias("n"), m.alias("m"), F.max(F.when(used, F.struct("i_id", "i_version"))).alias("one"), F.max(F.when(scoped, F.struct("i_id", "i_version"))).alias("own")
    )
    narrowed = ~F.col("any_parent")
    state = (
        F.when(F.col("n") == 0, "NOT_FOUND")
        .when(narrowed & (F.col("m") == 1), "FOUND")
        .when(narrowed & (F.col("m") > 1), "ERROR")
        .when(narrowed & ~F.col("allow_move"), "NOT_FOUND")
        .when(F.col("n") == 1, "FOUND")
        .otherwise("ERROR")
    )
    pick = F.when(narrowed & (F.col("m") == 1), F.col("own")).otherwise(F.col("one"))
    titles = found.withColumn("lookup", state).withColumn("pick", F.when(F.col("lookup") == "FOUND", pick))
    return ids.unionByName(titles.select("node_id", "lookup", F.col("pick.i_id").alias("page_id"), F.col("pick.i_version").alias("version")))


def plan(nodes: DataFrame, index: DataFrame, fix_hierarchy: bool = True, depth_limit: int | None = None) -> DataFrame:
    """The read-only import plan of a tree (node_id, parent_node_id, title, has_page), level by level from the root.

    status is new, update, move, skip (a folder without a page: its children hang from its parent) or error (ambiguous, or
    a page that another node claims). Each level is one lookup join; a page id is frozen with its version. ``depth_limit``
    is a number of levels, all without one; nodes in a cycle hang from no root and are in no level.
    """
    level = nodes.where("parent_node_id is null").select("node_id", "title", "has_page", F.lit(None).cast("string").alias("parent_node_id"), F.lit(None).cast("string").alias("target"), F.lit(False).alias("pending"), F.lit(0).alias("depth"))
    out, claimed = None, None
    for _ in count() if depth_limit is None else range(depth_limit):
        wanted = level.where("has_page").select("node_id", "title", F.lit(None).cast("string").alias("wanted_id"), F.col("target").alias("parent_id"), F.col("pending").alias("any_parent"), F.lit(True).alias("allow_move"))
        found = level.join(lookup(wanted, index), "node_id", "left")
        where = index.select(F.col("id").alias("page_id"), F.nullif("parent_id", F.lit("")).alias("current_parent"))
        found = found.join(where, "page_id", "left")
        first = F.row_number().over(Window.partitionBy("page_id").orderBy("node_id")) == 1
        taken = found.withColumn("free", F.col("page_id").isNull() | first)
        if claimed is not None:
            taken = taken.join(claimed.withColumn("__claimed", F.lit(True)), "page_id", "left").withColumn("free", F.col("free") & F.col("__claimed").isNull()).drop("__claimed")
        differs = F.col("pending") | ~F.col("current_parent").eqNullSafe(F.col("target"))
        status = F.when(~F.col("has_page"), "skip").when((F.col("lookup") == "ERROR") | ~F.col("free"), "error").when(F.col("lookup") == "NOT_FOUND", "new").when(differs & F.lit(fix_hierarchy), "move").otherwise("update")
        rows = taken.withColumn("status", status)
        ok = F.col("status").isin("move", "update")
        rows = rows.select("node_id", "parent_node_id", "title", "status", F.when(ok, F.col("page_id")).alias("page_id"), F.when(ok, F.col("version")).alias("version"), F.col("target").alias("target_parent_id"), "depth", "pending")
        rows = held(rows, "level")
        if rows.isEmpty():
            break
        out = rows if out is None else out.unionByName(rows)
        mine = rows.where("page_id is not null").select("page_id")
        claimed = mine if claimed is None else claimed.union(mine)
        skip = F.col("p_status") == "skip"
        up = rows.select(F.col("node_id").alias("parent_node_id"), F.col("status").alias("p_status"), F.col("page_id").alias("p_page"), F.col("target_parent_id").alias("p_target"), F.col("pending").alias("p_pending"), F.col("depth").alias("p_depth"))
        below = nodes.where("parent_node_id is not null").join(up, "parent_node_id")
        level = below.select("node_id", "title", "has_page", "parent_node_id", F.when(skip, F.col("p_target")).otherwise(F.col("p_page")).alias("target"), F.when(skip, F.col("p_pending")).otherwise(F.col("p_page").isNull()).alias("pending"), F.when(skip, F.col("p_depth")).otherwise(F.col("p_depth") + 1).alias("depth"))
    return out.drop("pending") if out is not None else nodes.limit(0).select("node_id", "parent_node_id", "title", F.lit("").alias("status"), F.lit("").alias("page_id"), F.lit(0).alias("version"), F.lit("").alias("target_parent_id"), F.lit(0).alias("depth"))


def descendants(index: DataFrame, root: str, depth: int = 0) -> DataFrame:
    """id, depth of the pages below ``root`` and itself, breadth first; ``depth`` 0 is no limit, cycles end."""
    level = index.where(F.col("id") == root).select("id", F.lit(0).alias("depth"))
    seen = level
    n = 0
    edges = index.select(F.col("id"), F.col("parent_id"))
    while not level.isEmpty() and (depth == 0 or n < depth):
        n += 1
        level = edges.join(level.select(F.col("id").alias("parent_id")), "parent_id").select("id", F.lit(n).alias("depth"))
        level = held(level.join(seen.select("id"), "id", "left_anti").dropDuplicates(["id"]), "level")
        seen = seen.unionByName(level)
    return seen


def children(index: DataFrame) -> DataFrame:
    """(parent_id, id, title): child pages by parent."""
    return index.where("parent_id is not null").select("parent_id", "id", "title")


def stale(updates: DataFrame, current: DataFrame) -> DataFrame:
    """updates with state: ok if version and body hash are unchanged, conflict if either moved, gone without a page."""
    now = current.select("page_id", F.col("version").alias("now_version"), F.sha2(F.col("storage").cast("binary"), 256).alias("now_sha"))
    same = (F.col("version") == F.col("now_version")) & (F.col("body_sha256") == F.col("now_sha"))
    state = F.when(F.col("now_version").isNull(), "gone").when(same, "ok").otherwise("conflict")
    return updates.join(now, "page_id", "left").withColumn("state", state).withColumn("next_version", F.when(F.col("state") == "ok", F.col("version") + 1))


def duplicate_page_ids(planned: DataFrame) -> DataFrame:
    return planned.where("page_id is not null").groupBy("page_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("node_id")).alias("nodes")).where("n > 1")


def gates(planned: DataFrame) -> DataFrame:
    """One row: has_move, has_error, duplicates; a plan may run only without errors and duplicates."""
    n = duplicate_page_ids(planned).agg(F.count("*").alias("duplicates"))
    return planned.agg(F.coalesce(F.bool_or(F.col("status") == "move"), F.lit(False)).alias("has_move"), F.coalesce(F.bool_or(F.col("status") == "error"), F.lit(False)).alias("has_error")).join(F.broadcast(n))


def pending(planned: DataFrame, done: DataFrame) -> DataFrame:
    """Nodes still to be done: not skipped, not in the checkpoint (node_id, page_id), with the parent's page id if known.

    A node whose parent is neither found nor done waits.
    """
    ready = planned.where("page_id is not null").select(F.col("node_id").alias("parent_node_id"), F.col("page_id").alias("p1"))
    made = done.select(F.col("node_id").alias("parent_node_id"), F.col("page_id").alias("p2"))
    todo = planned.where("status not in ('skip', 'error')").join(done.select("node_id"), "node_id", "left_anti")
    out = todo.join(ready, "parent_node_id", "left").join(made, "parent_node_id", "left").withColumn("target", F.coalesce("p2", "p1"))
    return out.select("node_id", "title", "status", "parent_node_id", "target", (F.col("parent_node_id").isNull() | F.col("target").isNotNull()).alias("ready"))


def numbered(nodes: DataFrame, depth: int = 3) -> DataFrame:
    """node_id, number: hierarchical numbers such as 1.2.3 for nodes (node_id, parent_node_id, ord) of up to ``depth`` levels."""
    w = Window.partitionBy("parent_node_id").orderBy("ord")
    rows = nodes.select("node_id", "parent_node_id", F.row_number().over(w).cast("string").alias("own"))
    level = rows.where("parent_node_id is null").select("node_id", F.col("own").alias("number"))
    out = level
    for _ in range(depth - 1):
        up = level.select(F.col("node_id").alias("parent_node_id"), F.col("number").alias("up"))
        level = rows.join(up, "parent_node_id").select("node_id", F.concat_ws(".", "up", "own").alias("number"))
        out = out.unionByName(level)
    return out
