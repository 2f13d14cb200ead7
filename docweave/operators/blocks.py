"""Blocks, contexts, owners and sections by windows and higher-order functions, without a scanner."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def paragraph_units(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, unit, start, end, source: units of plain texts, one per run of lines between blank lines.

    Everything is one generator over the text split at blank lines; offsets come from the lengths of what went before.
    """
    gap = r"\n[ \t]*(?:\n[ \t]*)+"
    t = F.coalesce(F.col(text), F.lit(""))
    parts, gaps = F.split(t, gap, -1), F.regexp_extract_all(t, F.lit(gap), F.lit(0))
    rows = docs.select(F.col(key), F.posexplode(F.arrays_zip(parts.alias("p"), gaps.alias("g"))).alias("i", "x"))
    size = F.length("x.p") + F.coalesce(F.length("x.g"), F.lit(0))
    w = Window.partitionBy(key).orderBy("i")
    before = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - size
    rows = rows.select(key, "i", F.col("x.p").alias("source"), before.alias("start")).where(F.col("source").rlike("[A-Za-z]"))
    return rows.select(key, F.row_number().over(w).alias("unit"), "start", (F.col("start") + F.length("source")).alias("end"), "source")


def context(items: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Adds the nearest value on either side by offset; items that begin at the same place are no neighbours.

    Both frames grow from the first row, one of them in descending order, so each is evaluated once along a group.
    """
    before = F.last(value).over(Window.partitionBy(key).orderBy(order).rangeBetween(Window.unboundedPreceding, -1))
    after = F.last(value).over(Window.partitionBy(key).orderBy(F.desc(order)).rangeBetween(Window.unboundedPreceding, -1))
    return items.withColumn("context_before", F.coalesce(before, F.lit(""))).withColumn("context_after", F.coalesce(after, F.lit("")))


def merged_context(units: DataFrame, regions: DataFrame, key: str = "doc_id") -> DataFrame:
    """Context of units and regions (key, start, value) among both lists, in order of their starts; ``kind`` tells them apart."""
    both = units.select(key, "start", "value", F.lit("unit").alias("kind")).unionByName(regions.select(key, "start", "value", F.lit("region").alias("kind")))
    return context(both, key, "start", "value")


def pack(units: DataFrame, limit: int, keys: list[str], order: str = "unit", size: str = "chars") -> DataFrame:
    """Adds block, counted from 1 in each group: a block closes before a unit that would exceed ``limit``; a larger unit stands alone.

    The sequence is serial within a group. Groups are brought together in order, and one pass over a partition carries the
    open block from row to row: nothing is collected, whatever a group's size.
    """
    names = units.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, block, room = None, 0, 0
        for batch in batches:
            made = []
            for *own, n in zip(*(batch.column(c).to_pylist() for c in [*keys, size]), strict=True):
                if own != group:
                    group, block, room = own, 0, 0
                if block == 0 or n > room:
                    block, room = block + 1, limit
                room -= n
                made.append(block)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.int32())], [*names, "block"])

    schema = StructType([*units.schema.fields]).add("block", "integer")
    return units.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)


def block_totals(packed: DataFrame, keys: list[str]) -> DataFrame:
    return packed.groupBy(*keys, "block").agg(F.count("*").alias("unit_count"), F.min("unit").alias("first_unit"), F.max("unit").alias("last_unit"), F.sum("chars").alias("chars"), F.sum(F.octet_length("source")).alias("bytes"))


def fingerprint(packed: DataFrame, keys: list[str]) -> DataFrame:
    """A plan's hash: block numbers, unit numbers and hashes of the units' texts, in order."""
    line = F.concat_ws(":", F.col("block"), F.col("unit"), F.sha2(F.col("source").cast("binary"), 256))
    rows = packed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("unit", line.alias("line")))).alias("x"))
    return rows.select(*keys, F.sha2(F.array_join(F.transform("x", lambda u: u["line"]), "\n").cast("binary"), 256).alias("fingerprint"))


def owners(units: DataFrame, headings: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds owner: the start of the last heading at or before the unit (as-of, backward), null before the first.

    One sort of both sides together, no range join.
    """
    both = units.select(key, F.col("start"), F.lit(1).alias("kind"), F.col("unit"), F.lit(None).cast("int").alias("level")).unionByName(headings.select(key, "start", F.lit(0).alias("kind"), F.lit(None).cast("int").alias("unit"), F.col("level").cast("int").alias("level")))
    w = Window.partitionBy(key).orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owner = F.last(F.when(F.col("kind") == 0, F.col("start")), ignorenulls=True).over(w)
    # Chars of headings of level 4 and deeper count for the last one of level 3 or less.
    shown = F.last(F.when((F.col("kind") == 0) & (F.col("level") <= 3), F.col("start")), ignorenulls=True).over(w)
    found = both.withColumn("owner", owner).withColumn("shown", shown).where("kind = 1").select(key, "unit", "owner", "shown")
    return units.join(found, [key, "unit"])


def section_chars(units: DataFrame, headings: DataFrame, key: str = "doc_id") -> DataFrame:
    found = owners(units, headings, key)
    return found.groupBy(key, F.coalesce("shown", F.lit(-1)).alias("section_start")).agg(F.sum("chars").alias("chars"), F.count("*").alias("units"))


def spliced(docs: DataFrame, edits: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, rendered, valid: the text with edits (start, end, value) put in; overlaps or bounds violations make it invalid."""
    rows = edits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "value"))).alias("e"))
    t = F.col(text)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(True).alias("ok"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fine = acc["ok"] & (x["start"] >= acc["at"]) & (x["end"] >= x["start"]) & (x["end"] <= F.length(t))
        gap = F.substr(t, (acc["at"] + 1).cast("int"), F.greatest(F.lit(0), x["start"] - acc["at"]).cast("int"))
        return F.struct(x["end"].cast("long").alias("at"), fine.alias("ok"), F.concat(acc["out"], F.array(gap, x["value"])).alias("out"))

    joined = docs.select(key, text).join(rows, key, "left").withColumn("f", F.aggregate(F.coalesce("e", F.array().cast(edits_type(edits))), start, step))
    tail = F.substr(t, (F.col("f.at") + 1).cast("int"), F.lit(2**31 - 1))
    return joined.select(key, F.when(F.col("f.ok"), F.concat(F.array_join("f.out", ""), tail)).alias("rendered"), F.col("f.ok").alias("valid"))


def edits_type(edits: DataFrame) -> str:
    s = edits.schema
    return f"array<struct<start:{s['start'].dataType.simpleString()},end:{s['end'].dataType.simpleString()},value:string>>"


def level_counts(headings: DataFrame, key: str = "doc_id") -> DataFrame:
    return headings.where("level <= 3").groupBy(key).pivot("level", [1, 2, 3]).count().na.fill(0)
