"""Spans against spans by sweeps: containment, overlap and crossing, without comparing all pairs of a unit.

Spans are (start, end) with start <= end, by unit. A sweep orders a unit's spans by start and carries the furthest end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def contained(inner: DataFrame, outer: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """``inner`` with ``inside``: some span of ``outer`` of the same unit holds the whole span. Null bounds are inside nothing.

    A span lies in one that begins no later exactly if the furthest end of those that begin no later reaches its own end.
    """
    columns = inner.columns
    own = inner.select(F.col(key).alias("__k"), F.col(start).alias("__s"), F.lit(1).alias("__kind"), F.lit(None).cast("long").alias("__far"), F.struct(*columns).alias("__r"))
    held = outer.select(F.col(key).alias("__k"), F.col(start).alias("__s"), F.lit(0).alias("__kind"), F.col(end).cast("long").alias("__far"), F.lit(None).cast(own.schema["__r"].dataType).alias("__r"))
    w = Window.partitionBy("__k").orderBy("__s", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = own.unionByName(held.where("__s is not null")).withColumn("__far", F.max("__far").over(w)).where("__kind = 1")
    return both.select("__r.*", F.coalesce(F.col("__far") >= F.col(f"__r.{end}"), F.lit(False)).alias("inside")).select(*columns, "inside")


def overlapping(spans: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """``spans`` with ``overlaps``: some other span of the unit shares a place with it. Spans that only touch don't overlap.

    Of the spans before, the one that reaches furthest decides; of those after, the one that begins first. An empty span
    overlaps one that holds its place inside.
    """
    w = Window.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)) > F.col(start)
    after = F.lead(start).over(w) < F.col(end)
    return spans.withColumn("overlaps", F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False)))


def overlap_pairs(a: DataFrame, b: DataFrame, key: str, width: int, start: str = "start", end: str = "end") -> DataFrame:
    """Pairs of rows of ``a`` and ``b`` (as structs) of a unit that share a place, each once.

    Spans are dealt to bins of ``width`` places; a pair meets in each bin that both reach and counts in the first one. Work
    follows the spans' lengths in bins and the pairs in a bin; choose a width about that of a usual span.
    """

    def dealt(rows: DataFrame, name: str) -> DataFrame:
        bins = F.sequence(F.floor(F.col(start) / width), F.floor((F.greatest(F.col(end), F.col(start) + 1) - 1) / width))
        return rows.where((F.col(end) > F.col(start))).select(F.col(key).alias("__k"), F.explode(bins).alias("__bin"), F.struct(*rows.columns).alias(name))

    both = dealt(a, "a").join(dealt(b, "b"), ["__k", "__bin"])
    shared = (F.col(f"a.{start}") < F.col(f"b.{end}")) & (F.col(f"b.{start}") < F.col(f"a.{end}"))
    first = F.floor(F.greatest(F.col(f"a.{start}"), F.col(f"b.{start}")) / width) == F.col("__bin")
    return both.where(shared & first).select("a", "b")


def first_crossing(pairs: DataFrame, key: str, name: str, open_: str = "open", close: str = "close") -> DataFrame:
    """key, name, other, at: where marker pairs of a unit cross first (a < c < b < d), one row for each unit that has a crossing.

    ``name`` closes at ``at`` while ``other``, opened later, is still open. If pairs are nested, each close belongs to the
    open right before it among the marks of its depth; at the first close that doesn't, the pairs cross, and where they
    cross there is such a close. Places are distinct within a unit; pairs that don't open before they close are left out.
    """
    right = pairs.where(F.col(open_) < F.col(close))
    both = F.array(F.struct(F.col(open_).alias("at"), F.lit(1).alias("step")), F.struct(F.col(close).alias("at"), F.lit(-1).alias("step")))
    marks = right.select(key, F.col(name).alias("__name"), F.explode(both).alias("x")).select(key, "__name", "x.*")
    depth = F.sum("step").over(Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    level = marks.withColumn("__level", depth + F.when(F.col("step") < 0, 1).otherwise(0))
    w = Window.partitionBy(key, "__level").orderBy("at")
    wrong = level.withColumn("__other", F.lag("__name").over(w)).where((F.col("step") < 0) & ~F.col("__name").eqNullSafe(F.col("__other")))
    first = wrong.groupBy(key).agg(F.min(F.struct("at", F.col("__name").alias("n"), F.col("__other").alias("o"))).alias("x"))
    return first.select(key, F.col("x.n").alias(name), F.col("x.o").alias("other"), F.col("x.at").alias("at"))


def reversed_pairs(pairs: DataFrame, open_: str = "open", close: str = "close") -> DataFrame:
    """The pairs that close at or before the place where they open."""
    return pairs.where(F.col(open_) >= F.col(close))
