"""State that runs along a group, without a task that ever sees the whole group.

A group's rows are cut into chunks by their order value, so that no ranking of the group is needed. A chunk is summarised
(a sum, a last value, a table of transitions); the summaries of a group are combined in order; and each chunk starts from
the state that reaches it. What is serial in a group is a list of summaries, one for ``width`` rows, never its rows.

Keys may be null. The order value is an integer that is unique within its group; null order values are not allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from ..functions.fold import states

CHUNK = "__chunk"


def chunked(rows: DataFrame, order: str, width: int) -> DataFrame:
    return rows.withColumn(CHUNK, F.expr(f"cast(`{order}` as bigint) div {width}L"))


def with_carry(rows: DataFrame, carry: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``rows`` with the columns that ``carry`` has for their keys and chunk; null keys meet as well."""
    on = [*keys, CHUNK]
    right = carry.select(*(F.col(k).alias(f"__r{i}") for i, k in enumerate(on)), *(c for c in carry.columns if c not in on))
    same = [F.col(k).eqNullSafe(F.col(f"__r{i}")) for i, k in enumerate(on)]
    return rows.join(right, same, how).drop(*(f"__r{i}" for i in range(len(on))))


def running_sum(rows: DataFrame, keys: Sequence[str], order: str, value: Column, name: str, width: int = 4096) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` up to the row and with it. Nulls count as 0."""
    cut = chunked(rows.withColumn("__value", F.coalesce(value, F.lit(0))), order, width)
    total = cut.groupBy(*keys, CHUNK).agg(F.sum("__value").alias("__total"))
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = total.withColumn("__carry", F.coalesce(F.sum("__total").over(before), F.lit(0))).drop("__total")
    local = Window.partitionBy(*keys, CHUNK).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return with_carry(cut, carry, keys).withColumn(name, F.sum("__value").over(local) + F.col("__carry")).drop("__value", "__carry", CHUNK)


def running_last(rows: DataFrame, keys: Sequence[str], order: str, value: Column, name: str, width: int = 4096) -> DataFrame:
    """``rows`` with ``name``: the last ``value`` that isn't null, up to the row and with it."""
    cut = chunked(rows.withColumn("__value", value), order, width)
    last = cut.where("__value is not null").groupBy(*keys, CHUNK).agg(F.max_by("__value", order).alias("__last"))
    every = with_carry(cut.select(*keys, CHUNK).distinct(), last, keys, "left")
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = every.withColumn("__carry", F.last("__last", ignorenulls=True).over(before)).drop("__last")
    local = Window.partitionBy(*keys, CHUNK).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return with_carry(cut, carry, keys).withColumn(name, F.coalesce(F.last("__value", ignorenulls=True).over(local), F.col("__carry"))).drop("__value", "__carry", CHUNK)


def automaton(rows: DataFrame, keys: Sequence[str], order: str, symbol: Column, table: Sequence[Sequence[int]], name: str = "state", start: int = 0, width: int = 1024) -> DataFrame:
    """``rows`` with ``name``: the state of a finite automaton before the row. ``table[state][symbol]`` is the next state.

    A chunk's summary is the state it ends in for each state it may begin in; composing these in order gives each chunk its
    first state. Columns of ``rows`` must be of types that can be ordered.
    """
    symbols = len(table[0])
    flat = F.array(*(F.lit(x) for row in table for x in row))

    def step(state: Column, x: Column) -> Column:
        return flat[state * symbols + x]

    others = [c for c in rows.columns if c not in keys]
    own = F.struct(F.col(order).alias("o"), symbol.cast("int").alias("s"), F.struct(*(F.col(c) for c in others)).alias("r"))
    chunks = chunked(rows, order, width).groupBy(*keys, CHUNK).agg(F.array_sort(F.collect_list(own)).alias("__rows"))
    ends = F.array(*(F.aggregate("__rows", F.lit(s), lambda a, x: step(a, x["s"])) for s in range(len(table))))
    summaries = chunks.select(*keys, CHUNK, ends.alias("__ends")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(CHUNK, "__ends"))).alias("__all"))
    begins = states(F.col("__all"), F.lit(start), lambda s, x: x["__ends"][s], "int")
    carry = summaries.select(*keys, F.explode(F.arrays_zip(F.transform("__all", lambda x: x[CHUNK]).alias("c"), begins.alias("s"))).alias("x")).where("x.c is not null").select(*keys, F.col("x.c").alias(CHUNK), F.col("x.s").alias("__begin"))
    run = states(F.col("__rows"), F.col("__begin"), lambda s, x: step(s, x["s"]), "int")
    out = with_carry(chunks, carry, keys).select(*keys, F.explode(F.arrays_zip(F.transform("__rows", lambda x: x["r"]).alias("r"), run.alias("s"))).alias("x")).where("x.r is not null")
    return out.select(*keys, "x.r.*", F.col("x.s").alias(name)).select(*rows.columns, name)


# --- greedy packing -------------------------------------------------------------------------------------------------


def _next(before: np.ndarray, size: np.ndarray, limit: int) -> np.ndarray:
    """For a block that begins at each unit, the unit that begins the next one; a unit above the limit stands alone."""
    end = before + size
    return np.maximum(np.searchsorted(end, before + limit, "right"), np.arange(len(size)) + 1)


def packed(units: DataFrame, keys: Sequence[str], order: str, limit: int, size: str = "chars", wide: int = 64, width: int = 4096) -> DataFrame:
    """``units`` with ``block``, from 1 on in each group: a block closes before the unit that would take it over ``limit``.

    The serial rule in parallel: chunks hold about ``wide`` limits' worth of units. How a chunk goes on depends only on the
    room that its first block finds taken, and only through the unit at which that block closes, one of the units within
    the first ``limit``. So the table of a chunk has an entry for each of these, and tables are combined in order of chunks.
    Sizes are integers of 0 or more; null counts as 0. ``width`` is that of the running sum of sizes.
    """
    n = F.coalesce(F.col(size).cast("long"), F.lit(0))
    # Chunks are cut by size, counting every unit as one more, so that units of no size can't fill one.
    placed = running_sum(units.withColumn("__size", n), keys, order, n + 1, "__end", width)
    placed = placed.withColumn(CHUNK, F.floor((F.col("__end") - 1) / (wide * (limit + 1))).cast("long"))
    fields = StructType([placed.schema[k] for k in keys])
    groups = [*keys, CHUNK]

    def table_of(group: pa.Table) -> pa.Table:
        rows = group.sort_by(order)
        length = rows.column("__size").to_numpy()
        before = np.cumsum(length) - length
        head = int(np.searchsorted(before + length, limit, "right")) + 1  # the open block closes at one of these, or never
        after = _next(before, length, limit)
        count, taken = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        total = int(length.sum())
        for i in range(len(length) - 1, -1, -1):  # from the block that begins at i to the end of the chunk
            j = after[i]
            count[i], taken[i] = (1, total - before[i]) if j == len(length) else (count[j] + 1, taken[j])
        head = min(head, len(length))
        one = {k: [rows.column(k)[0].as_py()] for k in groups}
        one |= {"__close": [(before + length)[:head].tolist()], "__count": [count[:head].tolist()], "__taken": [taken[:head].tolist()], "__total": [total]}
        return pa.Table.from_pydict(one, schema=table_schema)

    def carry_of(group: pa.Table) -> pa.Table:
        rows = group.sort_by(CHUNK).to_pydict()
        block, used, out = 0, None, []
        for close, count, taken, total in zip(rows["__close"], rows["__count"], rows["__taken"], rows["__total"], strict=True):
            out.append((block, used))
            # A first block is opened by the first unit, as if an earlier one were full.
            at = 0 if used is None else int(np.searchsorted(np.array(close), limit - used, "right"))
            if used is not None and used + total <= limit:
                used += total
            else:
                block, used = block + count[at], taken[at]
        made = {k: rows[k] for k in groups} | {"__block": [b for b, _ in out], "__used": [u for _, u in out]}
        return pa.Table.from_pydict(made, schema=carry_schema)

    def replay(group: pa.Table) -> pa.Table:
        rows = group.sort_by(order)
        block, used = rows.column("__block")[0].as_py(), rows.column("__used")[0].as_py()
        made = []
        for x in rows.column("__size").to_pylist():
            if used is None or used + x > limit:
                block, used = block + 1, x
            else:
                used += x
            made.append(block)
        return rows.select(names).append_column("block", pa.array(made, pa.int32()))

    from pyspark.sql.pandas.types import to_arrow_schema

    longs = ArrayType(LongType())
    table_type = StructType([*fields, placed.schema[CHUNK]]).add("__close", longs).add("__count", longs).add("__taken", longs).add("__total", LongType())
    carry_type = StructType([*fields, placed.schema[CHUNK]]).add("__block", LongType()).add("__used", LongType())
    table_schema, carry_schema = to_arrow_schema(table_type), to_arrow_schema(carry_type)
    names = units.columns
    tables = placed.select(*groups, order, "__size").groupBy(*groups).applyInArrow(table_of, table_type)
    carry = tables.groupBy(*keys).applyInArrow(carry_of, carry_type)
    done = with_carry(placed, carry, keys).groupBy(*groups).applyInArrow(replay, StructType([*units.schema.fields]).add("block", IntegerType()))
    return done
