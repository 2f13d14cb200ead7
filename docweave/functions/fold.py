"""Folds over arrays that give something for each element.

Appending copies an array, and so does cutting a part out of one. Both are held down by parts of about the square root of
the number of elements: work grows with its power of 1.5, and linearly up to a few thousand elements.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST = 16


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` where ``value`` is computed once, however often it occurs."""
    return F.transform(F.array(value), use)[0]


def states(items: Column, start: Column, step: Callable[[Column, Column], Column], ddl: str) -> Column:
    """The state (of type ``ddl``) before each item and the one after the last: size(items) + 1 states.

    Parts of states are made on their own and joined at the end.
    """
    part = F.greatest(F.lit(LEAST), F.ceil(F.sqrt(F.size(items))).cast("int"))

    def one(own: Column, x: Column) -> Column:
        return F.concat(own, F.array(step(F.element_at(own, -1), x)))

    def more(parts: Column, i: Column) -> Column:
        first = F.array(F.element_at(F.element_at(parts, -1), -1))
        return F.concat(parts, F.array(F.aggregate(F.slice(items, i * part + 1, part), first, one)))

    begin = F.array(F.array(start.cast(ddl)))
    numbers = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.floor((F.size(items) - 1) / part).cast("int"))).otherwise(F.array().cast("array<int>"))
    parts = F.aggregate(numbers, begin, more)
    # Each part begins with the state that the one before ended with.
    return F.concat(F.flatten(F.transform(parts, lambda p: F.slice(p, F.lit(1), F.size(p) - 1))), F.slice(F.element_at(parts, -1), -1, 1))


def tokens(text: Column, pattern: str) -> Column:
    """The matches of ``pattern`` as (start, end, value) with code point offsets; the pattern never matches nothing."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.transform(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("value")), lambda x: F.struct(F.length(x["gap"]).alias("gap"), x["value"].alias("value")))

    def placed(own: Column) -> Column:
        at = states(own, F.lit(0), lambda at, x: at + x["gap"] + F.coalesce(F.length(x["value"]), F.lit(0)), "int")
        return bind(at, lambda ends: F.transform(own, lambda x, i: F.struct((ends[i] + x["gap"]).alias("start"), ends[i + 1].alias("end"), x["value"].alias("value"))))

    # The last piece is the text after the last match.
    return F.when(F.size(found) > 0, bind(pieces, lambda p: bind(placed(p), lambda own: F.slice(own, F.lit(1), F.size(own) - 1)))).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))
