"""Python functions over rows, in Arrow batches: one wide call per row, nothing per column.

A scanner goes down one call per level of nesting. Calls of Python functions need no machine stack, so ``DEPTH`` levels are
allowed; a row nested more deeply costs itself alone, never the job.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

STEP = 256
DEPTH = 50_000


def schema_of(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


def flat_map(df: DataFrame, columns: list[str], make: Callable[..., Iterable[dict]], ddl: str) -> DataFrame:
    """Rows that ``make(*columns)`` yields for each row, as the schema ``ddl``. Only ``columns`` leave the JVM.

    A row nested too deeply gives one row with those of its columns that the schema has, ``error`` if that is one of them,
    and nulls.
    """
    out = to_arrow_schema(schema_of(ddl))

    def made(row: tuple) -> list[dict]:
        try:
            return list(make(*row))
        except RecursionError as e:
            own = {c: v for c, v in zip(columns, row, strict=True) if c in out.names}
            return [own | ({"error": f"RecursionError: {e}"} if "error" in out.names else {})]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), DEPTH))
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                values = [part.column(i).to_pylist() for i in range(part.num_columns)]
                rows = [x for row in zip(*values, strict=True) for x in made(row)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=out)

    return df.select(*columns).mapInArrow(run, ddl)


def map_rows(df: DataFrame, columns: list[str], make: Callable[..., dict], ddl: str) -> DataFrame:
    return flat_map(df, columns, lambda *row: [make(*row)], ddl)
