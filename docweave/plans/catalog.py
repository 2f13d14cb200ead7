"""The registry of queries, and literal rows that the queries and their oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with a DuckDB statement where SQL can express it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, ddl: str, data: list[tuple]) -> DataFrame:
    return spark.createDataFrame(data, ddl)


_TYPES = {"long": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(_literal, v)) + "]"
    return "'" + v.replace("'", "''") + "'"


def expected(ddl: str, data: list[tuple]) -> str:
    """A DuckDB statement for literal rows, written down by hand from the rule and not computed."""
    fields = [x.rsplit(" ", 1) for x in ddl.split(", ")]
    names = ", ".join(n for n, _ in fields)
    casts = ", ".join(f"CAST({n} AS {_TYPES.get(t, 'VARCHAR')}) AS {n}" for n, t in fields)
    values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in data)
    return f"SELECT {casts} FROM (VALUES {values}) AS t({names})"
