"""Every registered query of the engine against its SQL oracle on the smallest tables."""

import duckdb
import pytest

from docweave.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: round(v, 6) if isinstance(v, float) else v
    return [columns[i] for i in order], sorted(tuple(repr(value(r[i])) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_oracle(spark, sf, duck, name):
    found = QUERIES[name](spark, sf)
    got = canonical([tuple(r) for r in found.collect()], found.columns)
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert got == canonical(result.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_oracle(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0


def test_entry(spark, sf):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
