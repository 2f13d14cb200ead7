"""State along groups, against plain loops, with chunks so narrow that every carry counts."""

import random

import pytest
from pyspark.sql import functions as F

from docweave.functions import fold
from docweave.operators import blocks, prefix


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = [(k, 3 * i + 1, rng.choice([None, 0, 1, 2, 3, 9, 10, 25]), rng.randrange(3)) for k, n in ((1, 300), (2, 1), (None, 77), (4, 40)) for i in range(n)]
    return data, spark.createDataFrame(data, "k long, o long, v long, s int").repartition(5).cache()


def by_key(data):
    out = {}
    for r in sorted(data, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("width", [1, 7, 4096])
def test_running_values(rows, width):
    data, df = rows
    out = prefix.running_last(prefix.running_sum(df, ["k"], "o", F.col("v"), "total", width), ["k"], "o", F.when(F.col("v") > 2, F.col("v")), "last", width)
    found = {(r["k"], r["o"]): (r["total"], r["last"]) for r in out.collect()}
    assert len(found) == len(data)
    for k, own in by_key(data).items():
        total, last = 0, None
        for _, o, v, _ in own:
            total += v or 0
            last = v if v is not None and v > 2 else last
            assert found[k, o] == (total, last)


@pytest.mark.parametrize("width", [1, 10, 1024])
def test_automaton(rows, width):
    data, df = rows
    table = [[1, 0, 3], [2, 2, 0], [0, 1, 2], [3, 0, 1]]
    out = prefix.automaton(df, ["k"], "o", F.col("s"), table, width=width)
    assert out.columns == [*df.columns, "state"]
    found = {(r["k"], r["o"]): r["state"] for r in out.collect()}
    assert len(found) == len(data)
    for k, own in by_key(data).items():
        state = 0
        for _, o, _, s in own:
            assert found[k, o] == state
            state = table[state][s]


@pytest.mark.parametrize(("limit", "wide"), [(10, 1), (10, 3), (25, 2), (1, 1), (1000, 1)])
def test_packing_equals_the_serial_rule(rows, limit, wide):
    data, df = rows
    found = {(r["k"], r["o"]): r["block"] for r in prefix.packed(df, ["k"], "o", limit, "v", wide).collect()}
    plain = {(r["k"], r["o"]): r["block"] for r in blocks.pack(df.na.fill(0, ["v"]), limit, ["k"], "o", "v").collect()}
    for k, own in by_key(data).items():
        block, used = 0, None
        for _, o, v, _ in own:
            if used is None or used + (v or 0) > limit:
                block, used = block + 1, v or 0
            else:
                used += v or 0
            assert found[k, o] == block == plain[k, o]


def test_empty_groups(rows):
    none = rows[1].limit(0)
    assert prefix.running_sum(none, ["k"], "o", F.col("v"), "x").collect() == []
    assert prefix.automaton(none, ["k"], "o", F.col("s"), [[0, 0, 0]]).collect() == []
    assert prefix.packed(none, ["k"], "o", 5, "v").collect() == []


def test_one_long_text_runs_in_many_tasks(spark):
    """No stage of the plan deals rows by the group alone: chunks are part of every key but that of the summaries."""
    df = spark.range(200_000).select(F.lit(1).alias("k"), F.col("id").alias("o"), (F.col("id") % 7).alias("v"))
    out = prefix.packed(df, ["k"], "o", 50, "v")
    assert out.agg(F.max("block")).first()[0] == blocks.pack(df, 50, ["k"], "o", "v").agg(F.max("block")).first()[0]
    parity = prefix.automaton(df, ["k"], "o", (F.col("v") == 3).cast("int"), [[0, 1], [1, 0]])
    assert parity.where("state <> (o + 3) div 7 % 2").count() == 0


def test_folds(spark):
    texts = ["", "a$b$$c", "$", "é$日$", None, "$" * 500, "x" * 100]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = {r["i"]: [(x["start"], x["end"], x["value"]) for x in r["x"]] for r in df.select("i", fold.tokens(F.coalesce("t", F.lit("")), r"\$+").alias("x")).collect()}
    import re

    for i, t in enumerate(texts):
        assert found[i] == [(m.start(), m.end(), m[0]) for m in re.finditer(r"\$+", t or "")]
    sums = spark.range(1).select(fold.states(F.sequence(F.lit(1), F.lit(1000)), F.lit(0), lambda a, x: a + x, "int").alias("x")).first()["x"]
    assert sums == [n * (n + 1) // 2 for n in range(1001)]
