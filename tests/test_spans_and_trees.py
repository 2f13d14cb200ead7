"""Sweeps over spans and numbers of trees against plain loops."""

import random
import time

import pytest
from pyspark.sql import functions as F

from docweave.operators import spans, trees

SPAN = "u int, start int, end int"


def random_spans(n, seed, long=12):
    rng = random.Random(seed)
    return [(rng.randrange(4), s, s + rng.randrange(long)) for s in (rng.randrange(80) for _ in range(n))]


def test_containment_and_overlap(spark):
    inner, outer = random_spans(150, 1) + [(None, 3, 4), (2, None, 5)], random_spans(30, 2, 25) + [(None, 1, 9)]
    a, b = spark.createDataFrame(inner, SPAN), spark.createDataFrame(outer, SPAN)
    found = sorted(map(repr, [tuple(r) for r in spans.contained(a, b, "u").collect()]))
    want = [(u, s, e, s is not None and any(v == u and x <= s and e <= y for v, x, y in outer)) for u, s, e in inner]
    assert found == sorted(map(repr, want))
    real = [x for x in inner if x[1] is not None]
    got = sorted(map(repr, [tuple(r) for r in spans.overlapping(spark.createDataFrame(real, SPAN), "u").collect()]))
    meets = lambda x, y: x[0] == y[0] and x[1] < y[2] and y[1] < x[2]
    full = [x for x in real if x[2] > x[1]]
    pairs = spans.overlap_pairs(spark.createDataFrame(full, SPAN), b, "u", 7)
    assert sorted(repr((tuple(r["a"]), tuple(r["b"]))) for r in pairs.collect()) == sorted(repr((x, y)) for x in full for y in outer if x[0] is not None and y[1] is not None and y[2] > y[1] and meets(x, y))
    by = {repr((*x, any(meets(x, y) for j, y in enumerate(real) if i != j))) for i, x in enumerate(real) if x[2] > x[1]}
    assert {g for g in got if eval(g)[2] > eval(g)[1]} == by  # noqa: S307


def plain_crossing(pairs):
    best = {}
    for u, n, a, b in pairs:
        for v, m, c, d in pairs:
            if u == v and a < c < b < d and (u not in best or (b, -c) < best[u][0]):
                best[u] = ((b, -c), n, m)
    return {u: (n, m, key[0]) for u, (key, n, m) in best.items()}


def test_first_crossing(spark):
    rng = random.Random(3)
    pairs = []
    for u in range(60):
        places = rng.sample(range(100), 2 * rng.randrange(1, 6))
        pairs += [(u, f"m{i}", *sorted(places[2 * i : 2 * i + 2])) for i in range(len(places) // 2)]
    pairs += [(100, "a", 1, 10), (100, "b", 2, 9), (100, "c", 3, 4), (101, "a", 5, 5), (101, "b", 7, 2)]
    df = spark.createDataFrame(pairs, "u int, n string, open int, close int")
    found = {r["u"]: (r["n"], r["other"], r["at"]) for r in spans.first_crossing(df, "u", "n").collect()}
    want = plain_crossing([p for p in pairs if p[2] < p[3]])
    assert found == want and 20 < len(found) < 60
    assert spans.reversed_pairs(df).count() == 2


def test_a_unit_of_many_spans(spark):
    df = spark.range(100_000).select(F.lit(1).alias("u"), F.col("id").cast("string").alias("n"), F.col("id").alias("open"), (F.lit(1_000_000) - F.col("id")).alias("close")).cache()
    df.count()
    began = time.time()
    assert spans.first_crossing(df, "u", "n").count() == 0
    assert spans.contained(df.withColumnsRenamed({"open": "start", "close": "end"}), df.withColumnsRenamed({"open": "start", "close": "end"}), "u").where("inside").count() == 100_000
    assert time.time() - began < 30


# --- trees ----------------------------------------------------------------------------------------------------------


def plain_order(rows):
    ids = {r[0] for r in rows}
    up = {n: (p if p in ids and p != n else None) for n, p, _ in rows}
    children = {}
    for n, p, o in sorted(rows, key=lambda r: r[2]):
        children.setdefault(up[n], []).append(n)
    out, number, pre, post = {}, {}, [0], [0]
    stack = [(n, 0, str(i + 1), False) for i, n in enumerate(children.get(None, []))][::-1]
    first = {}
    while stack:
        n, depth, name, done = stack.pop()
        if done:
            out[n] = (depth, first[n], post[0], pre[0] - first[n])
            post[0] += 1
            continue
        first[n], number[n] = pre[0], name
        pre[0] += 1
        stack.append((n, depth, name, True))
        stack += [(c, depth + 1, f"{name}.{i + 1}", False) for i, c in enumerate(children.get(n, []))][::-1]
    return out, number, ids - set(out)


def random_tree(n, kind, seed=1):
    rng = random.Random(seed)
    up = {"bushy": lambda i: rng.randrange(i), "chain": lambda i: max(0, i - 1 - (i % 3 == 0)), "flat": lambda i: 0, "forest": lambda i: None if i % 9 == 0 else rng.randrange(i)}[kind]
    return [(i, None if i == 0 else up(i), (i * 37) % 1009 + 1009 * i % 7 * 2000) for i in range(n)]


@pytest.mark.parametrize("kind", ["bushy", "chain", "flat", "forest"])
def test_orders_and_numbers(spark, kind):
    rows = random_tree(160, kind)
    rows = [(n, p, 1000 * i + o % 7) for i, (n, p, o) in enumerate(rows)]
    df = spark.createDataFrame(rows, "node_id long, parent_node_id long, ord long").repartition(3)
    order, number, lost = plain_order(rows)
    found = trees.ordered(df)
    assert {r["node_id"]: (r["depth"], r["pre"], r["post"], r["size"]) for r in found.collect()} == order and not lost
    if kind in ("bushy", "forest"):
        assert {r["node_id"]: r["number"] for r in trees.numbers(df).collect()} == number


def test_cycles_missing_parents_and_repeats(spark):
    rows = [(1, 2, 1), (2, 1, 2), (3, 1, 3), (4, 4, 4), (5, 99, 5), (6, 5, 6), (6, 5, 6), (None, 5, 7), (7, 6, 8)]
    df = spark.createDataFrame(rows, "node_id long, parent_node_id long, ord long")
    found = {r["node_id"]: (r["depth"], r["pre"], r["post"], r["size"]) for r in trees.ordered(df).collect()}
    assert found == {1: (None,) * 4, 2: (None,) * 4, 3: (None,) * 4, 4: (0, 0, 0, 1), 5: (0, 1, 3, 3), 6: (1, 2, 2, 2), 7: (2, 3, 1, 1)}
    assert {r["node_id"] for r in trees.cycles(df).collect()} == {1, 2, 3}
    assert trees.ordered(df.limit(0)).collect() == []
    held = trees.inside(trees.ordered(df), trees.ordered(df).where("node_id in (5, 6)"))
    assert sorted(map(tuple, held.collect())) == [(5, 6), (5, 7), (6, 7)]
