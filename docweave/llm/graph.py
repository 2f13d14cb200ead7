"""Connected components of a graph too large for one machine.

Alternating star contraction: every edge end moves to its smallest known neighbour until nothing changes.
Minima are aggregated before the shuffle and kept as tables, so that the joins on a hub's id are plain
shuffle joins which adaptive execution can split; edges never meet in one task by design.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, materialise


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the components of the edges a-b, root the smallest id; vectorised union-find."""
    ids, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        root = root[root]
        if np.array_equal(root, before):
            return ids, ids[root]


def _local(batches):
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if len(a):
            node, root = forest(a, b)
            keep = node != root
            yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(root[keep])], ["hi", "lo"])


def components(edges: DataFrame, max_rounds: int = 60, arrow: bool = True) -> DataFrame:
    """(node, component) of every node with an edge (a, b); component is the smallest id it reaches.

    ``arrow`` thins out the edges of each batch first; without it, everything runs in the JVM.
    """
    e = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    e = e.mapInArrow(_local, "hi long, lo long") if arrow else e.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    now = materialise(e.distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        both = now.select(F.col("hi").alias("n"), F.col("lo").alias("m")).union(now.select(F.col("lo"), F.col("hi")))
        low = materialise(both.groupBy("n").agg(F.min("m").alias("m")).where("m < n"), "low")
        large = now.join(low, now.lo == low.n, "left").select("hi", F.coalesce("m", "lo").alias("lo")).where("hi <> lo")
        least = materialise(large.groupBy(F.col("hi").alias("n")).agg(F.min("lo").alias("m")), "least")
        small = large.join(least, large.hi == least.n).select("hi", "lo", "m")
        small = small.select(F.explode(F.array(F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("x")).select("x.*").where("hi <> lo")
        after = materialise(small.distinct(), "edges")
        said = after.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        for old in (now, low, least):
            drop(old)
        now = after
        if said == mark:
            break
        mark = said
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)
