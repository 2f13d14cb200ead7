"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its nearest reference points (pivots) in order. Two vectors that nearly coincide share most of
their nearest pivots, so the index lists vectors under every combination of ``shared`` of their nearest pivots: meeting in
such a list means at least ``shared`` common pivots. A pair is judged only in the smallest list that both are in, so links
are counted once. Lists are cut into chunks and tasks hold two chunks at most; the exact cosine decides, and a task returns
a number of links per vector and a spanning forest, never the pairs.

The pivots come from a bounded, documented sample; every vector is indexed. Their number grows with the square root of the
vectors', so that lists stay of one length on average, and the prefix grows with the number of pivots, so that recall stays.
Equal vectors of a label form one class first, with its size as weight, so copies meet in no list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .graph import components, forest
from .minhash import by_unit, in_chunks
from .scratch import materialise
from .textops import U64, mix


@dataclass(frozen=True)
class Params:
    threshold: float = 0.93
    least: int = 64  # pivots of up to ``base`` vectors
    base: int = 1 << 18
    sample: int = 4  # rows for each pivot that the pivots are chosen from; 2048 at least
    prefix: int = 5  # of 64 pivots; one more for each eightfold number
    shared: int = 2
    chunk: int = 256

    def pivots(self, vectors: int) -> int:
        return int(self.least * max(1.0, vectors / self.base) ** 0.5)

    def length(self, pivots: int) -> int:
        return min(pivots, self.prefix + max(0, round(np.log2(max(1, pivots) / self.least) / 3 + 0.49)))


def _components(vectors: DataFrame) -> F.Column:
    """Single precision as it is (half the bytes to move), anything else as double; tasks compute in double precision."""
    single = isinstance(vectors.schema["embedding"].dataType.elementType, FloatType)
    return F.col("embedding") if single else F.transform("embedding", lambda c: c.cast("double"))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v): label not null; v without nulls or non-finite components, not all zero."""
    v = _components(vectors)
    bad = F.exists(F.coalesce("v", F.array()), lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda c: c != 0))


def _stack(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    m = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)
    return m / np.linalg.norm(m / np.abs(m).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(m).max(axis=1, keepdims=True)


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first traversal: each pivot is the sample row farthest from those chosen before."""
    chosen = [0]
    near = sample @ sample[0]
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, sample @ sample[chosen[-1]])
    return sample[chosen]


def prefixes(m: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """Ordered indices of the ``length`` nearest pivots of each row."""
    return np.argsort(-(m @ pivots.T), axis=1, kind="stable")[:, :length]


def near_duplicate_vectors(vectors: DataFrame, p: Params = Params()) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label).

    Links join vectors of one label with cosine >= threshold in double precision. Null, zero or unusable vectors and null
    labels have no links; a null vec_id has none either, a null component, and is kept. Vectors of different dimensions are
    never compared. Repeated ids are separate rows, each with the links of its own vector. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors).withColumn("d", F.size("v"))
    same = rows.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("d").alias("d"))
    classes = materialise(same.withColumn("node", F.monotonically_increasing_id()), "classes")
    edges, counts = [], []
    for r in classes.groupBy("d").agg(F.count("*").alias("n")).orderBy("d").collect():  # one pass for each dimension, of which there are few
        of = classes.where(F.col("d") == r["d"])
        pivots = p.pivots(r["n"])
        # In an order by content: reruns choose the same pivots.
        seed = _stack(of.select("rep", "v").orderBy(F.xxhash64("v"), "rep").limit(max(2048, p.sample * pivots)).toArrow().column("v"))
        index = spark.sparkContext.broadcast(choose_pivots(seed, pivots))
        posted = materialise(_post(of, index, p), "postings")
        units = in_chunks(posted, "list", p.chunk, ["node", "near", "combo"]).join(of.select("node", "weight", "v"), "node")
        found = materialise(units.repartition("unit").sortWithinPartitions("unit", "g", "i", "j").mapInArrow(_judge(p), "a long, b long, links long"), "links")
        edges.append(found.where("b is not null").select("a", "b"))
        counts.append(found.where("links > 0").select("a", "links"))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", _components(vectors).alias("v"))
    if not edges:
        return out.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    joined = edges[0]
    for more in edges[1:]:
        joined = joined.union(more)
    summed = counts[0]
    for more in counts[1:]:
        summed = summed.union(more)
    found = materialise(components(joined), "components")
    least = found.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
    found = found.join(least, "component").select("node", "least")
    links = summed.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    of_class = classes.select("label", "v", "node", "rep", "weight").join(links, "node", "left").join(found, "node", "left")
    of_class = materialise(of_class.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("least", "rep").alias("component")), "classes")
    # A class of a third of all rows is one hot key of this join; adaptive execution splits plain shuffle joins.
    out = out.join(of_class, ["label", "v"], "left")
    known = F.col("vec_id").isNotNull()
    out = out.select("vec_id", F.when(known, F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"), F.when(known, F.coalesce("component", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _post(classes: DataFrame, index, p: Params) -> DataFrame:
    """Inverted lists: a row for each vector and each combination of its nearest pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = index.value
        length = p.length(len(pivots))
        take = np.array(list(combinations(range(length), min(p.shared, length))))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                near = np.sort(prefixes(_stack(b.column("v")), pivots, length), axis=1).astype(np.uint32)
                sets = near[:, take]  # rows x combinations x shared, each in order
                n, c = sets.shape[:2]
                rows = np.repeat(np.arange(n), c)
                key = mix(b.column("label_key").to_numpy().view(U64)[rows] + U64(17))
                for k in range(sets.shape[2]):
                    key = mix(key ^ sets[:, :, k].ravel().astype(U64))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(b.column("node").to_numpy()[rows]), _blobs(near[rows]), _blobs(sets.reshape(n * c, -1))], ["list", "node", "near", "combo"])

    # The vectors themselves follow once the lists are cut, and only to lists of two or more.
    return classes.select("node", "v", F.xxhash64("label").alias("label_key")).mapInArrow(run, "list long, node long, near binary, combo binary")


def _blobs(m: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    m = np.ascontiguousarray(m)
    offsets = (np.arange(len(m) + 1) * m.shape[1] * m.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(offsets), pa.py_buffer(m.tobytes())])


def _first_common(x: np.ndarray, y: np.ndarray, shared: int) -> np.ndarray:
    """For pairs of sorted prefixes the ``shared`` smallest pivots that both have."""
    both = (x[:, :, None] == y[:, None, :]).any(axis=2)
    return np.sort(np.where(both, x, np.uint32(0xFFFFFFFF)), axis=1)[:, :shared]


def _judge(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_unit(batches):
            node, side = t.column("node").to_numpy(), t.column("side").to_numpy()
            weight = t.column("weight").to_numpy()
            near = np.frombuffer(b"".join(t.column("near").to_pylist()), np.uint32).reshape(len(node), -1)
            combo = np.frombuffer(t.column("combo")[0].as_py(), np.uint32)
            m = _stack(t.column("v"))
            left = np.flatnonzero(side == 0)
            right = np.flatnonzero(side == 1) if side.any() else left
            hit = m[left] @ m[right].T >= p.threshold
            x, y = np.nonzero(hit)
            x, y = left[x], right[y]
            if not side.any():
                x, y = x[x < y], y[x < y]
            mine = (_first_common(near[x], near[y], len(combo)) == combo).all(axis=1)  # the smallest list that both are in
            x, y = x[mine], y[mine]
            if not len(x):
                continue
            links = np.bincount(x, weight[y], len(node)) + np.bincount(y, weight[x], len(node))
            has = np.flatnonzero(links)
            ids, root = forest(node[x], node[y])
            off = ids != root
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([ids[off], node[has]])), pa.array(np.concatenate([root[off], np.zeros(len(has), np.int64)]), mask=np.arange(off.sum() + len(has)) >= off.sum()), pa.array(np.concatenate([np.zeros(off.sum(), np.int64), links[has].astype(np.int64)]))],
                ["a", "b", "links"],
            )

    return run
