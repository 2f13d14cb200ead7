"""Centroid clustering (Lloyd) over distinct quantised vectors that carry their multiplicities, in exact integers.

Equal quantised vectors are grouped first, with partial counts before the shuffle, so a vector that a third of all rows
share is one row from then on. Each round assigns the distinct vectors to their nearest centroid and sums them, weighted,
as integers; tasks return at most one row per cluster, component and limb of 40 bits, so what reaches the driver depends
on clusters and dimensions alone. The assignment goes back to the vectors' ids by a join on a 128-bit key of the vector,
whose hot keys adaptive execution can split.

Integers are exact at any size: a component is a double that holds a whole number; products stay in doubles where they
are below 2^53 and are Python's integers beyond.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialise

LIMB = 40
_EXACT = 2.0**20  # components below this in size: the squares of 64 differences fit a double many times over
_LONG = 2**63 - 1
_KEY = ("__key_a", "__key_b")


@dataclass(frozen=True)
class Params:
    clusters: int = 16
    rounds: int = 3
    dimensions: int = 64
    scale: float = 64.0
    seed: str = "1"
    rows: int = 4096  # compared with all centroids at once


def quantised(vectors: DataFrame, p: Params = Params()) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, as a whole number in a double.

    Left out are vectors that are null, have another number of components, or hold null or non-finite ones; a component
    that only the scale takes beyond a double's range counts as non-finite. A null vec_id and repeated ids take part.
    """
    x = F.transform("embedding", lambda c: c.cast("double") * p.scale)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    rows = rows.where(F.col("x").isNotNull() & (F.size("x") == p.dimensions) & ~bad)
    # A double of 2^52 or more is whole; floor() itself returns a long.
    return rows.select("vec_id", F.transform("x", lambda c: F.when(F.abs(c) >= 2.0**52, c).otherwise(F.floor(c).cast("double"))).alias("v"))


def starts(rows: DataFrame, p: Params = Params()) -> list[list[int]]:
    """The first centroids: the rows whose ``seed:vec_id`` has the smallest SHA-256, equal ones by the vector; null ids come last."""
    order = F.sha2(F.concat(F.lit(f"{p.seed}:"), F.col("vec_id").cast("string")), 256)
    found = rows.orderBy(order.asc_nulls_last(), "v").limit(p.clusters).collect()
    return [[int(x) for x in r["v"]] for r in found]


def nearest(m: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, list[int] | np.ndarray]:
    """(cluster, squared distance) of each row of whole numbers; ties go to the smaller number. Distances are exact."""
    c = np.array(centroids, float)
    if max(np.abs(m).max(initial=0), np.abs(c).max(initial=0)) < _EXACT:
        d = (m * m).sum(axis=1)[:, None] - 2 * (m @ c.T) + (c * c).sum(axis=1)
        at = d.argmin(axis=1)
        return at, d[np.arange(len(m)), at].astype(np.int64)
    at, out = np.zeros(len(m), np.int64), []
    for i, row in enumerate(m.tolist()):
        v = [int(x) for x in row]
        d = [sum((a - b) ** 2 for a, b in zip(v, own, strict=True)) for own in centroids]
        at[i] = d.index(min(d))
        out.append(d[at[i]])
    return at, out


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """(number, limb) of the non-zero limbs of an integer, each with its sign."""
    sign, value, number = (-1 if value < 0 else 1), abs(value), 0
    while value:
        if value & ((1 << LIMB) - 1):
            yield number, sign * (value & ((1 << LIMB) - 1))
        value >>= LIMB
        number += 1


def _matrix(batch: pa.RecordBatch, dimensions: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def weighted_sums(distinct: DataFrame, centroids: list[list[int]], p: Params) -> list[tuple[int, list[int]]]:
    """For each cluster its number of vectors and their sums by component, from distinct vectors ``v`` of ``weight``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((p.clusters, p.dimensions + 1), object)
        for batch in batches:
            for start in range(0, batch.num_rows, p.rows):
                part = batch.slice(start, p.rows)
                m, weight = _matrix(part, p.dimensions), part.column("weight").to_numpy(zero_copy_only=False)
                at = nearest(m, centroids)[0]
                small = np.abs(m).max(initial=0) < _EXACT and weight.sum(dtype=float) < 2.0**40
                for k in np.unique(at).tolist():
                    own = at == k
                    if small:
                        sums = (m[own].astype(np.int64) * weight[own, None]).sum(axis=0).tolist()
                    else:
                        sums = [sum(int(x) * w for x, w in zip(column, weight[own].tolist(), strict=True)) for column in m[own].T.tolist()]
                    total[k] += np.array([int(weight[own].sum()), *sums], object)
        rows = [(k, j, limb, x) for k in range(p.clusters) for j in range(p.dimensions + 1) for limb, x in _limbs(int(total[k, j]))]
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        types = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["cluster", "component", "limb", "total"])

    parts = distinct.select("v", "weight").mapInArrow(run, "cluster int, component int, limb int, total long")
    out = [[0] * (p.dimensions + 1) for _ in range(p.clusters)]
    for r in parts.groupBy("cluster", "component", "limb").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        out[r["cluster"]][r["component"]] += int(r["total"]) << (LIMB * r["limb"])
    return [(x[0], x[1:]) for x in out]


def assigned(distinct: DataFrame, centroids: list[list[int]], p: Params) -> DataFrame:
    """``distinct`` (key, weight, v) without ``v``, with ``cluster`` and ``distance``: null where it exceeds a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, p.rows):
                part = batch.slice(start, p.rows)
                at, distance = nearest(_matrix(part, p.dimensions), centroids)
                if isinstance(distance, list):
                    distance = [d if d <= _LONG else None for d in distance]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (*_KEY, "weight")), pa.array(at.astype(np.int32)), pa.array(distance, pa.int64())], [*_KEY, "weight", "cluster", "distance"])

    return distinct.select(*_KEY, "weight", "v").mapInArrow(run, "__key_a long, __key_b long, weight long, cluster int, distance long")


def cluster(vectors: DataFrame, p: Params = Params()) -> DataFrame:
    """Clusters of ``vectors`` (vec_id, embedding): one row per usable row, see ``quantised``.

    Columns: vec_id, cluster, distance (squared, to its centroid), cluster_inertia and inertia (distances summed over its
    cluster and over all rows), centroid_sha256 (of its centroid's components as decimal integers joined by commas). A
    distance or sum beyond a long is null. An empty cluster keeps its centroid; fewer rows than clusters make fewer
    clusters; no usable row, no rows. Repeated rows count each. Other columns are ignored. Reruns agree.
    """
    spark = vectors.sparkSession
    key = [F.xxhash64("v").alias(_KEY[0]), F.xxhash64(F.lit("docweave"), "v").alias(_KEY[1])]
    rows = quantised(vectors, p)
    centroids = starts(rows, p)
    grouped = rows.groupBy("v").agg(F.count(F.lit(1)).alias("weight"))
    distinct = materialise(grouped.select(*key, "weight", "v"), "distinct-vectors")
    for _ in range(p.rounds if centroids else 0):
        sums = weighted_sums(distinct, centroids, p)
        centroids = [[s // n for s in total] if n else old for old, (n, total) in zip(centroids, sums, strict=False)]
    # Without any row there is nothing to assign either; the plan stays the same.
    found = materialise(assigned(distinct, centroids or [[0] * p.dimensions], p), "assigned")
    summed = F.sum(F.col("distance").cast("decimal(38,0)") * F.col("weight"))
    by = {r["cluster"]: r for r in found.groupBy("cluster").agg(summed.alias("total"), F.max(F.col("distance").isNull()).alias("beyond")).collect()}
    total = {k: None if r["beyond"] or r["total"] > _LONG else int(r["total"]) for k, r in by.items()}
    whole = None if None in total.values() or sum(total.values()) > _LONG else sum(total.values())
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    told = spark.createDataFrame([(k, total[k], whole, digest[k]) for k in sorted(by)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    back = rows.select("vec_id", *key).join(found.drop("weight"), list(_KEY)).drop(*_KEY)
    # One row per cluster: bounded by a parameter.
    return back.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
