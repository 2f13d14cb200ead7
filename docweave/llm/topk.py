"""Exact top-k inner-product search by multi-resolution segment statistics.

A vector is cut into 2, 4, 8, ... equal segments; each segment keeps its mean and its deviation (the norm of
what is left after the mean). For two vectors the squared distance is at least the sum over segments of
``length * ((mean difference)^2 + (deviation difference)^2)``, and finer segments only raise that bound. Through
``2 * <q, v> = |q|^2 + |v|^2 - distance^2`` a lower bound on the distance is an upper bound on the score. Rows
whose bound is under the k-th best score so far are dropped level by level, coarse to fine; survivors get exact
integer scores.

Queries are taken in blocks of bounded size. A pass over the rows takes many blocks, which are sent to all tasks and run
against each batch of rows; a task keeps k rows per query, so neither a hot vector nor the number of partitions decides
what is shuffled. Where more than one pass is needed, the quantised rows are written once and reread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialise

SCHEMA = "query_id long, vec_id long, score long"


@dataclass(frozen=True)
class Params:
    k: int = 5
    block: int = 4096  # queries compared with a batch of rows at once
    blocks: int = 8  # of a pass; each is 4096 * dimensions * 8 bytes in every task, and three times that in statistics
    seeds: int = 4096  # rows of the seed sample that gives each query its first threshold
    rows: int = 1024  # rows of a task scored together


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component as double; rows with unusable vectors take no part.

    Unusable are null ids, and vectors that are null, empty, or hold null or non-finite components. Repeated ids are
    separate rows. A component beyond the range of a long becomes the nearest long.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    whole = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    usable = whole & ~F.exists(F.coalesce("x", F.array()), lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", x.alias("x")).where(usable)
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v"))


def statistics(m: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each resolution that divides the dimension: segment means and deviations (scaled by sqrt of the length)."""
    n, d = m.shape
    out, parts = [], 1
    while d % parts == 0 and d // parts >= 2:
        seg = m.reshape(n, parts, d // parts)
        mean = seg.mean(axis=2)
        dev = np.sqrt(np.maximum(0.0, (seg * seg).sum(axis=2) - mean * mean * (d // parts)))
        out.append((mean * np.sqrt(d // parts), dev, parts))
        parts *= 2
    return out


def _matrix(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    col = batch.column("v")
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    ids = batch.column("vec_id").to_numpy()
    return ids, col.flatten().to_numpy().reshape(len(ids), -1) if len(ids) else np.zeros((0, 1), np.int64)


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -score))[:k]
    return ids[order], score[order]


class Queries:
    """A block of queries: ids, integer components, statistics, and each one's best rows and least score so far."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, floor: np.ndarray):
        self.ids, self.ints, self.floor = ids, m, floor.copy()
        self.m = m.astype(np.float64)
        self.norm = np.linalg.norm(self.m, axis=1)
        self.stats = statistics(self.m)
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)


def _survivors(q: Queries, rows: np.ndarray, norm: np.ndarray, stats: list) -> np.ndarray:
    """(queries, rows) that no bound rules out. Rounding is allowed for in proportion to the norms."""
    limit = q.floor[:, None] - 1e-9 * q.norm[:, None] * norm[None, :]
    alive = None
    for (qm, qd, _), (rm, rd, _) in zip(q.stats, stats, strict=True):
        # |q|^2 + |v|^2 - distance^2 over means and deviations is twice the products of both
        if alive is None or alive.mean() > 0.1:
            ok = qm @ rm.T + qd @ rd.T >= limit
            alive = ok if alive is None else alive & ok
        else:
            i, j = np.nonzero(alive)
            alive[i, j] = (qm[i] * rm[j]).sum(axis=1) + (qd[i] * rd[j]).sum(axis=1) >= limit[i, j]
    return np.ones((len(q.ids), len(rows)), bool) if alive is None else alive


def search(ids: np.ndarray, ints: np.ndarray, blocks: list[Queries], k: int) -> int:
    """Compare rows with all blocks of queries, which keep their k best; returns how many pairs were compared exactly."""
    rows = ints.astype(np.float64)
    norm, stats, compared = np.linalg.norm(rows, axis=1), statistics(rows), 0
    for q in blocks:
        alive = _survivors(q, rows, norm, stats)
        exact = q.norm.max(initial=0) * norm.max(initial=0) < 2**52  # every sum of products is exact in double precision
        for i in np.flatnonzero(alive.any(axis=1)):
            j = np.flatnonzero(alive[i])
            j = j[ids[j] != q.ids[i]]
            compared += len(j)
            score = (rows[j] @ q.m[i]).astype(np.int64) if exact else ints[j].astype(object) @ q.ints[i].astype(object)
            keep = score >= q.floor[i]
            if not keep.any():
                continue
            own, had = q.best[i], score[keep] if exact else np.array(score[keep].tolist(), np.int64)
            q.best[i] = _best(np.concatenate([own[0], ids[j][keep]]), np.concatenate([own[1], had]), k)
            if len(q.best[i][1]) == k:
                q.floor[i] = max(q.floor[i], _floor(q.best[i][1][-1]))
    return compared


def _floor(score: int) -> float:
    """A double that is no more than the score."""
    return float(score) - (abs(float(score)) * 2.0**-52 if abs(int(score)) >= 2**53 else 0.0)


def top_k(queries: DataFrame, rows: DataFrame, p: Params = Params()) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query, ties to the smaller id.

    Both tables are (vec_id long, v array<long>) of one dimension, as ``quantised`` makes them. A query's own id is no
    candidate; rows of another dimension than the query's are none either. Rows of a repeated id are candidates each;
    queries of a repeated id have one answer, the k best of all of them. Scores are exact integers of any size; one that no long
    holds fails the job. No usable rows: an empty result.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("d", F.size("v"))
    queries = queries.withColumn("d", F.size("v"))
    n = max(1, -(-queries.count() // p.block))
    numbered = materialise(queries.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n))), "queries")
    of_dimension: dict[int, list[int]] = {}
    for r in numbered.select("d", "block").distinct().orderBy("d", "block").toLocalIterator():
        of_dimension.setdefault(r["d"], []).append(r["block"])
    passes = [(d, blocks[i : i + p.blocks]) for d, blocks in of_dimension.items() for i in range(0, len(blocks), p.blocks)]
    if len(passes) > 1:
        rows = materialise(rows, "rows")
    parts = []
    for d, blocks in passes:
        of = rows.where(F.col("d") == d).select("vec_id", "v")
        sids, s = _matrix(of.limit(p.seeds).toArrow())
        sent = []
        for block in blocks:
            qids, m = _matrix(numbered.where((F.col("d") == d) & (F.col("block") == block)).select("vec_id", "v").orderBy("vec_id").toArrow())
            # The k-th best of any k other rows is a score that the best k reach.
            first = Queries(qids, m, np.full(len(qids), -np.inf))
            search(sids, s, [first], p.k)
            sent.append(spark.sparkContext.broadcast((qids, m, first.floor)))

        def run(batches: Iterator[pa.RecordBatch], sent=tuple(sent)) -> Iterator[pa.RecordBatch]:
            found = [Queries(*x.value) for x in sent]
            for batch in batches:
                for at in range(0, batch.num_rows, p.rows):
                    search(*_matrix(batch.slice(at, p.rows)), found, p.k)
            for q in found:
                held = [len(x[0]) for x in q.best]
                if sum(held):
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q.ids, held)), *(pa.array(np.concatenate([x[i] for x in q.best])) for i in (0, 1))], ["query_id", "vec_id", "score"])

        parts.append(materialise(of.mapInArrow(run, SCHEMA), "topk"))
        for x in sent:
            x.destroy()
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")
