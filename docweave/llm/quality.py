"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics of whole texts are standardised and mapped to cosines of random projections, whose inner products
approximate a Gaussian kernel. Ridge regression in that space needs only sums over rows: each partition adds up its
normal equations and the driver adds the partitions' sums, a fixed number of matrices of fixed size. Scores of rows
kept apart from the fit are then calibrated by pooling adjacent violators.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialise, text_batches
from .textops import Words, buffers, distinct_by_doc, slices

SYMBOLS = "#$%&*|!?.,;:-_/\\@()[]{}<>=+~^\"'"


@dataclass(frozen=True)
class Params:
    features: int = 192
    width: float = 0.35  # the projections' scale: the inverse of the kernel's width
    ridge: float = 1e-2
    rows: int = 60_000  # labelled rows that the fit takes at most, about
    tasks: int = 16
    bins: int = 400  # of calibration
    seed: int = 7


STATISTICS = (
    ["log_bytes", "log_words", "upper", "lower", "digit", "space", "newline", "non_ascii", "mean_word", "spread_word", "longest_word", "distinct_words", "top_word", "distinct_pairs", "capital_words", "alpha_words", "symbol_end", "line_words"]
    + [f"symbol_{i}" for i in range(len(SYMBOLS))]
)


def _classes() -> np.ndarray:
    b = np.arange(256)
    rows = [(b >= 65) & (b <= 90), (b >= 97) & (b <= 122), (b >= 48) & (b <= 57), np.isin(b, [32, 9, 11, 12, 13]), b == 10, b >= 128]
    return np.stack([*rows, *[b == ord(c) for c in SYMBOLS]])


CLASSES = _classes()
KIND = np.full(256, len(CLASSES), np.int64)
for _i, _row in enumerate(CLASSES):
    KIND[_row] = _i


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text of a slice."""
    n_docs, size = len(off) - 1, np.diff(off)
    doc = np.repeat(np.arange(n_docs), size)
    kinds = len(CLASSES) + 1
    share = np.bincount(doc * kinds + KIND[data], minlength=n_docs * kinds).reshape(n_docs, kinds) / np.maximum(1, size)[:, None]
    w = Words(data, off)
    count = w.counts
    some = np.maximum(1, count)
    length = (w.ends - w.starts).astype(float)

    def per_doc(values: np.ndarray) -> np.ndarray:
        return np.bincount(w.doc, values, n_docs) / some

    mean = per_doc(length)
    spread = np.sqrt(np.maximum(0, per_doc(length * length) - mean * mean))
    longest = np.zeros(n_docs)
    np.maximum.at(longest, w.doc, length)
    order = np.lexsort((w.hash, w.doc))
    h, d = w.hash[order], w.doc[order]
    begin = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))) if len(h) else np.zeros(0, np.int64)
    runs = np.diff(np.append(begin, len(h)))
    top = np.zeros(n_docs)
    np.maximum.at(top, d[begin], runs)
    words = np.bincount(d[begin], minlength=n_docs)
    pair = w.hash[:-1] * np.uint64(3) + w.hash[1:] if len(w.hash) else w.hash
    inside = w.doc[:-1] == w.doc[1:]
    _, at = distinct_by_doc(w.doc[:-1][inside], pair[inside], n_docs)
    start, end = data[w.starts], data[w.ends - 1]
    second = data[np.minimum(w.starts + 1, len(data) - 1)] if len(data) else data
    capital = per_doc(((start >= 65) & (start <= 90) & (second >= 65) & (second <= 90)).astype(float))
    alpha = per_doc((((start | 32) >= 97) & ((start | 32) <= 122) | (start >= 128)).astype(float))
    ends = per_doc(((end < 128) & (KIND[end] >= 6) & ~np.isin(end, [46, 44])).astype(float))
    lines = np.bincount(doc, data == 10, n_docs) + 1
    head = [np.log1p(size), np.log1p(count), *share[:, :6].T, mean, np.log1p(spread), np.log1p(longest), words / some, top / some, np.diff(at) / some, capital, alpha, ends, np.log1p(count / lines)]
    return np.column_stack([*head, *share[:, 6 : len(CLASSES)].T])


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x): STATISTICS of each whole text; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = statistics(*buffers(part.column("text"))).astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))], ["doc_id", "x"])

    return text_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, x array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1).astype(np.float64)


def _sums(rows: DataFrame, f) -> np.ndarray:
    """The sum over rows of what ``f`` makes of a partition's (x, y): partition sums are added on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                own = f(_matrix(b.column("x")), b.column("y").to_numpy().astype(float))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    parts = [np.frombuffer(r["sums"]) for r in rows.mapInArrow(run, "sums binary").collect()]
    return np.sum(sorted(parts, key=lambda a: a.tobytes()), axis=0) if parts else np.zeros(0)


def pool(score: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Isotonic regression of label on score order: pool adjacent violators."""
    level: list[list[float]] = []
    for y, w in zip(label.tolist(), weight.tolist(), strict=True):
        level.append([y * w, w, 1])
        while len(level) > 1 and level[-2][0] * level[-1][1] >= level[-1][0] * level[-2][1]:
            s, w2, n = level.pop()
            level[-1] = [level[-1][0] + s, level[-1][1] + w2, level[-1][2] + n]
    return np.concatenate([np.full(n, s / w) for s, w, n in level]) if level else np.zeros(0)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    weight: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def map(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        f = np.cos(z @ self.projection + self.phase) * np.sqrt(2 / len(self.phase))
        return np.column_stack([f, np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.map(x) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0.0, 1.0)


def fit(labelled: DataFrame, p: Params = Params()) -> Model | None:
    """Train on (doc_id, x, y) with y 0 or 1; None where there is nothing to learn from. One in five rows calibrates."""
    n = labelled.count()
    if not n:
        return None
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = labelled.where(draw < p.rows / n).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(5)))
    rows = materialise(rows.repartition(p.tasks, F.xxhash64("doc_id", F.lit("task"))), "labelled")
    moments = _sums(rows, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]))
    d = (len(moments) - 1) // 2
    mean = moments[1 : d + 1] / moments[0]
    scale = np.sqrt(np.maximum(1e-8, moments[d + 1 :] / moments[0] - mean * mean)) + 1e-3
    rng = np.random.RandomState(p.seed)
    model = Model(mean, scale, rng.normal(0, p.width / np.sqrt(2), (d, p.features)), rng.uniform(0, 2 * np.pi, p.features), np.zeros(p.features + 1), np.zeros(1), np.zeros(1))
    k = p.features + 1

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        f = model.map(x)
        return np.concatenate([(f.T @ f).ravel(), f.T @ y, [len(f)]])

    sums = _sums(rows.where("fold <> 0"), normal)
    if not len(sums):
        sums = _sums(rows, normal)
    gram = sums[: k * k].reshape(k, k)
    penalty = np.full(k, p.ridge * sums[-1] / k)
    penalty[-1] = 0
    model.weight = np.linalg.solve(gram + np.diag(penalty) + 1e-9 * np.eye(k), sums[k * k : k * k + k])

    def binned(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.clip(((model.raw(x) + 0.5) * p.bins / 2).astype(int), 0, p.bins - 1)
        return np.concatenate([np.bincount(at, minlength=p.bins), np.bincount(at, y, p.bins)]).astype(float)

    held = _sums(rows.where("fold = 0"), binned)
    held = held if len(held) else _sums(rows, binned)
    count, ones = held[: p.bins], held[p.bins :]
    has = count > 0
    model.knots = (np.flatnonzero(has) + 0.5) * 2 / p.bins - 0.5
    model.values = pool(model.knots, ones[has] / count[has], count[has])
    return model


def score(statistics_: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score): the calibrated probability of label 1 for each row of (doc_id, x); 0.5 without a model."""
    if model is None:
        return statistics_.select("doc_id", F.lit(0.5).alias("score"))
    sent = statistics_.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [sent.value.score(_matrix(b.column("x").slice(at, 4096))) for at in range(0, b.num_rows, 4096)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate(s) if s else np.zeros(0))], ["doc_id", "score"])

    return statistics_.mapInArrow(run, "doc_id long, score double")


def one_label(labels: DataFrame) -> DataFrame:
    """(doc_id, y): one 0/1 label of quality for each id; where rows disagree the lower one."""
    return labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("double").alias("y"))
