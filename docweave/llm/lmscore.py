"""Language-model scores by cross-entropy difference.

A model of target texts and one of background texts share one vocabulary (all words of the corpus) and one smoothing:
``p(w | h) = (c(h, w) + mu * p(w)) / (c(h) + mu)`` with ``p(w) = (c(w) + alpha) / (n + alpha * v)`` for both, v the number of
distinct words. A text's score is its mean loss per token under the target model minus that under the background model,
in bits: the lower, the more it is like the target.

Words and pairs are known by 64-bit hashes and counted apart, so the tables grow with the corpus; no process holds them whole:

1. Texts are cut into chunks of about ``tokens`` tokens. A chunk sends its distinct words and pairs with their counts to
   buckets of the hash, once each, so a frequent one is one entry per chunk.
2. A bucket adds up what it got and answers each chunk with the corpus counts of the chunk's own words and pairs. Its own
   totals (distinct words, tokens, texts) are summed over all buckets to one row.
3. The chunk's texts meet their answers and that row, and are scored.

The number of buckets follows the size of the texts, so a bucket's share of the corpus doesn't. A chunk has a row for a bucket
only where it has words or pairs for it: there are never more rows than entries, which follow the corpus, however many
chunks and buckets there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialise, small_enough, text_batches
from .textops import U64, Words, buffers, mix, slices


@dataclass(frozen=True)
class Params:
    tokens: int = 1 << 21  # tokens of a chunk, about, or one longer text
    bucket: int = 8 << 20  # bytes of text for each bucket of words and pairs, about
    mu: float = 16.0
    alpha: float = 0.05
    broadcast_rows: int = 1_000_000  # ids of target rows that may be sent to every executor, 16 bytes each


def _pairs(w: Words) -> np.ndarray:
    """For each word the hash of the pair it ends; a text's first word follows a mark."""
    before = np.zeros(len(w.hash), U64)
    before[1:] = w.hash[:-1]
    first = np.zeros(len(w.hash), bool)
    first[w.bounds[:-1][w.counts > 0]] = True
    before[first] = 1
    return mix(before * U64(0x9E3779B97F4A7C15) ^ w.hash)


def _planes(x: np.ndarray) -> bytes:
    """The bytes of the numbers, all lowest ones first, so that the many zeros of the high ones are compressed."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _numbers(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _steps(keys: np.ndarray) -> np.ndarray:
    """Differences of sorted keys, the first from 0."""
    return np.diff(keys, prepend=U64(0))


class _Chunk:
    """Texts of a chunk as (doc_id, text, target), and their distinct words and pairs."""

    def __init__(self, parts: list[pa.RecordBatch], found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.parts = parts
        self.token_counts = [f[2] for f in found]
        self.keys, self.at = [], []
        for k in (0, 1):
            keys, at = np.unique(np.concatenate([f[k] for f in found]), return_inverse=True)
            self.keys.append(keys)
            self.at.append(at)
        self.docs = np.concatenate(self.token_counts)
        self.doc = np.repeat(np.arange(len(self.docs)), self.docs)
        self.target = np.concatenate([x.column("target").fill_null(False).to_numpy(zero_copy_only=False).astype(bool) for x in parts])

    def counts(self, k: int) -> np.ndarray:
        """(2, keys) own counts of words (0) or pairs (1) in all texts and in the target."""
        n = len(self.keys[k])
        return np.stack([np.bincount(self.at[k], minlength=n), np.bincount(self.at[k][self.target[self.doc]], minlength=n)]).astype(np.int64)


def _found(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w = Words(*buffers(part.column("text")))
    return w.hash, _pairs(w), w.counts


ASKED = "chunk long, bucket int, texts long, target_texts long, words int, keys binary, counts binary, own binary"
ANSWERED = "chunk long, bucket int, words int, counts binary, own binary"
TOTALS = "vocabulary long, tokens long, target_tokens long, texts long, target_texts long"
SCORED = "doc_id long, n_tokens long, background_loss double, target_loss double, score double"


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    fields = [pa.field(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=pa.schema(fields))


def _asked(bits: int, p: Params):
    """Chunks of the texts: a row of words and pairs for each of the 2^bits buckets that has some, and one of the texts themselves."""

    def rows(parts: list[pa.RecordBatch], found: list[tuple], number: int) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        c = _Chunk(parts, found)
        chunk = (TaskContext.get().partitionId() << 32) + number
        apart = -1 - int(mix(np.array([chunk], U64))[0] >> U64(34))  # a group of its own, so that the texts of all chunks spread
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, parts[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for part in parts:
                out.write_batch(part)
        yield _batch(ASKED, [(chunk, apart, 0, 0, 0, None, None, sink.getvalue().to_pybytes())])
        high = [keys >> U64(64 - bits) for keys in c.keys]
        n = [c.counts(0), c.counts(1)]
        told = (int((c.docs > 0).sum()), int(((c.docs > 0) & c.target).sum()))  # once a chunk
        for b in np.union1d(*high):
            own = [slice(int(np.searchsorted(x, b)), int(np.searchsorted(x, b, "right"))) for x in high]
            keys = np.concatenate([_steps(c.keys[k][own[k]]) for k in (0, 1)])
            count = np.concatenate([n[k][i, own[k]] for i in (0, 1) for k in (0, 1)])
            yield _batch(ASKED, [(chunk, int(b), *told, own[0].stop - own[0].start, _planes(keys), _planes(count), None)])
            told = (0, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, found, tokens, number = [], [], 0, 0
        for batch in batches:
            for part in slices(batch, "text"):
                now = _found(part)
                if parts and tokens + len(now[0]) > p.tokens:
                    yield from rows(parts, found, number)
                    parts, found, tokens, number = [], [], 0, number + 1
                parts.append(part)
                found.append(now)
                tokens += len(now[0])
        if parts:
            yield from rows(parts, found, number)

    return run


def _answered(table: pa.Table) -> pa.Table:
    """The rows of one bucket with the corpus counts of their words and pairs; a chunk's texts pass."""
    rows = table.to_pylist()
    if rows[0]["own"] is not None:
        return pa.Table.from_batches([_batch(ANSWERED, [(r["chunk"], -1, 0, None, r["own"]) for r in rows])])
    steps, count = [_numbers(r["keys"], U64) for r in rows], [_numbers(r["counts"], np.int64).reshape(2, -1) for r in rows]
    totals, at = [], []
    for k in (0, 1):
        of = [slice(0, r["words"]) if k == 0 else slice(r["words"], None) for r in rows]
        keys, where = np.unique(np.concatenate([np.cumsum(x[o], dtype=U64) for x, o in zip(steps, of, strict=True)]), return_inverse=True)
        own = np.concatenate([c[:, o] for c, o in zip(count, of, strict=True)], axis=1)
        total = np.zeros((2, len(keys)), np.int64)
        for i in (0, 1):
            np.add.at(total[i], where, own[i])
        totals.append(total)
        at.append(np.split(where, np.cumsum([len(x[o]) for x, o in zip(steps, of, strict=True)])[:-1]))
    out = []
    for j, r in enumerate(rows):
        answer = np.concatenate([totals[k][i, at[k][j]] for i in (0, 1) for k in (0, 1)])
        out.append((r["chunk"], r["bucket"], r["words"], _planes(answer), None))
    return pa.Table.from_batches([_batch(ANSWERED, out)])


def _totalled(table: pa.Table) -> pa.Table:
    """What one bucket adds to the totals: its distinct words, and the tokens and texts of its rows."""
    if table["own"].null_count < len(table):
        return pa.Table.from_batches([_batch(TOTALS, [(0, 0, 0, 0, 0)])])
    words, tokens = [np.zeros(0, U64)], np.zeros(2, np.int64)
    for r in table.select(["words", "keys", "counts"]).to_pylist():
        words.append(np.cumsum(_numbers(r["keys"], U64)[: r["words"]], dtype=U64))
        tokens += _numbers(r["counts"], np.int64).reshape(2, -1)[:, : r["words"]].sum(axis=1)
    texts = [sum(table[c].to_pylist()) for c in ("texts", "target_texts")]
    return pa.Table.from_batches([_batch(TOTALS, [(len(np.unique(np.concatenate(words))), *tokens.tolist(), *texts)])])


def _scored(p: Params):
    """The texts of one chunk with the answers of its buckets and the totals, scored."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["bucket"])
        if rows[0]["own"] is None:
            raise RuntimeError("answers without their texts")
        parts = pa.ipc.open_stream(rows[0]["own"]).read_all().to_batches()
        c = _Chunk(parts, [_found(x) for x in parts])
        answers = rows[1:]
        vocabulary, texts = rows[0]["vocabulary"], [rows[0][n] for n in ("texts", "target_texts")]
        tokens = [rows[0][n] for n in ("tokens", "target_tokens")]
        none = [np.zeros((2, 0), np.int64)]
        counts = [_numbers(r["counts"], np.int64).reshape(2, -1) for r in answers]
        known = [np.concatenate(none + [x[:, : r["words"]] if k == 0 else x[:, r["words"] :] for x, r in zip(counts, answers, strict=True)], axis=1) for k in (0, 1)]
        if [x.shape[1] for x in known] != [len(x) for x in c.keys]:
            raise RuntimeError("answers belong to another cut of the texts")
        word, pair = c.at
        first = np.append(True, c.doc[1:] != c.doc[:-1])[: len(word)]
        loss = []
        for i in (0, 1):
            single = (known[0][i] + p.alpha) / (tokens[i] + p.alpha * max(1, vocabulary))
            history = np.empty(len(word))
            history[1:] = known[0][i][word[:-1]]
            history[first] = texts[i]  # the mark that begins a text
            bits = np.log2(history + p.mu) - np.log2(known[1][i][pair] + p.mu * single[word])
            loss.append(np.bincount(c.doc, bits, len(c.docs)) / np.maximum(1, c.docs))
        none = c.docs == 0
        ids = pa.concat_arrays([x.column("doc_id") for x in parts])
        out = [ids, pa.array(c.docs.astype(np.int64)), pa.array(loss[0], mask=none), pa.array(loss[1], mask=none), pa.array(loss[1] - loss[0], mask=none)]
        return pa.Table.from_arrays(out, [x.split()[0] for x in SCORED.split(", ")])

    return run


def score(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, n_tokens, background_loss, target_loss, score) per row of ``docs`` (doc_id, text, target boolean).

    Losses and score are null for texts without words.
    """
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    bits = max(1, (-(-size // p.bucket) - 1).bit_length()) if size else 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "target")
    asked = text_batches(rows).mapInArrow(_asked(bits, p), ASKED)
    # Both take the same exchange of ``asked``, which is made once.
    answered = asked.groupBy("bucket").applyInArrow(_answered, ANSWERED).withColumn("one", F.lit(1))
    totals = asked.groupBy("bucket").applyInArrow(_totalled, TOTALS).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (x.split()[0] for x in TOTALS.split(", "))))
    known = answered.join(F.broadcast(totals.withColumn("one", F.lit(1))), "one").drop("one")  # one row
    return known.groupBy("chunk").applyInArrow(_scored(p), SCORED)


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, p: Params = Params()) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text) against a background of all rows and a target of the rows in ``target_ids``.

    Other columns are ignored. A null text or one without words has null losses and score and counts for neither model; a
    null id is scored but never a target. Repeated rows are counted and scored each, all rows of a target id are targets,
    and repeated target ids count once. Without targets the target model is the smoothing alone. No rows give no rows.
    """
    ids = target_ids.select(F.col("doc_id").alias("__id")).where("__id is not null").distinct()
    ids = F.broadcast(ids) if small_enough(ids, p.broadcast_rows) else ids
    marked = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("__id"), "left")
    return score(marked.select("doc_id", "text", F.col("__id").isNotNull().alias("target")), p)
