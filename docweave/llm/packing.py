"""Best-fit packing of token pieces into sequences under several capacities.

A bin has a vector of capacities: tokens, pieces, and attention cost. The cost of a piece is the number of tiles of
``tile`` by ``tile`` positions that block-diagonal attention computes for it, so a short piece costs more than its share of
tokens: neither the second nor the third capacity follows from the first. Pieces come longest first; each goes to the
open bin, among those that fit it in every capacity, whose weighted residual vector would be shortest afterwards, ties to
the bin opened first. All open bins are compared at once, so the choice is exact. Where the second and third capacity would
cost more than one sequence in a hundred, as with many tiny pieces, they are doubled until they don't (``fitted``).

Pieces are dealt to cells of a bounded number of pieces, packed each in one task, by their number in a written table: a
repeated or null id is no hot key. A cell wastes part of one bin at most more than a single packing of all would, and any
number of cells run side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .scratch import materialise, text_batches
from .textops import slices
from .tokens import encoder


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@dataclass(frozen=True)
class Params:
    tokens: int = 2048
    pieces: int = 256  # of a sequence, at first; 2048 could never bind
    tile: int = 64
    cost: int = 1028  # tiles of a sequence, at first: one longest piece (1024) and four of a tile; short pieces alone could need 2048
    loss: float = 0.01  # share of sequences that the second and third capacity may cost before they are doubled
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)  # of the residual tokens, pieces and cost, each as a share
    end_id: int = 0
    cell: int = 4096

    def tiles(self, lengths):
        """Attention cost of pieces of these lengths."""
        return (-(-lengths // self.tile)) ** 2


def token_pieces(docs: DataFrame, path: str, p: Params = Params()) -> DataFrame:
    """(doc_id, piece, start, length, ids): a row's token ids and one end id, cut into pieces of at most ``tokens``.

    ids are unsigned little-endian 32-bit numbers. A null or empty text gives one piece with the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, at = enc.encode(part.column("text"))
                n = len(at) - 1
                all_ids = np.insert(ids, at[1:], p.end_id).astype("<u4")
                at = at + np.arange(n + 1)
                size = np.diff(at)
                number = -(-size // p.tokens)
                row = np.repeat(np.arange(n), number)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
                start = piece * p.tokens
                length = np.minimum(p.tokens, size[row] - start)
                # Pieces follow one another without a gap, so their bounds are the buffer's offsets.
                offsets = np.append(0, np.cumsum(length) * 4).astype(np.int32)
                blob = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(offsets), pa.py_buffer(all_ids.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), blob], ["doc_id", "piece", "start", "length", "ids"])

    return text_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def best_fit(lengths: np.ndarray, p: Params = Params()) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece. A piece that no capacity allows even alone raises ValueError.

    Pieces of one length come in the order given. A bin without room for the shortest piece leaves the comparison.
    """
    costs = p.tiles(lengths)
    full = np.array([p.tokens, p.pieces, p.cost], float)
    if len(lengths) and (lengths.max() > p.tokens or costs.max() > p.cost or p.pieces < 1):
        raise ValueError("a piece exceeds the capacities of an empty sequence")
    scale = np.array(p.weights) / full**2
    least = np.array([lengths.min(), 1, costs.min()], float) if len(lengths) else full
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room, number = np.empty((3, len(lengths))), np.empty(len(lengths), np.int64)  # of the open bins, in order of opening
    open_ = made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        own = np.array([lengths[i], 1, costs[i]], float)
        after = room[:, :open_] - own[:, None]
        norm = scale @ (after * after)
        norm[(after < 0).any(axis=0)] = np.inf
        at = int(norm.argmin()) if open_ else 0
        if not open_ or norm[at] == np.inf:
            at, open_ = open_, open_ + 1
            room[:, at], number[at] = full, made
            made += 1
        bins[i], offsets[i] = number[at], p.tokens - room[0, at]
        room[:, at] -= own
        if (room[:, at] < least).any():
            room[:, at : open_ - 1] = room[:, at + 1 : open_]
            number[at : open_ - 1] = number[at + 1 : open_]
            open_ -= 1
    return bins, offsets


def fitted(lengths: np.ndarray, p: Params = Params()) -> tuple[np.ndarray, np.ndarray]:
    """``best_fit`` under the tightest capacities of ``p``, doubled once or more, that cost at most ``loss`` of the sequences.

    Pieces and cost are held down to keep sequences alike, not to need more of them: where small pieces abound, the two
    capacities give way. The least number is that of the tokens alone, and where that isn't reached, of a fit by tokens.
    """
    found, least = best_fit(lengths, p), None
    while len(lengths):
        made = int(found[0].max()) + 1
        if made <= (1 + p.loss) * -(-int(lengths.sum()) // p.tokens):
            break
        free = replace(p, pieces=p.tokens, cost=max(p.cost, int(p.tiles(np.array([p.tokens]))[0]), p.tokens))
        if least is None:
            open_ = best_fit(lengths, free)
            least = int(open_[0].max()) + 1
        if made <= (1 + p.loss) * least:
            break
        p = replace(p, pieces=min(2 * p.pieces, free.pieces), cost=min(2 * p.cost, free.cost))
        found = open_ if (p.pieces, p.cost) == (free.pieces, free.cost) else best_fit(lengths, p)
    return found


def pack(pieces: DataFrame, p: Params = Params()) -> DataFrame:
    """``pieces`` (doc_id, piece, length and other columns) with sequence_id and offset.

    Pieces of one length are taken in order of id and number, equal ones as they come. Reruns over the same files agree.
    No pieces give no rows.
    """
    held = materialise(pieces, "pieces")
    n = held.count()
    cells = max(1, -(-n // p.cell))
    # Rows of a written table keep their numbers when a task is run again.
    dealt = held.withColumn("__cell", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(cells)).cast("long"))
    names = held.columns
    schema = StructType([*held.schema.fields]).add("sequence_id", "long").add("offset", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, last = [], None

        def done() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
            bins, offsets = fitted(t.column("length").to_numpy(), p)
            yield pa.RecordBatch.from_arrays([*(t.column(c) for c in names), pa.array((last << 24) + bins), pa.array(offsets)], [*names, "sequence_id", "offset"])

        for batch in batches:
            cell = batch.column("__cell").to_numpy()
            cut = np.flatnonzero(cell[1:] != cell[:-1]) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(cell)], strict=True):
                if a == b:
                    continue
                if last != int(cell[a]) and kept:
                    yield from done()
                    kept = []
                last = int(cell[a])
                kept.append(batch.slice(a, b - a))
        if kept:
            yield from done()

    order = [F.col("__cell"), F.desc("length"), F.col("doc_id"), F.col("piece")]
    return dealt.repartition("__cell").sortWithinPartitions(*order).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, p: Params = Params()) -> DataFrame:
    """Place of every piece of every row of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Other columns are ignored. A null or empty text is one piece, the end id; repeated rows are packed each for itself;
    a null id stays null. An empty table gives no rows.
    """
    return pack(token_pieces(docs, path, p).withColumn("ids_crc32", F.crc32("ids")).drop("ids"), p)


def sequences(docs: DataFrame, placed: DataFrame, path: str, p: Params = Params()) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, from the texts and the places of their pieces."""
    ids = token_pieces(docs, path, p).withColumn("ids_crc32", F.crc32("ids")).dropDuplicates(["doc_id", "piece", "length", "ids_crc32"])
    ids = ids.select("piece", "length", "ids_crc32", "ids", F.col("doc_id").alias("id"))
    found = placed.join(ids, ["piece", "length", "ids_crc32"]).where(F.col("id").eqNullSafe(F.col("doc_id")))
    parts = found.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("x"))
    return parts.select("sequence_id", F.expr("aggregate(x, X'', (a, b) -> concat(a, b.ids))").alias("ids"))
