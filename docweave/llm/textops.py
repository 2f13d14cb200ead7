"""Vectorised text primitives over Arrow string buffers: words, 64-bit word hashes, shingles, lookup tables.

Nothing here loops over characters in Python. Texts are taken in slices of about ``SLICE`` bytes (a longer
text is a slice of its own), so memory follows the slice or the longest text, not the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 18
U64 = np.uint64
_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.RandomState(20240229)
_BYTE = _RANDOM.randint(0, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_POS = _RANDOM.randint(0, 2**63, 64, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_powers = np.ones(1, U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply rounds)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 2 * len(_powers), 256), _BASE, U64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each slice has about ``size`` bytes of text, or one longer text."""
    _, off = buffers(batch.column(column))
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def hash_spans(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span; spans are in order, ``inside`` is true on their bytes alone."""
    if not len(starts):
        return np.zeros(0, U64)
    begin = int(starts[0])
    position = np.arange(begin, len(low)) - np.repeat(starts, np.diff(np.append(starts, len(low))))
    lengths = ends - starts
    powers = _power(int(lengths.max()) + 1)
    inside = inside[begin:]
    position[~inside] = 0
    value = _BYTE[low[begin:]] * powers[position]
    value[~inside] = 0
    return mix(np.add.reduceat(value, starts - begin) + lengths.astype(U64))


class Words:
    """The words (maximal runs of non-space bytes) of a slice, document by document."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool = True):
        n, docs = len(data), len(off) - 1
        self.docs = docs
        low = _LOWER[data] if lower else data
        word = ~_WS[low]
        first = np.zeros(n + 1, bool)
        first[off[:-1]] = True
        begins = word.copy()
        begins[1:] &= ~word[:-1] | first[1:n]
        self.starts = np.flatnonzero(begins)
        ends = word.copy()
        ends[:-1] &= ~word[1:] | first[1:n]
        self.ends = np.flatnonzero(ends) + 1
        self.bounds = np.searchsorted(self.starts, off)
        self.counts = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(docs), self.counts)
        self.low = low
        self.hash = hash_spans(low, self.starts, self.ends, word)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each k-word shingle; a document with fewer words gives its whole sequence as one."""
    h, n = words.hash, len(words.hash)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    out = np.zeros(max(0, n - k + 1), U64)
    for j in range(k):
        out += h[j : n - k + 1 + j] * _POS[j] if n >= k else U64(0)
    doc = words.doc[: len(out)]
    whole = doc == words.doc[k - 1 : k - 1 + len(out)]
    doc, out = doc[whole], mix(out[whole] + U64(k))
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        extra = np.zeros(len(short), U64)
        for j in range(k - 1):
            has = words.counts[short] > j
            extra[has] += h[words.bounds[short[has]] + j] * _POS[j]
        extra = mix(extra + words.counts[short].astype(U64))
        doc = np.concatenate([doc, short])
        out = np.concatenate([out, extra])
    return doc, out


def distinct_by_doc(doc: np.ndarray, value: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each document and their bounds (length docs + 1)."""
    order = np.lexsort((value, doc)) if len(doc) else np.zeros(0, np.int64)
    doc, value = doc[order], value[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[keep], value[keep]
    return value, np.searchsorted(doc, np.arange(docs + 1))


class VecMap:
    """An open-addressing table from distinct 64-bit keys to 0..n-1, looked up for whole arrays at once."""

    def __init__(self, keys: np.ndarray):
        size = 1 << max(4, int(2 * len(keys)).bit_length())
        self.mask, self.bits = U64(size - 1), U64(64 - size.bit_length() + 1)
        self.slot = np.full(size, -1, np.int32)
        self.keys = keys.astype(U64)
        left = np.arange(len(keys), dtype=np.int32)
        at = self._home(self.keys)
        while len(left):
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]  # of several for one slot the last stays
            lost = self.slot[at] != left
            left, at = left[lost], (at[lost] + U64(1)) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * U64(0x9E3779B97F4A7C15)) >> self.bits

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 where it is absent."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = self._home(keys)
        found = self.slot[at]
        open_ = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        at = at[open_]
        while len(open_):
            at = (at + U64(1)) & self.mask
            now = self.slot[at]
            found[open_] = now
            more = (now >= 0) & (self.keys[now] != keys[open_])
            open_, at = open_[more], at[more]
        return found
