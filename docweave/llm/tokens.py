"""Token ids of whole texts under the public word BPE vocabulary, a slice of texts at a time.

The vocabulary's rules (lower case; words of letters, single digits, runs of other signs, the seven apostrophe
endings) are applied to the bytes of a slice with array operations, and each distinct word is encoded once by the
tokenizer library and remembered. Texts with signs outside the plain range (ASCII and the Latin letters U+00C0 to
U+017F), or with a special token's opening, go to the library whole. Both ways give the library's ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textops import U64, VecMap, hash_spans

_LETTER, _DIGIT, _SIGN, _SPACE, _OTHER = range(5)
_CLASS = np.full(256, _SIGN, np.int8)
_CLASS[:32] = _OTHER
_CLASS[127] = _OTHER
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _LETTER
_CLASS[97:123] = _LETTER
_CLASS[128:] = _OTHER
_CLASS[128:192] = _LETTER  # continuation bytes, after one of the three lead bytes
_CLASS[[0xC3, 0xC4, 0xC5]] = _LETTER
_ENDING_1 = frozenset(b"stmd")
_ENDING_2 = frozenset([b"re", b"ve", b"ll"])
KEPT_WORDS = 400_000

_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder for a vocabulary file."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")
        self._clear()

    def _clear(self) -> None:
        none = (np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.uint32))
        self.main, self.recent = _Table(*none), _Table(*none)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        ids = self.whole(" ".join(words))
        cut = np.flatnonzero(self.ends[ids]) + 1
        if len(cut) != len(words):  # a vocabulary without marked word ends
            each = [self.whole(w) for w in words]
            ids, cut = np.concatenate(each), np.cumsum([len(e) for e in each])
        count = np.diff(cut, prepend=0)
        self.recent = self.recent.plus(keys, count, ids)
        if len(self.recent.count) * 4 > len(self.main.count):
            self.main = self.main.plus(self.recent.keys, self.recent.count, self.recent.ids)
            self.recent = _Table(keys[:0], count[:0], ids[:0])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): the ids of all texts one after another, bounds of length texts + 1. A null is empty."""
        from .textops import buffers

        raw, off = buffers(texts)
        n = len(off) - 1
        odd = _odd(raw, off)
        if odd.any():
            texts = pc.if_else(pa.array(odd), pa.scalar("", texts.type), pc.fill_null(texts, ""))
        low, loff = buffers(pc.utf8_lower(texts))
        ids, doc_count = self._plain(low, loff)
        if not odd.any():
            return ids, np.append(0, np.cumsum(doc_count))
        bounds = np.append(0, np.cumsum(doc_count))
        parts = [self.whole(bytes(raw[off[i] : off[i + 1]]).decode()) if odd[i] else ids[bounds[i] : bounds[i + 1]] for i in range(n)]
        return np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))

    def _plain(self, low: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(off) - 1
        starts, ends, inside = _words(low, off)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        keys = hash_spans(low, starts, ends, inside)
        if len(self.main.count) + len(self.recent.count) > KEPT_WORDS:
            self._clear()
        for _ in range(2):
            count, ids, missing = self._look_up(keys)
            if not missing.any():
                break
            new, first = np.unique(keys[missing], return_index=True)
            at = np.flatnonzero(missing)[first]
            self._learn(new, [bytes(low[starts[i] : ends[i]]).decode() for i in at])
        bounds = np.searchsorted(starts, off)
        total = np.append(0, np.cumsum(count))
        return ids, np.diff(total[bounds])

    def _look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = self.main.map.get(keys)
        lost = np.flatnonzero(at < 0)
        found = self.recent.map.get(keys[lost])
        missing = np.zeros(len(keys), bool)
        missing[lost[found < 0]] = True
        if missing.any():
            return np.zeros(0, np.int64), np.zeros(0, np.uint32), missing
        count = np.empty(len(keys), np.int64)
        begin = np.empty(len(keys), np.int64)
        here = at >= 0
        count[here], begin[here] = self.main.count[at[here]], self.main.begin[at[here]]
        count[lost], begin[lost] = self.recent.count[found], self.recent.begin[found] + len(self.main.ids)
        flat = np.concatenate([self.main.ids, self.recent.ids])
        total = np.cumsum(count)
        return count, flat[np.repeat(begin - (total - count), count) + np.arange(total[-1])], missing


class _Table:
    def __init__(self, keys: np.ndarray, count: np.ndarray, ids: np.ndarray):
        self.keys, self.count, self.ids = keys, count, ids
        self.begin = np.cumsum(count) - count
        self.map = VecMap(keys)

    def plus(self, keys: np.ndarray, count: np.ndarray, ids: np.ndarray) -> _Table:
        return _Table(np.concatenate([self.keys, keys]), np.concatenate([self.count, count]), np.concatenate([self.ids, ids]))


def _odd(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Texts that the plain rules don't cover."""
    n = len(off) - 1
    bad = _CLASS[raw] == _OTHER
    if len(raw) > 1:
        a, b = raw[:-1], raw[1:]
        bad[:-1] |= (a == 0xC3) & ((b == 0x97) | (b == 0xB7)) | (a == 0xC4) & (b == 0xB0) | (a == 0xC5) & (b == 0x89) | (a == 60) & (b == 124)
    at = np.searchsorted(off, np.flatnonzero(bad), "right") - 1
    out = np.zeros(n, bool)
    out[at] = True
    return out


def _words(low: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the vocabulary's words, and the mask of their bytes."""
    kind = _CLASS[low]
    inside = kind != _SPACE
    edge = np.ones(len(low), bool)
    edge[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    edge[off[:-1][off[:-1] < len(low)]] = True
    all_starts = np.flatnonzero(edge)
    all_ends = np.append(all_starts[1:], len(low)) if len(all_starts) else all_starts
    real = inside[all_starts]
    starts, ends = all_starts[real], all_ends[real]
    quote = np.flatnonzero((low[starts] == 39) & (ends - starts == 1))
    limit = off[np.searchsorted(off, starts[quote], "right")]
    dropped = []
    for i, stop in zip(quote.tolist(), limit.tolist(), strict=True):  # apostrophes before letters
        if i + 1 < len(starts) and starts[i + 1] == ends[i] and ends[i] < stop and kind[ends[i]] == _LETTER:
            size = 1 if low[ends[i]] in _ENDING_1 else 2 if bytes(low[ends[i] : min(ends[i] + 2, ends[i + 1])]) in _ENDING_2 else 0
            ends[i] += size
            starts[i + 1] += size
            if starts[i + 1] >= ends[i + 1]:
                dropped.append(i + 1)
    if dropped:
        starts, ends = np.delete(starts, dropped), np.delete(ends, dropped)
    return starts, ends, inside
