"""Byte-level BPE: texts to token ids and character offsets, ids back to bytes and text.

The vocabulary comes as ranks: each token is a byte sequence, and of two neighbours those merge first whose joined bytes
have the lowest rank. The ``tokenizers`` library does the merging. It works on characters, so each byte is written as one
printable character (the byte table), and each way to cut a token in two earlier tokens is given to it as a merge, which
makes it equal to merging by ranks. Each match of the splitting pattern is encoded for itself.

A slice of texts is cut into the pattern's matches with array operations, and each distinct match goes to the library
once in a process and is remembered. A text with characters beyond ASCII and the Latin letters U+00C0 to U+017F goes to
the library whole. Both ways give the same ids.

Decoding looks up the bytes of each id, by the table reversed. One character may be split over several tokens: bytes are
joined before they are read as UTF-8, and in ``token_texts`` a character belongs to the token that completes it.

Rows stay where they are: there is no shuffle, and memory follows the Arrow batch or the longest text.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructType

from .scratch import text_batches
from .textops import U64, buffers, hash_spans, slices
from .tokens import KEPT_WORDS, _Table

_LETTER, _DIGIT, _SIGN, _SPACE, _OTHER = range(5)
_CLASS = np.full(256, _SIGN, np.int8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _LETTER
_CLASS[97:123] = _LETTER
_CLASS[128:] = _OTHER
_CLASS[128:192] = _LETTER  # continuation bytes, after one of the three lead bytes
_CLASS[[0xC3, 0xC4, 0xC5]] = _LETTER
_ENDING_1 = frozenset(b"stmd")
_ENDING_2 = frozenset([b"re", b"ve", b"ll"])

_loaded: dict[str, Codec] = {}


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def codec(path: str) -> Codec:
    """The process's codec for a file of ranks."""
    if path not in _loaded:
        _loaded[path] = Codec(path)
    return _loaded[path]


def byte_table() -> list[str]:
    """A printable character for each byte: itself in the printable parts of Latin-1, others from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (chr(0x100 + i) for i in range(256))
    return [chr(b) if b in own else next(others) for b in range(256)]


class Codec:
    def __init__(self, path: str):
        import public_tokenizers
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        table = byte_table()
        written = {token: "".join(table[b] for b in token) for token in ranks}
        merges = []
        for token in sorted(ranks, key=ranks.__getitem__):
            for i in range(1, len(token)):
                a, b = token[:i], token[i:]
                if ranks.get(a, ranks[token]) < ranks[token] and ranks.get(b, ranks[token]) < ranks[token]:
                    merges.append((written[a], written[b]))
        self.tokenizer = Tokenizer(models.BPE({written[t]: r for t, r in ranks.items()}, merges))
        split = pre_tokenizers.Split(Regex(public_tokenizers.PATTERN), "isolated")
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        of = {c: b for b, c in enumerate(table)}
        vocab = self.tokenizer.get_vocab()
        self.known = np.zeros(max(vocab.values(), default=-1) + 1, bool)
        self.size = np.zeros(len(self.known), np.int64)
        parts: list[bytes] = [b""] * len(self.known)
        for token, i in vocab.items():
            parts[i] = bytes(of[c] for c in token)
            self.known[i], self.size[i] = True, len(parts[i])
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        self.begin = np.cumsum(self.size) - self.size
        self._clear()

    def _clear(self) -> None:
        none = (np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.uint32))
        self.main, self.recent = _Table(*none), _Table(*none)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): the ids of all texts one after another, bounds of length texts + 1. A null is empty."""
        raw, off = buffers(texts)
        n = len(off) - 1
        odd = _odd(raw, off)
        if not odd.any():
            return self._plain(raw, off)
        plain = buffers(pc.if_else(pa.array(odd), pa.scalar("", texts.type), pc.fill_null(texts, "")))
        ids, bounds = self._plain(*plain)
        parts = [self.whole(bytes(raw[off[i] : off[i + 1]]).decode()) if odd[i] else ids[bounds[i] : bounds[i + 1]] for i in range(n)]
        return np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))

    def _plain(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends = _matches(raw, off)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        keys = hash_spans(raw, starts, ends, np.ones(len(raw), bool))
        if len(self.main.count) + len(self.recent.count) > KEPT_WORDS:
            self._clear()
        at = self.main.map.get(keys)
        late = np.flatnonzero(at < 0)
        found = self.recent.map.get(keys[late])
        if (found < 0).any():
            lost = late[found < 0]
            new, first = np.unique(keys[lost], return_index=True)
            self._learn(new, [bytes(raw[starts[i] : ends[i]]).decode() for i in lost[first]])
            at = self.main.map.get(keys)
            late = np.flatnonzero(at < 0)
            found = self.recent.map.get(keys[late])
        count, begin = self.main.count[at], self.main.begin[at]
        count[late], begin[late] = self.recent.count[found], self.recent.begin[found] + len(self.main.ids)
        flat = np.concatenate([self.main.ids, self.recent.ids])
        total = np.append(0, np.cumsum(count))
        ids = flat[np.repeat(begin - total[:-1], count) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, off)]

    def _learn(self, keys: np.ndarray, matches: list[str]) -> None:
        each = [e.ids for e in self.tokenizer.encode_batch_fast(matches, add_special_tokens=False)]
        count = np.array([len(e) for e in each], np.int64)
        self.recent = self.recent.plus(keys, count, np.array([i for e in each for i in e], np.uint32))
        if not len(self.main.count) or len(self.recent.count) * 4 > len(self.main.count):
            self.main = self.main.plus(self.recent.keys, self.recent.count, self.recent.ids)
            self.recent = _Table(keys[:0], count[:0], np.zeros(0, np.uint32))

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, bounds, whole): the bytes of all rows one after another; whole is false for rows with an unknown id."""
        ids = ids.astype(np.int64)
        good = (ids >= 0) & (ids < len(self.known))
        good[good] = self.known[ids[good]]
        bad = np.searchsorted(bounds, np.flatnonzero(~good), "right") - 1
        whole = np.ones(len(bounds) - 1, bool)
        whole[bad] = False
        ids = np.where(good, ids, 0)
        size = np.where(good, self.size[ids], 0)
        total = np.append(0, np.cumsum(size))
        data = self.data[np.repeat(self.begin[ids] - total[:-1], size) + np.arange(total[-1])]
        return data, total[bounds], whole

    def offsets(self, raw: np.ndarray, off: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token, and the one after its last, in its text; of a split character each token has it all."""
        first = np.cumsum(self.size[ids]) - self.size[ids]  # in raw, which the tokens cover without a gap
        last = first + self.size[ids] - 1
        character = np.cumsum((raw & 0xC0) != 0x80)  # 1 for the first
        before = np.append(0, character)[np.repeat(off[:-1], np.diff(bounds))]
        return character[first] - before - 1, character[last] - before


def _odd(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Texts with a character beyond the plain range."""
    bad = _CLASS[raw] == _OTHER
    bad[:-1] |= (raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))  # the two signs among the letters
    out = np.zeros(len(off) - 1, bool)
    out[np.searchsorted(off, np.flatnonzero(bad), "right") - 1] = True
    return out


def _matches(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pattern's matches in plain texts; they cover all bytes."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _CLASS[raw]
    first = np.zeros(len(raw) + 1, bool)  # of a text
    first[off] = True
    edge = first[:-1].copy()
    edge[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    # The last of several spaces stands apart where something follows it in its text.
    closes = space.copy()
    closes[:-1] &= ~space[1:]
    closes &= ~first[1:]
    edge |= closes
    # What follows a plain blank takes it in.
    blank = closes & (raw == 32)
    edge[1:] &= ~blank[:-1]
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], len(raw))
    quote = np.flatnonzero((raw[starts] == 39) & (ends - starts == 1))
    if len(quote):
        dropped = []
        for i in quote.tolist():  # endings after an apostrophe
            a = int(ends[i])
            if a < len(raw) and not first[a] and kind[a] == _LETTER:
                n = 1 if raw[a] in _ENDING_1 else 2 if bytes(raw[a : min(a + 2, ends[i + 1])]) in _ENDING_2 else 0
                ends[i] += n
                starts[i + 1] += n
                if n and starts[i + 1] >= ends[i + 1]:
                    dropped.append(i + 1)
        if dropped:
            starts, ends = np.delete(starts, dropped), np.delete(ends, dropped)
    return starts, ends


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(np.int32)))


def encode(docs: DataFrame, path: str, text: str = "text", offsets: bool = False) -> DataFrame:
    """``docs`` with ``ids``, and with ``offsets`` also ``starts`` and ``ends``, the characters that each token covers.

    A null or empty text has no ids. Columns of these names are replaced, all others stay; repeated rows are rows of
    their own; an empty table gives no rows.
    """
    new = ["ids", *(["starts", "ends"] if offsets else [])]
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in new or c == text))
    source = "__text"
    df = kept.withColumn(source, F.col(f"`{text}`").cast("string"))
    others = [c for c in df.columns if c not in (source, *new)]
    schema = StructType([df.schema[c] for c in others])
    for c in new:
        schema.add(c, ArrayType(IntegerType(), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = codec(path)
        for batch in batches:
            for part in slices(batch, source):
                texts = part.column(source)
                ids, at = enc.encode(texts)
                made = [_lists(ids, at)]
                if offsets:
                    made += (_lists(x, at) for x in enc.offsets(*buffers(texts), ids, at))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), *made], [*others, *new])

    return text_batches(df).mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids", as_text: bool = False) -> DataFrame:
    """``rows`` with ``decoded``, the bytes of ``ids``; ``as_text`` adds ``decoded_text``, where what isn't UTF-8 becomes U+FFFD.

    Null ids, and ids with a null or a number that the vocabulary lacks, decode to null; no ids to nothing. Columns of
    these names are replaced, all others stay.
    """
    new = ["decoded", *(["decoded_text"] if as_text else [])]
    kept = [c for c in rows.columns if c not in new]
    schema = StructType([rows.schema[c] for c in kept]).add("decoded", BinaryType())
    if as_text:
        schema.add("decoded_text", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = codec(path)
        for batch in batches:
            lists = batch.column(ids)
            flat = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            data, at, whole = enc.decode(flat, np.append(0, np.cumsum(size)))
            whole &= lists.is_valid().to_numpy(zero_copy_only=False)
            valid = pa.py_buffer(np.packbits(whole, bitorder="little").tobytes())
            out = pa.Array.from_buffers(pa.binary(), len(whole), [valid, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data.tobytes())])
            made = [out]
            if as_text:
                made.append(pa.array([None if x is None else x.decode("utf-8", "replace") for x in out.to_pylist()], pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], [*kept, *new])

    return text_batches(rows.select(*(F.col(f"`{c}`") for c in kept))).mapInArrow(run, schema)


def token_texts(ids: list[int], path: str) -> list[str]:
    """The text that each token adds when a sequence is read token by token: a split character comes with its last byte.

    Bytes that can't become a character any more count as U+FFFD, at the end those left over too.
    """
    enc = codec(path)
    data, at, _ = enc.decode(np.array(ids, np.int64), np.arange(len(ids) + 1))
    reader = codecs.getincrementaldecoder("utf-8")("replace")
    return [reader.decode(bytes(data[at[i] : at[i + 1]]), i + 1 == len(ids)) for i in range(len(ids))]


def digest(rows: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoded and decoded rows, by built-in functions."""
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
