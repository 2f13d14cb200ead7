"""Phrase collocations: contiguous phrases of 2 to 4 words that are frequent and whose parts hold together.

1. Sketches. Every chunk of texts counts its phrases by hash in two rows of counters; the rows are cut into ranges of
   2^20 counters, packed as gaps and counts, and summed range by range. The smaller of a phrase's two counters bounds its
   frequency from above, so one bit a counter (is it at least ``min_count``?) tells which phrases can be frequent, single
   words among them. Longer phrases are counted only where all their pairs can be frequent. The number of counters follows the corpus up to
   ``max_bits``; the broadcast bits are so bounded (2^max_bits / 8 bytes a row), and beyond that only more candidates
   pass, never fewer.
2. Scan. In each chunk the phrases that pass, and the words in them, are compiled into one Aho-Corasick automaton. Words are guarded by blanks and
   pieces end in a line feed, so `` the of `` matches whole words inside one piece alone, and overlapping matches all
   count. Chunks return one row per language and phrase: an automaton and its counts follow the chunk, not the corpus,
   and texts are never shuffled.
3. Sums. Counts are added up by phrase, then thresholds, scores and containment are joins on phrases. Exact: sketches
   only choose candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialise, text_batches
from .textops import _POS, U64, hash_spans, mix

RANGE = 20
_DELIMITERS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + _DELIMITERS, b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(_DELIMITERS))
_ROWS = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F))
_SLICE = 1 << 19


@dataclass(frozen=True)
class Params:
    min_count: int = 30
    longest: int = 4
    contained: int = 80  # per cent of a phrase's occurrences that lie in a longer candidate, from which it is dropped
    scale: int = 2_000_000
    top: int = 2000
    chunk: int = 1 << 23  # bytes of text compiled and scanned together; a longer text is a chunk of its own
    bucket: int = 1 << 24  # bytes of texts for each bucket in which phrases are summed
    held: int = 500_000  # counts that wait to be summed in a task; twice as many sums leave it
    min_bits: int = RANGE
    max_bits: int = 28
    bytes_per_counter: int = 24


def normalised(text: str | None) -> bytes:
    """`` w1 w2 \\n w3 \\n``: pieces of lower-cased words, each word between blanks, each piece closed by a line feed."""
    pieces = (x.split() for x in (text or "").encode().translate(_TABLE).split(b"\n"))
    return b"".join(b" " + b" ".join(w) + b" \n" for w in pieces if w)


def chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[dict[str, bytes]]:
    """For each chunk of texts its normalised text by language."""
    held: dict[str, list[bytes]] = {}
    total = 0
    for batch in batches:
        for text, lang in zip(batch.column("text"), batch.column("lang"), strict=True):
            own = normalised(text.as_py())
            held.setdefault(lang.as_py(), []).append(own)
            total += len(own)
            if total >= size:
                yield {k: b"".join(v) for k, v in held.items()}
                held, total = {}, 0
    if held:
        yield {k: b"".join(v) for k, v in held.items()}


class Grams:
    """Words of a normalised text and the hashes of its phrases; the language is part of a hash."""

    def __init__(self, text: bytes, lang: str):
        self.data = np.frombuffer(text, np.uint8)
        self.lang = mix(np.array([int.from_bytes(lang.encode()[:8].ljust(8), "little") ^ len(lang)], U64))[0]
        starts, ends, hashes, at = [], [], [], 0
        while at < len(text):  # slices end with a piece
            to = len(text) if len(text) - at <= _SLICE else text.find(b"\n", at + _SLICE) + 1
            part = self.data[at:to]
            inside = (part != 32) & (part != 10)
            edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
            first, last = edge[::2], edge[1::2]
            hashes.append(hash_spans(part, first, last, inside))
            starts.append(first + at)
            ends.append(last + at)
            at = to
        none = np.zeros(0, np.int64)
        self.starts, self.ends = np.concatenate([none, *starts]), np.concatenate([none, *ends])
        self.hash = np.concatenate([np.zeros(0, U64), *hashes])
        # A piece's last word is followed by a blank and a line feed.
        closes = self.data[np.minimum(self.ends + 1, max(0, len(self.data) - 1))] == 10 if len(self.ends) else np.zeros(0, bool)
        self.piece = np.cumsum(closes) - closes

    def places(self, k: int) -> np.ndarray:
        """Positions of the phrases of k words inside one piece."""
        n = max(0, len(self.hash) - k + 1)
        return np.flatnonzero(self.piece[:n] == self.piece[k - 1 : k - 1 + n])

    def phrases(self, at: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the phrases of k words at these positions."""
        out = np.full(len(at), self.lang, U64)
        out += U64(k)
        for j in range(k):
            out += self.hash[at + j] * _POS[j]
        return mix(out)


def _slots(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (hashes * _ROWS[row]) >> U64(64 - bits)


class Filter:
    """Which phrases can be frequent: for each number of words the bits of both rows of counters."""

    def __init__(self, bits: int, rows: dict[int, list[np.ndarray]]):
        self.bits, self.rows = bits, rows

    def passes(self, k: int, hashes: np.ndarray) -> np.ndarray:
        ok = np.ones(len(hashes), bool)
        for row, held in enumerate(self.rows[k]):
            slot = _slots(hashes, row, self.bits)
            ok &= (held[slot >> U64(3)] >> (slot & U64(7)).astype(np.uint8)) & 1 > 0
        return ok

    def candidates(self, grams: Grams, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For k = 2, 3, ...: k, and positions and hashes of the phrases of k words that can be frequent as far as is known.

        Once pairs are known, also k = 1: the words inside such pairs, or all that pass where words are known themselves.
        """
        good, known = np.zeros(0, bool), 0  # where the longest phrases with bits, of ``known`` words, pass
        for k in range(2, longest + 1):
            at = grams.places(k)
            for j in range(k - known + 1 if known else 0):
                at = at[good[at + j]]
            h = grams.phrases(at, k)
            if k in self.rows:
                ok = self.passes(k, h)
                at, h = at[ok], h[ok]
                good, known = np.zeros(len(grams.hash) + 1, bool), k
                good[at] = True
            if k == 2 and 2 in self.rows:
                single = np.flatnonzero(good[:-1] | np.append(False, good[:-2])) if 1 not in self.rows and len(grams.hash) else grams.places(1)
                own = grams.phrases(single, 1)
                if 1 in self.rows:
                    ok = self.passes(1, own)
                    single, own = single[ok], own[ok]
                yield 1, single, own
            yield k, at, h


def _pack(slots: np.ndarray) -> bytes:
    """Distinct sorted places in a range as gaps (three bytes) and counts (two bytes), byte by byte in planes of their own."""
    place, count = np.unique(slots, return_counts=True)
    gap = np.diff(place, prepend=0).astype(np.uint32)
    count = np.minimum(count, 0xFFFF).astype(np.uint32)
    planes = [gap & 255, gap >> 8 & 255, gap >> 16, count & 255, count >> 8]
    return np.concatenate(planes).astype(np.uint8).tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    b0, b1, b2, c0, c1 = np.frombuffer(blob, np.uint8).reshape(5, -1).astype(np.int64)
    return np.cumsum(b0 + (b1 << 8) + (b2 << 16)), c0 + (c1 << 8)


def sketch(texts: DataFrame, words: tuple[int, ...], known: Filter, p: Params) -> Filter:
    """``known`` with the bits of phrases of ``words`` words, counted where their known parts can be frequent."""
    sc = texts.sparkSession.sparkContext
    bits, shared, least = known.bits, sc.broadcast(known), p.min_count

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, p.chunk):
            out: list[tuple[int, int, int, bytes]] = []
            held: dict[int, list[np.ndarray]] = {k: [] for k in words}
            for lang, text in chunk.items():
                for k, _, h in shared.value.candidates(Grams(text, lang), max(2, *words)):
                    if k in held:
                        held[k].append(h)
            for k in words:
                h = np.concatenate(held[k])
                for row in range(len(_ROWS)):
                    slot = np.sort(_slots(h, row, bits))
                    part = (slot >> U64(RANGE)).astype(np.int64)
                    cut = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
                    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                        out.append((k, row, int(part[a]), _pack((slot[a:b] & U64((1 << RANGE) - 1)).astype(np.int64))))
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            types = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["k", "row", "part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def done() -> pa.RecordBatch:
            held = np.packbits(total >= least, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int32()) for x in now] + [pa.array([held], pa.binary())], ["k", "row", "part", "bits"])

        for batch in batches:
            for k, row, part, blob in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (k, row, part) != now:
                    if now is not None:
                        yield done()
                    now, total = (k, row, part), np.zeros(1 << RANGE, np.int64)
                place, n = _unpack(blob)
                total[place] += n
        if now is not None:
            yield done()

    parts = texts.mapInArrow(count, "k int, row int, part int, counts binary")
    by = ("k", "row", "part")
    summed = parts.repartition(*by).sortWithinPartitions(*by).mapInArrow(add, "k int, row int, part int, bits binary")
    rows = dict(known.rows) | {k: [np.zeros(1 << bits >> 3, np.uint8) for _ in _ROWS] for k in words}
    size = 1 << RANGE >> 3
    for r in summed.toLocalIterator():  # a bounded number of ranges
        rows[r["k"]][r["row"]][r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return Filter(bits, rows)


def _planes(counts: np.ndarray) -> bytes:
    return np.concatenate([counts >> (8 * i) & 255 for i in range(5)]).astype(np.uint8).tobytes()


def _counts(planes: bytes) -> np.ndarray:
    return sum(x.astype(np.int64) << (8 * i) for i, x in enumerate(np.frombuffer(planes, np.uint8).reshape(5, -1)))


class Totals:
    """Counts by language and phrase that are added up as they come, compacted after every ``room`` new ones."""

    def __init__(self, room: int):
        self.room, self.tables, self.waiting = room, [], 0

    def add(self, table: pa.Table) -> None:
        self.tables.append(table)
        self.waiting += table.num_rows
        if self.waiting > self.room:
            self.compact()

    def compact(self) -> pa.Table:
        """All so far; stays held."""
        t = pa.concat_tables(self.tables).group_by(["lang", "phrase"]).aggregate([("f", "sum"), ("bucket", "min")])
        self.tables, self.waiting = [t.rename_columns(["lang", "phrase", "f", "bucket"])], 0
        return self.tables[0]

    def rows(self) -> int:
        return sum(t.num_rows for t in self.tables)


def counted(texts: DataFrame, found: Filter, size: int, p: Params) -> DataFrame:
    """(lang, phrase, words, f): exact frequencies of the words and phrases that can be frequent; '' has all words.

    A task adds up its chunks, within bounded memory, and returns one row for each language and bucket of phrases, with the
    phrases in order and their counts. Buckets follow the corpus; a bucket is summed as its rows arrive.
    """
    shared = texts.sparkSession.sparkContext.broadcast(found)
    buckets = max(64, size // p.bucket)

    def told(t: pa.Table) -> pa.RecordBatch:
        t = t.sort_by([("bucket", "ascending"), ("lang", "ascending"), ("phrase", "ascending")]).combine_chunks()
        lang, bucket = t["lang"].combine_chunks().dictionary_encode(), t["bucket"].to_numpy()
        group = bucket * len(lang.dictionary) + lang.indices.to_numpy()
        cut = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group)).tolist()
        phrase, f = t["phrase"].to_pylist(), t["f"].to_numpy()
        parts = list(zip(cut[:-1], cut[1:], strict=True))
        columns = [pa.array(bucket[cut[:-1]]), t["lang"].take(pa.array(cut[:-1])).combine_chunks(), pa.array(["\n".join(phrase[a:b]) for a, b in parts]), pa.array([_planes(f[a:b]) for a, b in parts])]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "lang", "phrases", "counts"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        held = Totals(p.held)
        for chunk in chunks(batches, p.chunk):
            for lang, text in chunk.items():
                grams = Grams(text, lang)
                keys, hashes = [], [np.zeros(0, U64)]
                for k, at, h in shared.value.candidates(grams, p.longest):
                    h, first = np.unique(h, return_index=True)
                    at = at[first]
                    hashes.append(h)
                    keys += [text[a:b].decode() for a, b in zip((grams.starts[at] - 1).tolist(), (grams.ends[at + k - 1] + 1).tolist(), strict=True)]
                counts = np.zeros(0, np.int64)
                if keys:
                    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
                    for i, key in enumerate(keys):
                        automaton.add_word(key, i)
                    automaton.make_automaton()
                    hits = np.fromiter((i for _, i in automaton.iter(text.decode())), np.int32)
                    counts = np.bincount(hits, minlength=len(keys))
                bucket = np.append((np.concatenate(hashes) >> U64(20)) % U64(buckets), U64(0)).astype(np.int64)
                names = pa.array([*(x[1:-1] for x in keys), ""], pa.string())
                held.add(pa.table({"lang": pa.array([lang] * len(names), pa.string()), "phrase": names, "f": np.append(counts, len(grams.hash)).astype(np.int64), "bucket": bucket}))
            if held.rows() > 2 * p.held:
                yield told(held.compact())
                held = Totals(p.held)
        if held.tables:
            yield told(held.compact())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = Totals(p.held), None

        def done() -> Iterator[pa.RecordBatch]:
            t = held.compact()
            words = pc.if_else(pc.equal(t["phrase"], ""), 0, pc.add(pc.count_substring(t["phrase"], " "), 1)).cast(pa.int32())
            t = t.append_column("words", words)
            t = t.filter(pc.or_(pc.greater_equal(t["f"], p.min_count), pc.equal(t["words"], 0)))
            yield from t.select(["lang", "phrase", "words", "f"]).combine_chunks().to_batches()

        for batch in batches:
            for bucket, lang, phrases, counts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held.tables and bucket != now:
                    yield from done()
                    held = Totals(p.held)
                now = bucket
                names = phrases.split("\n")
                held.add(pa.table({"lang": pa.array([lang] * len(names), pa.string()), "phrase": pa.array(names, pa.string()), "f": _counts(counts), "bucket": np.full(len(names), bucket)}))
        if held.tables:
            yield from done()

    lists = texts.mapInArrow(scan, "bucket long, lang string, phrases string, counts binary")
    return lists.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add, "lang string, phrase string, words int, f long")


def scored(counts: DataFrame, p: Params) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of each candidate at its lowest-scoring cut, ties to the shortest first part."""
    terms = F.split("phrase", " ", -1)
    cuts = counts.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), terms.alias("w"))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest"))
    # Parts are at least as frequent as the whole, so each has its count.
    part = counts.where("words > 0").select(F.col("lang").alias("__lang"), F.col("phrase").alias("__part"), F.col("f"))
    left = cuts.join(part, (F.col("lang") == F.col("__lang")) & (F.col("first") == F.col("__part"))).withColumnRenamed("f", "l").drop("__lang", "__part")
    both = left.join(part, (F.col("lang") == F.col("__lang")) & (F.col("rest") == F.col("__part"))).withColumnRenamed("f", "r").drop("__lang", "__part")
    score = F.expr(f"(cast({p.scale} as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    lowest = F.min(F.struct(score.alias("score"), "k", "a", "l", "r")).alias("x")
    return both.groupBy("lang", "phrase", "words").agg(lowest).select("lang", "phrase", "words", "x.a", "x.l", "x.r", "x.score")


def contained(counts: DataFrame, p: Params) -> DataFrame:
    """(lang, phrase) of the candidates that a longer candidate holds in most of their occurrences."""
    longer = counts.where("words > 2").select("lang", F.col("f").alias("longer"), "words", F.split("phrase", " ", -1).alias("w"))
    size = longer.select("lang", "longer", "words", "w", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("k"))
    inside = size.select("lang", "longer", "k", "w", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("k") + 1)).alias("i"))
    inside = inside.select("lang", F.array_join(F.slice("w", F.col("i"), F.col("k")), " ").alias("phrase"), "longer")
    most = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    both = most.join(counts.where("words > 1"), ["lang", "phrase"])
    return both.where(F.col("longer").cast("decimal(20,0)") * 100 >= F.col("f").cast("decimal(20,0)") * p.contained).select("lang", "phrase")


def ranked(found: DataFrame, p: Params) -> DataFrame:
    """The first ``top`` rows of each language with their ``rank``, chosen in parts first so that no task sees a whole language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", "__part").orderBy(*order)
    few = found.withColumn("__part", F.pmod(F.xxhash64("phrase"), F.lit(16))).withColumn("rank", F.row_number().over(part)).where(f"rank <= {p.top}")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(f"rank <= {p.top}").drop("__part")


def collocations(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The best collocations of each language of ``docs`` (text, lang): lang, rank, phrase, a, l, r, n, score.

    A null text is empty, a null lang is ``und``. Words are what blanks and tabs part, within pieces that the signs
    ``. , ; : ! ?`` and line ends part; A-Z are lower-cased. a, l, r are the frequencies of the phrase and of its parts at
    the cut that scores lowest, n all words of the language. Repeated rows count each; equal scores are ordered by a, then
    by the phrase's bytes; other columns are ignored; an empty table gives no rows.
    """
    texts = text_batches(docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(p.max_bits, max(p.min_bits, (size // p.bytes_per_counter).bit_length()))
    found = Filter(bits, {})
    for words in ((2,), (1, *range(3, p.longest + 1))):
        found = sketch(texts, words, found, p)
    counts = materialise(counted(texts, found, size, p), "phrase-counts")
    n = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    kept = scored(counts, p).join(contained(counts, p), ["lang", "phrase"], "left_anti")
    top = ranked(kept, p)
    return top.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
