"""Language identification by prediction by partial matching.

Each language has a byte model of variable order: contexts of 0 to ``order`` bytes with the counts of what followed
them. A byte is coded in the longest context the language knows; if the context never saw it, an escape is paid and
the next shorter context tried, down to a uniform code (escape method C: with n counts and d distinct followers, a
follower seen c times costs -log2(c / (n + d)), an escape -log2(d / (n + d))). Statistics are frozen after training.
A text's code length is exact for every language; the shortest wins.

Training takes a bounded sample of labelled texts. Scoring covers whole texts: the cost of every context-and-byte
known to any language is tabulated for all languages at once, so a text is scored by table lookups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .scratch import apart, materialise, small_enough, text_batches, together
from .textops import U64, VecMap, buffers, slices

UNDETERMINED = "und"
SCHEMA = "lang_pred string, score double, bits_per_byte double"


@dataclass(frozen=True)
class Params:
    order: int = 4  # at most 6: a context and its byte fit in 64 bits
    texts: int = 96  # training texts for each language
    longest: int = 32_768  # characters that a training text gives at most: a longer one a stretch of so many from a place by hash
    apart: int = 1 << 18  # bytes of held-apart texts that each length of pieces is measured on, at most
    stretch: int = 64  # bytes that are judged in one language; texts may hold several
    least: int = 100  # pieces of a length that must be measured for a bound of its own
    quantile: float = 0.9995  # of the pieces' bits a byte
    margin: float = 1.5  # times that quantile is the bound


def held_out(doc_id: str = "doc_id") -> F.Column:
    """True where crc32 of the id as text is divisible by 5; such rows are never learned from. A null id is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def _grams(data: np.ndarray, off: np.ndarray, length: int) -> np.ndarray:
    """For each byte the number made of it and the length - 1 bytes before it in its text (zeros before the start)."""
    place = np.arange(len(data)) - np.repeat(off[:-1], np.diff(off))
    key = data.astype(U64)
    for j in range(1, length):
        before = np.zeros(len(data), U64)
        before[j:] = data[:-j] if j < len(data) else 0
        before[place < j] = 0
        key |= before << U64(8 * j)
    return key


# A word with a digit, @ or = is a key, a number or an address in any language.
ODD = r"(?<!\S)[^\s0-9@=]*+[0-9@=]\S*+"


def plain(text: F.Column) -> F.Column:
    """The text without its odd words; the whole text where no letter is left."""
    words = F.regexp_replace(text, ODD, " ")
    return F.transform(F.array(words), lambda w: F.when(w.rlike(r"\p{L}"), w).otherwise(text))[0]


def bounds(model: Model, texts: pa.Array, p: Params) -> dict[int, float]:
    """For lengths of 2, 4, 8, ... bytes the bits a byte that a piece of that length in the corpus's languages hardly exceeds.

    ``texts`` are plain texts the model hasn't learned from. A longer piece is never allowed more than a shorter one.
    """
    data, off = buffers(pc.utf8_lower(texts))
    found: dict[int, float] = {}
    k = 1
    while model.languages and len(off) > 1 and (1 << k) <= int(np.diff(off).max()):
        size, begins = 1 << k, []
        for b, e in zip(off[:-1], off[1:], strict=True):
            begins.append(np.arange(b, e - size + 1, size))
        begin = np.concatenate(begins)
        begin = begin[:: max(1, -(-len(begin) * size // p.apart))]
        if len(begin) < p.least:
            break
        pieces = data[(begin[:, None] + np.arange(size)).reshape(-1)]
        rate = model.stretches(pieces, np.arange(len(begin) + 1) * size, p.stretch)[1]
        found[size] = min(float(np.quantile(rate, p.quantile)) * p.margin, found.get(size >> 1, np.inf))
        k += 1
    return found


class Model:
    """Frozen tables: per length 1..order+1 the cost of each gram, and of escaping from each full context, by language."""

    bounds: dict[int, float] = {}  # of bits a byte by length, where ``fit`` has measured them

    def __init__(self, texts: dict[str, pa.Array], order: int):
        self.languages = sorted(texts)
        self.order = order
        found = [[np.unique(_grams(*buffers(pc.utf8_lower(texts[name])), k), return_counts=True) for name in self.languages] for k in range(1, order + 2)]
        n_lang = len(self.languages)
        self.maps: list[VecMap] = []
        self.costs: list[np.ndarray] = []
        self.escapes: list[tuple[VecMap, np.ndarray]] = []
        for k in range(1, order + 2):
            keys = np.unique(np.concatenate([f[0] for f in found[k - 1]])) if n_lang else np.zeros(0, U64)
            # The context is the gram without its last byte, which is the lowest 8 bits.
            contexts, of = np.unique(keys >> U64(8), return_inverse=True)
            lower = self.cost(keys & U64((1 << (8 * (k - 1))) - 1), k - 1)
            cost = np.empty((len(keys), n_lang))
            escape = np.zeros((len(contexts), n_lang))
            for j, (own, count) in enumerate(found[k - 1]):
                at = np.searchsorted(keys, own)
                c = np.zeros(len(keys))
                c[at] = count
                n = np.bincount(of, c, len(contexts))
                d = np.bincount(of, c > 0, len(contexts))
                with np.errstate(divide="ignore", invalid="ignore"):
                    escape[:, j] = np.where(n > 0, -np.log2(d / (n + d)), 0.0)
                    cost[:, j] = np.where(c > 0, -np.log2(c / (n + d)[of]), escape[of, j] + lower[:, j])
            self.maps.append(VecMap(keys))
            self.costs.append(cost.astype(np.float32))
            self.escapes.append((VecMap(contexts), escape.astype(np.float32)))

    def cost(self, keys: np.ndarray, length: int) -> np.ndarray:
        """Bits of each gram's last byte in every language, from contexts of length - 1 bytes down."""
        if length == 0:
            return np.full((len(keys), len(self.languages)), 8.0, np.float32)
        at = self.maps[length - 1].get(keys)
        out = self.costs[length - 1][np.maximum(at, 0)] if len(self.costs[length - 1]) else np.zeros((len(keys), len(self.languages)), np.float32)
        lost = np.flatnonzero(at < 0)
        if len(lost):
            shorter = self.cost(keys[lost] & U64((1 << (8 * (length - 1))) - 1), length - 1)
            where, escape = self.escapes[length - 1]
            c = where.get(keys[lost] >> U64(8))
            known = c >= 0
            shorter[known] += escape[c[known]]
            out[lost] = shorter
        return out

    def lengths(self, data: np.ndarray, off: np.ndarray, step: int = 1 << 18, cuts: np.ndarray | None = None) -> np.ndarray:
        """Code length in bits of each text, or of each stretch between ``cuts``, in each language."""
        keys = _grams(data, off, self.order + 1)
        cuts = off if cuts is None else cuts
        total = np.zeros((len(cuts) - 1, len(self.languages)))
        doc = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        for s in range(0, len(keys), step):
            bits = self.cost(keys[s : s + step], self.order + 1)
            d = doc[s : s + step]
            begin = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
            total[d[begin]] += np.add.reduceat(bits, begin, axis=0, dtype=np.float64)
        return total

    def stretches(self, data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(code length of each text in each language, bits a byte with each stretch of ``size`` bytes in the language it costs least in)."""
        each = -(-np.diff(off) // size)
        of = np.repeat(np.arange(len(off) - 1), each)
        place = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
        bits = self.lengths(data, off, cuts=np.append(off[:-1][of] + place * size, off[-1]))
        total = np.stack([np.bincount(of, b, len(off) - 1) for b in bits.T], axis=1)
        return total, np.bincount(of, bits.min(axis=1), len(off) - 1) / np.maximum(1, np.diff(off))


def fit(labelled: DataFrame, p: Params = Params()) -> Model:
    """Train on rows of (doc_id, text, lang); null or empty texts, null languages and ids are ignored.

    A language gives ``texts`` texts, or all it has, in order of a hash of their ids, those up to ``longest`` characters
    first. As many more measure the bounds of ``reject_unknown``. Equal rows count once.
    """
    rows = labelled.where("lang is not null and doc_id is not null and length(text) > 0").select("doc_id", "lang", "text", F.xxhash64("text").alias("key"))
    w = Window.partitionBy("lang").orderBy("long", F.xxhash64("doc_id"), "doc_id", "key")
    # A draw by hash leaves several times as many as a language needs, of short texts and of long ones; those are put in order.
    ids = rows.select("doc_id", "lang", "key", (F.length("text") > p.longest).alias("long"))
    many = materialise(ids.groupBy("lang", "long").agg(F.count("*").alias("rows")), "languages")
    few = small_enough(many, 10_000)  # rows of a name and a number; the training texts are at most 2 * texts times as many
    draw = F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = ids.join(F.broadcast(many) if few else many, ["lang", "long"]).where(draw * F.col("rows") < 8 * p.texts).select("doc_id", "lang", "key", "long").distinct()
    chosen = materialise(drawn.withColumn("n", F.row_number().over(w)).where(F.col("n") <= 2 * p.texts).drop("long"), "training")
    place = F.pmod(F.xxhash64("doc_id"), F.length("text") - p.longest)
    piece = F.when(F.length("text") > p.longest, F.substr("text", (place + 1).cast("int"), F.lit(p.longest))).otherwise(F.col("text"))
    found = rows.join(F.broadcast(chosen) if few else chosen, ["doc_id", "lang", "key"]).select("lang", "n", piece.alias("text")).dropDuplicates(["lang", "n"])
    found = found.select("lang", "n", "text", plain(F.col("text")).alias("plain")).toArrow().sort_by([("lang", "ascending"), ("n", "ascending")])
    learned = found.filter(pc.less_equal(found.column("n"), p.texts))
    texts = {name: learned.filter(pc.equal(learned.column("lang"), name)).column("text").combine_chunks() for name in pc.unique(learned.column("lang")).to_pylist()}
    model = Model(texts, p.order)
    model.bounds = bounds(model, found.filter(pc.greater(found.column("n"), p.texts)).column("plain").combine_chunks(), p)
    return model


def predict(docs: DataFrame, model: Model, stretch: int = 0) -> DataFrame:
    """All columns of ``docs`` with lang_pred, score and bits_per_byte, which replace columns of those names.

    score is the posterior of the predicted language under a uniform prior; ``und`` (score 0) is for texts that are
    null or without a letter, or if there is no language to choose from. Ties go to the language first in order. With ``stretch``, bits_per_byte
    takes each stretch of so many bytes in the language it costs least in.
    """
    sent: Broadcast = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score", "bits_per_byte")
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    inner = docs.withColumn("__letter", has_letter)
    names = inner.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        languages = pa.array([*model.languages, UNDETERMINED])
        for batch in batches:
            for part in slices(batch, "text"):
                data, off = buffers(pc.utf8_lower(part.column("text")))
                letter = part.column("__letter").to_numpy(zero_copy_only=False).astype(bool)
                if not model.languages:
                    letter &= False
                mixed = None
                if stretch and model.languages:
                    bits, mixed = model.stretches(data, off, stretch)
                else:
                    bits = model.lengths(data, off) if model.languages else np.zeros((len(off) - 1, 1))
                best = bits.argmin(axis=1)
                least = bits[np.arange(len(bits)), best]
                score = 1.0 / np.exp2(np.maximum(least[:, None] - bits, -1000.0)).sum(axis=1)
                pred = languages.take(pa.array(np.where(letter, best, len(languages) - 1)))
                rate = least / np.maximum(1, np.diff(off)) if mixed is None else mixed
                kept = [part.column(i) for i in range(part.num_columns) if part.schema.names[i] != "__letter"]
                yield pa.RecordBatch.from_arrays([*kept, pred, pa.array(np.where(letter, score, 0.0)), pa.array(np.where(letter, rate, 8.0))], [*(n for n in names if n != "__letter"), "lang_pred", "score", "bits_per_byte"])

    schema = StructType([*docs.schema.fields])
    for field in ("lang_pred string", "score double", "bits_per_byte double"):
        schema = schema.add(*field.split())
    return text_batches(inner).mapInArrow(run, schema)


def reject_unknown(docs: DataFrame, model: Model, unmeasured: float = 11.0) -> DataFrame:
    """Rows whose language is determined and whose plain words cost no more than the corpus's languages; columns as before.

    Each stretch of a text counts in the language it costs least in, so a text in two known languages stays. The bound is
    that of the longest measured length that the plain text reaches. A corpus too small to measure any has ``unmeasured``
    for all.
    """
    bound = F.lit(max(model.bounds.values(), default=unmeasured))
    for size, bits in sorted(model.bounds.items()):
        bound = F.when(F.octet_length("text") >= size, F.lit(bits)).otherwise(bound)
    rows = apart(docs, "text").withColumn("__whole", F.col("text")).withColumn("text", plain(F.col("text")))
    judged = predict(rows, model, Params.stretch)
    kept = judged.where((F.col("lang_pred") != UNDETERMINED) & (F.col("bits_per_byte") <= bound))
    return together(kept.withColumn("text", F.col("__whole")), docs, "text")
