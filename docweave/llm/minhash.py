"""Near-duplicate documents by SuperMinHash signatures, banding, exact verification and component grouping.

1. One pass over the texts gives each document's shingle-set size, a 128-bit digest of the set and its
   signature. Documents with equal sets form one class, which goes on as one node.
2. Nodes that share a band meet in blocks of bounded size; signatures that agree in at least ``agree`` of
   the slots join them to a family (a spanning forest per block, never all pairs).
3. Nodes of a family get their full shingle sets again, from the texts, and exact intersection sizes decide
   the links. A family of at most ``unit`` nodes is compared in one task. In a larger one each node is first
   compared with the node whose signature agrees best; what these links join is one part, and only nodes
   outside the family's largest part are then compared with all others. A link within a part changes no
   component, so none is lost, and a family of copies of one text costs its size, not its square.
4. Components of links, then members of classes, give every document its smallest reachable id.

A large bucket or family is dealt out as pairs of chunks, so no task holds an unbounded group. Bands and
``agree`` leave a pair of similarity 0.8 a chance of about 1e-4 to be missed; no link is ever assumed.
Null or wordless texts have an empty set and link with nothing. An id with several texts is one document
for each text, so reruns agree; equal rows are alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, forest
from .scratch import materialise, small_enough, text_batches
from .textops import U64, Words, buffers, distinct_by_doc, mix, shingles, slices


@dataclass(frozen=True)
class Params:
    words: int = 4
    numerator: int = 80  # links: 100 * intersection >= numerator * union
    bands: int = 25
    rows: int = 5
    agree: float = 0.62
    chunk: int = 512  # signatures of a block
    unit: int = 128  # shingle sets of a block
    crowd: int = 64  # nodes of a block of signatures from which on each node's best partner is noted
    broadcast_rows: int = 1_000_000  # 16 bytes each: ids that may be sent to every executor

    @property
    def slots(self) -> int:
        return self.bands * self.rows


def signature(values: np.ndarray, slots: int) -> np.ndarray:
    """SuperMinHash of a set of 64-bit hashes: slot minima of (permutation rank + uniform).

    Element by element the ranks of one random permutation are dealt to the slots; rank j is looked at only
    while some slot could still get a smaller value than it holds, so large sets stop after a rank or two.
    """
    n = len(values)
    best = np.full(slots, np.inf)
    perm = None
    rows = np.arange(n)
    for j in range(slots):
        r = mix(values + U64((j + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
        uniform = (r >> U64(32)).astype(np.float64) * 2.0**-32
        k = j + (((r & U64(0xFFFFFFFF)) * U64(slots - j)) >> U64(32)).astype(np.int64)
        if j == 0:
            slot = k
            first = k
        else:
            if perm is None:
                perm = np.broadcast_to(np.arange(slots, dtype=np.int16), (n, slots)).copy()
                perm[rows, first] = 0
                perm[:, 0] = first
            slot = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
            perm[:, j] = slot
        np.minimum.at(best, slot, uniform + j)
        if best.max() <= j + 1:
            break
    return best


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


SKETCH = "doc_id long, text_key long, n_shingles long, digest binary, bands array<long>, sig binary"


def sketches(docs: DataFrame, p: Params) -> DataFrame:
    """One row per document row: hash of the text, set size, set digest, band keys and 16-bit slots of the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(p.bands).astype(U64) * U64(0xA0761D6478BD642F)
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(*buffers(part.column("text")))
                value, at = distinct_by_doc(*shingles(w, p.words), w.docs)
                digest, bands, sig, known = [], [], [], {}
                for i in range(w.docs):
                    own = value[at[i] : at[i + 1]]
                    if not len(own):
                        digest.append(None), bands.append([]), sig.append(None)
                        continue
                    d = _digest(own)
                    if d not in known:
                        bits = mix(signature(own, p.slots).view(U64))
                        key = bits.reshape(p.bands, p.rows)
                        mixed = salt.copy()
                        for r in range(p.rows):
                            mixed = mix(mixed ^ key[:, r])
                        known[d] = mixed.view(np.int64), (bits & U64(0xFFFF)).astype(np.uint16).tobytes()
                    digest.append(d), bands.append(known[d][0]), sig.append(known[d][1])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array(np.diff(at)), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                    ["doc_id", "text_key", "n_shingles", "digest", "bands", "sig"],
                )

    return text_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))).mapInArrow(run, SKETCH)


def in_chunks(members: DataFrame, key: str, chunk: int, columns: list[str]) -> DataFrame:
    """Deal each group of ``members`` to units of at most about two chunks, a unit for each pair of chunks.

    A group of at most ``chunk`` rows is one unit. ``side`` is 0 or 1 in a unit of two chunks, else 0.
    """
    sizes = members.groupBy(F.col(key).alias("g")).agg(F.count("*").alias("n"), F.min("node").alias("unit_lo")).where("n > 1")
    sizes = materialise(sizes, "sizes")
    spread = members.join(sizes, members[key] == sizes.g).select(
        F.col("g"), *columns, F.ceil(F.col("n") / chunk).cast("long").alias("k"), F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / chunk).cast("long")).alias("c")
    )
    other = F.explode(F.when(F.col("k") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    return spread.withColumn("o", other).select(
        F.xxhash64("g", F.least("c", "o"), F.greatest("c", "o")).alias("unit"), "g", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), F.when(F.col("c") > F.col("o"), 1).otherwise(0).alias("side"), *columns
    )


def by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Regroup a partition sorted by (unit, g, i, j) into one table per unit."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in ("unit", "g", "i", "j")])
        cut = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
            own = tuple(keys[:, a].tolist())
            if own != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = own
    if held:
        yield pa.Table.from_batches(held)


EDGES = "a long, b long"


def _edges(a: list[np.ndarray], b: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def _joined(node: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids, root = forest(node[x], node[y])
    return ids[ids != root], root[ids != root]


def families(nodes: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """((node, component), (node, partner)): nodes whose signatures agree, over all buckets of all bands, and of nodes in
    crowded buckets the one that agrees best.

    ``nodes`` is (node, bands, sig).
    """
    keys = nodes.select("node", F.explode("bands").alias("bucket"))
    # As a table: then both sides of the join are plain exchanges, and a bucket of many documents can be split.
    full = materialise(keys.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "full-buckets")
    keys = materialise(keys.join(full, "bucket", "left_semi"), "buckets")
    met = keys.select("node").distinct()
    member = keys.join(nodes.select("node", "sig").join(met, "node", "left_semi"), "node")
    units = in_chunks(member, "bucket", p.chunk, ["node", "sig"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = int(np.ceil(p.agree * p.slots))
        for t in by_unit(batches):
            node, side = t.column("node").to_numpy(), t.column("side").to_numpy()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(len(node), p.slots)
            left = np.flatnonzero(side == 0) if side.any() else np.arange(len(node))
            right = np.flatnonzero(side == 1) if side.any() else left
            a, b, same = [], [], []
            for x in left:
                agree = (sig[right] == sig[x]).sum(axis=1)
                hit = (agree >= least) & (right != x)
                if hit.any():
                    a.append(np.full(hit.sum(), x)), b.append(right[hit]), same.append(agree[hit])
            if a:
                x, y, agree = np.concatenate(a), np.concatenate(b), np.concatenate(same)
                high, low = _joined(node, x, y)
                yield _rows(high, low, np.zeros(len(high), np.int64))
                if len(node) >= p.crowd:
                    x, y, agree = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([agree, agree])
                    order = np.lexsort((node[y], -agree, x))
                    first = order[np.append(True, np.diff(x[order]) > 0)]
                    yield _rows(node[x[first]], node[y[first]], agree[first])

    found = materialise(units.repartition("unit").sortWithinPartitions("unit", "g", "i", "j").mapInArrow(run, "a long, b long, agree long"), "candidates")
    partner = found.where("agree > 0").groupBy(F.col("a").alias("node")).agg(F.max(F.struct("agree", (-F.col("b")).alias("b"))).alias("x"))
    return components(found.where("agree = 0").select("a", "b")), partner.select("node", (-F.col("x.b")).alias("partner"))


def _rows(a: np.ndarray, b: np.ndarray, agree: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(agree)], ["a", "b", "agree"])


def shingle_sets(docs: DataFrame, p: Params) -> DataFrame:
    """(doc_id, digest, shingles): the sorted 64-bit shingle set of each document, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(*buffers(part.column("text")))
                value, at = distinct_by_doc(*shingles(w, p.words), w.docs)
                rows = [value[at[i] : at[i + 1]] for i in range(w.docs)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([_digest(x) for x in rows], pa.binary()), pa.array([x.tobytes() for x in rows], pa.binary())], ["doc_id", "digest", "shingles"])

    return docs.mapInArrow(run, "doc_id long, digest binary, shingles binary")


def exact_links(sets: list[np.ndarray], side: np.ndarray, numerator: int, slab: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (x of side 0, y of side 1, or x < y where all are of side 0) whose sets meet the threshold."""
    sizes = np.array([len(s) for s in sets])
    value, column = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(column, minlength=len(value)) > 1
    place = np.cumsum(shared) - 1
    row = np.repeat(np.arange(len(sets)), sizes)
    keep = shared[column]
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if side.any() else left
    common = np.zeros((len(left), len(right)), np.float32)
    width = int(place[-1]) + 1
    for s in range(0, width, slab):
        lo, hi = np.searchsorted(column, [s, s + slab])
        m = np.zeros((len(sets), min(slab, width - s)), np.float32)
        m[row[lo:hi], column[lo:hi] - s] = 1
        common += m[left] @ m[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - common
    x, y = np.nonzero(100.0 * common >= numerator * union)
    x, y = left[x], right[y]
    return (x[x < y], y[x < y]) if not side.any() else (x, y)


def _by_blocks(p: Params):
    """Edges of each block of sets: a spanning forest of the links confirmed on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_unit(batches):
            node, side = t.column("node").to_numpy(), t.column("side").to_numpy()
            sets = [np.frombuffer(x, U64) for x in t.column("shingles").to_pylist()]
            x, y = exact_links(sets, side, p.numerator)
            if len(x):
                yield from _edges(*([v] for v in _joined(node, x, y)))

    return run


def _by_pairs(p: Params):
    """Edges of those pairs of sets (a, b, x, y) that meet the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(k)[i].as_buffer(), U64) for k in ("x", "y"))
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked[i] = 100 * common >= p.numerator * (len(x) + len(y) - common)
            yield batch.select(["a", "b"]).filter(pa.array(linked))

    return run


def _outsiders(family: DataFrame, edges: DataFrame, p: Params) -> DataFrame:
    """(unit, g, i, j, side, node): blocks that compare each node outside its family's largest part with all of the family."""
    part = components(edges).withColumnRenamed("component", "part")
    labelled = materialise(family.join(part, "node", "left").select("node", "family", F.coalesce("part", "node").alias("part")), "parts")
    size = labelled.groupBy("family", "part").agg(F.count("*").alias("n"))
    core = size.groupBy("family").agg(F.max(F.struct("n", "part")).alias("core"), F.sum("n").alias("m")).select("family", "core.part", "m", (F.col("m") - F.col("core.n")).alias("s"))
    core = materialise(core.where("s > 0").withColumnRenamed("part", "core"), "cores")
    chunks = [F.ceil(F.col(c) / p.unit).cast("long").alias(k) for c, k in (("s", "ks"), ("m", "km"))]
    rows = labelled.join(core.select("family", "core", *chunks), "family")

    def dealt(of: DataFrame, side: int, own: str, other: str, i: str, j: str) -> DataFrame:
        rows = of.withColumn(i, F.pmod(F.xxhash64("node"), F.col(own))).withColumn(j, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        return rows.select(F.xxhash64("family", "i", "j").alias("unit"), F.col("family").alias("g"), "i", "j", F.lit(side).alias("side"), "node")

    return dealt(rows.where("part <> core"), 0, "ks", "km", "i", "j").unionByName(dealt(rows, 1, "km", "ks", "j", "i"))


def verified(docs: DataFrame, classes: DataFrame, family: DataFrame, partner: DataFrame, p: Params) -> DataFrame:
    """Edges (a, b) of confirmed links that connect what all links connect. ``classes`` is (node, digest, rep)."""
    family = family.withColumnRenamed("component", "family")
    sizes = materialise(family.groupBy("family").agg(F.count("*").alias("n")).where("n > 1"), "family-sizes")
    wanted = materialise(classes.select("node", "digest", F.col("rep").alias("doc_id")).join(family, "node").join(sizes, "family"), "family-members")
    ids = wanted.select("doc_id").distinct()
    ids = F.broadcast(ids) if small_enough(ids, p.broadcast_rows) else ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(ids, "doc_id", "left_semi")
    # Rows of one id and text are one; an id's other texts have other digests and drop out.
    sets = shingle_sets(texts, p).dropDuplicates(["digest", "doc_id"]).join(wanted, ["digest", "doc_id"])
    sets = materialise(sets.select("node", "family", "n", "shingles"), "sets")
    zero = [F.lit(0).cast("long").alias(c) for c in ("g", "i", "j")]
    one = sets.where(F.col("n") <= p.unit).select(F.col("family").alias("unit"), *zero, F.lit(0).alias("side"), "node", "shingles")
    edges = one.repartition("unit").sortWithinPartitions("unit").mapInArrow(_by_blocks(p), EDGES)
    large = wanted.where(F.col("n") > p.unit).select("node", "family")
    if large.isEmpty():
        return edges
    own = sets.where(F.col("n") > p.unit)
    pairs = partner.select(F.col("node").alias("a"), F.col("partner").alias("b"))
    # Two nodes that name each other are compared once.
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = pairs.join(own.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(own.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    near = materialise(pairs.select("a", "b", "x", "y").mapInArrow(_by_pairs(p), EDGES), "partners")
    units = _outsiders(large, near, p).join(own.select("node", "shingles"), "node")
    far = units.repartition("unit").sortWithinPartitions("unit", "g", "i", "j").mapInArrow(_by_blocks(p), EDGES)
    return edges.unionByName(near).unionByName(far)


def near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, group, text_key for every row of ``docs`` (doc_id, text, other columns ignored).

    kept is true for rows of the smallest id of each component; component is that id, group a number of the component and
    text_key the text's hash. A null doc_id links with nothing: it has a null component and is kept. Texts without words
    are components of their own, with a null group.
    """
    sketch = materialise(sketches(docs, p), "sketches")
    classes = sketch.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    family, partner = families(classes.select("node", "bands", "sig"), p)
    family = materialise(family, "families")
    of_class = classes.select("digest", "rep", "node")
    if not family.isEmpty():
        found = components(materialise(verified(docs, of_class, family, materialise(partner, "best"), p), "links"))
        found = materialise(found.withColumnRenamed("component", "group"), "components")
        least = found.join(of_class, "node").groupBy("group").agg(F.min("rep").alias("least"))
        found = materialise(found.join(least, "group"), "least")
        of_class = of_class.join(found, "node", "left").select("digest", F.coalesce("least", "rep").alias("component"), F.coalesce("group", "node").alias("group"))
    else:
        of_class = of_class.select("digest", F.col("rep").alias("component"), F.col("node").alias("group"))
    # A hot class is a hot key of this join: both sides are plain exchanges of tables, which adaptive execution splits.
    of_class = materialise(of_class, "classes")
    known = F.col("doc_id").isNotNull()
    out = sketch.select("doc_id", "n_shingles", "digest", "text_key").join(of_class, "digest", "left")
    out = out.select("doc_id", "n_shingles", F.when(known, F.coalesce("component", "doc_id")).alias("component_id"), F.when(known, F.col("group")).alias("group"), "text_key")
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "group", "text_key")


def without_copies(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``docs`` with one row of each group of near copies: of its smallest id, and of several texts or rows of that id one.

    Rows with a null id or without words all stay.
    """
    found = materialise(near_duplicates(docs, p), "found").where("group is not null")
    key = ["doc_id", "text_key"]
    several = found.where("kept").groupBy("group").agg(F.min("text_key").alias("first"), F.count("*").alias("n")).where("n > 1")
    several = materialise(found.where("kept").join(several, "group").select(*key, (F.col("text_key") == F.col("first")).alias("stays")).distinct(), "repeated")
    gone = materialise(found.where("not kept").select(*key).union(several.where("not stays").select(*key)).distinct(), "copies")

    def side(rows: DataFrame) -> DataFrame:
        # Up to a million keys go to every executor (16 MB), so that the texts needn't be dealt out again; more are joined.
        rows = rows.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
        return F.broadcast(rows) if small_enough(rows, p.broadcast_rows) else rows

    on = (F.col("doc_id").cast("long") == F.col("__id")) & (F.xxhash64("text") == F.col("__key"))
    left = docs.join(side(gone), on, "left_anti")
    twice = several.where("stays").select(*key)
    if twice.isEmpty():
        return left
    again = left.withColumn("__text_key", F.xxhash64("text")).join(side(twice), on, "left_semi").dropDuplicates(["doc_id", "__text_key"])
    return left.join(side(twice), on, "left_anti").unionByName(again.drop("__text_key"))
