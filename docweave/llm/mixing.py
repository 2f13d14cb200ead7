"""Mixing sources to target weights by entropy balancing.

Each source has a token target. A document's rate r lies in [0, 2]; among all rates that meet the targets those nearest
to 1 in bounded relative entropy are exponentially tilted, ``r = 2 / (1 + exp(-lambda * z))`` with z the document's size
over its source's mean size (at least a tenth). The multipliers solve a convex dual with one equation per source. Its sums
need a source's sizes only, so documents are counted by source and size first, and all Newton steps of a source, safeguarded
by a bracket, fold over that table in one job. Sizes above 4096 that agree in their first 12 bits share an entry, with
their own words and number: a source has 45,000 entries at most, whatever its documents.

Rates become copies by a hash of the document's id. What rounding leaves over or short is settled per source: documents
nearest to the next copy change, then smaller ones, up to thresholds found from one aggregated histogram each; what a
threshold moves is known from the histogram. A source's words end within a small document of its target, or within a
65536th of its words where that is more. All of it is DataFrame aggregation; per-source numbers stay in a table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialise, small_enough

SIZE = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Params:
    weights: tuple[int, ...] = (3, 1, 2)  # of the sources in order, repeating
    total: float = 1.5  # of all sizes
    most: float = 2.0  # a document's copies, and a source's target over its size
    steps: int = 120  # Newton steps or halvings at most; a dozen do
    tolerance: float = 1e-6  # of a source's words, relative to its target
    exact: int = 4096  # sizes with an entry of their own
    bins: int = 1 << 16
    moves: int = 3  # rounds that settle what rounding leaves
    broadcast_rows: int = 100_000  # sources: a name and a few numbers each


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SIZE)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, p: Params = Params()) -> DataFrame:
    """(source, n, size, weight, target) of each source; one row for null. Targets are filled up like water.

    The excess over ``most`` times a source's size is shared out by weight until no target is above. In order of
    size over weight, a source is full if it would be at the level that the sources before it, full, leave.
    """
    by = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    # Sources, not documents, pass these windows.
    w = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = F.element_at(F.array(*(F.lit(float(x)) for x in p.weights)), (F.pmod(F.row_number().over(w) - 1, F.lit(len(p.weights))) + 1).cast("int"))
    by = by.withColumn("weight", turn).withColumn("cap", F.col("source_size") * p.most)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    all_ = Window.partitionBy()
    by = by.withColumn("goal", F.sum("source_size").over(all_) * p.total)
    before = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    by = by.withColumn("level", (F.col("goal") - before) / rest)
    full = F.col("level") * F.col("weight") >= F.col("cap")
    by = by.withColumn("full", full).withColumn("open_level", F.min(F.when(~full, F.col("level"))).over(all_))
    # The first source that isn't full sets the level of all that follow.
    first = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    by = by.withColumn("level", first)
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return by.select("source", "n", "source_size", "weight", target.cast("double").alias("target"))


def _rate(z: Column, multiplier: Column, p: Params) -> Column:
    return F.when(multiplier == float("inf"), F.lit(p.most)).otherwise(F.lit(p.most) / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), multiplier * z)))))


def _tilt(size: Column, mean: Column) -> Column:
    return F.when(mean > 0, F.greatest(size / mean, F.lit(0.1))).otherwise(F.lit(1.0))


def _uniform() -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _per_source(rows: DataFrame, per: DataFrame, few: bool, how: str = "left") -> DataFrame:
    """Join a table of sources to rows; null joins null. ``few``: the number of sources was found to be small."""
    per = per.withColumnRenamed("source", "__source")
    side = F.broadcast(per) if few else per
    return rows.join(side, F.col("source").eqNullSafe(F.col("__source")), how).drop("__source")


def _entry(p: Params) -> Column:
    """The size under which a document's words are added up: its own, or above ``exact`` its first 12 bits."""
    bits = F.floor(F.log2(F.col("size").cast("double"))).cast("int") - 11
    high = F.when(F.col("size") > p.exact, F.call_function("shiftright", F.col("size"), bits))
    return F.when(F.col("size") > p.exact, F.call_function("shiftleft", high, bits)).otherwise(F.col("size"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with value computed once."""
    return F.transform(F.array(value), body)[0]


def _multiplier(entries: Column, mean: Column, target: Column, p: Params) -> Column:
    """(multiplier, done): Newton's method on the dual of one source, halving the bracket where a step would leave it.

    ``entries`` are structs (n, tokens) of the source's sizes.
    """

    def sums(m: Column) -> Column:
        def add(acc: Column, e: Column) -> Column:
            def with_z(z: Column) -> Column:
                return _let(_rate(z, m, p), lambda r: F.struct((acc["got"] + e["tokens"] * r).alias("got"), (acc["slope"] + e["tokens"] * z * r * (1 - r / p.most)).alias("slope")))

            return _let(_tilt(e["tokens"] / e["n"], mean), with_z)

        return F.aggregate(entries, F.struct(F.lit(0.0).alias("got"), F.lit(0.0).alias("slope")), add)

    def state(m: Column, low: Column, high: Column, done: Column) -> Column:
        return F.struct(m.alias("m"), low.alias("low"), high.alias("high"), done.alias("done"))

    def step(acc: Column, _: Column) -> Column:
        def after(s: Column) -> Column:
            gap = s["got"] - target
            low, high = F.when(gap < 0, acc["m"]).otherwise(acc["low"]), F.when(gap > 0, acc["m"]).otherwise(acc["high"])
            newton = F.when(s["slope"] > 0, acc["m"] - gap / s["slope"])
            inside = newton.isNotNull() & (newton > low) & (newton < high)
            done = (F.abs(gap) <= p.tolerance * (1 + target)) | (high - low < 1e-12)
            return state(F.when(done, acc["m"]).when(inside, newton).otherwise((low + high) / 2), low, high, done)

        return F.when(acc["done"], acc).otherwise(_let(sums(acc["m"]), after))

    # Rates beyond 700 multiples of z are 0 or 2 in double precision.
    start = state(F.lit(0.0), F.lit(-7000.0), F.lit(7000.0), F.lit(False))
    return F.aggregate(F.sequence(F.lit(1), F.lit(p.steps)), start, step)


MOVES = "array<struct<sign:int,above:double,limit:double,shift:double>>"


def solve(sizes: DataFrame, p: Params = Params()) -> tuple[DataFrame, bool]:
    """(source, source_size, target, mean, multiplier, moves): what turns each document into copies; are sources few.

    ``sizes`` is (doc_id, source, size). A dual that isn't solved in ``steps`` steps fails the job.
    """
    per = materialise(targets(sizes, p).withColumn("mean", F.col("source_size") / F.col("n")), "sources")
    few = small_enough(per, p.broadcast_rows)
    counts = sizes.where("size > 0").groupBy("source", _entry(p).alias("entry")).agg(F.count("*").cast("double").alias("n"), F.sum("size").cast("double").alias("tokens"))
    entries = counts.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("entry", "n", "tokens"))).alias("entries"))
    full = F.col("target") >= p.most * F.col("source_size") * (1 - 1e-12)
    now = _per_source(per, entries, few).withColumn("dual", F.when(~full & F.col("entries").isNotNull(), _multiplier(F.col("entries"), F.col("mean"), F.col("target"), p)))
    solved = F.when(full, F.lit(float("inf"))).when(F.col("entries").isNull(), F.lit(0.0)).when(F.col("dual.done"), F.col("dual.m")).otherwise(F.raise_error(F.lit("the dual of a source isn't solved")).cast("double"))
    now = materialise(now.select("source", "source_size", "target", "mean", solved.alias("multiplier"), F.array().cast(MOVES).alias("moves")), "dual")
    return _round(sizes, now, few, p), few


def _round(sizes: DataFrame, per: DataFrame, few: bool, p: Params) -> DataFrame:
    """Add the moves of each source: which documents get one copy more, or less, than their rounded rate.

    In the first move those nearest to gaining (or losing) a copy change, as long as the words stay within the target.
    In the next ones further documents no larger than what is still missing change, in an order by hash. In the last
    one a single larger document changes where that leaves less missing, on the other side.
    """
    sizes = sizes.where("size > 0")
    have = _per_source(sizes, per, few, "inner").withColumn("copies", copies(p)).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("have"))
    state = materialise(_per_source(per, have, few).withColumn("missing", F.col("target") - F.coalesce("have", F.lit(0))).drop("have"), "round")
    for turn in range(p.moves + 1):
        missing, sign = F.abs("missing"), F.signum("missing").cast("int")
        base = _rounded(p)
        open_ = (copies(p) == base) & F.when(F.col("missing") > 0, base < p.most).otherwise((F.col("missing") < 0) & (base >= 1))
        rows = _per_source(sizes, state, few, "inner").withColumn("at", _place(turn, p, sign))
        if turn == p.moves:
            larger = rows.where(open_ & (F.col("size") > missing) & (F.col("size") < 2 * missing))
            first = larger.groupBy("source").agg(F.min("at").alias("at"))
            after = _per_source(state, first, few).withColumn("shift", F.coalesce(F.col("at") + 2.0**-41, F.lit(0.0))).withColumn("moved", F.lit(0.0))
            above, limit = missing, 2 * missing - 0.5
        else:
            movable = rows.where(open_ if turn == 0 else open_ & (F.col("size") <= missing))
            bins = movable.groupBy("source", F.least(F.floor(F.col("at") * p.bins), F.lit(p.bins - 1)).alias("bin")).agg(F.sum("size").alias("tokens"))
            w = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            added = _per_source(bins.withColumn("upto", F.sum("tokens").over(w)), state.select("source", "missing"), few, "inner")
            fits = F.col("upto") <= missing
            edge = added.groupBy("source").agg(F.min(F.when(~fits, F.col("bin"))).alias("cross"), F.max(F.when(fits, F.col("upto"))).alias("moved"), F.lit(1).alias("any"))
            after = _per_source(state, edge, few).withColumn("shift", F.when(F.col("any").isNull(), F.lit(0.0)).otherwise(F.coalesce(F.col("cross") / F.lit(float(p.bins)), F.lit(1.0))))
            above, limit = F.lit(-1.0), missing if turn else F.lit(float("inf"))
        move = F.struct(sign.alias("sign"), above.cast("double").alias("above"), limit.cast("double").alias("limit"), F.col("shift").alias("shift"))
        left = (F.col("missing") - F.signum("missing") * F.coalesce("moved", F.lit(0))).alias("missing")
        state = materialise(after.select("source", "source_size", "target", "mean", "multiplier", F.concat("moves", F.array(move)).cast(MOVES).alias("moves"), left), "round")
    return state.drop("missing")


def _rounded(p: Params) -> Column:
    """A document's rate, rounded up or down by its hash."""
    v = _rate(_tilt(F.col("size"), F.col("mean")), F.col("multiplier"), p) + F.when(F.col("multiplier") == float("inf"), F.lit(0.0)).otherwise(_uniform())
    return F.least(F.floor(v), F.lit(int(p.most))).cast("int")


def _place(turn: int, p: Params, sign: Column) -> Column:
    """A document's place in [0, 1) in the order of a move."""
    if turn:
        return F.pmod(F.xxhash64("doc_id", F.lit(f"move {turn}")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    v = _rate(_tilt(F.col("size"), F.col("mean")), F.col("multiplier"), p) + _uniform()
    frac = v - F.floor(v)
    return F.when(sign > 0, F.lit(1.0) - frac - F.lit(2.0**-50)).otherwise(frac)


def copies(p: Params) -> Column:
    """Copies of a document, from its size and its source's mean, multiplier and moves. At most one move applies."""
    base = _rounded(p)
    moved = F.lit(0)
    for turn in reversed(range(p.moves + 1)):
        m = F.try_element_at("moves", F.lit(turn + 1))
        room = F.when(m["sign"] > 0, base < p.most).otherwise((m["sign"] < 0) & (base >= 1))
        applies = m.isNotNull() & room & (F.col("size") > m["above"]) & (F.col("size") <= m["limit"]) & (_place(turn, p, m["sign"]) < m["shift"])
        moved = F.when(applies, m["sign"]).otherwise(moved)
    return F.when(F.col("size") > 0, base + moved).otherwise(base).cast("int")


def mix(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``docs`` with size, source_size, target and copies. Reruns agree; equal ids are treated alike.

    A null text has size 0; null sources form one source. A document without words is taken by its rounded rate.
    Columns of these names, and mean, multiplier and moves, are replaced.
    """
    sizes = materialise(docs.select(F.col("doc_id"), F.col("source"), words(F.col("text")).alias("size")), "word-counts")
    found, few = solve(sizes, p)
    clean = docs.drop("size", "source_size", "target", "mean", "multiplier", "moves", "copies")
    joined = _per_source(clean.withColumn("size", words(F.col("text"))), found, few)
    return joined.withColumn("copies", copies(p)).drop("mean", "multiplier", "moves")


def mixed_sizes(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, size, source_size, target, taken: the digest of ``mix``, without rereading the texts."""
    sizes = materialise(docs.select(F.col("doc_id"), F.col("source"), words(F.col("text")).alias("size")), "word-counts")
    found, few = solve(sizes, p)
    out = _per_source(sizes, found, few).withColumn("copies", copies(p))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
