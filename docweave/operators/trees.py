"""Trees of any depth by pointer doubling: depth, pre- and post-order, subtree sizes, hierarchical numbers, cycles.

Every node points to its parent. In round k it points 2^k levels up and has summed what lies on the way, so log(depth)
rounds reach the root, for a chain of a million pages as for a flat space. A node is an ancestor of another exactly if its
pre-order number and its subtree's size enclose the other's number, so containment is a BETWEEN, not a walk.

Sums up a tree go the other way: in round k each node adds what the nodes 2^k levels below it have gathered. Sums are
aggregated before the shuffle, so a parent with a third of all nodes is one row. Each round's state is written and reread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import held
from .prefix import running_sum

PER_CHUNK = 4096


def linked(nodes: DataFrame, node: str = "node_id", parent: str = "parent_node_id", order: str = "ord") -> DataFrame:
    """(id, up, ord) of nodes: null ids are left out, of a repeated id the first by (parent, order) counts, a parent that
    isn't there is none, and neither is the node itself."""
    own = nodes.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("id")).agg(F.min(F.struct(F.col(parent).alias("up"), F.col(order).alias("ord"))).alias("x")).select("id", "x.*")
    known = own.select(F.col("id").alias("__p"))
    return own.join(known, F.col("up") == F.col("__p"), "left").select("id", F.when(F.col("__p") != F.col("id"), F.col("__p")).alias("up"), "ord")


def _doubled(start: DataFrame, sums: list[str], rounds: int | None = None) -> DataFrame:
    """``start`` (id, up, and columns ``sums``) with the sums over the whole path to the root, and ``up`` null; in a cycle
    ``up`` stays. Numbers are added; a text comes before what is below it.

    Nodes that have reached a root only serve as targets. A path without a cycle is shorter than the number of nodes, which
    bounds the rounds.
    """
    now = held(start, "tree")
    if rounds is None:
        rounds = max(1, now.count()).bit_length() + 1
    text = {c for c in sums if dict(now.dtypes)[c] == "string"}
    for _ in range(rounds):
        # Null parents don't meet anything; without these rows, the join has no hot null key.
        walking = now.where("up is not null")
        if walking.isEmpty():
            break
        above = now.select(F.col("id").alias("up"), F.col("up").alias("__up"), *(F.col(c).alias(f"__{c}") for c in sums))
        both = walking.join(above, "up")
        added = [(F.concat(F.col(f"__{c}"), F.lit("."), F.col(c)) if c in text else F.col(c) + F.col(f"__{c}")).alias(c) for c in sums]
        others = [c for c in now.columns if c not in ("id", "up", *sums)]
        moved = both.select("id", F.col("__up").alias("up"), *added, *others)
        now = held(now.where("up is null").select("id", "up", *sums, *others).unionByName(moved), "tree")
    return now


def _sizes(nodes: DataFrame) -> DataFrame:
    """id, size: the nodes of each subtree, itself included. Without cycles."""
    now = held(nodes.select("id", "up", F.lit(1).cast("long").alias("size")), "sizes")
    while True:
        walking = now.where("up is not null")
        if walking.isEmpty():
            return now.select("id", "size")
        below = walking.groupBy(F.col("up").alias("id")).agg(F.sum("size").alias("__below"))
        grown = now.join(below, "id", "left").select("id", "up", (F.col("size") + F.coalesce("__below", F.lit(0))).alias("size"))
        above = now.select(F.col("id").alias("up"), F.col("up").alias("__up"))
        now = held(grown.join(above, "up", "left").select("id", F.col("__up").alias("up"), "size"), "sizes")


def among_siblings(nodes: DataFrame, value: Column, name: str) -> DataFrame:
    """``nodes`` with ``name``: the sum of ``value`` over the siblings up to the node and with it, in order of ``ord``, then id.

    Siblings may be a third of all nodes, so they are summed in chunks, cut by their place among equally spaced orders.
    """
    ends = nodes.agg(F.min("ord").alias("a"), F.max("ord").alias("b"), F.count("*").alias("n")).first()
    width = max(1, (ends["b"] - ends["a"] + 1) * PER_CHUNK // max(1, ends["n"])) if ends["n"] else 1
    return running_sum(nodes, ["up"], "ord", value, name, width)


def ordered(nodes: DataFrame, node: str = "node_id", parent: str = "parent_node_id", order: str = "ord") -> DataFrame:
    """node, depth, pre, post, size of each node: depth from 0 at a root, numbers from 0 on, roots in order one after another.

    ``order`` is a whole number, distinct among siblings. Nodes in a cycle, and those below one, have nulls: they hang from
    no root. See ``linked`` for null, repeated and missing ids.
    """
    own = held(linked(nodes, node, parent, order), "nodes")
    paths = _doubled(own.select("id", "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth")), ["depth"])
    rooted = paths.where("up is null").select("id", "depth")
    fine = own.join(rooted, "id")
    sized = held(fine.join(_sizes(fine), "id"), "sized")
    before = among_siblings(sized, F.col("size"), "__end")
    # A child's number is its parent's, plus one for the parent, plus the subtrees of the siblings before it.
    shift = F.col("__end") - F.col("size") + F.when(F.col("up").isNull(), 0).otherwise(1)
    numbered = _doubled(before.select("id", "up", shift.alias("pre"), "depth", "size"), ["pre"])
    out = numbered.select(F.col("id").alias(node), "depth", "pre", (F.col("pre") + F.col("size") - 1 - F.col("depth")).alias("post"), "size")
    lost = own.join(rooted, "id", "left_anti").select(F.col("id").alias(node), *(F.lit(None).cast("long").alias(c) for c in ("depth", "pre", "post", "size")))
    return out.unionByName(lost)


def inside(found: DataFrame, of: DataFrame, node: str = "node_id") -> DataFrame:
    """(ancestor, node): which of the nodes ``of`` hold which nodes of ``found`` (both from ``ordered``) below them.

    An equi join on chunks of the order: an ancestor reaches over the chunks of its subtree.
    """
    width = 1 << 16
    a = of.where("pre is not null").select(F.col(node).alias("ancestor"), F.col("pre").alias("__a"), (F.col("pre") + F.col("size") - 1).alias("__b"), F.explode(F.sequence(F.floor(F.col("pre") / width), F.floor((F.col("pre") + F.col("size") - 1) / width))).alias("__c"))
    v = found.where("pre is not null").select(node, "pre", F.floor(F.col("pre") / width).alias("__c"))
    return v.join(a, "__c").where("pre > __a and pre <= __b").select("ancestor", node)


def numbers(nodes: DataFrame, node: str = "node_id", parent: str = "parent_node_id", order: str = "ord") -> DataFrame:
    """node, number: hierarchical numbers such as 1.2.3 at any depth, counted among siblings; null in and below a cycle."""
    own = held(linked(nodes, node, parent, order), "nodes")
    ranked = among_siblings(own, F.lit(1), "rank")
    paths = _doubled(ranked.select("id", "up", F.col("rank").cast("string").alias("number")), ["number"])
    return paths.select(F.col("id").alias(node), F.when(F.col("up").isNull(), F.col("number")).alias("number"))


def cycles(nodes: DataFrame, node: str = "node_id", parent: str = "parent_node_id", order: str = "ord") -> DataFrame:
    """The ids of nodes that reach no root: those in a cycle and those below one."""
    own = linked(nodes, node, parent, order)
    return _doubled(own.select("id", "up", F.lit(0).cast("long").alias("depth")), ["depth"]).where("up is not null").select(F.col("id").alias(node))
