"""Ancestry and levels of histories of any depth, by an index of chains instead of a walk of one hop a round.

The first parents make a forest. Each node is put on the chain that leads up to the deepest node above it, so a chain is a way of
first parents, and a node's place on it is its number of first ancestors. Both come of pointer doubling: a history n deep takes
some 2 log2 n rounds. From then on, a chain is one step: who reaches a place on a chain reaches all below it, so a walk takes a
round each time that it changes chains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stages import written

#: Places of a chain that are looked at in one window.
BUCKET = 4_096


class Cycle(ValueError):
    """The edges form a cycle."""


def first_parents(edges: DataFrame) -> DataFrame:
    """(node, parent): each node's edge with the lowest position, or the lowest target where edges (node, to_node) have none."""
    order = ["position", "to_node"] if "position" in edges.columns else ["to_node"]
    return edges.groupBy("node").agg(F.min(F.struct(*order)).alias("_first")).select("node", F.col("_first.to_node").alias("parent"))


def chain_index(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """(node, chain, level, root) of a forest: the node's chain, its place on it, and the node without parents below it.

    parents: (node, parent), one a node at most; parents outside nodes don't count. Nodes on cycles, and those that lead to
    them, have no row.
    """
    nodes = nodes.select("node").distinct()
    inside = parents.where("parent IS NOT NULL").join(nodes.withColumnRenamed("node", "parent"), "parent", "left_semi").select("node", "parent")
    start = nodes.join(inside, "node", "left").select("node", F.col("parent").alias("jump"), F.col("parent").isNotNull().cast("long").alias("level"), F.coalesce("parent", "node").alias("root"))
    state = written(start, "jumps")
    jumps = []
    for _ in range(state.count().bit_length() + 1):
        if not state.where("jump IS NOT NULL").limit(1).count():
            break
        jumps.append(state.select("node", "jump").where("jump IS NOT NULL"))
        there = state.select(F.col("node").alias("jump"), F.col("jump").alias("_jump"), F.col("level").alias("_level"), F.col("root").alias("_root"))
        further = state.join(there, "jump", "left").select("node", F.col("_jump").alias("jump"), (F.col("level") + F.coalesce("_level", F.lit(0))).alias("level"), F.coalesce("_root", "root").alias("root"))
        state = written(further, "jumps")
    found = state.where("jump IS NULL").select("node", "level", "root")
    if not inside.groupBy("parent").count().where("count > 1").limit(1).count():
        return found.select("node", F.col("root").alias("chain"), "level", "root")
    # the deepest node above each: what is known of nodes up to 2^k above goes 2^k down
    top = written(found.select("node", F.struct("level", "node").alias("top")), "tops")
    for jump in jumps:
        brought = top.join(jump, "node").groupBy(F.col("jump").alias("node")).agg(F.max("top").alias("_top"))
        top = written(top.join(brought, "node", "left").select("node", F.greatest("top", "_top").alias("top")), "tops")
    return found.join(top, "node").select("node", F.col("top.node").alias("chain"), "level", "root")


def index_of(edges: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """chain_index() of all nodes that edges (node, to_node), or more (node), name."""
    nodes = edges.select("node").unionByName(edges.select(F.col("to_node").alias("node")))
    return written(chain_index(nodes if more is None else nodes.unionByName(more.select("node")), first_parents(edges)), "index")


def crossings(edges: DataFrame, index: DataFrame) -> DataFrame:
    """(chain, level, to_chain, to_level): edges that lead to other chains, or up their own."""
    at = index.select("node", "chain", "level")
    both = edges.select("node", "to_node").join(at, "node").join(at.toDF("to_node", "to_chain", "to_level"), "to_node")
    out = both.where("chain <> to_chain OR to_level >= level")
    return out.groupBy("chain", "level", "to_chain").agg(F.max("to_level").alias("to_level"))


def is_ancestor(pairs: DataFrame, edges: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(a, b, is_ancestor) for each of pairs (a, b): whether b reaches a over edges (node, to_node), itself included.

    index: index_of(edges), made here if it isn't given. A walk holds the highest place of each chain that b has come to, follows
    only crossings between what it held and what it holds now, and ends once b's pairs are settled.
    """
    asked = pairs.select("a", "b").distinct()
    index = index_of(edges, asked.select(F.explode(F.array("a", "b")).alias("node"))) if index is None else index
    at = index.select("node", "chain", "level")
    cross = written(crossings(edges, index), "crossings")
    asked = written(asked.join(at.toDF("a", "a_chain", "a_level"), "a").join(at.toDF("b", "chain", "level"), "b"), "asked")
    left, hits = asked.drop("chain", "level"), None
    new = written(asked.select(F.col("b").alias("source"), "chain", "level", F.lit(-1).cast("long").alias("was")).distinct(), "walk")
    best = new.select("source", "chain", "level")
    while True:
        met = left.join(new.select(F.col("source").alias("b"), F.col("chain").alias("a_chain"), "level"), ["b", "a_chain"]).where("a_level <= level").select("a", "b").distinct()
        met = written(met, "met")
        hits = met if hits is None else hits.unionByName(met)
        left = written(left.join(met, ["a", "b"], "left_anti"), "left")
        going = new.join(left.select(F.col("b").alias("source")).distinct(), "source", "left_semi")
        over = going.join(cross.withColumnRenamed("level", "_from"), "chain").where("_from <= level AND _from > was")
        reached = over.groupBy("source", F.col("to_chain").alias("chain")).agg(F.max("to_level").alias("level"))
        higher = reached.join(best.withColumnRenamed("level", "_was"), ["source", "chain"], "left").where("_was IS NULL OR level > _was")
        new = written(higher.select("source", "chain", "level", F.coalesce("_was", F.lit(-1)).alias("was")), "walk")
        if not new.limit(1).count():
            break
        best = written(best.unionByName(new.select("source", "chain", "level")).groupBy("source", "chain").agg(F.max("level").alias("level")), "best")
    return pairs.select("a", "b").join(hits.withColumn("_hit", F.lit(True)), ["a", "b"], "left").select("a", "b", F.col("_hit").isNotNull().alias("is_ancestor"))


def highest_below(sources: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (chain, level) with extra: the highest need of the chain's sources (chain, level, need) at or below the level, 0 at least.

    A chain's places are dealt into buckets: the highest of each bucket is carried over one row a bucket, then windows run inside.
    """
    none = F.lit(None).cast("long")
    rows = sources.select("chain", "level", "need", F.lit(False).alias("_ask")).unionByName(asked.select("chain", "level", none.alias("need"), F.lit(True).alias("_ask")).distinct())
    rows = rows.withColumn("_bucket", F.floor(F.col("level") / BUCKET))
    before = Window.partitionBy("chain").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("chain", "_bucket").agg(F.max("need").alias("_most")).withColumn("_ahead", F.max("_most").over(before)).drop("_most")
    inside = Window.partitionBy("chain", "_bucket").orderBy("level").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.join(carried, ["chain", "_bucket"]).withColumn("extra", F.greatest(F.max("need").over(inside), "_ahead", F.lit(0)))
    return found.where("_ask").select("chain", "level", "extra")


def levels(nodes: DataFrame, edges: DataFrame, stop: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """(node, level): the longest way to a node without edges, over edges (node, to_node) without cycles.

    Along a chain levels rise by one a node, and by more only where a crossing comes from higher up. Only crossings are
    worked on, until none changes: a round each time that the longest ways change chains. Nodes of stop have no level, and edges to
    them, or to nodes outside nodes, don't count. A cycle raises Cycle. index: index_of(edges, nodes) where it is there already.
    """
    nodes = nodes.select("node").distinct()
    if stop is not None:
        nodes = nodes.join(stop.select("node"), "node", "left_anti")
    edges = edges.join(nodes, "node", "left_semi").join(nodes.withColumnRenamed("node", "to_node"), "to_node", "left_semi")
    index = index_of(edges, nodes) if index is None else index
    total = nodes.count()
    if index.count() < total:
        raise Cycle("the graph has a cycle")
    cross = written(crossings(edges, index).withColumn("need", F.col("to_level") + 1 - F.col("level")), "needs")
    while cross.limit(1).count():
        below = highest_below(cross, cross.select(F.col("to_chain").alias("chain"), F.col("to_level").alias("level")))
        again = cross.join(below.toDF("to_chain", "to_level", "extra"), ["to_chain", "to_level"])
        again = written(again.select("chain", "level", "to_chain", "to_level", (F.col("to_level") + F.col("extra") + 1 - F.col("level")).alias("need"), F.col("need").alias("_was")), "needs")
        changed, most = again.agg(F.count_if(F.col("need") != F.col("_was")), F.max(F.col("need") + F.col("level"))).first()
        cross = again.drop("_was")
        if most >= total:
            raise Cycle("the graph has a cycle")
        if not changed:
            break
    extra = highest_below(cross, index.select("chain", "level"))
    return index.join(extra, ["chain", "level"]).select("node", (F.col("level") + F.col("extra")).alias("level"))


def components(edges: DataFrame, index: DataFrame) -> DataFrame:
    """(node, component): the least root that a node's history has in common with others, over edges in either direction.

    Trees of first parents are one step; their roots take the least of their neighbours' labels, and labels of labels, until none changes.
    """
    at = index.select("node", "root")
    pairs = edges.select("node", "to_node").join(at, "node").join(at.toDF("to_node", "to_root"), "to_node").where("root <> to_root").select("root", "to_root").distinct()
    pairs = written(pairs.unionByName(pairs.select(F.col("to_root").alias("root"), F.col("root").alias("to_root"))).distinct(), "roots")
    label = written(at.select("root").distinct().withColumn("label", F.col("root")), "labels")
    while True:
        near = pairs.join(label.toDF("to_root", "_near"), "to_root").groupBy("root").agg(F.min("_near").alias("_near"))
        lower = label.join(near, "root", "left").select("root", F.least("label", "_near").alias("_next"), "label")
        # and the label that the new label has by now
        jumped = lower.join(label.toDF("_next", "_jumped"), "_next").select("root", F.least("_next", "_jumped").alias("label"), (F.col("_next") < F.col("label")).alias("_moved"))
        jumped = written(jumped, "labels")
        if not jumped.where("_moved").limit(1).count():
            return at.join(jumped.select("root", "label"), "root").select("node", F.col("label").alias("component"))
        label = jumped.drop("_moved")
