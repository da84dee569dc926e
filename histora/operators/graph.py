"""Closures, ancestry, order and reachability over edge tables.

Loops keep only counts on the driver. Each round's new rows are written to the shared folder, so that lineage stays
short and a lost executor costs one round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import depth
from .stages import written


def closure(heads: DataFrame, edges: DataFrame, node: list[str], by: list[str] | None = None, stop: DataFrame | None = None) -> DataFrame:
    """(by, node): every node reachable from heads, heads included, each once for each by.

    heads: (by, node); edges: (node, to_ + node). Nodes of stop are neither taken nor passed. Only the newest nodes are
    joined with the edges in a round.
    """
    by = by or []
    key = [*by, *node]
    outside = (lambda d: d.join(stop.select(*node), node, "left_anti")) if stop is not None else (lambda d: d)
    steps = edges.select(*node, *(f"to_{c}" for c in node))
    parts = [written(outside(heads.select(*key).distinct()), "closure")]
    while True:
        seen = reduce(DataFrame.unionByName, parts)
        reached = parts[-1].join(steps, node).select(*by, *(F.col(f"to_{c}").alias(c) for c in node)).distinct()
        new = written(outside(reached).join(seen, key, "left_anti"), "closure")
        if not new.limit(1).count():
            return seen
        parts.append(new)


def ancestors(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """(node, ancestor, distance) over chains (one parent a node at most), the node itself at distance 0.

    Pointer doubling: pairs up to distance d give those up to 2 d, so a chain of length n takes log2 n rounds.
    parents: (node, parent).
    """
    pairs = written(nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance")), "pairs")
    jump, width = written(parents.where("parent IS NOT NULL").select("node", "parent"), "jump"), 1
    while True:
        further = pairs.join(jump.select(F.col("node").alias("ancestor"), F.col("parent").alias("_to")), "ancestor")
        new = written(further.select("node", F.col("_to").alias("ancestor"), (F.col("distance") + width).alias("distance")), "pairs")
        if not new.limit(1).count():
            return pairs
        pairs = written(pairs.unionByName(new), "pairs")
        jump = written(jump.join(jump.select(F.col("node").alias("parent"), F.col("parent").alias("_to")), "parent").select("node", F.col("_to").alias("parent")), "jump")
        width *= 2


def is_ancestor(pairs: DataFrame, edges: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """(a, b, is_ancestor): whether b, by parent edges (node, to_node), reaches a.

    A walk from b ends once all its pairs are settled. levels: (node, level) such that each node is above its parents; with
    them a walk doesn't go below the lowest node that it still looks for.
    """
    steps = edges.select("node", "to_node")
    asked = written(pairs.select("a", "b").distinct(), "asked")
    level = None if levels is None else written(levels.select("node", "level"), "levels")
    if level is not None:
        asked = written(asked.join(level.withColumnsRenamed({"node": "a", "level": "_least"}), "a", "left"), "asked")
    new = written(asked.select(F.col("b").alias("source"), F.col("b").alias("node")).distinct(), "walk")
    seen, hits, left = [], [], asked
    while True:
        hit = written(left.join(new.select(F.col("source").alias("b"), F.col("node").alias("a")), ["a", "b"]).select("a", "b"), "hit")
        hits.append(hit)
        seen.append(new)
        left = written(left.join(hit, ["a", "b"], "left_anti"), "left")
        walks = left.groupBy(F.col("b").alias("source")).agg(*([] if level is None else [F.min(F.coalesce("_least", F.lit(-1))).alias("_least")]), F.count("*").alias("_n"))
        at = new.join(walks, "source")
        if level is not None:
            at = at.join(level, "node", "left").where("level IS NULL OR level > _least")
        reached = at.join(steps, "node").select("source", F.col("to_node").alias("node")).distinct()
        new = written(reached.join(reduce(DataFrame.unionByName, seen), ["source", "node"], "left_anti"), "walk")
        if not new.limit(1).count():
            break
    found = reduce(DataFrame.unionByName, hits).withColumn("_hit", F.lit(True))
    return pairs.join(found, ["a", "b"], "left").select("a", "b", F.col("_hit").isNotNull().alias("is_ancestor"))


def outside_ancestry(observed: DataFrame, edges: DataFrame) -> DataFrame:
    """(head, observed): observed heads that the new head doesn't descend from."""
    tested = depth.is_ancestor(observed.select(F.col("observed").alias("a"), F.col("head").alias("b")).distinct(), edges)
    return tested.where("NOT is_ancestor").select(F.col("b").alias("head"), F.col("a").alias("observed"))


def topo_levels(nodes: DataFrame, edges: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """(node, level): the longest way to a node without edges; null for members of cycles and what depends on them. Nodes of
    stop have no level and don't count as targets.

    Rounds peel the nodes whose targets all have levels; a level's round reads only edges that are still open.
    edges: (node, to_node), targets outside nodes don't count.
    """
    if stop is not None:
        nodes = nodes.join(stop.select("node"), "node", "left_anti")
        edges = edges.join(stop.select("node"), "node", "left_anti")
    inside = edges.join(nodes.select(F.col("node").alias("to_node")), "to_node", "left_semi").select("node", "to_node").distinct()
    open_edges, level = written(inside, "open"), 0
    rest = written(nodes.select("node").distinct(), "rest")
    parts = []
    while True:
        blocked = open_edges.select("node").distinct()
        done = written(rest.join(blocked, "node", "left_anti"), "level")
        if not done.limit(1).count():
            break
        parts.append(done.withColumn("level", F.lit(level)))
        rest = written(rest.join(done, "node", "left_anti"), "rest")
        open_edges = written(open_edges.join(done.withColumnRenamed("node", "to_node"), "to_node", "left_anti"), "open")
        level += 1
    return reduce(DataFrame.unionByName, [*parts, rest.withColumn("level", F.lit(None).cast("int"))])


def chain_levels(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """(node, level) over chains: the number of ancestors. Each round doubles how far all nodes have counted, so a chain of
    length n takes log2 n rounds of one row a node. A parent outside nodes counts but isn't walked on from."""
    up = parents.where("parent IS NOT NULL").select("node", "parent")
    state = written(nodes.select("node").join(up, "node", "left").select("node", F.col("parent").alias("jump"), F.col("parent").isNotNull().cast("int").alias("level")), "levels")
    while state.where("jump IS NOT NULL").limit(1).count():
        there = state.select(F.col("node").alias("jump"), F.col("jump").alias("_jump"), F.col("level").alias("_level"))
        state = written(state.join(there, "jump", "left").select("node", F.col("_jump").alias("jump"), (F.col("level") + F.coalesce("_level", F.lit(0))).alias("level")), "levels")
    return state.select("node", "level")


def frontier(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that nothing refers to."""
    return nodes.join(edges.select(F.col("to_node").alias("node")), "node", "left_anti")


def incomplete(heads: DataFrame, edges: DataFrame, node: list[str], stores: list[DataFrame], sentinels: DataFrame | None = None) -> DataFrame:
    """Reachable nodes that no store has, sentinels left out."""
    reached = closure(heads, edges, node)
    stored = reduce(DataFrame.unionByName, (s.select(*node) for s in stores))
    missing = reached.join(stored, node, "left_anti")
    return missing if sentinels is None else missing.join(sentinels.select(*node), node, "left_anti")


def to_fetch(heads: DataFrame, edges: DataFrame, node: list[str], local: DataFrame) -> DataFrame:
    """What is reachable and not stored locally."""
    return closure(heads, edges, node).join(local.select(*node), node, "left_anti")


def rewritten_refs(heads: DataFrame, cursors: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """Refs whose fetched head doesn't descend from the cursor."""
    both = heads.select(*key, F.col("oid").alias("b")).join(cursors.select(*key, F.col("oid").alias("a")), key)
    return both.join(depth.is_ancestor(both.select("a", "b").distinct(), edges), ["a", "b"]).where("NOT is_ancestor").select(*key, F.col("b").alias("head"), F.col("a").alias("cursor"))


def mark_and_sweep(roots: DataFrame, edges: DataFrame, stored: DataFrame) -> DataFrame:
    """(node, reason): stored nodes that no root reaches, and roots that aren't stored (broken_root)."""
    live = closure(roots.select("node"), edges, ["node"])
    swept = stored.select("node").join(live, "node", "left_anti").withColumn("reason", F.lit("unreachable"))
    broken = roots.select("node").distinct().join(stored.select("node"), "node", "left_anti").withColumn("reason", F.lit("broken_root"))
    return swept.unionByName(broken)


def propagate(nodes: DataFrame, edges: DataFrame, changed: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """(node, changed): a node is changed if it is in changed or reaches one that is, without passing stop.

    Changes run against the edges (node, to_node): a closure from the changed nodes over reversed edges.
    """
    back = edges.select(F.col("to_node").alias("node"), F.col("node").alias("to_node"))
    hit = closure(changed.select("node"), back, ["node"], stop=stop).withColumn("_hit", F.lit(True))
    return nodes.select("node").join(hit, "node", "left").select("node", F.col("_hit").isNotNull().alias("changed"))


def lift_classes(commits: DataFrame, parents: DataFrame, mapped: DataFrame, hidden: DataFrame, disclosed: DataFrame) -> DataFrame:
    """(node, class, canonical, reason): what becomes of public commits on the private side.

    mapped: (node, canonical), commits whose private form is known; they are mapped, and what is before them isn't looked
    at. Any other is a mirror if it discloses a path, if its parents' private form has a policy (hidden), or if the
    private form of a parent isn't the parent itself (parent), the first of these being its reason. The rest are the same
    on either side. canonical is null for mirrors, whose ids are made when they are written.

    commits: (node), parents: (node, to_node), hidden and disclosed: (node). Repeated rows count once; rows of commits that
    aren't in commits are ignored. Two private forms of a commit are an error of the mapping: such a commit has a row
    each with the class ambiguous.
    """
    commits = commits.select("node").distinct()
    forms = mapped.join(commits, "node", "left_semi").groupBy("node").agg(F.min("canonical").alias("canonical"), F.max("canonical").alias("_other"))
    forms = written(forms.select("node", "canonical", (F.col("canonical") != F.col("_other")).alias("_several")), "forms")
    open_ = commits.join(forms.select("node"), "node", "left_anti")
    own = disclosed.select("node").distinct().withColumn("reason", F.lit("disclosure")).unionByName(hidden.select("node").distinct().withColumn("reason", F.lit("hidden")))
    own = own.join(open_, "node", "left_semi").groupBy("node").agg(F.min("reason").alias("reason"))
    moved = forms.where("_several OR canonical <> node").select(F.col("node").alias("to_node"))
    after = parents.join(moved, "to_node", "left_semi").select("node").distinct().join(open_, "node", "left_semi")
    changed = propagate(open_, parents, own.select("node").unionByName(after).distinct(), forms.select("node"))
    rest = changed.join(own, "node", "left").select(
        "node", F.when(F.col("changed"), "mirror").otherwise("identity").alias("class"), F.when(~F.col("changed"), F.col("node")).alias("canonical"),
        F.when(F.col("changed"), F.coalesce("reason", F.lit("parent"))).alias("reason"),
    )
    one = forms.where("NOT _several").select("node", F.lit("mapped").alias("class"), "canonical", F.lit(None).cast("string").alias("reason"))
    several = mapped.join(forms.where("_several").select("node"), "node", "left_semi").select("node", "canonical").distinct()
    return rest.unionByName(one).unionByName(several.select("node", F.lit("ambiguous").alias("class"), "canonical", F.lit(None).cast("string").alias("reason")))
