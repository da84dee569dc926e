"""The index of chains against walks by hand, on histories of many shapes, and on one that is deep."""

import functools
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from histora.operators import depth, graph, projection


def history(seed, n=40):
    """Edges (node, position, to_node) of a history with branches and merges; a few nodes start anew."""
    rng = random.Random(seed)
    edges = []
    for i in range(1, n):
        if rng.random() < 0.08:
            continue
        near = lambda: rng.randrange(max(0, i - rng.choice([1, 1, 1, 3, 20])), i)  # noqa: E731, B023
        parents = list(dict.fromkeys(near() for _ in range(rng.choice([1, 1, 1, 2, 3]))))
        edges += [(i, k, p) for k, p in enumerate(parents)]
    return n, edges


def by_hand(n, edges):
    up = {i: [p for v, _, p in edges if v == i] for i in range(n)}
    above = functools.cache(lambda v: frozenset([v]).union(*(above(p) for p in up[v])))
    level = functools.cache(lambda v: max((level(p) + 1 for p in up[v]), default=0))
    return above, level


@pytest.mark.parametrize("seed", [0])
def test_against_walks(spark, seed):
    n, edges = history(seed)
    above, level = by_hand(n, edges)
    e = spark.createDataFrame(edges, "node long, position int, to_node long").cache()
    index = depth.index_of(e)
    places = [(r.chain, r.level) for r in index.collect()]
    assert len(set(places)) == len(places) > 0
    pairs = spark.range(n).select(F.col("id").alias("a")).crossJoin(spark.range(n).select(F.col("id").alias("b"))).cache()
    found = {(r.a, r.b): r.is_ancestor for r in depth.is_ancestor(pairs, e).collect()}
    assert found == {(a, b): a in above(b) for a in range(n) for b in range(n)}
    nodes = spark.range(n).withColumnRenamed("id", "node")
    assert {r.node: r.level for r in depth.levels(nodes, e).collect()} == {v: level(v) for v in range(n)}
    stop = spark.createDataFrame([(v,) for v in range(0, n, 7)], "node long")
    _, stopped = by_hand(n, [(v, k, p) for v, k, p in edges if v % 7 and p % 7])
    assert {r.node: r.level for r in depth.levels(nodes, e, stop).collect()} == {v: stopped(v) for v in range(n) if v % 7}
    of = {r.node: r.component for r in depth.components(e, depth.index_of(e, nodes)).collect()}
    joined = {v: v for v in range(n)}
    for _ in range(n):
        for v, _, p in edges:
            joined[v] = joined[p] = min(joined[v], joined[p])
    assert len(of) == n and len(set(of.values())) == len(set(joined.values())) == len(set((of[v], joined[v]) for v in range(n)))


def test_cycles_and_empty(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "node long")
    for edges in ([(1, 2), (2, 1)], [(1, 2), (2, 3), (3, 3)]):
        with pytest.raises(depth.Cycle):
            depth.levels(nodes, spark.createDataFrame(edges, "node long, to_node long")).count()
    # the way back is a second parent
    with pytest.raises(depth.Cycle):
        depth.levels(nodes, spark.createDataFrame([(1, 2), (2, 3), (3, 9), (2, 9), (9, 1)], "node long, to_node long").unionByName(spark.createDataFrame([(3, 1)], "node long, to_node long"))).count()
    none = spark.createDataFrame([], "node long, to_node long")
    assert {r.level for r in depth.levels(nodes, none).collect()} == {0}
    assert depth.levels(nodes.limit(0), none).count() == 0
    pairs = spark.createDataFrame([(1, 1), (1, 2)], "a long, b long")
    assert {(r.a, r.b): r.is_ancestor for r in depth.is_ancestor(pairs, none).collect()} == {(1, 1): True, (1, 2): False}


def test_a_deep_history(spark, monkeypatch):
    """100,000 commits on a line with a merged branch every 1,000: fewer than 60 small steps for its index, ancestry and levels."""
    n, rounds = 100_000, []
    monkeypatch.setattr(depth, "written", lambda df, name, write=depth.written: (rounds.append(name), write(df, name))[1])
    line = spark.range(1, n).select(F.col("id").alias("node"), F.lit(0).alias("position"), (F.col("id") - 1).alias("to_node"))
    side = spark.range(1, n // 1_000).select((F.col("id") + n).alias("node"), F.lit(0).alias("position"), (F.col("id") * 1_000 - 500).alias("to_node"))
    back = side.select((F.col("to_node") + 500).alias("node"), F.lit(1).alias("position"), F.col("node").alias("to_node"))
    e = line.unionByName(side).unionByName(back)
    index = depth.index_of(e)
    pairs = spark.createDataFrame([(0, n - 1), (n + 5, n - 1), (n + 5, 4_999), (n + 5, 5_000), (n - 1, 0), (4_500, n + 5), (4_501, n + 5)], "a long, b long")
    found = {(r.a, r.b): r.is_ancestor for r in depth.is_ancestor(pairs, e, index).collect()}
    assert [found[p] for p in ((0, n - 1), (n + 5, n - 1), (n + 5, 4_999), (n + 5, 5_000), (n - 1, 0), (4_500, n + 5), (4_501, n + 5))] == [True, True, False, True, False, True, False]
    nodes = index.select("node")
    levels = depth.levels(nodes, e, index=index)
    assert levels.agg(F.max("level")).first()[0] == n - 1 and levels.where(f"node = {n + 5}").first().level == 4_501
    assert len(rounds) < 60


def projected(commits, public):
    """Public ids by recursion, as the contract of project_commits states them."""
    out = {}
    for c, (tree, parents, bad) in commits.items():
        new, above = public.get(tree, tree), [out.get(p) for p in parents]
        error = "conflicted" if bad else "parent_missing" if None in above else "parent_failed" if any(e for _, e in above) else None
        if error:
            out[c] = (None, error)
            continue
        ids = [i for i, _ in above]
        data = "".join([f"tree {new}\n", *(f"parent {i}\n" for i in ids), "author me\n\n", c]).encode()
        out[c] = (hashlib.sha1(b"commit %d\0" % len(data) + data).hexdigest() if new != tree or ids != parents else c, None)
    return out


def test_projection_of_histories(spark):
    n, edges = history(5, 80)
    commits = {f"c{i}": (f"t{i % 9}", [f"c{p}" for v, _, p in edges if v == i], i % 31 == 30) for i in range(n)}
    commits["lost"] = ("t1", ["gone"], False)
    public = {"t1": "x1", "t5": "x5"}
    rows = [(c, t, p, [("tree", t), *(("parent", x) for x in p), ("gpgsig", "s"), ("author", "me")], c, bad) for c, (t, p, bad) in commits.items()]
    df = spark.createDataFrame(rows + rows[:1], "commit_id string, tree string, parents array<string>, headers array<struct<name string, value string>>, message string, conflicted boolean")
    trees = spark.createDataFrame(list(public.items()), "tree string, public_tree string")
    want = projected(commits, public)
    got = projection.project_commits(df, trees).collect()
    assert {r.canonical_id: (r.public_id, r.error) for r in got} == want and len(got) == len(want)
    # seeds stand for commits that were projected before
    early = {c: i for c, (i, e) in want.items() if e is None and int(c[1:]) < 20}
    seeds = spark.createDataFrame(list(early.items()), "canonical_id string, public_id string")
    again = {r.canonical_id: (r.public_id, r.error) for r in projection.project_commits(df, trees, seeds).collect()}
    assert again == {c: v for c, v in want.items() if c not in early}
    loop = spark.createDataFrame([("a", "t", ["b"], [], "a", False), ("b", "t", ["a"], [], "b", False), ("k", "t", [], [], "k", False)], df.schema)
    assert {r.canonical_id: r.error for r in projection.project_commits(loop, trees).collect()} == {"a": "cycle", "b": "cycle", "k": None}


def test_rewritten_refs_and_observed_heads(spark):
    e = spark.createDataFrame([(2, 1), (3, 2), (4, 1)], "node long, to_node long")
    seen = spark.createDataFrame([(3, 1), (3, 4), (4, 9)], "head long, observed long")
    assert sorted(map(tuple, graph.outside_ancestry(seen, e).collect())) == [(3, 4), (4, 9)]
