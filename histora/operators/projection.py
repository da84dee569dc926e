"""Projection of commits: which stay as they are, the bytes and ids of those that are rewritten, and the mappings."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import without_headers
from . import depth
from .graph import topo_levels
from .stages import written

#: Headers that a rewritten commit loses: signatures are of the old bytes.
SIGNATURES = ["gpgsig", "gpgsig-sha256"]


def commit_bytes(headers: Column, message: Column) -> Column:
    """A commit's bytes: a header a line, further lines of a value begin with a blank, an empty line, the message."""
    lines = F.transform(headers, lambda h: F.concat(h["name"], F.lit(" "), F.replace(h["value"], F.lit("\n"), F.lit("\n ")), F.lit("\n")))
    return F.concat(F.array_join(lines, ""), F.lit("\n"), message).cast("binary")


PROJECTED = "canonical_id string, public_id string, rewritten boolean, error string"
ROWS = ["component", "commit_id", "tree", "new_tree", "parents", "known", "uses", "rest", "conflicted"]


def _project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of commits, parents first in each component. A commit's outcome is held until its last child has been."""
    now, held = None, {}
    for batch in batches:
        out: list[tuple] = []
        for component, commit, tree, new_tree, parents, known, uses, rest, conflicted in zip(*(batch.column(c).to_pylist() for c in ROWS)):
            if component != now:
                now, held = component, {}
            given, public, failed, missing = dict(known or []), [], False, False
            for parent in parents:
                entry = held.get(parent)
                if entry:
                    entry[2] -= 1
                    if not entry[2]:
                        del held[parent]
                there, bad = (given[parent], None) if parent in given else entry[:2] if entry else (None, None)
                public.append(there)
                failed, missing = failed or bad is not None, missing or (bad is None and there is None)
            error = "conflicted" if conflicted else "parent_missing" if missing else "parent_failed" if failed else None
            own, rewritten = None, None
            if error is None:
                rewritten = new_tree != tree or public != parents
                data = b"".join(f"{name} {value}\n".encode() for name, value in [("tree", new_tree), *(("parent", p) for p in public)]) + rest
                own = hashlib.sha1(b"commit %d\0" % len(data) + data).hexdigest() if rewritten else commit
            if uses:
                held[commit] = [own, error, uses]
            out.append((commit, own, rewritten, error))
        columns = zip(*out) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.string(), pa.bool_(), pa.string()])], ["canonical_id", "public_id", "rewritten", "error"])


def project_commits(commits: DataFrame, public_trees: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(canonical_id, public_id, rewritten, error) for each commit that isn't a seed.

    commits: (commit_id, tree, parents, headers, message, conflicted), of rows that repeat an id one counts; public_trees:
    (tree, public_tree), trees without a row stay; seeds: (canonical_id, public_id) of commits projected before. A commit is the
    same on either side if its tree and its parents are; else it gets new headers, bytes and id. error: conflicted,
    parent_missing, or parent_failed below such a commit; those have no public id. Members of cycles, and what depends on
    them, have the error cycle.

    An id depends on the parents' new ids, so a history is one chain of digests. Histories that have no commit in common are
    dealt over tasks and stream by once, parents first; a task holds only what has children still to come. Rounds don't grow with
    depth, but for the doubling that finds the order.
    """
    spark = commits.sparkSession
    known = spark.createDataFrame([], "canonical_id string, public_id string") if seeds is None else seeds.select("canonical_id", "public_id")
    own = commits.join(known.select(F.col("canonical_id").alias("commit_id")), "commit_id", "left_anti").dropDuplicates(["commit_id"])
    own = own.join(public_trees.withColumnRenamed("public_tree", "_new"), "tree", "left")
    rest = commit_bytes(without_headers(F.col("headers"), ["tree", "parent", *SIGNATURES]), F.col("message"))
    own = written(own.select("commit_id", "tree", F.coalesce("_new", "tree").alias("new_tree"), "parents", rest.alias("rest"), "conflicted"), "commits")
    edges = own.select(F.col("commit_id").alias("node"), F.posexplode("parents").alias("position", "to_node"))
    nodes = own.select(F.col("commit_id").alias("node"))
    inside = written(edges.join(nodes.withColumnRenamed("node", "to_node"), "to_node", "left_semi").select("node", "position", "to_node"), "edges")
    index = depth.index_of(inside, nodes)
    try:
        order = depth.levels(nodes, inside, index=index)
    except depth.Cycle:
        order = topo_levels(nodes, inside)
    order = order.join(depth.components(inside, index), "node", "left").withColumnRenamed("node", "commit_id")
    uses = inside.groupBy(F.col("to_node").alias("commit_id")).agg(F.count("*").alias("uses"))
    found = edges.join(known.withColumnRenamed("canonical_id", "to_node"), "to_node").groupBy(F.col("node").alias("commit_id")).agg(F.map_from_entries(F.collect_set(F.struct("to_node", "public_id"))).alias("known"))
    rows = own.join(order, "commit_id").join(uses, "commit_id", "left").join(found, "commit_id", "left")
    rows = written(rows.withColumn("uses", F.coalesce("uses", F.lit(0))), "rows")
    in_order = rows.where("level IS NOT NULL").repartition("component").sortWithinPartitions("component", "level").select(*ROWS)
    cyclic = rows.where("level IS NULL").select(F.col("commit_id").alias("canonical_id"), F.lit(None).cast("string").alias("public_id"), F.lit(None).cast("boolean").alias("rewritten"), F.lit("cycle").alias("error"))
    return in_order.mapInArrow(_project, PROJECTED).unionByName(cyclic)


def projection_result(projected: DataFrame, heads: DataFrame, seeds: DataFrame, reached: DataFrame) -> dict[str, DataFrame]:
    """public_heads (head, public_id), new_mappings and reached_mappings (canonical_id, public_id).

    heads: (head); a head without a projection is the same on either side. reached: (canonical_id) of the seeds that the
    walk came to; those that are the same on either side make no mapping.
    """
    both = projected.where("error IS NULL").select("canonical_id", "public_id").unionByName(seeds.select("canonical_id", "public_id"))
    public = heads.join(both.withColumnRenamed("canonical_id", "head"), "head", "left").select("head", F.coalesce("public_id", "head").alias("public_id"))
    return {
        "public_heads": public,
        "new_mappings": projected.where("rewritten").select("canonical_id", "public_id"),
        "reached_mappings": seeds.join(reached, "canonical_id", "left_semi").where("canonical_id <> public_id").select("canonical_id", "public_id"),
    }
