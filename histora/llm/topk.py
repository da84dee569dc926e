"""Exact top-k search by exhaustive term-at-a-time accumulation.

Each task packs the candidate rows it reads into blocks, and these stay together in groups, which are shuffled once. The
queries, a small share of all rows, are packed in the same way and sent to each group. There the terms (components) of
the sparse query rows are taken one after the other, and each term's weighted postings are scattered into a dense array
of scores; partition selection keeps the best of a block, those of a group are merged as they come, and a window merges
the groups of a query.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Rows of a block: what one pair of blocks holds in memory.
CANDIDATES, QUERIES = 2_048, 256
#: Most candidate rows of a group. Queries are sent to each group, so they outweigh the candidates only beyond
#: GROUP rows times the ratio of candidates to queries.
GROUP = 65_536


def integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(row, vec_id, vector): floor(scale * x), x as double, and a number that tells rows apart, repeated ones too.

    Vectors that are null or hold null or non-finite components take no part. Written to the shared folder, so that
    numbers stay the same whatever is read from it.
    """
    x = F.col("embedding")
    usable = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = vectors.where(usable).select("vec_id", F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("vector"))
    return written(whole.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vector"), "vectors")


def postings(vectors: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """term -> (rows, weights) of the components that aren't zero."""
    rows = np.repeat(np.arange(len(vectors)), [len(v) for v in vectors])
    terms = np.concatenate([np.arange(len(v)) for v in vectors]) if vectors else rows
    weights = np.concatenate(vectors) if vectors else rows
    order = np.argsort(terms, kind="stable")
    order = order[weights[order] != 0]
    terms, cut = np.unique(terms[order], return_index=True)
    return {int(t): (rows[o], weights[o]) for t, o in zip(terms, np.split(order, cut[1:]))}


def packed(rows: DataFrame, size: int) -> DataFrame:
    """(block, value): some size rows of a task in one value, as few bytes a component as they need."""

    def value(row: list[np.ndarray], ids: list[pa.Array], vectors: list[list[int]]) -> bytes:
        low, high = min((min(v, default=0) for v in vectors), default=0), max((max(v, default=0) for v in vectors), default=0)
        kind = np.result_type(np.min_scalar_type(low), np.min_scalar_type(high), np.int8) if high < 2**62 else np.int64
        return pickle.dumps((np.concatenate(row), pa.concat_arrays(ids).to_pylist(), [np.asarray(v, dtype=kind) for v in vectors]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, ids, vectors = [], [], []
        out = lambda: pa.RecordBatch.from_arrays([pa.array([int(row[0][0])]), pa.array([value(row, ids, vectors)], pa.binary())], ["block", "value"])
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                some = batch.slice(start, size - len(vectors))
                start += some.num_rows
                row.append(some.column("row").to_numpy())
                ids.append(some.column("vec_id").cast(pa.int64()))
                vectors += some.column("vector").to_pylist()
                if len(vectors) == size:
                    yield out()
                    row, ids, vectors = [], [], []
        if vectors:
            yield out()

    return rows.select("row", "vec_id", "vector").mapInArrow(run, "block long, value binary")


class Best:
    """The k best candidates so far of each query of a block: highest score, then smallest id, ids that are null last."""

    def __init__(self, rows: np.ndarray, k: int):
        self.rows, self.k = rows, k
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in rows]

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > self.k:
            at = np.flatnonzero(scores >= np.partition(scores, -self.k)[-self.k])
            scores, ids = scores[at], ids[at]
        scores, ids = np.concatenate([self.found[i][0], scores]), np.concatenate([self.found[i][1], ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.found[i] = scores[order], ids[order]


#: Stands for an id that is null; so large an id is the last among ties as well.
NULL = np.iinfo(np.int64).max


def scored(k: int):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, best, asked, wanted = None, None, None, None

        def out() -> pd.DataFrame:
            sizes = [len(f[0]) for f in best.found]
            scores, ids = (np.concatenate([f[i] for f in best.found]) for i in (0, 1))
            query = np.repeat(np.array([NULL if q is None else q for q in asked], dtype=np.int64), sizes)
            return pd.DataFrame({"row": np.repeat(best.rows, sizes), "query_id": query, "vec_id": ids, "score": scores})

        for batch in batches:
            for group, block, candidates, queries in zip(batch["group"], batch["block"], batch["candidates"], batch["queries"]):
                if (group, block) != last:
                    if best:
                        yield out()
                    rows, asked, vectors = pickle.loads(queries)
                    last, best, wanted = (group, block), Best(rows, k), postings(vectors)
                rows, ids, vectors = pickle.loads(candidates)
                ids = np.array([NULL if i is None else i for i in ids], dtype=np.int64)
                dense = np.zeros((len(asked), len(ids)), dtype=np.int64)
                lists = postings(vectors)
                for term, (of, weights) in wanted.items():
                    if term in lists:
                        at, theirs = lists[term]
                        if len(at) == len(ids):
                            dense[of] += weights[:, None] * theirs
                        else:
                            dense[of[:, None], at] += weights[:, None] * theirs
                for i, own in enumerate(best.rows):
                    other = rows != own
                    best.add(i, dense[i][other], ids[other])
        if best:
            yield out()

    return score


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products among all rows of vectors but its own.

    vectors, queries: (row, vec_id, vector of integers), as integers() makes them. Rows that repeat an id, or all of a
    row, are candidates and queries of their own, so a query meets the other rows of its id. Rows without an id take part;
    among ties they come last, and a query without an id has query_id null. Other ties go to the smaller vec_id. Fewer
    than k candidates: all of them. Vectors may differ in length; a component that one lacks counts as zero, and an empty
    vector scores 0. Long vectors are kept whole. Scores are exact as long as they fit in a long. Empty tables give an empty
    result; other columns are not looked at.
    """
    total = vectors.count()
    # groups enough for all cores, but no more than need be: each gets all queries
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    groups = max(math.ceil(total / GROUP), min(4 * cores, math.ceil(total / CANDIDATES)), 1)
    c = packed(vectors, CANDIDATES).select(F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("group"), F.col("value").alias("candidates"))
    q = packed(queries, QUERIES).select("block", F.col("value").alias("queries"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    # a merge join takes a block of queries through all candidates of its group before it goes on to the next
    pairs = q.repartition(groups, "group").hint("merge").join(c.repartition(groups, "group"), "group").select("group", "block", "candidates", "queries")
    found = pairs.mapInPandas(scored(k), "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    known = lambda c: F.when(F.col(c) < int(NULL), F.col(c)).alias(c)
    return ranked.select(known("query_id"), "rank", known("vec_id"), "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integers(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS nr, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
t AS (SELECT nr, vec_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM v),
p AS (SELECT q.nr AS q_nr, c.nr AS c_nr, sum(q.x * c.x) AS score FROM t q JOIN t c ON q.i = c.i WHERE q.vec_id % 50 = 0 GROUP BY ALL),
s AS (
  SELECT q.nr, q.vec_id AS query_id, c.vec_id, CAST(coalesce(p.score, 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.nr <> c.nr LEFT JOIN p ON p.q_nr = q.nr AND p.c_nr = c.nr WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY nr ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
