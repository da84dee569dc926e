"""Importance resampling towards a target's word features.

Features are runs of one to three words, hashed into buckets. Arrow kernels do the texts' part: ascii_lower, split_pattern_regex,
list_flatten and dictionary_encode give each word a number; numbers shifted by a word make pairs, pairs shifted by a word
threes, each dictionary-encoded again, so that a checksum is taken once for each distinct pair of a slab. Counts of
buckets over all rows give a gain a bucket; take and sums over segments weigh each row. The draw is by weight plus a Gumbel number
made from the id, so the highest are a sample without replacement.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Buckets of features, the seed of the draw, the least words of a row that can be drawn, and the share of these that is drawn.
BUCKETS, SEED, LEAST, PERCENT = 10_000, 42, 20, 5
#: What stands between words: all of ASCII but digits and small letters, to which A-Z have been lowered.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of text that are worked on at a time, and rows of a range of the ranking.
SLAB, RANGE = 1 << 21, 1_000_000


def pieces(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about SLAB bytes of text each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy())
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, done + SLAB)))
        yield batch.slice(start, end - start)
        start = end


def _joined(first: np.ndarray, second: np.ndarray, sums: np.ndarray, follow: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the pairs (first, second), and each distinct pair's checksum from those of first and the bytes of second."""
    coded = pa.array(first.astype(np.int64) * len(follow) + second).dictionary_encode()
    left, right = np.divmod(coded.dictionary.to_numpy(), max(1, len(follow)))
    checks = [zlib.crc32(follow[b], a) for a, b in zip(sums[left].tolist(), right.tolist())]
    return coded.indices.to_numpy(), np.array(checks, dtype=np.int64)


def features(texts: pa.Array, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """(words of each text, for one, two and three words: places in the flat list of words, their feature's number, bucket of each number)."""
    split = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), pattern=BETWEEN)
    flat, of = pc.list_flatten(split), pc.list_parent_indices(split)
    real = pc.greater(pc.binary_length(flat), 0)
    coded, of = flat.filter(real).dictionary_encode(), of.filter(real).to_numpy()
    words = [w.encode() for w in coded.dictionary.to_pylist()]
    follow = [b" " + w for w in words]
    first = coded.indices.to_numpy()
    sums = np.array([zlib.crc32(w) for w in words], dtype=np.int64)
    at = np.arange(len(first))
    found, numbers = [(at, first, sums % buckets)], first
    for n in (1, 2):
        within = of[n:] == of[:-n]
        at = np.flatnonzero(within)
        # the number of the run of n words at each place, and the word after it
        known = np.zeros(len(first), dtype=np.int64)
        known[found[-1][0]] = numbers
        numbers, sums = _joined(known[at], first[at + n], sums, follow)
        found.append((at, numbers, sums % buckets))
    return np.bincount(of, minlength=len(texts)), found


def bucket_counts(rows: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows are in each bucket. A task gives at most one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for some in pieces(batch, "text"):
                for _, numbers, of in features(some.column("text"), buckets)[1]:
                    total += np.bincount(of[numbers], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    found = rows.select(F.col(text).alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, dtype=np.int64)
    out[found["bucket"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.int64)
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of how much likelier the target's features are in a bucket than the source's), with one added to each."""
    s_all, t_all, n = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(source.astype(float).tolist(), target.astype(float).tolist())], dtype=np.int64)


def gumbel(doc_id: int | None, seed: int = SEED) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, gains: np.ndarray, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket = shared.value
        for batch in batches:
            for some in pieces(batch, "text"):
                sizes, found = features(some.column("text"), len(by_bucket))
                gained = np.zeros(int(sizes.sum()) + 1, dtype=np.int64)
                for at, numbers, of in found:
                    gained[at + 1] += by_bucket[of].take(numbers)
                upto = np.cumsum(gained)
                ends = np.cumsum(sizes)
                weight = upto[ends] - upto[ends - sizes]
                n = sizes + np.maximum(sizes - 1, 0) + np.maximum(sizes - 2, 0)
                ids = some.column("doc_id")
                score = weight + np.array([gumbel(i, seed) for i in ids.to_pylist()], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x.astype(np.int64)) for x in (sizes, n, weight, score))], ["doc_id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def resampled(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, least: int = LEAST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for each row of docs; rank is null where a row isn't drawn.

    Drawn are percent in a hundred of the rows with at least least words, rounded down: those with the highest scores, ties going
    to the smaller doc_id, absent ids first. Rows that repeat an id with the same score stand in any fixed order. Null and empty texts have no features
    and weight 0; an empty target leaves all gains to how rare a bucket is. Texts are looked at whole, a very long one alone. Other
    columns of either table, whatever their names, are not looked at; texts of target are in the column text. An empty
    table gives an empty result.

    Rows are ranked in ranges of the order, each numbered on its own: no task holds more than a range, and a row's own number is
    the last key of the order, so that rows with equal scores and ids are dealt out too.
    """
    gains = bucket_gains(bucket_counts(docs, text, buckets), bucket_counts(target, "text", buckets))
    scored = written(weighed(docs, gains, key, text, seed), "scores").withColumn("_row", F.monotonically_increasing_id())
    enough = F.col("n_words") >= least
    total, able = scored.agg(F.count("*"), F.count(F.when(enough, 1))).first()
    order = [F.desc("_able"), F.desc("score"), F.asc("doc_id"), F.asc("_row")]
    parts = max(8, math.ceil(total / RANGE))
    ranged = scored.withColumn("_able", enough).repartitionByRange(parts, *order)
    ranged = written(ranged.withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = ranged.where("_able").groupBy("_part").count().collect()  # a row a range
    ahead, before = {}, 0
    for part, n in sorted(map(tuple, sizes)):
        ahead[part], before = before, before + n
    first = ranged.sparkSession.createDataFrame(list(ahead.items()), "_part int, _ahead long")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    ranked = ranged.join(F.broadcast(first), "_part", "left").withColumn("rank", F.col("_ahead") + inside)
    drawn = F.col("_able") & (F.col("rank") <= percent * able // 100)
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("rank")).cast("long").alias("rank"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
