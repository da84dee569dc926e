"""Exact dedup against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. New rows are reduced to one row a digest
(partial aggregation before the shuffle), set against the index by a sort-merge anti-join and appended.
All of it is DataFrame work without Python on the executors.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, comparable, hot_join, quoted, shared_dir, table, written

#: Digests of a bucket, and least and most buckets of an index.
BUCKET, LEAST, MOST = 500_000, 16, 100_000


def buckets_for(rows: int) -> int:
    return min(MOST, max(LEAST, math.ceil(rows / BUCKET)))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, digest): SHA-256 in hex of the text lower-cased in A-Z; null counts as empty."""
    return docs.select(F.col(key).alias("doc_id"), F.sha2(ascii_lower(text).cast("binary"), 256).alias("digest"))


class DigestIndex:
    """digest -> the row that stays and the number of equal rows in the batch that brought it.

    path: where the files are. A path that has an index already is opened with the buckets that it was made with, not
    overwritten. A run that broke off after appending finds its own digests on the next try and appends none of them twice.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = LEAST):
        self.spark, self.name = spark, f"digest_index_{uuid.uuid4().hex}"
        # the number of buckets is kept beside the files: whoever made the index has set it
        spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("ignore").parquet(f"{path}-buckets")
        self.buckets = spark.read.parquet(f"{path}-buckets").first()[0]
        spark.sql(
            f"CREATE TABLE {self.name} (digest STRING, keep_id BIGINT, group_size BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def close(self) -> None:
        """Takes the name out of the catalog; the files stay, and a later run opens them."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append_new(self, rows: DataFrame) -> None:
        """rows: (doc_id, digest). Of equal digests the largest doc_id stays; digests that the index has are left out."""
        groups = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        new = groups.join(self.rows().hint("merge"), "digest", "left_anti")
        new = new.select("digest", "keep_id", "group_size").repartition(self.buckets, "digest")
        new.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)


def decisions(docs: DataFrame, index: DigestIndex, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of docs, which are added to the index.

    Rows that repeat the id that stays are kept with it. A null id stays only if all ids of its group are null.
    Ties are settled by the largest id. Very long texts are digested whole. Other columns of docs, whatever their names, are
    not looked at. An empty table gives an empty result.
    """
    rows = written(digests(docs, key, text), "digests")
    index.append_new(rows)
    found = index.rows()
    out = hot_join(rows, found, "digest", "group_size")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def decided(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """decisions() against the index at path, which is made if it isn't there; the result is written, the index closed."""
    index = DigestIndex(docs.sparkSession, path, buckets_for(docs.count()))
    out = written(decisions(docs, index, key, text), "decisions")
    index.close()
    return out


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with their columns: one of each group of equal texts.

    Of rows that repeat the id that stays, or all lack an id, the one stays whose columns are the least in order, maps counting
    as JSON. Null and empty texts are equal; very long texts are digested whole. Columns of docs may have any names and types. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    found = decided(docs, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", key, text)
    gone = found.where("NOT kept").select(F.col("doc_id").alias("_gone"), F.col("text_sha256").alias("_sha"))
    sha = F.sha2(ascii_lower(docs[text]).cast("binary"), 256)
    out = docs.join(gone, docs[key].eqNullSafe(gone["_gone"]) & (sha == gone["_sha"]), "left_anti")
    several = found.where("kept").groupBy("text_sha256").count().where("count > 1").select(F.col("text_sha256").alias("_sha"))
    if not several.limit(1).count():
        return out
    # the least is found in each task before rows are shuffled
    row = F.struct(F.sha2(ascii_lower(text).cast("binary"), 256).alias("_sha"), F.struct(*quoted(docs)).alias("_row"), F.struct(*comparable(docs)).alias("_order"))
    packed = out.select(row.alias("_p")).select("_p._sha", "_p._row", "_p._order")
    repeats = packed.join(F.broadcast(several), "_sha", "left_semi") if several.count() < 100_000 else packed.join(several, "_sha", "left_semi")
    single = packed.join(several, "_sha", "left_anti").select("_row.*")
    return single.unionByName(repeats.groupBy("_sha").agg(F.min_by("_row", "_order").alias("_row")).select("_row.*"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT doc_id, sha256(t) AS text_sha256 FROM d)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM g WINDOW w AS (PARTITION BY text_sha256)
"""
