"""What the corpus operators share: reading tables, cutting lineage, running sums, packing text for numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from ..operators.stages import map_in_arrow, shared_dir, written  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: A word is a run of characters other than blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def settled(df: DataFrame, name: str) -> DataFrame:
    """written, without its shuffle files: these go when the table is there, not when the driver happens to collect its garbage."""
    conf, cleanup = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(cleanup)
    conf.set(cleanup, "true")
    try:
        return written(df, name)
    finally:
        conf.set(cleanup, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column | str) -> Column:
    """Lower-cases A-Z alone; null counts as empty."""
    return F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), UPPER, LOWER)


def quoted(df: DataFrame) -> list[Column]:
    """The columns of df, whatever their names."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def _has_map(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, MapType) or (isinstance(kind, ArrayType) and _has_map(kind.elementType))


def comparable(df: DataFrame) -> list[Column]:
    """The columns of df in forms that can be hashed and put in order: those that hold maps as JSON."""
    return [F.to_json(c).alias(f.name) if _has_map(f.dataType) else c for c, f in zip(quoted(df), df.schema.fields)]


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """The join on equal keys, null being equal to null; the keys are those of left."""
    right = right.select(*(F.col(c).alias(f"_r_{c}" if c in keys else c) for c in right.columns))
    joined = left.join(right, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in keys], how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*(f"_r_{c}" for c in keys))


def running_sum(df: DataFrame, group: list[str], order: str, value: str, out: str, rows: int) -> DataFrame:
    """Adds out: the sum of value over the group's earlier rows, in the order of (bucket, order).

    A window over a whole group would put a hot group into one task. Rows are dealt into hashed buckets
    first: sums of buckets are accumulated over one small row each, then windows run inside a bucket.
    rows: about how many rows df has; a bucket gets some thousand of them, and many buckets are
    accumulated in the same way.
    """
    buckets = max(1, rows // 1_000)
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(order), F.lit(buckets)))
    sums = df.groupBy(*group, "_bucket").agg(F.sum(value).alias("_sum"))
    if buckets > 10_000:
        sums = running_sum(sums.withColumnRenamed("_bucket", "_of"), group, "_of", "_sum", "_before", buckets).withColumnRenamed("_of", "_bucket")
    else:
        ahead = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)))
    sums = sums.select(*group, "_bucket", "_before")
    inside = Window.partitionBy(*group, "_bucket").orderBy(order, value).rowsBetween(Window.unboundedPreceding, -1)
    joined = null_safe(df, sums, [*group, "_bucket"], "left")
    return joined.withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_before", "_bucket")


def mix64(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit keys (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slabs(batches, columns: list[str], text: str, limit: int = 1 << 20):
    """Arrow batches as small runs of rows: lists of columns, the text as bytes, about limit bytes of text each.

    A row is never split, so a very long text makes a slab of its own. Only a slab's rows are Python objects at a time.
    """
    for batch in batches:
        texts = batch.column(text).cast("binary")
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        start = size = 0
        for i, n in enumerate(sizes):
            size += n
            if size >= limit or i == len(sizes) - 1:
                some = batch.slice(start, i + 1 - start)
                yield [some.column(c).to_pylist() for c in columns if c != text], [t or b"" for t in texts[start : i + 1].to_pylist()]
                start, size = i + 1, 0


def whole_groups(batches, keys: list[str], limit: int):
    """Tables of sorted batches: complete groups of equal keys, some limit rows at a time; a larger group comes alone.

    A task thus holds a few groups, however many rows its partition has.
    """

    def key(batch: pa.RecordBatch, row: int) -> list:
        return [batch.column(k)[row].as_py() or 0 for k in keys]

    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        # rows are put together only if a group has ended: those of one group are copied once, however many batches it has
        if rows >= limit and key(held[0], 0) != key(batch, batch.num_rows - 1):
            some = pa.Table.from_batches(held).combine_chunks()
            changes = np.zeros(rows - 1, dtype=bool)
            for k in keys:
                column = np.asarray(some[k].fill_null(0))
                changes |= column[1:] != column[:-1]
            cut = np.flatnonzero(changes)[-1] + 1
            yield some.slice(0, cut)
            held = [b for b in some.slice(cut).to_batches() if b.num_rows]
            rows -= cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


#: A key is hot if it holds more than one in HOT rows, so there are fewer than HOT hot keys: few enough to broadcast.
HOT = 2_000


def hot_join(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """rows joined to groups, which has each key once and in size the number of its rows.

    Rows of hot keys meet their group by broadcast, so that they need not come together in one task.
    """
    hot = groups.where(F.col(size) > F.lit(rows.count() / HOT))
    few = F.broadcast(hot.select(key, F.lit(True).alias("_hot")))
    marked = rows.join(few, key, "left")
    cold = marked.where("_hot IS NULL").drop("_hot").join(groups.join(few, key, "left_anti").hint("merge"), key)
    return cold.unionByName(marked.where("_hot").drop("_hot").join(F.broadcast(hot), key))
