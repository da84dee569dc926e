"""Ordering, sequences, offsets, bins, chunks, pages and as-of sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stages import written


def next_page(df: DataFrame, sequence: str, after: int, through: int | None = None, page: int = 256) -> DataFrame:
    """Rows with after < sequence <= through in order, a page of them, each with has_more and next_after.

    through is the present maximum if it isn't given; keep it over the pages of one reading.
    """
    if through is None:
        through = df.agg(F.coalesce(F.max(sequence), F.lit(0))).first()[0]
    some = df.where((F.col(sequence) > after) & (F.col(sequence) <= through)).orderBy(sequence).limit(page + 1)
    every = Window.orderBy(sequence).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = some.withColumn("_row", F.row_number().over(Window.orderBy(sequence))).withColumn("has_more", F.count("*").over(every) > page).where(F.col("_row") <= page)
    return ranked.withColumn("next_after", F.max(sequence).over(every)).drop("_row")


def read_since(df: DataFrame, sequence: str, after: int, through: int | None = None) -> DataFrame:
    """All rows with after < sequence <= the high-water, which is taken once."""
    if through is None:
        through = df.agg(F.coalesce(F.max(sequence), F.lit(0))).first()[0]
    return df.where((F.col(sequence) > after) & (F.col(sequence) <= through))


def snapshot_audit(mappings: DataFrame, cursors: DataFrame, sequence: str) -> DataFrame:
    """(rule, key) of what a snapshot must not hold: a sequence that is there twice, a ref with two cursors, and a
    mapping whose public id is its canonical one."""
    twice = mappings.groupBy(sequence).count().where("count > 1").select(F.lit("sequence_repeated").alias("rule"), F.col(sequence).cast("string").alias("key"))
    refs = cursors.groupBy("remote", "bookmark").count().where("count > 1").select(F.lit("ref_repeated").alias("rule"), F.concat_ws("/", "remote", "bookmark").alias("key"))
    same = mappings.where("canonical = public").select(F.lit("identity_mapping").alias("rule"), F.col(sequence).cast("string").alias("key"))
    return twice.unionByName(refs).unionByName(same)


def prefix_sums(df: DataFrame, group: list[str], order: list[str], value: Column, out: str, bucket: Column) -> DataFrame:
    """Adds out: the sum of value over earlier rows of the group.

    bucket must grow with the order. Sums of buckets are accumulated over one row each, then within each bucket, so that
    a group of any size is dealt over many tasks.
    """
    df = df.withColumn("_bucket", bucket).withColumn("_value", value)
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*group, "_bucket").agg(F.sum("_value").alias("_sum")).withColumn("_ahead", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(sums, [*group, "_bucket"])
    return joined.withColumn(out, F.col("_ahead") + F.coalesce(F.sum("_value").over(inside), F.lit(0))).drop("_bucket", "_value", "_ahead")


def assign_sequence(new: DataFrame, group: list[str], order: list[str], start: DataFrame, bucket: Column, out: str = "sequence") -> DataFrame:
    """Adds a sequence without gaps that goes on from each group's stored maximum. start: (group, high_water)."""
    numbered = prefix_sums(new, group, order, F.lit(1), "_before", bucket)
    joined = numbered.join(start, group, "left")
    return joined.withColumn(out, F.coalesce("high_water", F.lit(0)) + F.col("_before") + 1).drop("_before", "high_water")


def first_violation(violations: DataFrame, group: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Per group the violation that is first in order."""
    return violations.groupBy(*group).agg(F.min(F.struct(*order, *[v for v in values if v not in order])).alias("_first")).select(*group, *(F.col(f"_first.{v}").alias(v) for v in values))


def batches(df: DataFrame, group: list[str], order: list[str], n: int, bucket: Column) -> DataFrame:
    """Adds batch: rows in order, n of them a batch."""
    return prefix_sums(df, group, order, F.lit(1), "_before", bucket).withColumn("batch", F.floor(F.col("_before") / n)).drop("_before")


def priority_queue(df: DataFrame, group: list[str], preferred: Column, order: list[str], k: int) -> DataFrame:
    """Per group the first k rows: preferred ones first, then in order; with their rank."""
    w = Window.partitionBy(*group).orderBy(F.when(preferred, 0).otherwise(1), *order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def prune(parents: DataFrame, children: DataFrame, key: str, expired: Column, order: list[str], limit: int | None) -> tuple[DataFrame, DataFrame]:
    """Parents and children without the oldest expired parents, at most limit of them if it is given."""
    gone = parents.where(expired)
    if limit is not None:
        gone = gone.orderBy(*order).limit(limit)
    gone = gone.select(key)
    return parents.join(gone, key, "left_anti"), children.join(gone, key, "left_anti")


def prune_receipts(receipts: DataFrame, heads: DataFrame, counters: DataFrame, group: list[str], key: str, expired: Column, order: list[str], limit: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(receipts, heads, counters) after a pass: the oldest expired receipts of all groups, at most limit of them, go with
    their heads, and the counters (group, receipts, heads) of their groups are lowered by what went, never below zero.

    order ends in the key where ages tie, so that a pass is the same wherever it runs. Only keys of the receipts that go,
    which limit bounds, are joined; heads are counted in part before they are shuffled. Receipts without heads lower the
    number of receipts alone; groups without a counter get none; heads of receipts that aren't there stay.
    """
    gone = receipts.where(expired)
    if limit is not None:
        gone = gone.orderBy(*order, *group, key).limit(limit)
    gone = gone.select(*group, key).distinct()
    ids = [*group, key]
    fewer = gone.groupBy(*group).agg(F.count("*").alias("_receipts")).join(
        heads.join(gone, ids, "left_semi").groupBy(*group).agg(F.count("*").alias("_heads")), group, "left"
    )
    less = lambda c: F.greatest(F.lit(0), F.col(c) - F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c)
    corrected = counters.join(fewer, group, "left").select(*(less(c) if c in ("receipts", "heads") else c for c in counters.columns))
    return receipts.join(gone, ids, "left_anti"), heads.join(gone, ids, "left_anti"), corrected


def assign_packs(objects: DataFrame, group: list[str], position: str, size: str, before: str, most_bytes: int, most_objects: int, block: int = 1 << 16) -> DataFrame:
    """Adds pack: the next-fit bin of each object in order of position; an object alone over most_bytes gets -1 as pack.

    position counts from 0 without gaps in each group, before is the sum of sizes ahead. Where a bin that began at i
    ends depends on i alone: next(i) is the first place at which bytes or objects no longer fit, at most most_objects
    further. Places are dealt into blocks of at least so many, so next(i) is in the block of i or the one after, and is
    found by sorting two blocks at a time: no task holds a group. Starts of bins are what is reached from 0 by next, found
    by pointer doubling in log2 rounds; each object then belongs to the last start not after it, counted block by block.
    An object that is too large ends the bin before it, since its end is beyond any limit, and stands alone.
    """
    block = max(block, most_objects)
    rows = written(objects.select(*group, F.col(position).cast("long").alias(position), size, before).withColumn("_over", F.col(size) > most_bytes), "sizes")
    within = F.floor(F.col(position) / block)
    starts = rows.select(*group, within.alias("_block"), F.col(position).alias("_from"), (F.col(before) + most_bytes).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_to"), F.col("_over"))
    ends = rows.select(*group, F.explode(F.array(within, within - 1)).alias("_block"), F.lit(None).cast("long").alias("_from"), (F.col(before) + F.col(size)).alias("_at"), F.lit(0).alias("_side"), F.col(position).alias("_to"), F.lit(False).alias("_over"))
    # from the last mark back: ends beyond the limit come before the start, those equal to it, which fit, after it
    beyond = Window.partitionBy(*group, "_block").orderBy(F.desc("_at"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, -1)
    fits = starts.unionByName(ends).withColumn("_next", F.min("_to").over(beyond)).where("_side = 1")
    # null where no later end is beyond: the bin ends by its objects, or with the group
    to = F.when(F.col("_over"), F.col("_from") + 1).otherwise(F.least("_next", F.col("_from") + most_objects))
    jump = written(fits.select(*group, "_from", to.alias("_to")), "jump")
    reached = written(rows.where(F.col(position) == 0).select(*group, F.col(position).cast("long").alias("_from")), "starts")
    known = reached.count()
    while True:
        step = reached.join(jump, [*group, "_from"]).select(*group, F.col("_to").alias("_from"))
        reached = written(reached.unionByName(step).distinct(), "starts")
        if (now := reached.count()) == known:
            break
        known = now
        far = jump.select(*group, F.col("_from").alias("_to"), F.col("_to").alias("_far"))
        jump = written(jump.join(far, [*group, "_to"], "left").select(*group, "_from", F.coalesce("_far", "_to").alias("_to")), "jump")
    begun = reached.withColumn("_start", F.lit(1)).withColumnRenamed("_from", position)
    started = F.coalesce(F.col("_start"), F.lit(0))
    out = prefix_sums(objects.join(begun, [*group, position], "left"), group, [position], started, "_earlier", F.floor(F.col(position) / block))
    pack = F.when(F.col(size) > most_bytes, F.lit(-1)).otherwise(F.col("_earlier") + started - 1)
    return out.withColumn("pack", pack.cast("long")).drop("_start", "_earlier")


def with_offsets(objects: DataFrame, pack: list[str], order: list[str], size: str) -> DataFrame:
    """Adds byte_offset: the bytes of a pack's objects ahead. A pack is bounded, so a window per pack is."""
    w = Window.partitionBy(*pack).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return objects.withColumn("byte_offset", F.coalesce(F.sum(size).over(w), F.lit(0)))


def layout_audit(ranges: DataFrame, pack: list[str], position: str) -> DataFrame:
    """(pack, position, rule) where ranges aren't contiguous from 0, or positions have gaps."""
    w = Window.partitionBy(*pack).orderBy(position)
    expected = F.coalesce(F.lag(F.col("byte_offset") + F.col("byte_length")).over(w), F.lit(0))
    place = F.coalesce(F.lag(position).over(w) + 1, F.lit(0))
    rule = F.when(F.col("byte_offset") != expected, "not_contiguous").when(F.col(position) != place, "position_gap").when(F.col("byte_length") < 0, "negative_length")
    return ranges.withColumn("rule", rule).where("rule IS NOT NULL").select(*pack, position, "rule")


def chunk(df: DataFrame, key: list[str], data: str, size: int) -> DataFrame:
    """(key, position, byte_offset, byte_length, chunk): bytes cut at multiples of size; empty bytes make no chunk."""
    pieces = F.sequence(F.lit(0), F.floor((F.octet_length(data) - 1) / size).cast("int"))
    rows = df.where(F.octet_length(data) > 0).select(*key, data, F.explode(pieces).alias("position"))
    piece = F.substring(F.col(data), F.col("position") * size + 1, F.lit(size))
    return rows.select(*key, "position", (F.col("position").cast("long") * size).alias("byte_offset"), F.octet_length(piece).cast("long").alias("byte_length"), piece.alias("chunk"))


def overlap(chunks: DataFrame, objects: DataFrame, key: list[str], size: int) -> DataFrame:
    """(key, position, object, lo, hi): the bytes of each object that lie in each chunk of its pack.

    Chunks have a fixed size, so an object names the chunks it touches and the range join becomes an equi-join.
    """
    touched = F.sequence(F.floor(F.col("start") / size).cast("int"), F.floor((F.col("end") - 1) / size).cast("int"))
    spread = objects.where(F.col("end") > F.col("start")).withColumn("position", F.explode(touched))
    joined = spread.join(chunks.select(*key, "position", "byte_offset", "byte_length"), [*key, "position"])
    lo, hi = F.greatest("start", "byte_offset"), F.least(F.col("end"), F.col("byte_offset") + F.col("byte_length"))
    return joined.select(*key, "position", "object", lo.alias("lo"), hi.alias("hi")).where("lo < hi")


def reassemble(parts: DataFrame, key: list[str], position: str, data: str) -> DataFrame:
    """(key, bytes): parts of a key put together in order; a key's parts are bounded by the size of one object."""
    listed = F.array_sort(F.collect_list(F.struct(position, data)))
    grouped = parts.groupBy(*key).agg(listed.alias("_parts"))
    return grouped.select(*key, F.aggregate("_parts", F.lit(b""), lambda acc, p: F.concat(acc, p[data])).alias("bytes"))


def heads_as_of(intervals: DataFrame, cursor: int | Column) -> DataFrame:
    """The heads that live at a cursor. intervals: (head, added_at, removed_at or null)."""
    at = F.lit(cursor) if isinstance(cursor, int) else cursor
    return intervals.where((F.col("added_at") <= at) & (F.col("removed_at").isNull() | (F.col("removed_at") > at)))
