"""Mixing sources to target weights.

The words of a source, document after document, are cut into blocks of BLOCK words. Output shards draw
multinomial counts of blocks from the sources; each drawn slot goes through the pseudorandom permutation of
its source's block indices (a Feistel network with cycle walking), and slots meet blocks by (source, index).
A source whose slots outnumber its blocks starts the permutation again, so a block is taken at most three times.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, comparable, hot_join, null_safe, quoted, running_sum, table, word_count, written

BLOCK = 32
SHARD = 4_096
WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 42
#: A mix of more sources is refused with an error: targets are set on the driver and sent to all tasks.
SOURCES = 100_000


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, most: int = MOST) -> list[float]:
    """The target of each (source, size), in code point order with null last; weights repeat in that order.

    All sizes together are shared by weight; a source stops at most times its size and what is over is shared
    among the others in the same way. That is min(weight * level, most * size) for the one level that uses all.
    """
    w = np.array([weights[i % len(weights)] for i in range(len(sizes))], dtype=float)
    cap = most * np.array([n for _, n in sizes], dtype=float)
    open_, left = cap > 0, float(sum(n for _, n in sizes))
    out = np.zeros(len(sizes))
    while open_.any():
        share = np.where(open_, left * w / w[open_].sum(), 0)
        over = open_ & (share >= cap)
        if not over.any():
            return np.where(open_, share, out).tolist()
        out[over] = cap[over]
        left -= cap[over].sum()
        open_ &= ~over
    return out.tolist()


def permuted(slot: np.ndarray, n: int, key: int) -> np.ndarray:
    """Pseudorandom permutation of 0..n-1 at each slot: four Feistel rounds, walked until below n."""
    half = np.uint64(max(1, math.ceil(math.log2(max(2, n)) / 2)))
    mask = np.uint64((1 << int(half)) - 1)
    x = slot.astype(np.uint64)
    todo = np.ones(len(x), dtype=bool)
    while todo.any():
        a, b = x[todo] >> half, x[todo] & mask
        for r in range(4):
            f = (b + np.uint64(key % 2**32 * 8 + r)) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((f >> np.uint64(32)) & mask)
        x[todo] = (a << half) | b
        todo &= x >= n
    return x.astype(np.int64)


class Plan:
    """Sizes, targets, slots and blocks of each source: one small row a source on the driver, and no more than SOURCES of them."""

    def __init__(self, sized: DataFrame, block: int, weights=WEIGHTS):
        by_source = sized.groupBy("source").agg(F.sum("size"), F.count("*"))
        found = [(r[0], r[1] or 0, r[2]) for r in by_source.limit(SOURCES + 1).collect()]
        if len(found) > SOURCES:
            raise ValueError(f"a mix of more than {SOURCES} sources")
        found.sort(key=lambda r: (r[0] is None, r[0] or ""))
        self.names, self.sizes = [r[0] for r in found], [r[1] for r in found]
        self.rows = sum(r[2] for r in found)
        self.target = targets(list(zip(self.names, self.sizes)), weights)
        self.blocks = [math.ceil(n / block) for n in self.sizes]
        # a source's last block may be short, so the words of a slot are its blocks' mean length
        self.slots = [min(round(t * n / size), MOST * n) if size else 0 for t, n, size in zip(self.target, self.blocks, self.sizes)]

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, *x) for i, x in enumerate(zip(self.names, self.sizes, self.target))]
        return F.broadcast(spark.createDataFrame(rows, "s int, source string, source_size long, target double"))


def drawn(spark: SparkSession, plan: Plan, seed: int, shard: int = SHARD) -> DataFrame:
    """(s, block, pass): one row for each slot of the mix.

    Each shard draws its counts on its own from a generator seeded with its number. A source's draws beyond its
    slots are void and its missing ones form a last draw, so every source gets its slots exactly.
    """
    total = sum(plan.slots)
    if not total:
        return spark.createDataFrame([], "s int, block long, pass long")
    p = [x / total for x in plan.slots]
    shards = math.ceil(total / shard)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in batch["id"]:
                counts = np.random.default_rng([seed, int(i)]).multinomial(shard, p)
                some = np.flatnonzero(counts)  # a shard's slots at most
                yield pd.DataFrame({"shard": int(i), "s": some.astype(np.int32), "n": counts[some]})

    counts = spark.range(shards).mapInPandas(draw, "shard long, s int, n long")
    counts = running_sum(counts, ["s"], "shard", "n", "start", shards * min(len(p), shard))
    limits = F.broadcast(spark.createDataFrame([(i, n) for i, n in enumerate(plan.slots)], "s int, slots long"))
    counts = counts.join(limits, "s").withColumn("n", F.greatest(F.lit(0), F.least("n", F.col("slots") - F.col("start"))))
    got = counts.groupBy("s").agg(F.sum("n").alias("got"))
    last = limits.join(got, "s", "left").select("s", F.coalesce("got", F.lit(0)).alias("start"), (F.col("slots") - F.coalesce("got", F.lit(0))).alias("n"))
    counts = counts.select("s", "start", "n").unionByName(last).where("n > 0")
    # a last draw may be long: pieces of one shard at most
    pieces = counts.select("s", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1, F.lit(shard))).alias("start"), (F.col("start") + F.col("n")).alias("end"))
    pieces = pieces.select("s", "start", F.least("end", F.col("start") + shard).alias("end")).repartition(spark.sparkContext.defaultParallelism * 2)
    blocks = plan.blocks

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s, start, end in batch.itertuples(index=False):
                slot = np.arange(start, end)
                yield pd.DataFrame({"s": np.int32(s), "block": permuted(slot % blocks[s], blocks[s], seed + s), "pass": slot // blocks[s]})

    return pieces.mapInPandas(slots, "s int, block long, pass long")


def placed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size): the size is the number of words."""
    return docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"))


def overlaps(units: DataFrame, plan: Plan, block: int) -> DataFrame:
    """(unit, s, block, lo, hi): the words lo..hi-1 of a unit are in that block of its source.

    units: (unit, source, size, _key). Those of a source follow one another in the order of _key, a hash, and size.
    """
    lines = null_safe(units.where("size > 0"), plan.frame(units.sparkSession).select("s", "source"), ["source"], "inner")
    lines = running_sum(lines, ["s"], "_key", "size", "at", plan.rows)
    lines = lines.withColumn("block", F.explode(F.sequence((F.col("at") / block).cast("long"), ((F.col("at") + F.col("size") - 1) / block).cast("long"))))
    lo = F.greatest(F.lit(0), F.col("block") * block - F.col("at"))
    hi = F.least(F.col("size"), (F.col("block") + 1) * block - F.col("at"))
    return lines.select("unit", "s", "block", lo.alias("lo"), hi.alias("hi"))


def met(parts: DataFrame, slots: DataFrame) -> DataFrame:
    """parts and slots of one block of one source. Both are made of far fewer and smaller rows, by which Spark would take one of
    them for small enough to go through the driver as a broadcast; they grow with the corpus, so they are merged."""
    return parts.hint("merge").join(slots.hint("merge"), ["s", "block"])


def numbered(rows: DataFrame, unit: str, many: str, count: int) -> DataFrame:
    """Adds _nr, the number of a row among those of its unit, 0 where the column many says that it is alone.

    Which of equal rows has which number is all the same; they are counted over buckets of rows by _n, since there may be very many.
    """
    several = running_sum(rows.where(f"{many} > 1").withColumn("_one", F.lit(1)), [unit], "_n", "_one", "_nr", count).drop("_one")
    return rows.where(f"{many} = 1").withColumn("_nr", F.lit(0).cast("long")).unionByName(several.withColumn("_nr", F.col("_nr").cast("long")))


def mix(docs: DataFrame, block: int = BLOCK, weights=WEIGHTS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken): how many words of each document the mix takes.

    Null texts have size 0 and null sources form a source of their own. Documents without words are returned with
    taken 0. Rows of one source that share id and size, such as repeated rows or rows without an id, lie side by side in
    the mix as one document; each has its row, and the words taken are shared out evenly, the remainder one each, so none
    is lost and none gets more than three times its own. Very long texts span many blocks. Other columns of docs, whatever their
    names, are not looked at. More than SOURCES sources are an error. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    sized = written(placed(docs).withColumn("_n", F.monotonically_increasing_id()), "sizes")
    plan = Plan(sized, block, weights)
    alike = F.struct("doc_id", "source", "size")
    units = written(sized.groupBy(alike.alias("unit")).agg(F.count("*").alias("rows")), "units")
    lines = units.select("unit", "unit.source", (F.col("unit.size") * F.col("rows")).alias("size"), F.xxhash64("unit.doc_id", "unit.size").alias("_key"))
    times = drawn(spark, plan, seed).groupBy("s", "block").count()
    parts = met(overlaps(lines, plan, block), times)
    got = parts.groupBy("unit").agg(F.sum((F.col("hi") - F.col("lo")) * F.col("count")).alias("all_taken"))
    shared = written(units.join(got, "unit", "left").select("unit", "rows", F.coalesce("all_taken", F.lit(0)).alias("all_taken")), "taken")
    rows = numbered(hot_join(sized.withColumn("unit", alike), shared, "unit", "rows"), "unit", "rows", plan.rows)
    rows = null_safe(rows, plan.frame(spark).drop("s"), ["source"], "inner")
    one_more = (F.col("_nr") < F.expr("all_taken % rows")).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", (F.expr("all_taken div rows") + one_more).cast("long").alias("taken"))


def taken(text: str, runs: list[dict], word: re.Pattern) -> str:
    """The words of runs (lo, hi), in order."""
    spans = [m.span() for m in word.finditer(text)]
    merged: list[list[int]] = []
    for run in runs:
        if merged and merged[-1][1] == run["lo"]:
            merged[-1][1] = run["hi"]
        else:
            merged.append([run["lo"], run["hi"]])
    return "\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in merged)


def mixed_documents(docs: DataFrame, block: int = BLOCK, weights=WEIGHTS, seed: int = SEED) -> DataFrame:
    """The mix itself, with the columns of docs: for each document and pass one row with the words taken in that pass.

    Words of neighbouring blocks keep the white space between them, others are set apart by a line feed; n_chars,
    if there, is counted anew. A document that no block was drawn from has no row. Rows that repeat an id are told
    apart by their place; their order comes from the rows' contents, so reruns agree. Null texts and sources are as in
    mix(). Columns of docs may have any names and types. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    row = F.struct(*quoted(docs))
    keyed = written(docs.select(F.xxhash64(F.struct(*comparable(docs))).alias("_key"), F.monotonically_increasing_id().alias("_n"), row.alias("_row")), "mix-rows")
    sized = keyed.select("_n", "_key", F.col("_row.source").alias("source"), word_count("_row.text").alias("size"))
    plan = Plan(sized, block, weights)
    # equal rows are one unit, whose words the rows hold one after the other
    alike = F.struct("_key", "source", "size")
    units = written(sized.groupBy(alike.alias("unit")).agg(F.count("*").alias("rows")), "units")
    lines = units.select("unit", "unit.source", (F.col("unit.size") * F.col("rows")).alias("size"), "unit._key")
    drawn_parts = met(overlaps(lines, plan, block), drawn(spark, plan, seed)).select("unit", "pass", "lo", "hi")
    rows = numbered(hot_join(sized.withColumn("unit", alike), units, "unit", "rows"), "unit", "rows", plan.rows)
    parts = drawn_parts.withColumn("_nr", F.explode(F.expr("sequence(lo div unit.size, (hi - 1) div unit.size)")))
    start = F.col("_nr") * F.col("unit.size")
    own = lambda x: F.least(F.greatest(F.col(x) - start, F.lit(0)), F.col("unit.size")).alias(x)
    parts = parts.select("unit", "_nr", "pass", own("lo"), own("hi"))
    parts = rows.select("unit", "_nr", "_n").join(parts, ["unit", "_nr"])
    parts = parts.groupBy("_n", "pass").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("_runs"))
    schema = docs.schema
    names = schema.names

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(WORD)
        for batch in batches:
            for start in range(0, batch.num_rows, 100):  # texts and runs as Python objects take much more room than as Arrow
                some = batch.slice(start, 100)
                columns = some.column("_row").flatten()
                texts = [taken(t, r, word) for t, r in zip(columns[names.index("text")].to_pylist(), some.column("_runs").to_pylist())]
                columns = [pa.array(texts, pa.string()) if n == "text" else c for n, c in zip(names, columns)]
                yield pa.RecordBatch.from_arrays(columns, names)

    joined = keyed.select("_n", "_row").join(parts, "_n").select("_row", "_runs")
    out = joined.mapInArrow(cut, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)).select(*quoted(out)) if "n_chars" in names else out


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
