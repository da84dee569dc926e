"""SimHash near-dedup: fingerprints of word shingles, linked by a self-join of binary tries.

Two fingerprints that differ in at most three of 64 bits agree in one of four 16-bit blocks. Distinct
fingerprints are dealt by each block; those that share one are the leaves of a binary trie over the other
bits. The trie is joined with itself: pairs of nodes go down together, differing bits add up, and a pair is
dropped once the error budget is exceeded, or if all its leaves are in one component already. The budget
grows from one bit to three, so that dense groups are connected before their far pairs would be visited.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_join, slabs, table, whole_groups, written
from .components import components

SHINGLE, ERRORS, SEED = 3, 3, 42
#: Bits of the four blocks that fingerprints are dealt by: first of all 64, then, where more than CROWD fingerprints share a
#: block, of the other 48, and then of the 36 that are left.
WIDTHS, CROWD = (16, 12, 9), 4_096
#: Texts of more bytes are hashed a piece at a time; fingerprints that a task looks at together.
LONG, MOST = 1 << 20, 1_000_000
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_hashes(text: bytes, n: int) -> list[int]:
    """XXH64 of the n-word shingles of a text, lower-cased in A-Z; of all words if they are fewer than n; none without words.

    bytes.lower() and bytes.split() know ASCII letters and the six ASCII white space characters only, as needed.
    """
    words = text.lower().split()
    joined = b" ".join(words)
    if len(words) <= n:
        return [xxhash.xxh64_intdigest(joined, SEED)] if words else []
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[n - 1 :])]


def print_of_long(text: bytes, n: int, piece: int = 1 << 16) -> int:
    """The fingerprint of a long text, in memory that doesn't grow with it."""
    last: deque[bytes] = deque(maxlen=n)
    ones, total = np.zeros(64, dtype=np.int64), 0
    hashes: list[int] = []

    def count() -> None:
        nonlocal ones, total
        bits = np.unpackbits(np.array(hashes, dtype=np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones, total = ones + bits.sum(axis=0, dtype=np.int64), total + len(hashes)
        hashes.clear()

    for m in _WORD.finditer(text):
        last.append(m.group().lower())
        if len(last) == n:
            hashes.append(xxhash.xxh64_intdigest(b" ".join(last), SEED))
            if len(hashes) == piece:
                count()
    if not hashes and not total and last:
        hashes.append(xxhash.xxh64_intdigest(b" ".join(last), SEED))
    if hashes:
        count()
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints_of(texts: list[bytes], n: int) -> np.ndarray:
    """A bit is one if it is set in over half the hashes; zero without words."""
    hashes = [shingle_hashes(t, n) if len(t) <= LONG else [] for t in texts]
    sizes = np.array([len(h) for h in hashes])
    out = np.zeros(len(texts), dtype=np.uint64)
    some = sizes > 0
    if some.any():
        flat = np.array([x for h in hashes for x in h], dtype=np.uint64)
        bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[some] = np.packbits(ones * 2 > sizes[some][:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    for i, t in enumerate(texts):
        if len(t) > LONG:
            out[i] = print_of_long(t, n)
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids,), texts in slabs(batches, ["doc_id", "text"], "text"):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fingerprints_of(texts, n).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


class Forest:
    """Binary tries over sorted rows of distinct keys; a trie's rows share group and are split on the bits below."""

    def __init__(self, group: np.ndarray, key: np.ndarray):
        self.key, self.label = key, np.arange(len(key))
        cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
        self.roots = np.stack([cut[:-1], cut[1:]])
        self.ones: dict[int, np.ndarray] = {}

    def middle(self, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
        if bit not in self.ones:
            self.ones[bit] = np.concatenate([[0], np.cumsum((self.key >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        ones = self.ones[bit]
        return hi - (ones[hi] - ones[lo])

    def link(self, budget: int, top: int, chunk: int = 1 << 20) -> None:
        """Joins labels of leaves that differ in at most budget bits; top: the highest bit on which leaves of a trie may differ."""
        lo, hi = self.roots
        keep = hi - lo > 1
        lo, hi = lo[keep], hi[keep]
        stack = [(top, lo, hi, lo, hi, np.zeros(len(lo), dtype=np.int8))]
        while stack:
            bit, alo, ahi, blo, bhi, errors = stack.pop()
            if len(alo) > chunk:
                half = len(alo) // 2
                stack += [(bit, *(x[half:] for x in (alo, ahi, blo, bhi, errors))), (bit, *(x[:half] for x in (alo, ahi, blo, bhi, errors)))]
                continue
            changes = np.concatenate([[0], np.cumsum(self.label[1:] != self.label[:-1])])
            one = (changes[ahi - 1] == changes[alo]) & (changes[bhi - 1] == changes[blo]) & (self.label[alo] == self.label[blo])
            leaf = ~one & (ahi - alo == 1) & (bhi - blo == 1)
            if leaf.any():
                a, b = alo[leaf], blo[leaf]
                near = np.bitwise_count(self.key[a] ^ self.key[b]) <= budget
                self.union(a[near], b[near])
            go = ~one & ~leaf
            if bit < 0 or not go.any():
                continue
            alo, ahi, blo, bhi, errors = (x[go] for x in (alo, ahi, blo, bhi, errors))
            am, bm, same = self.middle(alo, ahi, bit), self.middle(blo, bhi, bit), alo == blo
            parts = [(alo, am, blo, bm, errors), (am, ahi, bm, bhi, errors), (alo, am, bm, bhi, errors + 1), (am, ahi, blo, bm, errors + 1)]
            nexts = []
            for k, (p, q, r, s, e) in enumerate(parts):
                ok = (q > p) & (s > r) & (e <= budget)
                if k < 2:
                    ok &= ~(same & (q - p == 1))
                if k == 3:
                    ok &= ~same
                nexts.append([x[ok] for x in (p, q, r, s, e.astype(np.int8))])
            stack.append((bit - 1, *(np.concatenate(x) for x in zip(*nexts))))

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        """Labels become the smallest of their component, edges a-b added."""
        label = self.label
        while True:
            x, y = label[a], label[b]
            if (x == y).all():
                break
            np.minimum.at(label, x, np.minimum(x, y))
            np.minimum.at(label, y, np.minimum(x, y))
            while (label != (jumped := label[label])).any():
                label = jumped
        self.label = label


def linked(groups: list[np.ndarray], key: np.ndarray, ids: np.ndarray, top: int, errors: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): stars that connect the ids whose keys share the groups' values and differ in at most errors bits."""
    order = np.lexsort((key, *reversed(groups)))
    key, ids = key[order], ids[order]
    new = np.zeros(len(key), dtype=bool)
    for g in groups:
        g = g[order]
        new[1:] |= g[1:] != g[:-1]
    forest = Forest(np.cumsum(new), key)
    for budget in range(1, errors + 1):
        forest.link(budget, top)
    moved = forest.label != np.arange(len(key))
    return ids[moved], ids[forest.label[moved]]


def _deal(rows: DataFrame, keep: list[str], out: str, width: int, parts: int) -> DataFrame:
    """Each row once for each of its key's blocks: the block's number and value, and the key with that block on top."""
    turn = F.expr(f"explode(sequence(0, {parts - 1}))").alias(f"{out}_at")
    rows = rows.select(*keep, "key", turn)
    bits = width * parts
    low = F.lit(2**bits - 1 if bits < 64 else -1)
    turned = F.expr(f"shiftleft(key, {width} * {out}_at) | shiftrightunsigned(key, {bits} - {width} * {out}_at)") if bits == 64 else F.expr(f"shiftleft(key, {width} * {out}_at) | shiftrightunsigned(key & {2**bits - 1}L, {bits} - {width} * {out}_at)")
    rows = rows.withColumn("key", turned.bitwiseAND(low))
    value = F.expr(f"shiftrightunsigned(key, {bits - width})")
    return rows.select(*keep, f"{out}_at", value.alias(out), F.col("key").bitwiseAND(F.lit(2 ** (bits - width) - 1)).alias("key"))


def links(reps: DataFrame, errors: int = ERRORS, crowd: int = CROWD) -> DataFrame:
    """(a, b): edges between the rep_ids of fingerprints that differ in at most errors (3 at most) bits.

    reps: (fp, rep_id), each fp once. Edges connect the same rows as all links would, without listing each.
    """
    assert errors <= 3

    def run(names: list[str], top: int):
        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in whole_groups(batches, names, MOST):
                columns = {c: rows[c].to_numpy() for c in rows.column_names}
                a, b = linked([columns[c] for c in names], columns["key"].astype(np.uint64), columns["rep_id"], top, errors)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        return join

    rows, names, bits, out = reps.select("rep_id", F.col("fp").alias("key")), [], 64, None
    for i, width in enumerate(WIDTHS):
        rows = written(_deal(rows, ["rep_id", *names], f"block{i}", width, 4), "blocks")
        names = [*names, f"block{i}_at", f"block{i}"]
        bits -= width
        thin = rows
        if i + 1 < len(WIDTHS):
            crowds = rows.groupBy(*names).count().where(F.col("count") > crowd).drop("count")
            thin, rows = rows.join(crowds, names, "left_anti"), rows.join(crowds, names, "left_semi")
        near = thin.repartition(*names).sortWithinPartitions(*names).mapInArrow(run(names, bits - 1), "a long, b long")
        out = near if out is None else out.unionByName(near)
        if i + 1 < len(WIDTHS) and not crowds.limit(1).count():
            break
    return out


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = SHINGLE, errors: int = ERRORS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row.

    Null and empty texts have fingerprint zero and are linked like any other. Rows that repeat an id keep a row each.
    Rows without an id get the component of their fingerprint, null if no row of it has an id. Very long texts are hashed a
    piece at a time. Other columns, whatever their names, are not looked at. An empty table gives an empty result.
    """
    prints = written(fingerprints(docs, key, text, n), "fingerprints")
    reps = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep_id"), F.count("*").alias("n")), "reps")
    found = components(links(reps.where("rep_id IS NOT NULL"), errors))
    named = reps.join(found, reps["rep_id"] == found["node"], "left").select("fp", "n", F.coalesce("component", "rep_id").alias("component_id"))
    out = hot_join(prints, written(named, "components"), "fp", "n")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without those of a group whose id isn't the group's smallest. Rows without an id stay."""
    gone = groups(docs, key, text).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[key] == gone["_gone"], "left_anti")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))
