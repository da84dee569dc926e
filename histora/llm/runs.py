"""Periodic runs of words: a suffix automaton per stretch of text, walked by link-cut access.

The states that end at a prefix form a path of suffix links. Appending a word recolours that path with the word's place;
the colour it had before, cut into segments, tells for every length where the longest suffix of that segment ended last. Where
the distance between the previous and the new end is within the segment's length, the two occurrences touch: a square.
The length of the segment also tells how far the period reaches back, and the same distance found again at the next word
carries it on, so squares grow to whole runs.

A run in which a period comes four times or more holds each of its neighbouring pairs of words at least three times. Before
automata are built, texts are therefore cut at pairs that their stretch holds less often, until nothing more is cut;
no run is lost by it, and prose leaves almost nothing.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, mix64, slabs, table

#: A run has at least so many words, and its period at least so many times.
LENGTH, TIMES = 6, 4


def automaton(words: list[int]) -> tuple[array, array, list[int]]:
    """(length, link, ends) of the suffix automaton of words; state 1 is the empty word's, its link is 0.

    Most states have a single transition, which is kept in arrays; those with more have a dictionary besides.
    """
    length, link, symbol, to = (array("i", [x, y]) for x, y in ((0, 0), (0, 0), (-1, -1), (0, 0)))
    more: dict[int, dict[int, int]] = {}
    ends, last = [], 1
    for i, w in enumerate(words, 1):
        new = len(length)
        length.append(i)
        link.append(1)
        symbol.append(-1)
        to.append(0)
        p, q = last, 0
        while p:
            if symbol[p] == w:
                q = to[p]
                break
            if symbol[p] == -1:
                symbol[p], to[p] = w, new
            else:
                others = more.setdefault(p, {})
                q = others.setdefault(w, new)
                if q != new:
                    break
                q = 0
            p = link[p]
        if q:
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                symbol.append(symbol[q])
                to.append(to[q])
                if q in more:
                    more[twin] = dict(more[q])
                while p:
                    if symbol[p] == w and to[p] == q:
                        to[p] = twin
                    elif p in more and more[p].get(w) == q:
                        more[p][w] = twin
                    else:
                        break
                    p = link[p]
                link[q] = link[new] = twin
        ends.append(new)
        last = new
    return length, link, ends


def squares(length: array, link: array, ends: list[int]) -> Iterator[tuple[int, int, int]]:
    """(end, previous end, longest common suffix) wherever the ends are no farther apart than that suffix is long.

    Paths of one colour are splay trees ordered by depth; a tree's colour is kept at its root.
    """
    zeros = bytes(4 * len(link))
    up, left, right, seen = link[:], array("i", zeros), array("i", zeros), array("i", zeros)

    def rotate(child: int, parent: int) -> None:
        above = up[parent]
        if left[parent] == child:
            x = left[parent] = right[child]
            right[child] = parent
        else:
            x = right[parent] = left[child]
            left[child] = parent
        if x:
            up[x] = parent
        up[parent], up[child] = child, above
        if above and left[above] == parent:
            left[above] = child
        elif above and right[above] == parent:
            right[above] = child
        else:
            seen[child] = seen[parent]

    for end, state in enumerate(ends, 1):
        below, v = 0, state
        while v:
            # v is splayed to the root of its path's tree
            while (p := up[v]) and (left[p] == v or right[p] == v):
                g = up[p]
                if g and left[g] == p:
                    rotate(p, g) if left[p] == v else rotate(v, p)
                elif g and right[g] == p:
                    rotate(p, g) if right[p] == v else rotate(v, p)
                rotate(v, up[v])
            before = seen[v]
            if before and end - before <= length[v]:
                yield end, before, length[v]
            if right[v]:
                seen[right[v]] = before
            right[v] = below
            below, v = v, up[v]
        seen[below] = end


def runs(words: list[int], shortest: int = LENGTH, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of the maximal runs of words, in order of start and period."""
    found, open_runs = [], {}

    def close(period: int, start: int, end: int) -> None:
        if end - start >= max(shortest, times * period):
            found.append((start, end - start, period))

    for end, before, common in squares(*automaton(words)):
        period = end - before
        start, until = open_runs.get(period, (0, -1))
        if until != end - 1:
            if until > 0:
                close(period, start, until)
            start = before - common
        open_runs[period] = (start, end)
    for period, (start, end) in open_runs.items():
        close(period, start, end)
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(words: np.ndarray, sizes: np.ndarray, shortest: int = LENGTH, times: int = TIMES) -> list[tuple[int, int]]:
    """(start, end) of the stretches of words in which alone there can be runs; sizes: the words of each text.

    Pairs are counted by hash, so that some may seem more frequent than they are: that cuts less, never too much.
    """
    last = np.zeros(len(words), dtype=bool)
    last[np.cumsum(sizes)[sizes > 0] - 1] = True
    pairs = np.flatnonzero(~last)
    words = words.astype(np.uint64)
    while len(pairs):
        new = np.diff(pairs, prepend=-2) != 1
        piece = np.cumsum(new) - 1
        long_enough = np.bincount(piece) >= shortest - 1
        bits = np.uint64(64 - max(8, int(4 * len(pairs)).bit_length()))
        with np.errstate(over="ignore"):
            key = mix64(words[pairs] * np.uint64(0x9E3779B97F4A7C15) + words[pairs + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + piece.astype(np.uint64)) >> bits
        key = key.astype(np.int64)
        kept = long_enough[piece] & (np.bincount(key)[key] >= times - 1)
        if kept.all():
            starts = np.flatnonzero(new)
            return list(zip(pairs[starts].tolist(), (pairs[np.append(starts[1:], len(pairs)) - 1] + 2).tolist()))
        pairs = pairs[kept]
    return []


def periodic(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = LENGTH, times: int = TIMES) -> DataFrame:
    """(doc_id, runs array<struct<start, length, period>>, collapsed) for each row of docs.

    Words are runs of characters other than blank, tab, line feed, vertical tab, form feed, carriage return, numbered from 0. A run is a stretch with a
    smallest period that no neighbouring word extends, of shortest words and times periods or more; runs are in order of start and
    period. collapsed: the words, joined by one blank, without those that stand in a run after its first period.
    Null and empty texts have no runs and collapse to the empty string. Rows that repeat, or have no id, keep a row each. A text is
    one task's work, whatever its length (about 64 bytes a word of its repetitive stretches). Other columns, whatever their
    names, are not looked at. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids,), texts in slabs(batches, ["doc_id", "text"], "text"):
            split = [t.split() for t in texts]
            sizes = np.array([len(w) for w in split])
            flat = pa.array([w for ws in split for w in ws], pa.binary()).dictionary_encode().indices.to_numpy()
            first = np.cumsum(sizes) - sizes
            found: dict[int, list] = {}
            for start, end in stretches(flat, sizes, shortest, times):
                of = int(np.searchsorted(first, start, "right")) - 1
                found.setdefault(of, []).extend((start - int(first[of]) + s, n, p) for s, n, p in runs(flat[start:end].tolist(), shortest, times))
            collapsed = []
            for i, words in enumerate(split):
                if i in found:
                    gone = np.zeros(len(words), dtype=bool)
                    for s, n, p in found[i]:
                        gone[s + p : s + n] = True
                    words = [w for w, g in zip(words, gone) if not g]
                collapsed.append(b" ".join(words))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            listed = [[{"start": s, "length": n, "period": p} for s, n, p in found.get(i, [])] for i in range(len(ids))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(listed, kind), pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def repeated(text: Column, doc_id: Column) -> Column:
    """The text whose words repeat from a place on with a period, both made from crc32 of the id, for one id in ten; else the text."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size(words)
    at = (g % n).cast("int")
    period = (1 + F.floor((n - at) / (3 + g % 8))).cast("int")
    unit = F.slice(words, at + 1, period)
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil((n - at) / period).cast("int"))), F.lit(1), n - at)
    return F.when((h % 10 == 0) & (n > 0), F.concat_ws(" ", F.slice(words, F.lit(1), at), tail)).otherwise(text)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = periodic(docs.select("doc_id", repeated(F.col("text"), F.col("doc_id")).alias("text")))
    longer = lambda best, r: best["start"].isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    nothing = F.expr("CAST(NULL AS STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>)")
    best = F.aggregate("runs", nothing, lambda best, r: F.when(longer(best, r), r).otherwise(best))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), "collapsed").select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("best.length * 1000 DIV best.period").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
