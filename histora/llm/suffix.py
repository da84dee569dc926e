"""Removal of repeated strings by suffix arrays built with the difference-cover algorithm.

Which byte strings of LENGTH bytes start earlier as well is found in three steps.

1. Each window of LENGTH bytes is given to its anchor: the leftmost of its K-byte strings with the least hash. Equal
   windows have equal anchors, so all windows of an anchor can be settled apart from all others. An anchor's windows
   are neighbours; they and their text make a chunk. Anchors that occur once settle nothing and go.
2. Of equal chunks all but the first are repeated as a whole. They are taken out before the shuffle in each task and
   after it, so a passage that very many documents share is not gathered in one task. Chunks are equal if the 64-bit
   hashes of their anchors, and 64-bit hashes of the whole chunks with the place of the anchor, are: bytes aren't compared here.
3. Anchors with chunks that differ are dealt over tasks, and each task builds suffix arrays of its chunks, some anchors at
   a time: sampled triples are sorted and named, names are sorted by recursion, the other suffixes are merged in. Windows
   that are neighbours in the array and have the same LENGTH bytes are equal; all but the earliest are repeated. The chunks of
   an anchor that has very many, as among near copies, are cut into windows, and these are dealt by their own hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT, mix64, slabs, table, whole_groups, written

LENGTH, K = 100, 32
#: About how many bytes of chunks one suffix array holds; an anchor with more has an array of its own.
ARRAY = 1 << 19
#: An anchor with more chunks than this, and more than one in HOT of all, is cut into windows.
MANY = 256
#: Rows that are looked at together.
MOST = 1_000_000
_B = np.uint64(0x9E3779B97F4A7C55)
_LETTERS = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


# ---------------------------------------------------------------- difference cover


def packed_keys(*columns: np.ndarray) -> np.ndarray:
    """One number for each row of columns (non-negative), in the rows' order: side by side in 63 bits, or dense ranks."""
    bits = [max(1, int(c.max()).bit_length()) if len(c) else 1 for c in columns]
    if sum(bits) <= 63:
        key = columns[0]
        for c, b in zip(columns[1:], bits[1:]):
            key = (key << b) | c
        return key
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), dtype=np.int64)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def dense(key: np.ndarray, table: int = 1 << 22) -> np.ndarray:
    """The dense rank of each number: by counting if all are below table, else by sorting."""
    if not len(key):
        return key
    if (top := int(key.max())) < table:
        there = np.zeros(top + 1, dtype=np.int64)
        there[key] = 1
        return (np.cumsum(there) - 1)[key]
    order = np.argsort(key)
    sorted_ = key[order]
    out = np.empty(len(key), dtype=np.int64)
    out[order] = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
    return out


def suffix_order(text: np.ndarray, length: int) -> np.ndarray:
    """Starts of the suffixes of text (positive numbers), in the order of their first length symbols at least."""
    return np.argsort(suffix_ranks(text, length), kind="stable")


def suffix_ranks(s: np.ndarray, length: float) -> np.ndarray:
    """For each suffix, how many are less. Suffixes that agree in their first length symbols may count as equal.

    Each recursion makes a symbol of three, so that it ends when all names differ or they span length symbols.
    """
    n = len(s)
    padded = np.concatenate([s, np.zeros(5, dtype=np.int64)])
    if n < 4:
        key = packed_keys(padded[:n], padded[1 : n + 1], padded[2 : n + 2])
        return np.searchsorted(np.sort(key), key)
    zero, one, two = np.arange(0, n, 3), np.arange(1, n + 2, 3), np.arange(2, n + 2, 3)
    sample = np.concatenate([one, two])
    # sort the sampled triples and name them
    names = dense(packed_keys(padded[sample], padded[sample + 1], padded[sample + 2]))
    if length > 3 and names.max() + 1 < len(sample):
        # recurse on the names: those of the first class, an end, those of the second
        deeper = suffix_ranks(np.concatenate([names[: len(one)] + 1, [0], names[len(one) :] + 1]), length / 3)
        less = np.concatenate([deeper[: len(one)], deeper[len(one) + 1 :]]) - 1  # the end itself is less
    else:
        less = np.concatenate([[0], np.cumsum(np.bincount(names))])[names]
    rank = np.zeros(n + 7, dtype=np.int64)
    rank[sample] = less + 1
    # merge the others: each is set against either class by keys that both have
    by_one = packed_keys(np.concatenate([padded[zero], padded[one]]), np.concatenate([rank[zero + 1], rank[one + 1]]))
    by_two = packed_keys(*(np.concatenate([x[zero + i], x[two + i]]) for i, x in enumerate((padded, padded, rank))))
    z = len(zero)
    order = np.argsort(by_one[:z])
    zeros_one, zeros_two = by_one[order], np.sort(by_two[:z])
    ones, twos = np.sort(by_one[z:]), np.sort(by_two[z:])
    out = np.zeros(n + 5, dtype=np.int64)
    # needles in order, so that neighbours look in the same place
    out[zero[order]] = np.searchsorted(zeros_one, zeros_one) + np.searchsorted(ones, zeros_one) + np.searchsorted(twos, by_two[order])
    at = np.argsort(less[: len(one)])
    out[one[at]] = less[at] + np.searchsorted(zeros_one, by_one[z + at])
    at = np.argsort(less[len(one) :])
    out[two[at]] = less[len(one) + at] + np.searchsorted(zeros_two, by_two[z + at])
    beyond = (one >= n).sum() + (two >= n).sum()  # empty suffixes are less than all
    return out[:n] - beyond


def repeated_windows(chunks: list[bytes], doc: np.ndarray, start: np.ndarray, length: int) -> list[np.ndarray]:
    """For each chunk the windows (offsets) that are equal to one with a smaller (doc, start)."""
    sizes = np.array([len(c) for c in chunks])
    text = np.zeros(int(sizes.sum()) + len(chunks) + 8, dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes[:-1] + 1)])
    inside = np.ones(len(text), dtype=bool)
    inside[begin + sizes] = False
    inside[int(sizes.sum()) + len(chunks) :] = False
    data = np.frombuffer(b"".join(chunks), dtype=np.uint8)
    text[inside] = dense(data.astype(np.int64)) + 1
    order = suffix_order(text, length)
    # only whole windows take part
    of = np.repeat(np.arange(len(chunks)), sizes - length + 1)
    within = np.arange(len(of)) - np.repeat(np.concatenate([[0], np.cumsum(sizes - length + 1)[:-1]]), sizes - length + 1)
    which = np.full(len(text), -1, dtype=np.int64)
    which[begin[of] + within] = np.arange(len(of))
    order = order[which[order] >= 0]
    # compare neighbours: eight bytes at a time
    raw = (text % 256).astype(np.uint64)  # should 256 become 0, it is still told from the others
    words = np.zeros(len(text), dtype=np.uint64)
    for i in range(8):
        words[: len(text) - i] |= raw[i:] << np.uint64(8 * i)
    left, right = order[:-1], order[1:]
    equal = np.arange(len(left))
    for i in [*range(0, length - 8, 8), length - 8]:
        equal = equal[words[left[equal] + i] == words[right[equal] + i]]
    new = np.ones(len(order), dtype=bool)
    new[1:][equal] = False
    run = np.cumsum(new) - 1
    w = which[order]
    # windows of a chunk are neighbours, and chunks of a document don't share windows
    by_place = np.lexsort((start, doc))
    windows = (sizes - length + 1)[by_place]
    offset = np.empty(len(chunks), dtype=np.int64)
    offset[by_place] = np.cumsum(windows) - windows
    place = offset[of] + within
    # a document that is there twice has the same place twice
    first = np.full(run[-1] + 1 if len(run) else 0, np.iinfo(np.int64).max)
    np.minimum.at(first, run, place[w])
    earliest = np.empty(len(of), dtype=np.int64)
    earliest[w] = first[run]
    back = np.empty(len(of), dtype=np.int64)
    back[place] = np.arange(len(of))
    e = back[earliest]
    repeated = (doc[of] != doc[of[e]]) | (start[of] + within != start[of[e]] + within[e])
    return np.split(within[repeated], np.searchsorted(of[repeated], np.arange(1, len(chunks))))


# ---------------------------------------------------------------- anchors


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The index of the leftmost least value of each run of width values."""
    at, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        span += step
    return at


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.of[0]) < n:
        inverse = np.uint64(pow(int(_B), -1, 2**64))
        _powers.of = tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, b, dtype=np.uint64), dtype=np.uint64)]) for b in (_B, inverse))
    return _powers.of


_powers.of = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def anchors(texts: list[bytes], length: int, k: int) -> tuple[np.ndarray, ...]:
    """(text, lo, hi, hash of the anchor, hash of the chunk): windows lo..hi of a text have that anchor."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    power, inverse = _powers(n + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(_LETTERS[data] * power[:n], dtype=np.uint64)])
    grams = mix64((total[k:] - total[:-k]) * inverse[: n - k + 1])
    owner = sliding_least(grams, length - k + 1)
    begin = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(texts)), np.maximum(0, sizes - length + 1))
    window = np.arange(len(text)) - np.repeat(np.cumsum(np.maximum(0, sizes - length + 1)) - np.maximum(0, sizes - length + 1), np.maximum(0, sizes - length + 1)) + begin[text]
    anchor = owner[window]
    cut = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])) if len(text) else np.zeros(0, np.int64)
    last = np.concatenate([cut[1:], [len(text)]])[: len(cut)] - 1
    text, lo, hi, at = text[cut], window[cut], window[last], anchor[cut]
    whole = mix64((total[hi + length] - total[lo]) * inverse[lo]) + (hi - lo).astype(np.uint64) * _B + (at - lo).astype(np.uint64)
    return text, lo - begin[text], hi - begin[text], grams[at], mix64(whole)


# ---------------------------------------------------------------- Spark jobs


def numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(n, doc_id, text): n orders documents. Rows that share an id are ordered by a hash of their text, rows without
    an id come first; rows equal in both are one document."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    odd = rows.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL")
    if not odd.limit(1).count():
        return rows.select(F.col("doc_id").alias("n"), "doc_id", "text")
    rows = rows.withColumn("_hash", F.xxhash64("text"))
    names = rows.select("doc_id", "_hash").distinct().orderBy(F.asc_nulls_first("doc_id"), "_hash").rdd.zipWithIndex()
    names = docs.sparkSession.createDataFrame(names.map(lambda x: (x[1], x[0][0], x[0][1])), "n long, _id long, _h long")
    return rows.join(names, rows["doc_id"].eqNullSafe(names["_id"]) & (rows["_hash"] == names["_h"])).select("n", "doc_id", "text")


def _first_of_equal(key: np.ndarray, chunk: np.ndarray, doc: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by (key, chunk, doc, lo), and whether a row in it is the first of its (key, chunk)."""
    order = np.lexsort((lo, doc, chunk, key))
    first = np.ones(len(order), dtype=bool)
    first[1:] = (key[order][1:] != key[order][:-1]) | (chunk[order][1:] != chunk[order][:-1])
    # the same place again is not an earlier one
    again = np.zeros(len(order), dtype=bool)
    again[1:] = ~first[1:] & (doc[order][1:] == doc[order][:-1]) & (lo[order][1:] == lo[order][:-1])
    return order[~again], first[~again]


_COLUMNS = ["key", "chunk", "n", "lo", "hi"]
_SCHEMA = "key long, chunk long, n long, lo long, hi long"


def _batch(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in columns], names)


def _found(rows: DataFrame, length: int, k: int, most: int = 1_000_000) -> DataFrame:
    """(key, chunk, n, lo, hi) of all chunks; key is null for those that an equal chunk of their task precedes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> pa.RecordBatch:
            key, chunk, doc, lo, hi = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order, first = _first_of_equal(key, chunk, doc, lo)
            batch = _batch([x[order] for x in (key, chunk, doc, lo, hi)], _COLUMNS)
            return batch.set_column(0, "key", pa.array(key[order].view(np.int64), mask=~first))

        for (docs,), texts in slabs(batches, ["n", "text"], "text"):
            text, lo, hi, key, chunk = anchors(texts, length, k)
            held.append((key, chunk, np.array(docs, dtype=np.int64)[text], lo, hi))
            if sum(len(h[0]) for h in held) > most:
                yield out()
        if held:
            yield out()

    return rows.select("n", "text").mapInArrow(run, _SCHEMA)


def _sifted(found: DataFrame) -> DataFrame:
    """(key, n, lo, hi, whole): chunks that are repeated as a whole, and first chunks of keys with chunks that differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["key"], MOST):
            sure = np.asarray(rows["key"].is_null())
            key, chunk, doc, lo, hi = (np.asarray(rows[c].fill_null(0)) for c in _COLUMNS)
            s = np.flatnonzero(sure)
            yield _batch([key[s], doc[s], lo[s], hi[s]], ["key", "n", "lo", "hi"]).append_column("whole", pa.array(np.ones(len(s), dtype=bool)))
            key, chunk, doc, lo, hi = (x[~sure] for x in (key, chunk, doc, lo, hi))
            order, first = _first_of_equal(key, chunk, doc, lo)
            key, doc, lo, hi = (x[order] for x in (key, doc, lo, hi))
            start = np.ones(len(key), dtype=bool)
            start[1:] = key[1:] != key[:-1]
            kinds = np.bincount(np.cumsum(start) - 1, first, minlength=1)[np.cumsum(start) - 1] if len(key) else np.zeros(0)
            stays = ~first | (kinds > 1)
            yield _batch([x[stays] for x in (key, doc, lo, hi)], ["key", "n", "lo", "hi"]).append_column("whole", pa.array(~first[stays]))

    dealt = F.coalesce("key", F.xxhash64("n", "lo"))
    return found.repartition(dealt).sortWithinPartitions("key").mapInArrow(run, "key long, n long, lo long, hi long, whole boolean")


def _packed(rows: DataFrame) -> DataFrame:
    """Texts compressed: half of what a shuffle of them would write."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = pa.array([press.compress(t) for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("n"), batch.column("doc_id"), texts], ["n", "doc_id", "text"])

    return rows.select("n", "doc_id", "text").mapInArrow(run, "n long, doc_id long, text binary")


def _windows(text: bytes, key: list[int], lo: list[int], hi: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(key, lo) of the windows of chunks of a text; a window's key is a hash of its anchor and all its bytes."""
    data = np.frombuffer(text, dtype=np.uint8)
    power, inverse = _powers(len(data) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(_LETTERS[data] * power[: len(data)], dtype=np.uint64)])
    sizes = np.array(hi) - np.array(lo) + 1
    at = np.repeat(np.array(lo) - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    return mix64((total[at + LENGTH] - total[at]) * inverse[at] ^ np.repeat(np.array(key, dtype=np.int64).view(np.uint64), sizes)).view(np.int64), at


def _with_text(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, n, lo, hi, bytes): the text of the windows of each chunk; bytes is null where they are repeated for sure.

    spans: (key, n, lo, hi, many). Chunks of anchors that have many are cut into windows with keys of their own, and of
    equal windows in a task only the first is sent on.
    """
    names = ["key", "n", "lo", "hi", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        cut: list[tuple[np.ndarray, ...]] = []
        texts_of: dict[int, bytes] = {}

        def windows() -> pa.RecordBatch:
            key, doc, lo = (np.concatenate(x) for x in zip(*cut))
            order = np.lexsort((lo, doc, key))
            key, doc, lo = key[order], doc[order], lo[order]
            first = np.ones(len(key), dtype=bool)
            first[1:] = key[1:] != key[:-1]
            # a document that is there twice has the same place twice
            own = np.ones(len(key), dtype=bool)
            own[1:] = first[1:] | (doc[1:] != doc[:-1]) | (lo[1:] != lo[:-1])
            key, doc, lo, first = (x[own] for x in (key, doc, lo, first))
            found: list[bytes | None] = []
            last = None
            for n, a, f in zip(doc.tolist(), lo.tolist(), first.tolist()):
                window = texts_of[n][a : a + LENGTH]
                found.append(None if not f and window == last else window)
                last = window if f else last
            cut.clear()
            texts_of.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(x) for x in (key, doc, lo, lo)), pa.array(found, pa.binary())], names)

        for batch in batches:
            key, doc, lo, hi, found = [], [], [], [], []
            for n, text, chunks in zip(*(batch.column(c).to_pylist() for c in ("n", "text", "chunks"))):
                text = press.decompress(text)
                many = [c for c in chunks if c["many"]]
                if many:
                    k, at = _windows(text, *([c[x] for c in many] for x in ("key", "lo", "hi")))
                    cut.append((k, np.full(len(k), n, dtype=np.int64), at))
                    texts_of[n] = text
                    if sum(map(len, texts_of.values())) > 32 << 20 or sum(len(c[0]) for c in cut) > MOST // 4:
                        yield windows()
                for c in chunks:
                    if not c["many"]:
                        key.append(c["key"])
                        doc.append(n)
                        lo.append(c["lo"])
                        hi.append(c["hi"])
                        found.append(text[c["lo"] : c["hi"] + LENGTH])
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (key, doc, lo, hi)), pa.array(found, pa.binary())], names)
        if cut:
            yield windows()

    grouped = spans.groupBy("n").agg(F.collect_list(F.struct("key", "lo", "hi", "many")).alias("chunks"))
    # with all columns of texts, so that the other join reuses this one's shuffle
    joined = grouped.join(texts, "n").select("n", "doc_id", "text", "chunks")
    return joined.mapInArrow(run, "key long, n long, lo long, hi long, bytes binary")


def _settled(chunks: DataFrame) -> DataFrame:
    """(n, lo, hi): windows that start earlier as well, by one suffix array for some anchors at a time."""

    def arrays(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        sure = rows["bytes"].is_null()
        yield from rows.filter(sure).select(["n", "lo", "hi"]).to_batches()
        rows = rows.filter(rows["bytes"].is_valid())
        if not rows.num_rows:
            return
        key, doc, lo = (np.asarray(rows[c]) for c in ("key", "n", "lo"))
        order = np.lexsort((lo, doc, key))
        key, doc, lo, texts = key[order], doc[order], lo[order], rows["bytes"].take(pa.array(order)).to_pylist()
        ends = np.flatnonzero(np.concatenate([key[1:] != key[:-1], [True]])) + 1
        size, start = 0, 0
        begin = 0
        for end in ends:
            size += sum(len(t) for t in texts[begin:end])
            begin = end
            if size >= ARRAY or end == len(key):
                n, a, b = [], [], []
                for i, w in enumerate(repeated_windows(texts[start:end], doc[start:end], lo[start:end], LENGTH), start):
                    if len(w):
                        cut = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1] + 1]))
                        n.append(np.full(len(cut), doc[i]))
                        a.append(lo[i] + w[cut])
                        b.append(lo[i] + w[np.concatenate([cut[1:] - 1, [len(w) - 1]])])
                if n:
                    yield _batch([np.concatenate(x) for x in (n, a, b)], ["n", "lo", "hi"])
                size, start = 0, end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["key"], MOST // 10):
            yield from arrays(rows)

    # rows that are settled go anywhere
    dealt = F.when(F.col("bytes").isNull(), F.xxhash64("n", "lo")).otherwise(F.col("key"))
    return chunks.repartition(dealt).sortWithinPartitions("key").mapInArrow(run, "n long, lo long, hi long")


def spans_of(size: int, starts: list[dict], length: int) -> list[tuple[int, int]]:
    """The maximal runs of bytes that windows starting in lo..hi of each of starts cover."""
    out: list[list[int]] = []
    for a, b in sorted((s["lo"], s["hi"] + length) for s in starts):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, size)) for a, b in out]


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, bytes, spans) for each row: its text as UTF-8 and the byte runs that a string of LENGTH bytes covers
    that also starts earlier: in a smaller doc_id, or further left in the same document.

    Null texts count as empty. Rows that share an id are ordered by a hash of their text, rows without an id come
    first; rows equal in both are one document, and each gets its result. Very long texts are looked at whole, each in the
    memory of one task. Other columns, whatever their names, are not looked at. An empty table gives an empty result.
    """
    rows = numbered(docs, key, text)
    sifted = written(_sifted(_found(rows, LENGTH, K)), "chunks")
    packed = _packed(rows)
    partial = sifted.where("NOT whole").drop("whole")
    # fewer than HOT anchors have more than one in HOT of all chunks
    limit = max(MANY, partial.count() // HOT)
    many = partial.groupBy("key").count().where(F.col("count") > limit).select("key", F.lit(True).alias("many"))
    marked = partial.join(F.broadcast(many), "key", "left").withColumn("many", F.coalesce("many", F.lit(False)))
    partly = _settled(_with_text(marked, packed))
    starts = sifted.where("whole").select("n", "lo", "hi").unionByName(partly)
    grouped = starts.groupBy("n").agg(F.collect_list(F.struct("lo", "hi")).alias("starts"))
    return packed.join(grouped, "n", "left").select("doc_id", "text", "starts")


def _results(found: DataFrame, schema: str, make) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            columns: list[list] = []
            for i, text, starts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "starts"))):
                text = press.decompress(text)
                columns.append(make(i, text, spans_of(len(text), starts or [], LENGTH)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*columns) if columns else [[]] * len(types), types)], names)

    fields = [f.split() for f in schema.split(", ")]
    names = [f[0] for f in fields]
    types = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f[1]] for f in fields]
    return found.mapInArrow(run, schema)


def _kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    return b"".join(text[a:b] for a, b in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(text)]))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kept): what is left of each text, as bytes, since a cut may fall within a character."""
    return _results(removals(docs, key, text), "doc_id long, kept binary", lambda i, t, s: (i, _kept(t, s)))


def digested(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row."""

    def row(i: int, text: bytes, spans: list[tuple[int, int]]) -> tuple:
        return i, len(text), sum(b - a for a, b in spans), len(spans), hashlib.sha256(_kept(text, spans)).hexdigest()

    return _results(removals(docs, key, text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", row)


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(table(spark, sf_dir, "documents"))
