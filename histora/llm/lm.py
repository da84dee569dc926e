"""Language-model scores from a probabilistic suffix tree over words.

Words are counted over all training texts. The tree grows level by level: a context is a candidate if its share of
all positions is at least P_MIN, and it is kept, with its suffixes, if its next-symbol distribution diverges from
that of its suffix. A symbol is one of the frequent words, the end, or the class of all other words, within which
probability is shared as at the root. Distributions are smoothed by discounting towards the suffix, down to the
root, which is the base distribution. A position is scored in its longest kept state.

Shares bound what is broadcast whatever the size of the corpus: below 1/WORD words, 1/P_MIN states a level and
1/JOINT entries a level. Counts of all other words stay in tables.

Below these short states the tree has long ones, kept by their counts and not by shares, so that they grow with the
corpus; they are counted by ranges of anchors from sorted lists of hashes (64 bits: 40 of the anchor, 24 of its run). CONTEXT words in a row are an anchor if their hash says so, which about one in EVERY does. An anchor
is a context whose next symbol is the whole run of words up to the next anchor, or to the end. By default EVERY is 1:
all positions are anchors, and the run is the next word alone. A run that training
texts hold twice behind its anchor is an entry; an anchor with entries is kept as a state if its distribution diverges
from what the short states say of the same words. Runs that aren't entries share what discounting takes off.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, settled, slabs, table, whole_groups

#: Least shares of a word that is looked up in memory, of a symbol, of a context, and of a context with its next symbol.
WORD, SYMBOL, P_MIN, JOINT = 1e-6, 5e-5, 5e-4, 2e-7
DEPTH = 3
#: Least divergence in nats of a context from its suffix, and what is taken off each count for what isn't counted.
DIVERGENCE, DISCOUNT = 0.01, 0.75
ALPHA = 0.1
#: Words of an anchor (more than DEPTH, so that short states of the run behind it don't depend on what is before it), how
#: many positions have one anchor (every position that has CONTEXT words before it), and the least count of a run.
CONTEXT, EVERY, TWICE = 4, 1, 2
#: Positions of a bucket of texts and of a range of anchors, how many of these are worked on at a time, and the bits of a
#: key that tell runs of an anchor apart.
MOST, SLICE, _RUN = 1_000_000, 1 << 17, np.uint64((1 << 24) - 1)
#: The end; no word holds a blank.
END = b" end"


def _with_sides(docs: DataFrame, key: str, text: str) -> DataFrame:
    held = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 10 == 0
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), held.alias("held_out"))


def word_counts(texts: DataFrame, most: int = 300_000) -> DataFrame:
    """(word, n) over (text); the end counts as a word. Tasks send sums, and begin anew with a new sum beyond most words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return batch

        for _, some in slabs(batches, ["text"], "text"):
            for t in some:
                seen.update(t.lower().split())
            seen[END] += len(some)
            if len(seen) > most:
                yield out()
        if seen:
            yield out()

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Tree:
    """Frequent words with their base probabilities, and levels of states.

    A level maps (suffix state, one word earlier) to a state; symbol k is the k-th most frequent word, the last
    symbol is the class of all others.
    """

    def __init__(self, words: list[tuple[bytes, int]], total: int, distinct: int):
        self.total, self.distinct = total, distinct
        self.at = {w: i for i, (w, _) in enumerate(words)}
        self.counts = counts = np.array([n for _, n in words], dtype=float)
        p = (counts + ALPHA) / self.norm
        self.log_base = np.log10(p)
        self.other = int((counts >= max(2, SYMBOL * total)).sum())
        self.end = self.at[END]
        if self.end >= self.other:
            self.other = self.end + 1
        self.root = np.append(p[: self.other], max(1e-300, 1 - p[: self.other].sum()))
        self.symbols = self.other + 1
        self.states: list[np.ndarray] = []
        self.entries: list[tuple[np.ndarray, np.ndarray]] = []
        self.rest: list[np.ndarray] = []

    @property
    def norm(self) -> float:
        return self.total + ALPHA * (self.distinct + 1)

    def flat(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
        """Indices of the words of texts, each followed by the end; -1 for words not in memory; the lengths; those words."""
        get, out, sizes, unknown = self.at.get, [], [], []
        for t in texts:
            words = t.lower().split()
            ids = [get(w, -1) for w in words]
            unknown.append([w for w, i in zip(words, ids) if i < 0])
            out += ids
            out.append(self.end)
            sizes.append(len(ids) + 1)
        return np.array(out, dtype=np.int64), np.array(sizes), unknown

    def walk(self, ids: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Symbols of the positions, and their state at each level, -1 if it has none. A text begins after an end."""
        symbol = np.where((ids < 0) | (ids >= self.other), self.other, ids)
        earlier, state, found = symbol, np.zeros(len(ids), dtype=np.int64), []
        inside = np.ones(len(ids), dtype=bool)
        for level in range(min(depth, len(self.states))):
            if level:  # before an end is another text
                inside &= earlier != self.end
            earlier = np.concatenate([[self.end], earlier[:-1]])
            keys = self.states[level]
            key = state * self.symbols + earlier
            at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
            hit = inside & (state >= 0) & (keys[at] == key) if len(keys) else np.zeros(len(ids), dtype=bool)
            state = np.where(hit, at, -1)
            found.append(state)
        return symbol, found

    def probabilities(self, ids: np.ndarray) -> np.ndarray:
        """Of each position's symbol in its longest state."""
        symbol, found = self.walk(ids, len(self.states))
        p = self.root[symbol]
        for state, (keys, values), rest in zip(found, self.entries, self.rest):
            here = np.flatnonzero(state >= 0)
            if not len(here):
                continue
            key = state[here] * self.symbols + symbol[here]
            at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
            own = np.where(keys[at] == key, values[at], 0.0) if len(keys) else 0.0
            p[here] = own + rest[state[here]] * p[here]
        return p


def _transitions(texts: DataFrame, tree: Tree, most: int = 2_000_000) -> DataFrame:
    """(state, symbol, n): how often each symbol follows each state of the last level in the training texts of encoded ones."""
    shared, depth, symbols = texts.sparkSession.sparkContext.broadcast(tree), len(tree.states), tree.symbols

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def merged(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            unique, where = np.unique(key, return_inverse=True)
            return unique, np.bincount(where, n, minlength=len(unique)).astype(np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys // symbols), pa.array(keys % symbols), pa.array(counts)], ["state", "symbol", "n"])

        for held, sizes, value in (row.values() for batch in batches for row in batch.select(["held_out", "sizes", "ids"]).to_pylist()):
            symbol, found = shared.value.walk(_array(value, np.int32).astype(np.int64), depth)
            here = (found[-1] >= 0) & ~np.repeat(held, sizes)
            new, n = np.unique(found[-1][here] * symbols + symbol[here], return_counts=True)
            keys, counts = merged(np.concatenate([keys, new]), np.concatenate([counts, n]))
            if len(keys) > most:
                yield out()
                keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield out()

    return texts.mapInArrow(run, "state long, symbol long, n long").groupBy("state", "symbol").agg(F.sum("n").alias("n"))


def fit(texts: DataFrame, counts: DataFrame, depth: int = DEPTH) -> Tree | None:
    """The tree of (text), whose word counts are given; None without texts."""
    tree = root(counts)
    if tree is not None:
        rows = texts.select(F.lit(0).cast("long").alias("doc_id"), F.lit(False).alias("held_out"), "text")
        grow(tree, settled(encoded(rows, texts.sparkSession.sparkContext.broadcast(tree)), "encoded"), depth)
    return tree


def root(counts: DataFrame) -> Tree | None:
    """The tree without levels; None without words."""
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    if not total:
        return None
    common = counts.where((F.col("n") >= max(2, WORD * total)) | (F.col("word") == F.lit(END)))
    words = sorted(((bytes(w), n) for w, n in common.select("word", "n").collect()), key=lambda x: (-x[1], x[0]))
    return Tree(words, total, distinct)


def grow(tree: Tree, texts: DataFrame, depth: int = DEPTH) -> None:
    """Adds the levels that the training texts of encoded ones give."""
    total = tree.total
    least = max(2.0, P_MIN * total)
    # level 1: every frequent symbol but the class of others
    level = np.flatnonzero(tree.counts[: tree.other] >= least)
    parents: list[np.ndarray] = []
    distributions = [{0: tree.root}]
    kept: list[set[int]] = []
    for k in range(depth):
        if not len(level):
            break
        tree.states.append(np.sort(level))
        keys = tree.states[-1]
        parents.append(keys // tree.symbols)
        after = settled(_transitions(texts, tree), "transitions")
        n_state = np.zeros(len(keys))
        for state, n in after.groupBy("state").agg(F.sum("n")).collect():
            n_state[state] = n
        found = after.where(F.col("n") >= max(2.0, JOINT * total)).toPandas().sort_values(["state", "symbol"])
        now, keep, values = {}, set(), np.zeros(len(found))
        states, symbols, ns = (found[c].to_numpy() for c in ("state", "symbol", "n"))
        cut = np.searchsorted(states, np.arange(len(keys) + 1))
        rest = np.ones(len(keys))
        for s in range(len(keys)):
            a, b = cut[s], cut[s + 1]
            if a == b:
                continue
            up = distributions[-1].get(int(parents[-1][s]) if k else 0)
            if up is None:
                continue
            own = (ns[a:b] - DISCOUNT) / n_state[s]
            rest[s] = 1 - own.sum()
            p = rest[s] * up
            p[symbols[a:b]] += own
            values[a:b] = own
            now[s] = p
            divergence = (p * np.log(p / up)).sum()
            # chance alone makes about half as much for each symbol seen
            if divergence >= DIVERGENCE and n_state[s] * divergence >= b - a:
                keep.add(s)
        tree.entries.append((states * tree.symbols + symbols, values))
        tree.rest.append(rest)
        distributions.append(now)
        kept.append(keep)
        # a longer context: state s followed by x, seen often, where the suffix of s followed by x is a state as well
        level = _longer(tree, k, states, symbols, ns, least)
    # suffixes of what is kept are kept
    for k in range(len(kept) - 1, 0, -1):
        kept[k - 1] |= {int(parents[k][s]) for s in kept[k]}
    for k, keep in enumerate(kept):
        drop = np.ones(len(tree.rest[k]), dtype=bool)
        drop[list(keep)] = False
        tree.rest[k][drop] = 1.0
        keys, values = tree.entries[k]
        stays = ~drop[keys // tree.symbols]
        tree.entries[k] = (keys[stays], values[stays])


def _longer(tree: Tree, k: int, states: np.ndarray, symbols: np.ndarray, ns: np.ndarray, least: float) -> np.ndarray:
    """Keys of the candidates of level k + 1: word sequences of a state of level k and a symbol."""

    def words_of(level: int, s: int) -> list[int]:
        """Newest first."""
        out = []
        while level >= 0:
            key = int(tree.states[level][s])
            out.append(key % tree.symbols)
            s, level = key // tree.symbols, level - 1
        return out[::-1]

    often = np.flatnonzero((ns >= least) & (symbols != tree.other) & (symbols != tree.end))
    found = []
    for i in often:
        newest_first = [int(symbols[i]), *words_of(k, int(states[i]))]
        state = 0
        for level, w in enumerate(newest_first[:-1]):
            key, keys = state * tree.symbols + w, tree.states[level]
            at = int(np.searchsorted(keys, key))
            if at == len(keys) or keys[at] != key:
                break
            state = at
        else:
            found.append(state * tree.symbols + newest_first[-1])
    return np.array(sorted(found), dtype=np.int64)


def runs(ids: np.ndarray, sizes: np.ndarray, unknown: list[list[bytes]], every: int = EVERY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts one behind the other: positions of the anchors, each position's run (that of which anchor, -1 if before
    its text's first), the anchors' hashes, and hashes of each with its run. ids, sizes and unknown are Tree.flat's.
    """
    with np.errstate(over="ignore"):
        word = mix64(ids.astype(np.uint64) + np.uint64(2))
        word[ids < 0] = np.array([xxhash.xxh3_64_intdigest(w) for some in unknown for w in some], dtype=np.uint64)
        context = word.copy()
        for back in range(1, CONTEXT):
            context[back:] += mix64(word[:-back] + np.uint64(back))
        context = mix64(context)
        starts = np.cumsum(sizes) - sizes
        place = np.arange(len(ids)) - np.repeat(starts, sizes)
        inside = (place >= CONTEXT - 1) & (place < np.repeat(sizes, sizes) - 1)
        at = np.flatnonzero(inside & (context % np.uint64(every) == 0))
        run = np.searchsorted(at, np.arange(len(ids))) - 1
        if not len(at):
            return at, run, context[:0], context[:0]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        run[owner != owner[at[run]]] = -1
        value = np.where(run >= 0, mix64(word + mix64((np.arange(len(ids)) - at[run]).astype(np.uint64))), np.uint64(0))
        return at, run, context[at], mix64(mix64(context[at]) + np.add.reduceat(value, at + 1))


def _planes(x: np.ndarray) -> bytes:
    """An array byte by byte, compressed."""
    return zstandard.compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), 1)


def _array(value: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(value), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind)[:, 0]


def encoded(rows: DataFrame, shared, most: int = MOST) -> DataFrame:
    """(bucket, doc_id, held_out, sizes, ids, unknown): about most positions of neighbouring texts a row, as Tree.flat has them."""
    names = ["bucket", "doc_id", "held_out", "sizes", "ids", "unknown"]
    types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = TaskContext.get().partitionId() << 20
        docs: list[tuple] = []
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            ids, sizes, words = zip(*held)
            row = [bucket, *(list(c) for c in zip(*docs)), np.concatenate(sizes).tolist(), _planes(np.concatenate(ids).astype(np.int32)), zstandard.compress(b" ".join(w for w in words if w), 1)]
            held.clear()
            docs.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names)

        size = 0
        for own, texts in slabs(batches, ["doc_id", "held_out", "text"], "text"):
            ids, sizes, unknown = shared.value.flat(texts)
            docs += zip(*own)
            held.append((ids, sizes, b" ".join(w for some in unknown for w in some)))
            size += len(ids)
            if size >= most:
                yield out()
                bucket, size = bucket + 1, 0
        if size:
            yield out()

    return rows.mapInArrow(run, "bucket long, doc_id array<long>, held_out array<boolean>, sizes array<int>, ids binary, unknown binary")


class Bucket:
    """The texts of a row of encoded: their log10 probabilities at the root and in short states, and their runs.

    Whole texts, about SLICE positions at a time, are walked and hashed, so that only what is kept has a bucket's length.
    """

    def __init__(self, tree: Tree, sizes: list[int], ids: bytes, unknown: bytes, every: int):
        self.ids, self.sizes = _array(ids, np.int32), np.array(sizes, dtype=np.int64)
        self.words = zstandard.decompress(unknown).split()
        ends = np.cumsum(self.sizes)
        self.starts = ends - self.sizes
        self.base, self.p = np.empty(len(self.sizes)), np.empty(len(self.sizes))
        self.run = np.empty(len(self.ids), dtype=np.int32)
        owners, lps, keys, words, anchors = [], [], [], 0, 0
        texts = np.flatnonzero(np.append(True, self.starts[1:] // SLICE != self.starts[:-1] // SLICE)).tolist()
        for i, j in zip(texts, [*texts[1:], len(self.sizes)]):
            a, b = int(self.starts[i]), int(ends[j - 1])
            some = self.ids[a:b].astype(np.int64)
            base = np.where(some >= 0, tree.log_base[some], 0.0)
            # a word of the class of others: its share of the class is that at the root
            other = (some < 0) | (some >= tree.other)
            p = np.log10(tree.probabilities(some)) + np.where(other, base - np.log10(tree.root[tree.other]), 0.0)
            missing = int((some < 0).sum())
            at, run, anchor, key = runs(some, self.sizes[i:j], [self.words[words : words + missing]], every)
            lps.append(np.add.reduceat(np.where(run >= 0, p, 0.0), at + 1) if len(at) else np.zeros(0))
            starts = self.starts[i:j] - a
            self.base[i:j], self.p[i:j] = np.add.reduceat(base, starts), np.add.reduceat(p, starts)
            self.run[a:b] = np.where(run >= 0, run + anchors, -1)
            owners.append((np.searchsorted(starts, at, side="right") - 1 + i).astype(np.int32))
            keys.append(anchor & ~_RUN | key & _RUN)
            words, anchors = words + missing, anchors + len(at)
        #: Of each run: which text it is in, and its probability in short states.
        self.owner, self.lp = np.concatenate(owners), np.concatenate(lps)
        #: Each different pair of an anchor and its run, in order, where one is, and which of them each run is.
        key = np.concatenate(keys)
        del keys, owners, lps
        order = np.argsort(key, kind="stable").astype(np.int32)
        self.keys = key[order]
        new = np.append(True, self.keys[1:] != self.keys[:-1])[: len(key)]
        self.keys, self.one, self.which = self.keys[new], order[new], np.empty(len(key), dtype=np.int32)
        self.which[order] = np.cumsum(new, dtype=np.int32) - 1


def _cuts(keys: np.ndarray, parts: int) -> list[int]:
    """Where each of parts equal ranges of anchors begins in sorted keys, and their end."""
    bounds = np.array([-(-(i << 40) // parts) << 24 for i in range(parts)], dtype=np.uint64)
    return [*np.searchsorted(keys, bounds).tolist(), len(keys)]


def kept_runs(key: np.ndarray, n: np.ndarray, lp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (key, count in training texts, log10 probability in short states): whether the anchor is kept as a state;
    three numbers of it (count, and number and counts of its entries); and the row's own count, 0 if it isn't an entry.

    Words that aren't in memory are left out of lp; with them it would be smaller still, so the divergence is a lower bound.
    """
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    first = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
    unique, n_k, lp_k = sorted_[first], np.add.reduceat(n[order], first), np.maximum.reduceat(lp[order], first)
    anchor = unique >> np.uint64(24)
    start = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    of = np.cumsum(np.bincount(start, minlength=len(unique))) - 1
    entry = n_k >= TWICE
    n_k = np.where(entry, n_k, 0)
    n_a = np.add.reduceat(n[order], first[start])
    kinds, seen = np.add.reduceat(entry, start, dtype=np.int64), np.add.reduceat(n_k, start)
    rest = 1 - (seen - DISCOUNT * kinds) / np.maximum(n_a, 1)
    p = (n_k - DISCOUNT) / np.maximum(n_a, 1)[of] + rest[of] * 10.0**lp_k
    d = np.add.reduceat(np.where(entry, p * (np.log(np.where(entry, p, 1.0)) - lp_k * np.log(10)), 0.0), start) + rest * np.log(rest)
    kept = (kinds > 0) & (d >= DIVERGENCE) & (n_a * d >= kinds)
    back = np.empty(len(key), dtype=np.int64)
    back[order] = np.repeat(np.arange(len(unique)), np.diff(np.append(first, len(key))))
    own = of[back]
    return kept[own], np.stack([n_a, kinds, seen])[:, own], n_k[back]


def kept_of_range(key: np.ndarray, n: np.ndarray, lp: np.ndarray, some: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """kept_runs of a range of anchors, with its four numbers together, over whole anchors of about some rows at a time."""
    kept, numbers = np.zeros(len(key), dtype=bool), np.zeros((4, len(key)), dtype=np.uint32)
    order = np.argsort(key, kind="stable")
    anchor = key[order] >> np.uint64(24)
    cuts = np.unique(np.append(np.searchsorted(anchor, anchor[:: some or SLICE]), len(key))).tolist()
    for a, b in zip(cuts[:-1], cuts[1:]):
        at = order[a:b]
        kept[at], numbers[:3, at], numbers[3, at] = kept_runs(key[at], n[at].astype(np.int64), lp[at].astype(float))
    return kept, numbers


def long_states(texts: DataFrame, shared, parts: int, every: int) -> DataFrame:
    """(bucket, part, kept, numbers): which keys of a bucket have an anchor that is kept as a state, and their counts.

    Each bucket sends its keys, sorted and compressed, with their counts in its training texts, to where each range of
    anchors is counted, and gets back what is known of each of them: no position goes as a row, and none is left out.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                number, held, *rest = (batch.column(c)[row].as_py() for c in ("bucket", "held_out", "sizes", "ids", "unknown"))
                b = Bucket(shared.value, *rest, every)
                n = np.bincount(b.which, ~np.array(held)[b.owner], minlength=len(b.keys)).astype(np.uint32)
                lp, cuts = b.lp[b.one].astype(np.float16), _cuts(b.keys, parts)
                some = [i for i in range(parts) if cuts[i] < cuts[i + 1]]
                columns = [[f(x[cuts[i] : cuts[i + 1]]) for i in some] for f, x in ((lambda x: _planes(np.diff(x, prepend=np.uint64(0))), b.keys), (_planes, n), (_planes, lp))]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([number] * len(some), pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], ["part", "bucket", "keys", "n", "lp"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in whole_groups(batches, ["part"], 1):
            part, columns = np.asarray(some["part"]), [some[c].to_pylist() for c in ("bucket", "keys", "n", "lp")]
            for i in np.unique(part):
                own = np.flatnonzero(part == i)
                bucket, keys, n, lp = ([c[x] for x in own] for c in columns)
                keys = [np.cumsum(_array(x, np.uint64), dtype=np.uint64) for x in keys]
                cuts = np.cumsum([0, *map(len, keys)])
                kept, numbers = kept_of_range(np.concatenate(keys), np.concatenate([_array(x, np.uint32) for x in n]), np.concatenate([_array(x, np.float16) for x in lp]))
                rows = []
                for b, x, y in zip(bucket, cuts[:-1], cuts[1:]):
                    here = kept[x:y]
                    if here.any():
                        rows.append((b, int(i), _planes(np.packbits(here)), _planes(numbers[:, x:y][:, here].reshape(-1))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["bucket", "part", "kept", "numbers"])

    sent = texts.mapInArrow(send, "part long, bucket long, keys binary, n binary, lp binary")
    return sent.repartition("part").sortWithinPartitions("part").mapInArrow(count, "bucket long, part long, kept binary, numbers binary")


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = DEPTH, every: int = EVERY) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row.

    Rows whose crc32(id) is divisible by 10 are held out (a null id counts as the empty string); the others train the
    model. Null texts count as empty: their one token is the end. Repeated rows keep a row each and count each in
    training. Very long texts are scored whole. Words that are equally frequent are ordered by their bytes. Other columns,
    whatever their names, are not looked at. An empty table gives an empty result; without training rows everything has the score 0.
    """
    spark = docs.sparkSession
    rows = _with_sides(docs, key, text)
    train = rows.where("NOT held_out").select("text")
    counts = settled(word_counts(train), "words")
    tree = root(counts)
    if tree is None:
        words = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))) + 1
        zero, none = F.lit(0.0), F.lit(0).cast("long")
        return rows.select("doc_id", "held_out", words.cast("long").alias("n_tokens"), none.alias("n_known"), none.alias("train_tokens"), zero.alias("base_score"), zero.alias("score"))
    texts = settled(encoded(rows, spark.sparkContext.broadcast(tree)), "encoded")
    grow(tree, texts, depth)
    shared = spark.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, known = shared.value, {}
        for batch in batches:
            for row in range(batch.num_rows):
                bucket, part = batch.column("bucket")[row].as_py(), batch.column("part")[row].as_py()
                if part < parts:  # what is known of the keys of a bucket comes before its texts
                    known[part] = _array(batch.column("kept")[row].as_py(), np.uint8), _array(batch.column("numbers")[row].as_py(), np.uint32)
                    continue
                doc, held, *rest = (batch.column(c)[row].as_py() for c in ("doc_id", "held_out", "sizes", "ids", "unknown"))
                yield scored(bucket, doc, held, Bucket(tree, *rest, every), known)
                known = {}

    def scored(bucket: int, doc: list, held: list, b: Bucket, known: dict) -> pa.RecordBatch:
        cuts = _cuts(b.keys, parts)
        rest, own = np.ones(len(b.keys)), np.zeros(len(b.keys))
        for i, (bits, numbers) in known.items():
            here = cuts[i] + np.flatnonzero(np.unpackbits(bits, count=cuts[i + 1] - cuts[i]))
            n_a, kinds, seen, n = numbers.reshape(4, -1).astype(float)
            rest[here] = 1 - (seen - DISCOUNT * kinds) / n_a
            own[here] = np.where(n > 0, (n - DISCOUNT) / n_a, 0.0)
        rest, own = rest[b.which], own[b.which]
        missing = np.flatnonzero(b.ids < 0)
        # runs that are entries and hold words that aren't in memory wait until these are known
        waits = np.zeros(len(b.owner) + 1, dtype=bool)
        waits[b.run[missing]] = True
        waits = waits[:-1] & (own > 0)
        better = np.where(waits, 0.0, np.log10(own + rest * 10.0**b.lp) - b.lp)
        # what isn't an entry: its probability in short states may be below the least double
        better = np.where(~waits & (own == 0), np.log10(rest), better)
        first = np.searchsorted(b.owner, np.arange(len(b.sizes)))
        owner = np.searchsorted(b.starts, missing, side="right") - 1
        of = b.run[missing]
        number = np.where((of >= 0) & np.append(waits, False)[of], of - first[owner], -1) if len(b.owner) else np.full(len(missing), -1)
        number, cut, counted = number.tolist(), np.searchsorted(owner, np.arange(len(b.sizes) + 1)).tolist(), []
        for x, y in zip(cut[:-1], cut[1:]):
            counted.append(Counter(zip(number[x:y], b.words[x:y])))
        late = np.flatnonzero(waits)
        offsets = pa.array(np.searchsorted(b.owner[late], np.arange(len(b.sizes) + 1)), pa.int32())
        lists = lambda x, t: pa.ListArray.from_arrays(offsets, pa.array(x, t))
        p = b.p + np.bincount(b.owner, better, minlength=len(b.sizes))
        columns = [
            pa.array((bucket << 24) + np.arange(len(b.sizes))), pa.array(doc, pa.int64()), pa.array(held, pa.bool_()), pa.array(b.sizes),
            pa.array(np.add.reduceat(b.ids >= 0, b.starts, dtype=np.int64)), pa.array(b.base), pa.array(p),
            pa.array([[w for _, w in c] for c in counted], pa.list_(pa.binary())), pa.array([[r for r, _ in c] for c in counted], pa.list_(pa.int32())),
            pa.array([list(c.values()) for c in counted], pa.list_(pa.int32())),
            lists(late - first[b.owner[late]], pa.int32()), *(lists(x[late], pa.float64()) for x in (b.lp, rest, own)),
        ]
        return pa.RecordBatch.from_arrays(columns, ["uid", "doc_id", "held_out", "n_tokens", "known", "base", "p", "word", "run", "times", "late", "lp", "rest", "own"])

    parts = max(1, tree.total // MOST)
    states = settled(long_states(texts, shared, parts, every), "long_states")
    none = {c: F.lit(None).cast("binary").alias(c) for c in ("kept", "numbers")}
    both = texts.select("*", F.lit(parts).cast("long").alias("part"), *none.values()).unionByName(states, allowMissingColumns=True)
    both = both.repartition("bucket").sortWithinPartitions("bucket", "part")
    schema = "uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, p double, word array<binary>, run array<int>, times array<int>, late array<int>, lp array<double>, rest array<double>, own array<double>"
    part = settled(both.mapInArrow(run, schema), "parts")
    rare = part.select("uid", F.inline(F.arrays_zip("word", "run", "times"))).join(counts, "word", "left")
    n = F.coalesce("n", F.lit(0))
    more = rare.groupBy("uid", "run").agg(F.sum(F.log10((n + ALPHA) / tree.norm) * F.col("times")).alias("more"), F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("more_known"))
    more = settled(more, "more")
    late = part.select("uid", F.inline(F.arrays_zip(F.col("late").alias("run"), "lp", "rest", "own"))).join(more, ["uid", "run"])
    short = F.col("lp") + F.col("more")
    here = F.log10(F.col("own") + F.col("rest") * F.pow(F.lit(10.0), short)) - short
    zero = F.lit(0).cast("long")
    sums = more.select("uid", "more", F.lit(0.0).alias("better"), "more_known").unionAll(late.select("uid", F.lit(0.0), here, zero))
    sums = sums.groupBy("uid").agg(F.sum("more").alias("more"), F.sum("better").alias("better"), F.sum("more_known").alias("more_known"))
    out = part.select("uid", "doc_id", "held_out", "n_tokens", "known", "base", "p").join(sums, "uid", "left")
    out = out.fillna(0, ["more", "better", "more_known"])
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.col("more_known")).alias("n_known"), F.lit(tree.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("more")).alias("base_score"), (F.col("p") + F.col("more") + F.col("better")).alias("score"),
    )


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    gain = (F.col("score") - F.col("base_score")) / F.col("n_tokens")
    return scores(table(spark, sf_dir, "documents")).withColumn("gain", gain)
