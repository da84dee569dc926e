"""Secrets in texts: spans of fixed patterns, and those that a linear-chain conditional random field adds.

Tokens are runs of letters and digits, or single marks. Each is tagged as a secret's begin, as its inside or as outside. What a tag
scores depends on the token's shape, on the words and marks around it, on whether a blank stands before it, and on
features of the whole text; tags next to each other score together. The field is fitted to what the patterns find in a bounded
sample, also with the telling word replaced, so that shapes and neighbours it has never seen together add up. Decoding is Viterbi's.
Tokens that score so much better outside that no tags around them can make up for it are outside in every best sequence, so only the
stretches between them are decoded: as one sequence, cut into blocks whose best scores between any two tags are found side by side.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slabs, table

# The kinds of spans in their order, and the patterns of the first three.
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
TELLING = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: Other words for the telling one, with which windows of the sample are seen once more.
ALIASES = (b"auth", b"pwd", b"key", b"credential", b"login", b"pass")

#: Rows that are looked at for the fit, about; windows of a text among them; windows with and without spans at most; bytes on either side.
SAMPLE, WINDOWS, MOST, AROUND = 20_000, 2, 2_000, 100
ROUNDS, RATE, PENALTY = 60, 0.25, 0.3
OUT, BEGIN, INSIDE = range(3)

_SPACE, _WORD, _MARK = range(3)
_CLASS = np.full(256, _MARK, dtype=np.uint8)
_CLASS[[32, 9, 10, 11, 12, 13]] = _SPACE
_CLASS[128:] = _WORD
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = _WORD
#: Small letter, capital, digit, other.
_SORT = np.full(256, 3, dtype=np.uint8)
_SORT[97:123], _SORT[65:91], _SORT[48:58] = 0, 1, 2
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_VOWEL = np.isin(_LOWER, [ord(c) for c in "aeiouy"])
_HEXA = np.isin(_LOWER, [ord(c) for c in "0123456789abcdef"])
_TO_HEX = bytes(104 if c in b"0123456789abcdef" else 32 for c in range(256))

#: First feature number of each group: sort, length and mix, changes of sort, hex digits, vowels, word; then blanks before and the text's.
IDENTITIES = 1_024
_GROUPS = np.cumsum([0, 145, 12 * 16, 12 * 5, 12 * 2, 5 * 16, IDENTITIES + 1])
_GAP, _FILE = int(_GROUPS[-1]), int(_GROUPS[-1]) + 2
FILE = (4, 4, 6)
N_FEATURES = _FILE + sum(FILE)
#: Groups that count at each distance from a token.
AT = {0: (1, 2, 3, 4), -1: (0, 5), -2: (0, 5), -3: (0, 5), -4: (0, 5), 1: (0,), 2: (0,)}
PAD = 4


def patterns(text: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, end) in bytes of what the patterns find: leftmost matches that don't overlap, those that are too short dropped."""
    found = []
    low = text.lower()
    if any(k in low for k in TELLING):
        found += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if b"AKIA" in text:
        found += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if b"h" * 16 in text.translate(_TO_HEX):
        found += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def file_features(texts: list[bytes]) -> np.ndarray:
    """A row of three grades for each text: how many digits and marks it has for its length, and its length."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum(sizes)

    def share(kind: np.ndarray) -> np.ndarray:
        upto = np.append(0, np.cumsum(kind))
        return (upto[ends] - upto[ends - sizes]) / np.maximum(1, sizes)

    digits = np.searchsorted([0.01, 0.05, 0.15], share(_SORT[data] == 2))
    marks = np.searchsorted([0.02, 0.06, 0.15], share(_CLASS[data] == _MARK))
    return np.stack([digits, marks, np.searchsorted([200, 1_000, 5_000, 20_000, 100_000], sizes)], axis=1)


@dataclass
class Field:
    weights: np.ndarray  # distance, feature, tag
    steps: np.ndarray  # tag, next tag


class Tokens:
    """The tokens of several texts as one sequence, PAD empty tokens around each text, and their features."""

    def __init__(self, texts: list[bytes], files: np.ndarray | None = None):
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.first = np.cumsum(sizes) - sizes
        kind = _CLASS[data]
        new = kind == _MARK
        new[1:] |= kind[1:] != kind[:-1]
        new[self.first[sizes > 0]] = True
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(data))
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        real = kind[starts] != _SPACE
        #: 1 for a token that stands at the start of its text or after a blank.
        self.gap = (~np.append(False, real[:-1]) | np.isin(starts, self.first))[real].astype(np.int64) if len(starts) else np.zeros(0, dtype=np.int64)
        self.starts, self.ends = starts[real], ends[real]
        self.words = coded.dictionary
        n, d = len(self.starts), len(self.words)
        self.text = np.repeat(np.arange(len(texts)), np.diff(np.append(np.searchsorted(self.starts, self.first), n)))
        #: Where each token stands in the sequence.
        self.at = np.arange(n) + PAD * (self.text + 1)
        self.sequence = np.full(n + PAD * (len(texts) + 1), d, dtype=np.int64)
        self.sequence[self.at] = coded.indices.to_numpy()[real]
        self.files = (file_features(texts) if files is None else files) + _FILE + np.cumsum((0, *FILE[:-1]))
        self.features = self._features()

    def _features(self) -> np.ndarray:
        """Feature numbers of each distinct token (and last of the empty one) in each group."""
        d = len(self.words)
        out = np.empty((d + 1, len(_GROUPS) - 1), dtype=np.int64)
        out[d] = [144, 0, 0, 0, 0, IDENTITIES]
        if d:
            offsets = np.frombuffer(self.words.buffers()[1], dtype=np.int64)[: d + 1]
            data = np.frombuffer(self.words.buffers()[2], dtype=np.uint8)[: offsets[-1]]
            begin, size = offsets[:-1], np.diff(offsets)
            total = lambda x: np.add.reduceat(x.astype(np.int64), begin)
            sort = _SORT[data]
            n = [total(sort == k) for k in range(4)]
            mix = sum((n[k] > 0).astype(np.int64) << k for k in range(4))
            grade = np.searchsorted([2, 3, 4, 5, 8, 12, 16, 20, 32, 40, 64], size, "right")
            changed = np.zeros(len(data), dtype=bool)
            changed[1:] = sort[1:] != sort[:-1]
            changed[begin] = False
            changes = np.searchsorted([1, 2, 4, 8], total(changed), "right")
            hexa = (total(_HEXA[data]) == size).astype(np.int64)
            vowels = np.searchsorted([0.1, 0.25, 0.45, 0.6], total(_VOWEL[data]) / size, "right")
            mark = _CLASS[data[begin]] != _WORD
            with np.errstate(over="ignore"):
                place = (np.arange(len(data)) - np.repeat(begin, size)).astype(np.uint64)
                spread = (_LOWER[data] + np.uint64(1)) * (place * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xBF58476D1CE4E5B9))
                mixed = np.add.reduceat(spread ^ (spread >> np.uint64(29)), begin)
                word = ((mixed * np.uint64(0x94D049BB133111EB)) >> np.uint64(54)).astype(np.int64)
            out[:d, 0] = np.where(mark, np.minimum(data[begin], 127), 128 + mix)
            out[:d, 1] = grade * 16 + mix
            out[:d, 2] = grade * 5 + changes
            out[:d, 3] = grade * 2 + hexa
            out[:d, 4] = vowels * 16 + mix
            out[:d, 5] = np.where(mark | (size > 12), IDENTITIES, word)
        return out + _GROUPS[:-1]

    def by_word(self, weights: np.ndarray) -> list[np.ndarray]:
        """What each distinct token adds to the tags' scores at each distance of AT."""
        return [sum(weights[k].take(self.features[:, g], axis=0) for g in groups) for k, groups in enumerate(AT.values())]

    def scores(self, weights: np.ndarray, some: np.ndarray | None = None, by_word: list[np.ndarray] | None = None) -> np.ndarray:
        """What each tag scores for tokens, or for some of them."""
        some = np.arange(len(self.at)) if some is None else some
        out = weights[0].take(_GAP + self.gap[some], axis=0) + weights[0][self.files].sum(axis=1).take(self.text[some], axis=0)
        for distance, added in zip(AT, by_word or self.by_word(weights)):
            out += added.take(self.sequence[self.at[some] + distance], axis=0)
        return out

    def uncertain(self, field: Field, by_word: list[np.ndarray]) -> np.ndarray:
        """Tokens that may be in a secret: for the others, being outside is better by more than all steps to the tags around can differ."""
        lead = lambda x: (x[:, 1:].max(axis=1) - x[:, OUT]).astype(np.float32)
        bound = lead(field.weights[0])[_GAP + self.gap] + lead(field.weights[0][self.files].sum(axis=1))[self.text]
        for distance, added in zip(AT, by_word):
            bound += lead(added).take(self.sequence[self.at + distance])
        a = field.steps
        most = max(a[x, y] + a[y, z] - a[x, OUT] - a[OUT, z] for x in range(3) for y in (1, 2) for z in range(3))
        return np.flatnonzero(bound > -most - 1e-3)

    def slope(self, rest: np.ndarray) -> np.ndarray:
        """The derivative for the weights, from that for the scores of the places of tokens."""
        out = np.zeros((len(AT), N_FEATURES, 3))
        for k, (distance, groups) in enumerate(AT.items()):
            words = self.sequence[self.at + distance]
            for tag in range(3):
                by_word = np.bincount(words, rest[:, tag], len(self.features))
                for g in groups:
                    out[k, :, tag] += np.bincount(self.features[:, g], by_word, N_FEATURES)
        for tag in range(3):
            out[0, :, tag] += np.bincount(_GAP + self.gap, rest[:, tag], N_FEATURES)
            for column in self.files.T:
                out[0, :, tag] += np.bincount(column[self.text], rest[:, tag], N_FEATURES)
        return out


def viterbi(scores: np.ndarray, steps: np.ndarray, block: int = 64) -> np.ndarray:
    """The best tags of a sequence that is outside before its start and after its end; of equally good ways into a tag, the one over the lower tag.

    Blocks are worked on side by side: the best score from each tag before a block to each tag at its end. Blocks are then
    joined one after the other, and the way back is taken in all blocks at once.
    """
    n = len(scores)
    count = n // block + 1  # at least one empty token behind the last
    padded = np.zeros((count * block, 3))
    padded[:n] = scores
    padded[n:] = (0.0, -1e6, -1e6)
    at = padded.reshape(count, block, 3)
    best = np.where(np.eye(3, dtype=bool), 0.0, -1e9)[None].repeat(count, axis=0)
    came = np.empty((block, count, 3, 3), dtype=np.uint8)
    for t in range(block):
        top, way = best[:, :, 0, None] + steps[0], np.zeros((count, 3, 3), dtype=np.uint8)
        for tag in (1, 2):
            other = best[:, :, tag, None] + steps[tag]
            better = other > top
            top = np.where(better, other, top)
            way[better] = tag
        best, came[t] = top + at[:, t, None, :], way
    first, now = [], [0.0, -1e9, -1e9]
    for to in best.tolist():
        ways = [max(range(3), key=lambda a: now[a] + to[a][b]) for b in range(3)]
        first.append(ways)
        now = [now[ways[b]] + to[ways[b]][b] for b in range(3)]
    tags = np.empty((count, block), dtype=np.int64)
    ends, starts = np.empty(count, dtype=np.int64), np.empty(count, dtype=np.int64)
    tag = max(range(3), key=now.__getitem__)
    for b in range(count - 1, -1, -1):
        ends[b], tag = tag, first[b][tag]
        starts[b] = tag
    every = np.arange(count)
    for t in range(block - 1, -1, -1):
        tags[:, t] = ends
        ends = came[t, every, starts, ends]
    return tags.reshape(-1)[:n]


def likelihood(field: Field, tokens: Tokens, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(mean log likelihood of the tags of each text's tokens, its slopes for weights and steps), by forward and backward sums. Texts are outside before and after."""
    scores = tokens.scores(field.weights)
    texts, sizes = np.unique(tokens.text, return_counts=True)
    row, width = np.repeat(np.arange(len(texts)), sizes), sizes.max()
    column = np.arange(len(scores)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    top = scores.max(axis=1)
    grid = np.ones((width, len(texts), 3))
    grid[column, row] = np.exp(scores - top[:, None])
    inside = np.zeros((width, len(texts), 1), dtype=bool)
    inside[column, row] = True
    step = np.exp(field.steps)
    # chances ahead of and after each place, each place's scaled by its total
    ahead, after, scale = np.ones_like(grid), np.ones_like(grid), np.ones((width, len(texts), 1))
    for t in range(width):
        now = ((ahead[t - 1] @ step) if t else step[OUT]) * grid[t]
        total = now.sum(axis=1, keepdims=True)
        ahead[t], scale[t] = np.where(inside[t], now / total, ahead[t - 1]), np.where(inside[t], total, 1.0)
    last = ahead[-1] @ step[:, OUT]
    after[:] = step[:, OUT] / last[:, None]
    for t in range(width - 2, -1, -1):
        after[t] = np.where(inside[t + 1], (grid[t + 1] * after[t + 1]) @ step.T / scale[t + 1], after[t])
    chance = (ahead * after)[column, row]
    both = np.einsum("tba,tbc->ac", ahead[:-1], grid[1:] * after[1:] / scale[1:] * inside[1:]) * step
    ends = np.cumsum(sizes) - 1
    both[OUT] += chance[column == 0].sum(axis=0)
    both[:, OUT] += chance[ends].sum(axis=0)
    before = np.append(np.where(column > 0, np.append(OUT, tags[:-1]), OUT), tags[ends])
    after_that = np.append(tags, np.full(len(ends), OUT))
    seen = np.bincount(before * 3 + after_that, minlength=9).reshape(3, 3)
    value = scores[np.arange(len(tags)), tags].sum() + field.steps[before, after_that].sum() - np.log(scale).sum() - np.log(last).sum() - top.sum()
    n = len(texts)
    return value / n, tokens.slope((np.eye(3)[tags] - chance) / n), (seen - both) / n


def tagged(tokens: Tokens, spans: list[list[tuple[int, int]]]) -> np.ndarray:
    """Tags of tokens from the spans (start, end) of each text: begin at a span's first token, inside at its others."""
    tags = np.zeros(len(tokens.starts), dtype=np.int64)
    for i, some in enumerate(spans):
        for start, end in sorted(some):
            a, b = np.searchsorted(tokens.starts, [tokens.first[i] + start, tokens.first[i] + end])
            if not tags[a:b].any():
                tags[a:b] = INSIDE
                tags[a : a + 1] = BEGIN if b > a else tags[a : a + 1]
    return tags


def values(text: bytes) -> list[tuple[int, int]]:
    """The spans to learn: values of assignments, and whole matches of the other patterns."""
    found = [m.span(2) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    return found + [(a, b) for k, a, b in patterns(text) if k and not any(x < b and a < y for x, y in found)]


def window(text: bytes, start: int, end: int) -> bytes:
    """The text around a span, from blank to blank."""
    a, b = max(0, start - AROUND), min(len(text), end + AROUND)
    while a > 0 and a > start - 2 * AROUND and text[a - 1] not in b" \t\n\v\f\r":
        a -= 1
    while b < len(text) and b < end + 2 * AROUND and text[b] not in b" \t\n\v\f\r":
        b += 1
    return text[a:b]


def renamed(text: bytes, alias: bytes) -> tuple[bytes, list[tuple[int, int]]] | None:
    """The text with the telling word of its first assignment replaced, and its spans; None if it has no assignment."""
    found = ASSIGN.search(text)
    if not found:
        return None
    longer = len(alias) - len(found[1])
    moved = lambda x: x + longer if x > found.start() else x
    return text[: found.start(1)] + alias + text[found.end(1) :], [(moved(a), moved(b)) for a, b in values(text)]


def fit_field(windows: list[tuple[bytes, tuple[int, int, int]]], rounds: int = ROUNDS) -> Field:
    """A field by full-batch Adam on the penalised likelihood. windows: texts and the features of their files."""
    rows = [(t, f, values(t)) for t, f in windows if t.strip()]
    again = [(renamed(t, ALIASES[i % len(ALIASES)]), f) for i, (t, f, _) in enumerate(rows)]
    rows += [(r[0], f, r[1]) for r, f in again if r]
    tokens = Tokens([r[0] for r in rows], np.array([r[1] for r in rows]))
    tags = tagged(tokens, [r[2] for r in rows])
    field = Field(np.zeros((len(AT), N_FEATURES, 3)), np.zeros((3, 3)))
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (field.weights, field.steps)]
    for k in range(1, rounds + 1):
        _, *slopes = likelihood(field, tokens, tags)
        for x, slope, (m, v) in zip((field.weights, field.steps), slopes, moments):
            slope = slope - PENALTY / len(rows) * x
            m += 0.1 * (slope - m)
            v += 0.01 * (slope * slope - v)
            x += RATE * (1 - k / (rounds + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return field


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Field | None:
    """The field of a sample of docs, None if the patterns find nothing in it.

    Rows are taken by a hash of id and text, about sample of them (all, if there are fewer). Each gives up to WINDOWS windows
    around what the patterns find, and one of MOST / sample one elsewhere. Of either sort at most MOST, those with the lowest
    hashes, are fitted on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (numbers,), texts in slabs(batches, ["n", "text"], "text"):
            out = []
            for n, t, file in zip(numbers, texts, file_features(texts).tolist()):
                found = patterns(t)
                out += [(n, True, window(t, a, b), *file) for _, a, b in found[:WINDOWS]]
                place = n % max(1, len(t))
                if n <= few and not any(a < place + 3 * AROUND and place - 3 * AROUND < b for _, a, b in found):
                    out.append((n, False, window(t, place, place), *file))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)

    schema = pa.schema([("n", pa.int64()), ("found", pa.bool_()), ("part", pa.binary()), ("digits", pa.int32()), ("marks", pa.int32()), ("size", pa.int32())])
    rows = docs.count()
    upto = lambda n: min(2**63 - 1, int(n / max(1, rows) * 2**64) - 2**63)
    few = upto(MOST)
    hashed = F.xxhash64(F.col(key).cast("string"), F.col(text))
    some = docs.select(hashed.alias("n"), F.col(text).alias("text")).where(F.col("n") <= F.lit(upto(sample)))
    parts = some.mapInArrow(run, "n long, found boolean, part binary, digits int, marks int, size int")
    order = ["n", "part"]
    taken = [parts.where(where).orderBy(*order).limit(MOST).collect() for where in ("found", "NOT found")]
    if not taken[0]:
        return None
    return fit_field([(bytes(r.part), (r.digits, r.marks, r.size)) for r in taken[0] + taken[1]])


def decoded(field: Field, texts: list[bytes]) -> list[list[tuple[int, int]]]:
    """Spans (start, end) in bytes of each text that the field tags as secrets."""
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    tokens = Tokens(texts)
    by_word = tokens.by_word(field.weights)
    some = tokens.uncertain(field, by_word)
    # stretches of uncertain tokens, each behind an empty token that is outside
    new = np.diff(tokens.at[some], prepend=-PAD) != 1
    place = np.arange(len(some)) + np.cumsum(new)
    scores = np.full((len(some) + int(new.sum()) + 1, 3), (0.0, -1e6, -1e6))
    scores[place] = tokens.scores(field.weights, some, by_word)
    tags = viterbi(scores, field.steps)
    inside = np.flatnonzero(tags != OUT)
    begins = inside[(tags[inside] == BEGIN) | (tags[inside - 1] == OUT)]
    ends = inside[(tags[inside + 1] != INSIDE)]
    token = np.full(len(scores), -1)
    token[place] = some
    for a, b in zip(token[begins].tolist(), token[ends].tolist()):
        of = int(tokens.text[a])
        out[of].append((int(tokens.starts[a] - tokens.first[of]), int(tokens.ends[b] - tokens.first[of])))
    return out


def found_spans(docs: DataFrame, field: Field | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) for each row of docs, spans in order of start and kind, in code points, end exclusive.

    Spans of the patterns are all there; the field's are added where they don't overlap these. Without a field there are only
    the patterns'. Null and empty texts have none. Texts are looked at whole, a very long one alone. Rows that repeat, or have no id, keep
    a row each. Other columns, whatever their names, are not looked at. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids,), texts in slabs(batches, ["doc_id", "text"], "text"):
            added = decoded(shared.value, texts) if shared.value is not None and any(texts) else [[]] * len(texts)
            out = []
            for t, more in zip(texts, added):
                spans = patterns(t)
                spans += [(3, a, b) for a, b in more if not any(x < b and a < y for _, x, y in spans)]
                if spans:
                    points = np.append(0, np.cumsum((np.frombuffer(t, dtype=np.uint8) & 0xC0) != 0x80))
                    spans = sorted((int(points[a]), k, int(points[b])) for k, a, b in spans)
                out.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = found_spans(docs, fit(docs))
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != KINDS[-1])
    return found.select("doc_id", *map(n, KINDS[:-1]), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
