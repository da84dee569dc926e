"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A piece of text is a row of symbols; leaf i of its tree holds the rank of the pair that starts at symbol i. The
root yields the lowest rank and, of equal ranks, the leftmost pair. A merge changes three leaves, and each change
goes up the tree in logarithmic time, until the root says that no pair can be merged. Trees of equal size are
worked on side by side as numpy arrays, one row a piece.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slabs, table

NONE = np.int64(1) << np.int64(40)
#: Pieces that a Python worker remembers before it starts anew.
REMEMBERED = 80_000
_SPACE = r"\p{White_Space}"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """What encoding needs of a tokenizer file: NFC, lower case, a split pattern, byte letters, BPE with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], dtype=np.int64)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.specials.values()]) + 1
        self.tokens = [""] * self.size
        for token, i in [*vocab.items(), *self.specials.items()]:
            self.tokens[i] = token
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # \s within and without brackets: Unicode white space and no control characters
        self.pattern = split["pattern"]["Regex"].replace(r"\s", _SPACE)
        self.special_pattern = "|".join(regex.escape(t) for t in sorted(self.specials, key=len, reverse=True))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs; NONE where there is no merge or a symbol is missing (-1)."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], NONE)


def merge_all(symbols: np.ndarray, lengths: np.ndarray, v: Vocabulary) -> np.ndarray:
    """symbols: one piece a row, -1 beyond its length; the number of columns is a power of two. Merged symbols, -1 where one went."""
    rows, width = symbols.shape
    tree = np.full((rows, 2 * width), NONE)
    position = np.arange(width)
    # a node holds rank * width + position, so that the least is the leftmost pair of the lowest rank
    first = v.rank(symbols[:, :-1], symbols[:, 1:]) if width > 1 else np.full((rows, 0), NONE)
    tree[:, width : 2 * width - 1] = np.where(first < NONE, first * width + position[:-1], NONE)
    level = width
    while level > 1:
        level //= 2
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
    after = np.tile(position + 1, (rows, 1))
    before = np.tile(position - 1, (rows, 1))
    after[after >= lengths[:, None]] = -1

    def put(row: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        node = leaf + width
        tree[row, node] = value
        while node[0] > 1:  # leaves are at one depth
            node >>= 1
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

    def pair(row: np.ndarray, at: np.ndarray) -> np.ndarray:
        right = after[row, at]
        rank = v.rank(symbols[row, at], np.where(right >= 0, symbols[row, right], -1))
        return np.where(rank < NONE, rank * width + at, NONE)

    live = np.flatnonzero(tree[:, 1] < NONE)
    while len(live):
        rank, at = np.divmod(tree[live, 1], width)
        gone = after[live, at]
        symbols[live, at] = v.merged[rank]
        symbols[live, gone] = -1
        beyond = after[live, gone]
        after[live, at] = beyond
        some = beyond >= 0
        before[live[some], beyond[some]] = at[some]
        put(live, gone, np.full(len(live), NONE))
        put(live, at, pair(live, at))
        ahead = before[live, at]
        some = ahead >= 0
        if some.any():
            put(live[some], ahead[some], pair(live[some], ahead[some]))
        live = live[tree[live, 1] < NONE]
    return symbols


def encode_pieces(pieces: list[str], v: Vocabulary) -> list[list[int]]:
    """The ids of each piece."""
    raw = [p.encode() for p in pieces]
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    widths = np.where(sizes > 1, 2 ** np.ceil(np.log2(np.maximum(sizes, 2))).astype(np.int64), 1)
    out: list[list[int]] = [[]] * len(pieces)
    for width in np.unique(widths):
        of = np.flatnonzero(widths == width)
        step = max(1, (1 << 19) // int(width))
        for start in range(0, len(of), step):
            some = of[start : start + step]
            lengths = sizes[some]
            data = np.frombuffer(b"".join(raw[i] for i in some), dtype=np.uint8)
            inside = np.arange(width) < lengths[:, None]
            symbols = np.full((len(some), int(width)), -1, dtype=np.int64)
            symbols[inside] = v.inner[data]
            ends = np.cumsum(lengths) - 1
            symbols[np.arange(len(some)), lengths - 1] = v.last[data[ends]]
            symbols = merge_all(symbols, lengths, v)
            left = symbols >= 0
            flat, cuts = symbols[left].tolist(), np.concatenate([[0], np.cumsum(left.sum(axis=1))]).tolist()
            for k, i in enumerate(some.tolist()):
                out[i] = flat[cuts[k] : cuts[k + 1]]
    return out


class Codec:
    """Encodes and decodes whole texts; remembers the pieces it has seen."""

    def __init__(self, v: Vocabulary):
        self.v, self.known = v, {}
        self.find = regex.compile(v.pattern).findall
        self.special = regex.compile(f"({v.special_pattern})") if v.special_pattern else None

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text; special tokens stand for themselves and aren't lower-cased or split."""
        if self.special is None or not any(s in text for s in self.v.specials):
            return self.find(self.normal(text))
        out = []
        for part in self.special.split(text):
            out += [part] if part in self.v.specials else self.find(self.normal(part))
        return out

    @staticmethod
    def normal(text: str) -> str:
        if not text.isascii():
            # each letter is lower-cased on its own: no final form of sigma
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.known]
        if not new:
            return
        if len(self.known) > REMEMBERED:
            self.known.clear()
            new = list(pieces)
        plain = [p for p in new if p not in self.v.specials]
        for p, ids in zip(plain, encode_pieces(plain, self.v)):
            self.known[p] = (len(ids), " ".join(map(str, ids)), self.decode(ids))
        for p in new:
            if p in self.v.specials:
                self.known[p] = (1, str(self.v.specials[p]), self.decode([self.v.specials[p]]))

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder: tokens are joined by blanks."""
        return " ".join([self.v.tokens[i] for i in ids])

    def encode(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """(number of ids, ids joined by blanks, decoded text) of each text."""
        split = [self.pieces(t) for t in texts]
        self.learn(set().union(*split))
        known = self.known
        for pieces in split:
            found = [known[p] for p in pieces]
            yield sum([f[0] for f in found]), " ".join([f[1] for f in found]), " ".join([f[2] for f in found])


_codecs: dict[int, Codec] = {}


def encoded(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) for each row: ids and decoded text of the whole text.

    Null and empty texts have no tokens and decode to the empty string. Strings of special tokens in a text become
    those tokens. Of pairs of equal rank the leftmost is merged. Very long texts are encoded whole. Rows that repeat, or have no
    id, keep a row each; other columns, whatever their names, are not looked at. An empty table gives an empty result.
    """
    return _run(docs, path, key, text, False)


def digested(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): as encoded(), with digests in place of ids and text."""
    return _run(docs, path, key, text, True)


def _run(docs: DataFrame, path: str | None, key: str, text: str, digest: bool) -> DataFrame:
    path = path or default_path()
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))
    which = hash(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if which not in _codecs:
            _codecs[which] = Codec(shared.value)
        codec = _codecs[which]
        for (ids,), texts in slabs(batches, ["doc_id", "text"], "text"):
            n, a, b = [], [], []
            for count, tokens, decoded in codec.encode([t.decode() for t in texts]):
                n.append(count)
                a.append(hashlib.sha256(tokens.encode()).hexdigest() if digest else [int(x) for x in tokens.split()])
                b.append(hashlib.sha256(decoded.encode()).hexdigest() if digest else decoded)
            columns = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string() if digest else pa.list_(pa.int32())), pa.array(b, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["doc_id", "n_tokens", "ids", "decoded"]
    schema = f"doc_id long, n_tokens long, {names[2]} {'string' if digest else 'array<int>'}, {names[3]} string"
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def decoded(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): null ids count as empty."""
    shared = tokens.sparkSession.sparkContext.broadcast(Vocabulary(path or default_path()).tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [" ".join(shared.value[i] for i in ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(table(spark, sf_dir, "documents"))
