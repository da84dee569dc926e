"""Importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from histora.llm import resampling

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def buckets(text):
    ws = words(text)
    return [zlib.crc32(" ".join(ws[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(ws) - n + 1)]


def brute(docs, target):
    s = Counter(b for _, t in docs for b in buckets(t))
    t = Counter(b for x in target for b in buckets(x))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000))))
    rows = []
    for i, text in docs:
        found = buckets(text)
        weight = sum(map(gain, found))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in rows]


def key(row):
    return tuple((x is not None, x or 0) for x in row)


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["The", "the", "été", "x1", "9", "日本", "İ", "don't", "a-b", "ſ", "KelvinK"] + [f"w{i}" for i in range(300)]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\n", ", ", "\x7f", " "]) for _ in range(n))
    docs = [(i, text(rng.choice([0, 1, 2, 3, 19, 20, 21, 60]))) for i in range(900)]
    docs += [(1_000, None), (1_001, ""), (1_002, "!?"), (1_003, text(60_000)), (7, docs[7][1]), (None, text(40))]
    docs += [(5_000, "same words " * 20)] * 30
    target = [text(30) for _ in range(20)] + [None, ""]
    frame = spark.createDataFrame([(t, i, "clash", {"a": 1}) for i, t in docs], "text string, doc_id long, `rank` string, `a.b` map<string,int>")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "doc_id int, text string")
    got = [tuple(r) for r in resampling.resampled(frame.repartition(7), bench).collect()]
    assert sorted(got, key=key) == sorted(brute(docs, target), key=key)
    assert resampling.resampled(frame, bench).columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c " * 20)] * 20 + [(2, None)], "doc_id long, text string")
    nothing = docs.limit(0)
    assert resampling.resampled(nothing, docs).count() == 0
    got = [tuple(r) for r in resampling.resampled(docs, nothing).collect()]
    assert sorted(got, key=key) == sorted(brute([(1, "a b c " * 20)] * 20 + [(2, None)], []), key=key)


def test_pieces_never_split_rows(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(resampling, "SLAB", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(["aaaa", "b" * 30, None, "", "cc", "d" * 9, "e" * 9])], ["text"])
    some = [p.column("text").to_pylist() for p in resampling.pieces(batch, "text")]
    assert sum(some, []) == batch.column("text").to_pylist() and ["b" * 30] in some or max(map(len, some)) < 7
