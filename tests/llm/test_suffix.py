"""Difference-cover suffix arrays and the removal of repeated strings against brute force."""

import hashlib
import random

import numpy as np
import pytest

from histora.llm import suffix


@pytest.mark.parametrize("letters,n,length", [(2, 300, 1_000), (2, 301, 20), (3, 302, 7), (1, 200, 50), (40, 500, 100), (2, 3, 9), (2, 1, 9)])
def test_suffix_order(letters, n, length):
    rng = np.random.default_rng(n)
    text = rng.integers(1, letters + 1, n)
    order = suffix.suffix_order(text, length)
    assert sorted(order) == list(range(n))
    prefixes = [tuple(text[i : i + min(length, n)]) for i in order]
    assert prefixes == sorted(prefixes)


def test_anchors_cover_each_window_once():
    rng = random.Random(1)
    texts = [bytes(rng.choices(b"abc", k=n)) for n in (0, 99, 100, 101, 400, 1_000)] + [b"a" * 300, b"ab" * 200]
    text, lo, hi, key, chunk = suffix.anchors(texts, 100, 32)
    seen = [(t, w) for t, a, b in zip(text, lo, hi) for w in range(a, b + 1)]
    assert sorted(seen) == [(t, w) for t, x in enumerate(texts) for w in range(len(x) - 99)]
    owner = {(t, w): k for t, a, b, k in zip(text, lo, hi, key) for w in range(a, b + 1)}
    of = {}
    for (t, w), k in owner.items():
        assert of.setdefault(texts[t][w : w + 100], k) == k


def brute(rows, length=100):
    """rows: (doc_id, bytes) in order."""
    seen, out = {}, []
    for i, text in rows:
        cover = np.zeros(len(text) + 1, dtype=int)
        for p in range(len(text) - length + 1):
            if text[p : p + length] in seen:
                cover[p : p + length] = 1
            else:
                seen[text[p : p + length]] = True
        kept = bytes(b for b, c in zip(text, cover) if not c)
        out.append((i, len(text), int(cover.sum()), int((np.diff(np.concatenate([[0], cover])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_removals(spark, monkeypatch):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 7)))
    passage = [" ".join(word() for _ in range(rng.randint(20, 120))) for _ in range(6)]
    texts = [None, "", "short", "a" * 350, "a" * 120, "xy" * 150, passage[0], passage[0], passage[0] + "!", "?" + passage[0], passage[0] * 3]
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 6)):
            p = rng.choice(passage)
            a = rng.randint(0, len(p) // 2)
            parts.append(rng.choice([p, p[a : a + rng.randint(50, 400)], " ".join(word() for _ in range(rng.randint(1, 60))), p[:80] + word() + p[80:]]))
        texts.append("".join(parts))
    texts.append(texts[-1] * 20)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], "doc_id long, text string, n int, key string")
    want = brute([(i, (t or "").encode()) for i, t in rows])
    assert sorted(map(tuple, suffix.digested(docs).collect())) == want
    monkeypatch.setattr(suffix, "ARRAY", 1)
    assert sorted(map(tuple, suffix.digested(docs.repartition(5)).collect())) == want
    # anchors with many chunks are cut into windows
    monkeypatch.setattr(suffix, "ARRAY", 1 << 19)
    monkeypatch.setattr(suffix, "MANY", 3)
    assert sorted(map(tuple, suffix.digested(docs.repartition(3)).collect())) == want
    kept = {r.doc_id: hashlib.sha256(bytes(r.kept)).hexdigest() for r in suffix.deduplicated(docs).collect()}
    assert kept == {r[0]: r[4] for r in want}


def test_shared_ids_null_ids_and_empty(spark):
    text = "".join(random.Random(3).choices("abcdefgh", k=400))
    docs = spark.createDataFrame([(5, text), (5, text), (2, text[100:]), (None, text[:150]), (5, text + "tail")], "doc_id long, text string")
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix.digested(docs).collect()))
    assert got[:2] == [(False, 0, 150, 0), (True, 2, 300, 0)]
    assert [g[2] for g in got[2:]] == [400, 400, 404] and got[2] == got[3]
    assert suffix.digested(docs.limit(0)).count() == 0


def test_near_copies(spark, monkeypatch):
    """Copies of one text with a letter replaced here and there: anchors with very many chunks."""
    rng = random.Random(17)
    base = "".join(rng.choices("abcdefgh ", k=600))
    rows = []
    for i in range(300):
        at = rng.randrange(600)
        rows.append((i, base[:at] + rng.choice("xyz") + base[at + 1 :]))
    docs = spark.createDataFrame(rows + rows[:1], "doc_id long, text string")
    monkeypatch.setattr(suffix, "MANY", 20)
    monkeypatch.setattr(suffix, "HOT", 10**9)
    got = sorted(set(map(tuple, suffix.digested(docs).collect())))
    assert got == brute([(i, t.encode()) for i, t in rows])
