"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np

from histora.llm import runs

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, shortest=6, times=4):
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(shortest, times * q) and all(any(w[i + k] != w[i + k + d] for k in range(length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {k for s, n, p in found for k in range(s + p, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def sequences():
    rng = random.Random(1)
    for _ in range(1_500):
        k = rng.choice([1, 2, 2, 3, 5])
        w = [rng.randrange(k) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.6 and len(w) > 8:
            unit = [rng.randrange(4) for _ in range(rng.randint(1, 8))]
            w[rng.randrange(len(w)) :] = unit * rng.randint(2, 7) + [rng.randrange(k) for _ in range(4)]
        yield w


def test_automaton_knows_all_subwords():
    for w in list(sequences())[:200]:
        length, link, _ = runs.automaton(w)
        subwords = {tuple(w[i:j]) for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
        assert sum(length[v] - length[link[v]] for v in range(2, len(length))) == len(subwords)


def test_runs_and_stretches():
    for w in sequences():
        want = brute(w)
        assert runs.runs(w) == want, w
        cut = [(s + a, n, p) for s, e in runs.stretches(np.array(w, dtype=np.int32), np.array([len(w)])) for a, n, p in runs.runs(w[s:e])]
        assert sorted(cut, key=lambda r: (r[0], r[2])) == want, w


def test_other_bounds():
    for w in list(sequences())[:300]:
        assert runs.runs(w, 4, 2) == brute(w, 4, 2), w


def test_prose_leaves_little():
    rng = random.Random(2)
    w = np.array([min(int(rng.paretovariate(0.9)), 3_000) for _ in range(50_000)])
    assert sum(e - s for s, e in runs.stretches(w, np.array([20_000, 0, 30_000]))) < 5_000


def test_table(spark):
    texts = [None, "", " ", "a", "x " * 6, "x " * 5, "a b a b a b a b", "é é " * 7, "A a " * 9, "one two\tthree\n" * 4 + "one", "x " * 30_000 + "y z " * 20_000]
    docs = spark.createDataFrame([(t, i, [1], {"k": "v"}) for i, t in enumerate([*texts, "a " * 9])] + [("a " * 9, 4, None, None), ("a " * 9, None, None, None)], "text string, doc_id long, `runs` array<int>, `a.b` map<string,string>")
    rows = runs.periodic(docs).collect()
    assert len(rows) == len(texts) + 3
    for text, r in [(texts[r.doc_id], r) for r in rows if r.doc_id is not None and r.doc_id < len(texts) and r.doc_id != 4]:
        w = WORDS.findall(text or "")
        want = brute(w) if len(w) < 1_000 else [(0, 30_000, 1), (30_000, 40_000, 2)]
        assert [tuple(x) for x in r.runs] == want
        assert r.collapsed == collapsed(w, want)
    assert runs.periodic(docs.limit(0)).count() == 0


def remade(text, i):
    w = WORDS.findall(text or "")
    h, n = zlib.crc32(str(i).encode()), len(w)
    if i is None or h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("ab" if i % 3 else "abcdefgh") for _ in range(rng.choice([0, 1, 2, 7, 60, 150]))) for i in range(400)]
    texts[10:12] = [None, "  "]
    docs = list(enumerate(texts)) + [(None, "b " * 8), (0, texts[0])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, text in docs:
        w = remade(text, i)
        found = brute(w)
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
        want.append((i, len(found), *best, best[1] and 1000 * best[1] // best[2], sha(lines), sha(collapsed(w, found))))
    got = [tuple(r) for r in runs.op13_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[1] for r in got) > 20
