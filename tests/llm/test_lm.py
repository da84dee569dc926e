"""Language-model scoring: the base score against brute force, the tree's distributions, held-out gain."""

import itertools
import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
import zstandard

from histora.llm import lm


def tokens(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]


def brute(rows):
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows]
    counts = Counter()
    for (_, t), h in zip(rows, held):
        if not h:
            counts.update(tokens(t))
            counts[None] += 1
    n, v = sum(counts.values()), len(counts)
    for (i, t), h in zip(rows, held):
        own = [*tokens(t), None]
        yield i, h, len(own), sum(w in counts for w in own), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)


def corpus(n, seed):
    """Two languages, so that a word tells much of the next one."""
    rng = random.Random(seed)
    words = [[f"{x}{a}{b}" for a, b in itertools.product("abcdefgh", "lmnopq")] for x in "xy"]
    out = []
    for i in range(n):
        own = rng.choice(words)
        out.append((i, " ".join(rng.choices(own, weights=[1 / (k + 1) for k in range(len(own))], k=rng.randint(0, 120)) + (["Rare%d" % rng.randint(0, 3 * n)] if i % 3 == 0 else []))))
    return out


def test_base_scores(spark, monkeypatch):
    monkeypatch.setattr(lm, "WORD", 3e-3)  # so that most words are looked up by the join
    rows = [*corpus(120, 1), (None, "xal"), (500, None), (501, " \n"), (502, "X\x0bY\x1cz É é"), (7, "again xal xal"), (7, "again xal xal"), (503, "long " * 60_000)]
    docs = spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], "doc_id long, text string, word string, n int")
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in lm.scores(docs).collect()), key=key)
    want = sorted(brute(rows), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want])


def test_tree_is_a_distribution_and_helps(spark):
    rows = corpus(600, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = lm._with_sides(docs, "doc_id", "text").where("NOT held_out").select("text")
    tree = lm.fit(train, lm.word_counts(train).cache())
    assert tree.states and len(tree.entries[0][0])
    for before in ([], [tree.end], [0], [3, 0], [1, 2, 3]):
        p = [tree.probabilities(np.array([*before, x if x < tree.other else -1]))[-1] for x in range(tree.symbols)]
        assert sum(p) == pytest.approx(1, abs=1e-9) and min(p) > 0
    held = [r for r in lm.scores(docs).collect() if r.held_out]
    # which of two languages a text is in is worth log10(2) a token: at least half of that is found
    assert sum(r.score - r.base_score for r in held) > math.log10(2) / 2 * sum(r.n_tokens for r in held)


def test_longest_state_matches_counts(spark):
    """Each kept state's kept entries are the discounted shares of what follows it in the training texts."""
    rows = corpus(300, 3)
    train = spark.createDataFrame([(t,) for _, t in rows], "text string")
    tree = lm.fit(train, lm.word_counts(train).cache(), depth=2)
    names = {i: w for w, i in tree.at.items()}
    seen, follow = Counter(), Counter()
    for _, t in rows:
        own = [lm.END, *(w.encode() for w in tokens(t)), lm.END]
        for a, b in zip(own, own[1:]):
            seen[a] += 1
            follow[a, b] += 1
    keys, values = tree.entries[0]
    assert len(keys)
    for k, v in zip(keys, values):
        a, b = names[int(tree.states[0][k // tree.symbols])], int(k % tree.symbols)
        n = follow[a, names[b]] if b < tree.other else sum(c for (x, y), c in follow.items() if x == a and tree.at.get(y, tree.other) >= tree.other)
        assert v == pytest.approx((n - lm.DISCOUNT) / seen[a])


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm.scores(docs).count() == 0
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    row = lm.scores(spark.createDataFrame([(alone, "a b")], "doc_id long, text string")).first()
    assert tuple(row) == (alone, True, 3, 0, 0, 0.0, 0.0)


def brute_scores(rows, depth, is_anchor, unknown):
    """The model written down context by context: rows (text, trains), the score of each."""
    counts = Counter()
    for t, trains in rows:
        if trains:
            counts.update([*tokens(t), None])
    total, distinct = sum(counts.values()), len(counts)
    base = lambda w: (counts[w] + lm.ALPHA) / (total + lm.ALPHA * (distinct + 1))
    often = {w for w, n in counts.items() if n >= max(2, lm.SYMBOL * total)} | {None}
    symbol = lambda w: w if w in often else "*"
    root = {w: base(w) for w in often}
    root["*"] = 1 - sum(root.values())

    def positions(t):
        """(context before, newest last, as far back as the text's beginning; the symbol; the word)."""
        own = [None, *(symbol(w) for w in tokens(t))]
        for i, w in enumerate([*tokens(t), None]):
            yield tuple(own[: i + 1]), symbol(w), w

    least = max(2.0, lm.P_MIN * total)
    states = [{(w,) for w in often if counts[w] >= least}]
    shares, rest, above, kept = {}, {}, {(): root}, set()
    for level in range(depth):
        if len(states) <= level or not states[level]:
            break
        follow = Counter()
        for t, trains in rows:
            if trains:
                follow.update((c[-level - 1 :], s) for c, s, _ in positions(t) if len(c) > level and c[-level - 1 :] in states[level])
        size = Counter()
        for (c, _), n in follow.items():
            size[c] += n
        counted = {k: n for k, n in follow.items() if n >= max(2.0, lm.JOINT * total)}
        here = {}
        for c in states[level]:
            own = {s: (n - lm.DISCOUNT) / size[c] for (k, s), n in counted.items() if k == c}
            up = above.get(c[1:])
            shares[c], rest[c] = own, 1.0
            if not own or up is None:
                continue
            rest[c] = 1 - sum(own.values())
            p = here[c] = {s: rest[c] * q + own.get(s, 0) for s, q in up.items()}
            divergence = sum(q * math.log(q / up[s]) for s, q in p.items())
            if divergence >= lm.DIVERGENCE and size[c] * divergence >= len(own):
                kept |= {c[i:] for i in range(len(c))}
        above = here
        states.append({(*c, s) for (c, s), n in counted.items() if n >= least and s not in ("*", None) and (*c, s)[1:] in states[level]})

    def short(t):
        for c, s, w in positions(t):
            p = root[s]
            for d in range(1, min(depth, len(c)) + 1):
                if c[-d:] in kept:
                    p = shares[c[-d:]].get(s, 0) + rest[c[-d:]] * p
            yield math.log10(p * base(w) / root["*"] if s == "*" else p)

    def cut(t):
        """The beginning up to the first anchor, then (anchor, run, its log10 probability in short states)."""
        own, p, first = [*tokens(t), None], list(short(t)), 0
        ends = [i for i in range(lm.CONTEXT - 1, len(own) - 1) if is_anchor(own[i - lm.CONTEXT + 1 : i + 1])]
        out = [(None, (), sum(p[: ends[0] + 1] if ends else p))]
        for i, e in zip(ends, [*(e + 1 for e in ends[1:]), len(own)]):
            out.append((tuple(own[i - lm.CONTEXT + 1 : i + 1]), tuple(own[i + 1 : e]), sum(p[i + 1 : e])))
        return out

    cuts = [cut(t) for t, _ in rows]
    follow, lp = Counter(), {}
    for runs, (_, trains) in zip(cuts, rows):
        for a, r, x in runs[1:]:
            follow[a, r] += trains
            lp[a, r] = x - sum(math.log10(base(w)) for w in r if unknown(w))
    long = {}
    for a in {a for a, _ in follow}:
        n_a = sum(n for (b, _), n in follow.items() if a == b)
        own = {r: (n - lm.DISCOUNT) / n_a for (b, r), n in follow.items() if a == b and n >= 2}
        left = 1 - sum(own.values())
        ps = {r: q + left * 10 ** lp[a, r] for r, q in own.items()}
        d = sum(p * (math.log(p) - lp[a, r] * math.log(10)) for r, p in ps.items()) + (left * math.log(left) if own else 0)
        if own and d >= lm.DIVERGENCE and n_a * d >= len(own):
            long[a] = own, left
    out, met = [], 0
    for runs in cuts:
        score = 0.0
        for a, r, x in runs:
            if a in long:
                met += 1
                x = math.log10(long[a][0].get(r, 0) + long[a][1] * 10**x)
            score += x
        out.append(score)
    return out, met


@pytest.mark.parametrize("depth", [1, 3])
def test_scores_match_a_brute_force_tree(spark, depth, monkeypatch):
    monkeypatch.setattr(lm, "WORD", 2e-3)  # so that some words are looked up by the join
    monkeypatch.setattr(lm, "SYMBOL", 4e-3)
    rng = random.Random(6)
    chains = {a: rng.choices("abcdefgh", k=2) for a in "abcdefghijklmnop"}
    rows = []
    for i in range(160):
        w = [rng.choice("abcdefgh")]
        while rng.random() < 0.96:
            w.append(rng.choice(chains[w[-1]]) if rng.random() < 0.9 else rng.choice("abcdefghijklmnop"))
        rows.append((i, " ".join(w + [f"rare{i}"] * (i % 7 == 0))))
    rows += [(200, None), (201, "a b\x1cc A")]
    rows += [(300 + i, t) for i, (_, t) in enumerate(rows[:40])] + [(400 + i, "some%d words met twice only rare%d " % (i // 2, i // 2) + rows[i][1]) for i in range(12)]
    got = {r.doc_id: (r.score, r.held_out) for r in lm.scores(spark.createDataFrame(rows, "doc_id long, text string"), depth=depth, every=3).collect()}
    train = spark.createDataFrame([(t,) for i, t in rows if not got[i][1]], "text string")
    tree = lm.fit(train, lm.word_counts(train).cache(), depth)
    name = lambda w: lm.END if w is None else w.encode()

    def is_anchor(words):
        """The hash written down for one anchor in Python's integers."""
        mix = lambda x: int(lm.mix64(np.array([x % 2**64], dtype=np.uint64))[0])
        one = [mix(tree.at[name(w)] + 2) if name(w) in tree.at else xxhash.xxh3_64_intdigest(name(w)) for w in words[::-1]]
        return mix(one[0] + sum(mix(x + i) for i, x in enumerate(one) if i)) % 3 == 0

    want, met = brute_scores([(t, not got[i][1]) for i, t in rows], depth, is_anchor, lambda w: name(w) not in tree.at)
    assert met > 100 and any(name(w) not in tree.at for _, t in rows for w in tokens(t))
    assert np.allclose([got[i][0] for i, _ in rows], want)
    assert len(tree.states) == depth and all((r < 1).any() for r in tree.rest)


def test_documents_that_occur_twice_score_apart(spark):
    """Both copies train: their tokens are told by the long states, whatever the size of the corpus."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices([f"w{x}" for x in range(2_000)], k=150))) for i in range(300)]
    twice = [i for i in range(0, 300, 10) if all(zlib.crc32(str(x).encode()) % 10 for x in (i, 1_000 + i))]
    rows += [(1_000 + i, rows[i][1]) for i in twice]
    gain = {r.doc_id: (r.score - r.base_score) / r.n_tokens for r in lm.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    apart = {i for i in gain if gain[i] > 1}
    assert apart >= {*twice, *(1_000 + i for i in twice)} and len(apart) == 2 * len(twice)


def test_hot_anchors_and_long_texts(spark):
    """One text in most rows, a text of one word many times, rows without words: nothing is lost, scores are finite."""
    rows = [(i, "one two three four five six seven eight nine ten " * 20) for i in range(200)]
    rows += [(500, "long " * 60_000), (501, ""), (502, None), (None, "x"), (503, "long " * 60_000)]
    got = lm.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(math.isfinite(r.score) and r.score <= 1e-9 for r in got)


def test_every_position_has_its_long_state(spark, monkeypatch):
    """By default no position is left out: the scores are those of a tree in which each four words are an anchor."""
    monkeypatch.setattr(lm, "WORD", 4e-3)
    monkeypatch.setattr(lm, "SYMBOL", 6e-3)
    rng = random.Random(14)
    words = [f"w{i}" for i in range(60)]
    stretch = [rng.choices(words, k=7) for _ in range(40)]
    # copied stretches of seven words between words of which some are in no other text
    rows = [(i, " ".join(w for k in range(6) for w in (*rng.choice(stretch), *rng.choices(words, k=2), f"u{i}x{k}"))) for i in range(120)]
    got = {r.doc_id: (r.score, r.held_out) for r in lm.scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), depth=1).collect()}
    train = spark.createDataFrame([(t,) for i, t in rows if not got[i][1]], "text string")
    tree = lm.fit(train, lm.word_counts(train).cache(), 1)
    want, met = brute_scores([(t, not got[i][1]) for i, t in rows], 1, lambda words: True, lambda w: (lm.END if w is None else w.encode()) not in tree.at)
    assert met > 1_000 and any((lm.END if w is None else w.encode()) not in tree.at for _, t in rows for w in tokens(t))
    assert np.allclose([got[i][0] for i, _ in rows], want)


def test_buckets_and_ranges_are_worked_on_in_slices(monkeypatch):
    """The same from slices of any size, and no arrays of a whole bucket or range but those that are kept."""
    rng = np.random.default_rng(15)
    words = sorted([(lm.END, 3_000), *((b"w%d" % i, 2_000_000 // (i + 1)) for i in range(20_000))], key=lambda x: (-x[1], x[0]))
    tree = lm.Tree(words, 20_000_000, 30_000)
    tree.states, tree.rest = [np.arange(50)], [np.full(50, 0.5)]
    tree.entries = [((np.arange(50)[:, None] * tree.symbols + np.arange(5)).ravel(), np.full(250, 0.1))]
    ids = np.minimum(rng.zipf(1.3, 400_000) - 1, 20_000).astype(np.int32)
    ids[ids == tree.end] = 0
    ids[ids == 20_000] = -1
    sizes = [1, 3, 150_000, 1, 4, 90_000, *[1_000] * 159, 991]
    ids[np.cumsum(sizes) - 1] = tree.end
    row = sizes, lm._planes(ids), zstandard.compress(b" ".join(b"u%d" % i for i in range(int((ids < 0).sum()))))
    found = []
    for size in (1 << 30, 1_000, 50_000):
        monkeypatch.setattr(lm, "SLICE", size)
        b = lm.Bucket(tree, *row, 1)
        n, lp = np.ones(len(b.keys), np.uint32), b.lp[b.one].astype(np.float16)
        found.append([b.base, b.p, b.run, b.lp, b.owner, b.keys, b.one, b.which, *lm.kept_of_range(*(np.concatenate([x, x[::3]]) for x in (b.keys, n, lp)))])
    for other in found[1:]:
        assert all(np.allclose(x, y) if x.dtype == float else (x == y).all() for x, y in zip(found[0], other))
    assert len(found[0][5]) > 100_000 and found[0][8].any() and not found[0][8].all()
    monkeypatch.undo()
    big = np.concatenate([np.sort(rng.integers(0, 1 << 62, 500_000).astype(np.uint64))] * 2)
    n, lp = np.ones(len(big), np.uint32), np.full(len(big), -3.0, np.float16)
    ids = np.tile(ids, 3)[:1_000_000]
    ids[999::1_000] = tree.end
    row = [1_000] * 1_000, lm._planes(ids), zstandard.compress(b" ".join(b"u%d" % i for i in range(int((ids < 0).sum()))))
    for work in (lambda: lm.Bucket(tree, *row, 1), lambda: lm.kept_of_range(big, n, lp)):
        tracemalloc.start()
        work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 90e6


def test_a_settled_table_leaves_no_shuffle_files(spark):
    """On the disk is the table alone, whenever garbage is collected; the session is as before."""
    from histora.llm.common import settled

    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f.name() for f in iter_blocks(manager.getAllBlocks()) if f.name().startswith("shuffle_")}

    def iter_blocks(blocks):
        return [blocks.apply(i) for i in range(blocks.size())]

    before, setting = shuffles(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    table = settled(spark.range(10_000).repartition(5, "id").groupBy((lm.F.col("id") % 7).alias("k")).count(), "counts")
    for _ in range(50):  # removal is asynchronous
        if not (left := shuffles() - before):
            break
        time.sleep(0.1)
    assert not left and table.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
