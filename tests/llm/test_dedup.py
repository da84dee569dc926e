"""Exact dedup, SimHash near-dedup and components against brute force."""

import itertools
import random
import uuid

import numpy as np
import pytest
import xxhash
from pyspark.sql import Row

from histora.llm import exact_dedup, simhash
from histora.llm.common import shared_dir
from histora.llm.components import components

DOCS = "doc_id long, text string, source string, digest string, _hot string"


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def index(spark, path=None):
    return exact_dedup.DigestIndex(spark, path or f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", 4)


def test_exact_dedup_cases(spark):
    rows = [(1, "Ab"), (2, "aB"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x " * 50_000), (7, "x " * 50_000), (None, "ab"), (None, "only")]
    docs = spark.createDataFrame([(i, t, "s", "clash", "clash") for i, t in rows], DOCS)
    got = exact_dedup.decisions(docs, index(spark)).collect()
    want = []
    for i, t in rows:
        group = [j for j, u in rows if fold(u) == fold(t)]
        keep = max((j for j in group if j is not None), default=None)
        want.append((i, keep, len(group), i == keep))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=key) == sorted(want, key=key)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 4, 5, 6, 7]
    odd = spark.createDataFrame([(None, "a", "y"), (None, "A", "x"), (3, "b", "z"), (3, "b", "z"), (3, "c", None), (3, "B", "q")], "doc_id long, text string, _row string")
    assert sorted(map(str, (tuple(r) for r in exact_dedup.keep_one(odd).collect()))) == ["(3, 'B', 'q')", "(3, 'c', None)", "(None, 'A', 'x')"]


def test_exact_dedup_empty_and_incremental(spark):
    empty = spark.createDataFrame([], DOCS)
    assert exact_dedup.decisions(empty, index(spark)).count() == 0
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    first = spark.createDataFrame([(1, "a", "", "", ""), (2, "b", "", "", "")], DOCS)
    later = spark.createDataFrame([(8, "A", "", "", ""), (9, "c", "", "", "")], DOCS)
    exact_dedup.decisions(first, index(spark, path)).count()
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.decisions(later, index(spark, path)).collect()}
    assert got == {8: (1, False), 9: (9, True)}
    # an index is opened with the buckets it was made with, whatever a later run asks for, and leaves no table behind
    before = len(spark.catalog.listTables())
    assert exact_dedup.DigestIndex(spark, path, 64).buckets == 4
    rows = exact_dedup.decided(docs := later.unionAll(first), path).collect()
    assert {r.doc_id: (r.keep_id, r.kept) for r in rows} == {1: (1, True), 2: (2, True), 8: (1, False), 9: (9, True)} and docs.count() == 4
    assert len(spark.catalog.listTables()) == before + 1
    assert exact_dedup.buckets_for(0) == 16 and exact_dedup.buckets_for(10**9) == 2_000


def test_hot_digest_is_split(spark):
    docs = spark.range(6_000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'same', cast(id AS string)) AS text")
    got = exact_dedup.decisions(docs, index(spark)).where("text_sha256 = sha2('same', 256)").agg({"group_size": "max", "keep_id": "max", "doc_id": "count"}).first()
    assert sorted(got) == [2_000, 2_000, 5_997]


def brute_print(text, n=3):
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in fold(text)).split(" ") if w]
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))


def brute_groups(ids, prints, errors=3):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, p), (j, q) in itertools.combinations(list(zip(ids, prints)), 2):
        if (p ^ q).bit_count() <= errors:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: find(i) for i in ids}


def test_fingerprints(spark):
    rng = random.Random(1)
    texts = [None, "", " \n", "one", "Two words", "a b c", "A B c d\x0be\x1cf é ß", "w " * 30_000] + [" ".join(rng.choices("ab cd ef gh ij".split(), k=rng.randint(1, 80))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in simhash.groups(docs).collect()}
    assert got == {i: f"{brute_print(t):016x}" for i, t in enumerate(texts)}


def test_fingerprints_of_long_texts_a_piece_at_a_time():
    rng = random.Random(6)
    for size in (0, 1, 2, 3, 500):
        text = " ".join(rng.choices("Ab cd\x0bEF \x1cg é".split(" "), k=size))
        assert simhash.print_of_long(text.encode(), 3, 7) == int(simhash.fingerprints_of([text.encode()], 3)[0]) == brute_print(text)


@pytest.mark.parametrize("crowd", [4_096, 2])
def test_links_find_all_groups(spark, crowd):
    rng = random.Random(2)
    prints = set()
    for _ in range(60):
        p = rng.getrandbits(64)
        prints.add(p)
        for _ in range(rng.randint(0, 12)):
            q = p
            for b in rng.sample(range(64), rng.randint(1, 5)):
                q ^= 1 << b
            prints.add(q)
    prints = sorted(prints)
    ids = list(range(len(prints)))
    rng.shuffle(ids)
    reps = spark.createDataFrame([(p - (p >> 63 << 64), i) for i, p in zip(ids, prints)], "fp long, rep_id long")
    found = {r.node: r.component for r in components(simhash.links(reps, crowd=crowd)).collect()}
    assert {i: found.get(i, i) for i in ids} == brute_groups(ids, prints)


def test_simhash_cases(spark):
    rows = [(5, "same text here now"), (2, "SAME text here now"), (9, None), (4, ""), (None, "same text here now"), (2, "SAME text here now")]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, fp="clash", key="clash") for i, t in rows])
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash.groups(docs).collect())
    assert got == [(0, 2), (2, 2), (2, 2), (4, 4), (5, 2), (9, 4)]
    assert simhash.groups(docs.limit(0)).count() == 0
    assert simhash.keep_one(docs).columns == docs.columns


def test_components_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(3, 3)]
    edges = spark.createDataFrame(chain, "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in range(7, 60)}


def test_dense_group_is_connected():
    rng = np.random.default_rng(3)
    base = np.uint64(0x123456789ABCDEF0)
    flips = rng.integers(0, 48, size=(3_000, 3))
    keys = np.unique(base ^ (np.uint64(1) << flips[:, 0].astype(np.uint64)) ^ (np.uint64(1) << flips[:, 1].astype(np.uint64)) ^ (np.uint64(1) << flips[:, 2].astype(np.uint64)))
    keys &= np.uint64(2**48 - 1)
    keys = np.unique(keys)
    a, b = simhash.linked([np.zeros(len(keys), dtype=np.int64)], keys, np.arange(len(keys)), 47, 3)
    assert len(a) == len(keys) - 1 and set(b) == {0}
