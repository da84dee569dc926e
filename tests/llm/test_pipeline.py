"""Each stage of the pipeline against brute force on its own input."""

import math
import random
from collections import Counter

import public_tokenizers
from test_dedup import brute_groups, brute_print, fold
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from histora.llm import exact_dedup, mixing, simhash, toxicity


def corpus(spark, path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=rng.randint(2, 6)))
    rude = ["vilefool", "vilefools", "oafish"]
    rows, labels = [], []
    for i in range(240):
        text = [word() for _ in range(rng.randint(0, 90))]
        toxic = i % 6 == 0
        if toxic:
            text = text[:40]
            for _ in range(8):
                text.insert(rng.randint(0, len(text)), rng.choice(rude))
        rows.append((i, " ".join(text), "en", f"src{i % 4}" if i % 50 else None, 0))
        labels.append((i, 1, int(toxic)))
    for i in range(240, 300):
        old = rows[rng.randrange(240)][1]
        new = old.upper() if i % 2 else old + " " + word()
        rows.append((i, new, "en", "src1", 0))
    rows += [(300, None, None, "src0", None), (301, "", None, "src0", 0), (None, "no id here", None, "src2", 10)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rude


def test_stages(spark, tmp_path):
    path = f"file://{tmp_path}/in"
    rude = corpus(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs if not i else spark.read.parquet(kept[-1]), path).write.parquet(out := f"file://{tmp_path}/{i}")
        kept.append(out)
    before = [docs.collect(), *(spark.read.parquet(p).collect() for p in kept)]
    for rows in before[1:5]:
        assert rows[0].__fields__ == docs.columns
    # toxicity: the documents with planted words, and no others
    bad = {r.doc_id for r in before[0] if any(w in fold(r.text).split() for w in rude)}
    assert {r.doc_id for r in before[0]} - {r.doc_id for r in before[1]} == bad
    # exact dedup: the largest id of each group of equal texts
    want = {}
    for r in before[1]:
        want[fold(r.text)] = max(want.get(fold(r.text), -1), -1 if r.doc_id is None else r.doc_id)
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in before[2]) == sorted(want.values())
    # SimHash: the smallest id of each component
    named = [r for r in before[2] if r.doc_id is not None]
    groups = brute_groups(*zip(*sorted((r.doc_id, brute_print(r.text)) for r in named)))
    assert sorted(r.doc_id for r in before[3] if r.doc_id is not None) == sorted(set(groups.values()))
    assert len(before[3]) == len(set(groups.values())) + 1
    # mixing: what a source gets is its target but for half a block of rounding and one more or less of its last, short
    # block; no document is taken more than three times
    size, taken, of = Counter(), Counter(), Counter()
    for r in before[3]:
        size[r.doc_id] += len(fold(r.text).split())
        of[r.source] += len(fold(r.text).split())
    for r in before[4]:
        taken[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    names = sorted(of, key=lambda s: (s is None, s or ""))
    for s, target in zip(names, mixing.targets([(s, of[s]) for s in names])):
        assert abs(sum(len(r.text.split()) for r in before[4] if r.source == s) - target) <= 1.5 * mixing.BLOCK
    assert all(taken[i] <= 3 * size[i] for i in taken)
    # BPE: as the tokenizers library
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    ids = sorted((r.doc_id or -1, t.encode(r.text, add_special_tokens=False).ids) for r in before[4])
    assert sorted((r.doc_id or -1, r.ids) for r in before[5]) == ids
    # the whole run gives the same rows
    again = sorted((r.doc_id or -1, r.ids) for r in corpus_pipeline.run(spark, path).collect())
    assert again == ids


def test_toxicity_cases(spark):
    docs = spark.createDataFrame([(1, None, "clash"), (2, "", "clash"), (2, "", "clash"), (None, "x " * 60_000, "clash")], "doc_id long, text string, toxic string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.fit(docs, none) is None
    assert [r.toxic for r in toxicity.severity(docs, None).collect()] == [False] * 4
    assert toxicity.accepted(docs, none).count() == 4
    rude = spark.createDataFrame([(i, f"plain words here w{i} " + "awfuloaf " * (i % 2 * (1 + i % 5))) for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(80)] + [(3, 0, None), (None, 0, 1), (999, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(rude, labels)
    got = {r.doc_id: r for r in toxicity.severity(rude, model).collect()}
    assert all(got[i].toxic == bool(i % 2) for i in range(80))
    assert got[1].severity < got[9].severity
    assert {r.toxic for r in toxicity.severity(docs, model).collect()} == {False}
    assert toxicity.accepted(docs, labels).columns == docs.columns
    assert toxicity.severity(docs.limit(0), model).count() == 0


def test_mixing_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string, s int")
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed_documents(empty).count() == 0
    rows = [(1, None, "a", 0), (2, "", None, 0), (3, "one two three", None, 0), (3, "one two three", None, 0), (4, "w " * 50_000, "b", 0), (None, "x y", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, s int")
    got = mixing.mix(docs).collect()
    # all words that the mix takes are someone's, also where ids repeat
    sized = mixing.placed(docs)
    plan = mixing.Plan(sized, 1)
    assert sum(r.taken for r in mixing.mix(docs, block=1).collect()) == sum(plan.slots)
    clash = docs.selectExpr("*", "1 AS _runs", "2 AS _row", "3 AS _n", "4 AS unit", "5 AS rows", "6 AS _key", "7 AS size", "8 AS doc", "9 AS block").unionAll(docs.selectExpr("*", "1", "2", "3", "4", "5", "6", "7", "8", "9").where("doc_id = 4"))
    mixed = mixing.mixed_documents(clash, block=1)
    assert mixed.columns == clash.columns
    assert sum(len(r.text.split()) for r in mixed.collect()) == sum(mixing.Plan(mixing.placed(clash), 1).slots)
    assert sorted(r["size"] for r in got) == [0, 0, 2, 3, 3, 50_000] and all(r.taken <= 3 * r["size"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    assert mixing.targets([("a", 10), ("b", 10), ("c", 1)]) == [9.0, 9.0, 3.0] or sum(mixing.targets([("a", 10), ("b", 10), ("c", 1)])) == 21


def test_permutation_is_one_and_taken_matches_brute_force(spark):
    import numpy as np

    for n in (1, 2, 3, 5, 64, 1_000):
        assert sorted(mixing.permuted(np.arange(n), n, 7)) == list(range(n))
    docs = spark.createDataFrame([(i, "w " * (i * 7 % 83), f"s{i % 3}") for i in range(90)], "doc_id long, text string, source string")
    plan = mixing.Plan(mixing.placed(docs), 32)
    slots = Counter((r.s, r.block) for r in mixing.drawn(spark, plan, mixing.SEED).collect())
    at, want = Counter(), {}
    keyed = mixing.placed(docs).where("size > 0").withColumn("_key", F.xxhash64("doc_id", "size"))
    order = mixing.running_sum(keyed, ["source"], "_key", "size", "at", plan.rows).collect()
    for r in order:
        s = plan.names.index(r.source)
        want[r.doc_id] = sum(slots[s, w // 32] for w in range(r.at, r.at + r["size"]))
        at[s] += r["size"]
    assert {r.doc_id: r.taken for r in mixing.mix(docs).collect() if r["size"]} == want


def brute_topk(rows, k):
    """(query_id, rank, vec_id, score) of rows (vec_id, vector of integers), None last among ties."""
    out = []
    for i, (q, u) in enumerate(rows):
        if q is not None and q % 50 == 0:
            scores = [(-sum(x * y for x, y in zip(u, v)), c is None, c or 0, c) for j, (c, v) in enumerate(rows) if j != i]
            out += [(q, r, c, -s) for r, (s, _, _, c) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def test_topk_cases(spark, tmp_path):
    import duckdb

    from histora.llm import topk

    rng = random.Random(11)
    rows = [(i, [rng.randint(-8, 8) / 8 for _ in range(6)]) for i in range(0, 300)]
    rows += [(50, rows[50][1]), (50, [1.0] * 6), (7, [3.0, 0.5]), (7, [1.0, 2.0]), (None, [2.0] * 6), (None, [2.0] * 6), (8, []), (100, rows[100][1]), (200, [1.0] * 600)]
    odd = [(9, None), (150, [1.0, None]), (10, [float("nan")]), (11, [float("inf"), 1.0])]
    frame = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows + odd], "vec_id long, embedding array<float>, vector string, row int").repartition(5)
    v = topk.integers(frame)
    whole = [(i, [math.floor(256 * x) for x in w]) for i, w in rows]
    for k in (3, 5):
        got = [tuple(r) for r in topk.top_k(v, v.where("vec_id % 50 = 0"), k).collect()]
        assert sorted(got, key=str) == brute_topk(whole, k)
    frame.select("vec_id", "embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(duck.execute(topk.ORACLE).fetchall(), key=str) == brute_topk(whole, 5)
    small = topk.integers(frame.where("vec_id IN (0, 1)"))
    assert topk.top_k(small, small.where("vec_id = 0")).count() == 1
    none = v.limit(0)
    assert topk.top_k(none, none).count() == 0


def test_topk_groups(spark, monkeypatch):
    from histora.llm import topk

    monkeypatch.setattr(topk, "CANDIDATES", 16)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rng = random.Random(12)
    rows = [(i, [rng.randint(-3, 3) for _ in range(4)]) for i in range(1_000)]
    v = topk.integers(spark.createDataFrame([(i, [x / 256 for x in w]) for i, w in rows], "vec_id long, embedding array<double>"))
    assert sorted((tuple(r) for r in topk.top_k(v, v.where("vec_id % 50 = 0")).collect()), key=str) == brute_topk(rows, 5)



def test_stages_keep_any_columns(spark):
    """Names with dots and blanks, maps, repeated rows and ids, nulls: each stage gives whole rows back."""
    texts = [None, "", "one two three four", "One two three four", "vile gross nasty words", "calm words here", "calm words here"]
    rows = [(i % 5, t, "s", {"k": i // 2}, [{"x": 1}], 3) for i, t in enumerate(texts)] * 2 + [(None, "calm words here", None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, m map<string,int>, n array<map<string,int>>, k int").withColumnsRenamed({"m": "a.b", "n": "a b`c", "k": "_row"})
    labels = spark.createDataFrame([(i, int(i != 4), int(i == 4)) for i in range(5)], "doc_id long, quality int, toxic int")
    for stage in (lambda d: toxicity.accepted(d, labels), exact_dedup.keep_one, simhash.keep_one, lambda d: mixing.mixed_documents(d, block=2)):
        out = stage(docs)
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all(r[3] is None or isinstance(r[3], dict) for r in got)
        assert stage(docs.limit(0)).count() == 0
    kept = exact_dedup.keep_one(docs).collect()
    assert len(kept) == len({(r.text or "").lower() for r in kept}) == len({(t or "").lower() for t in texts})


def test_mixing_sends_no_slots_or_blocks_through_the_driver(spark, monkeypatch):
    """A few rows become very many slots and blocks; Spark, going by the rows that they are made of, would broadcast them."""
    docs = spark.range(40).selectExpr("id AS doc_id", "repeat('one two three four ', 2000) AS text", "concat('s', id % 2) AS source")
    plans, write = [], mixing.written

    def seen(df):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
        return df

    monkeypatch.setattr(mixing, "written", lambda df, name: write(seen(df), name))
    for made in (mixing.mixed_documents, mixing.mix):
        plans.clear()
        seen(made(docs))
        joins = [line for plan in plans for line in plan.split("\n") if "Join [" in line and " block#" in line]
        assert joins and all("SortMergeJoin" in line for line in joins)
