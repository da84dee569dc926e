"""Public trees, rules of several parents, lifted commits, pruned receipts."""

import hashlib
import random

from pyspark.sql import functions as F

from histora.operators import graph, ordering, policy
from histora.operators.stages import written

KEYS = "scope long, path string, kind int, oid string, hidden boolean"


def sha(data):
    return hashlib.sha1(data).hexdigest()


def encode(files, prefix=""):
    """Plain encoding of {path: (kind, oid)}, by path of the directory."""
    names, out = {}, {}
    for path, (kind, oid) in files.items():
        if path.startswith(prefix):
            name, _, below = path[len(prefix) :].partition("/")
            if below:
                out |= encode(files, prefix + name + "/")
                names[name + "/"] = (b"40000", name, out[prefix + name])
            else:
                names[name + "\0"] = (b"120000" if kind == 2 else b"100755" if kind == 1 else b"100644", name, oid)
    data = b"".join(mode + b" " + name.encode() + b"\0" + bytes.fromhex(oid) for _, (mode, name, oid) in sorted(names.items()))
    return out | {prefix.rstrip("/"): sha(b"tree %d\0" % len(data) + data)}


def test_public_trees_encode_changed_directories_only(spark):
    seen = {
        1: {"a/b/c/d": 0, "a/b/e": 1, "a/f": 0, "g/h/i": 2, "g/j": 0, "k": 0},
        2: {"a/x": 0, "b/y": 0},
        3: {"only/one": 0},
        4: {"x": 0, "y/z": 0},
        None: {"p/q": 0, "r": 0},
    }
    hide = {(1, "a/b/e"), (1, "g/h/i"), (3, "only/one"), (None, "r")}
    rows = [(s, p, k, sha(f"{s}{p}".encode()), (s, p) in hide) for s, files in seen.items() for p, k in files.items()]
    rows += [(4, "sub", 5, sha(b"commit"), False), (4, "y/hidden", 5, sha(b"commit"), True)]
    decided = spark.createDataFrame(rows + rows[:3], KEYS)
    source = {s: encode({p: (k, sha(f"{s}{p}".encode())) for p, k in files.items()}) for s, files in seen.items()}
    trees = spark.createDataFrame([(s, p, i) for s, found in source.items() for p, i in found.items()], "scope long, path string, id string")
    got = {(r.scope, r.path): (r.id, r.encoded, r.error) for r in policy.public_trees(decided, trees, ["scope"], written).collect()}
    want = {(4, "sub"): (None, False, "embedded_repository")}
    for s, files in seen.items():
        if s != 4:
            left = encode({p: (k, sha(f"{s}{p}".encode())) for p, k in files.items() if (s, p) not in hide})
            above = {"/".join(p.split("/")[:i]) for t, p in hide if t == s for i in range(len(p.split("/")))}
            want |= {(s, p): (i, p in above, None) for p, i in left.items()}
    assert got == want
    assert got[3, ""] == (policy.EMPTY_TREE, True, None) and got[1, "a/b/c"][1] is False and got[1, "a/b"][1] is True
    assert policy.public_trees(decided.limit(0), trees.limit(0), ["scope"], written).count() == 0


def test_empty_trees_go_with_their_entry(spark):
    files = {"a/b": (0, sha(b"1"))}
    with_empty = encode(files)
    decided = spark.createDataFrame([("a/b", 0, sha(b"1"), False)], "path string, kind int, oid string, hidden boolean")
    trees = spark.createDataFrame([("", sha(b"old")), ("a", with_empty["a"]), ("void", policy.EMPTY_TREE)], "path string, id string")
    got = {r.path: (r.id, r.encoded) for r in policy.public_trees(decided, trees, [], written).collect()}
    assert got == {"": (with_empty[""], True), "a": (with_empty["a"], False)}
    refused = decided.unionByName(spark.createDataFrame([("m", 5, sha(b"2"), False)], decided.schema))
    assert [(r.path, r.error) for r in policy.public_trees(refused, trees, [], written).collect()] == [("m", "embedded_repository")]


def test_rules_of_parents_merge_or_differ(spark):
    rules = [(p, d, i, t, False, False) for p, d, i, t in [(1, "", 0, "*.key"), (2, "", 0, "*.key"), (2, "sub/", 0, "x"), (3, "", 0, "*.pem"), (3, "sub/", 0, "x")]]
    rules = spark.createDataFrame(rules, "scope long, directory string, line int, pattern string, negated boolean, dir_only boolean")
    parents = spark.createDataFrame([(10, 1), (10, 2), (11, 1), (11, 3), (12, 3), (12, 3), (13, 9)], "commit_id long, parent long")
    merged, differing = policy.rules_of_parents(parents, rules)
    assert sorted((r.commit_id, r.directory, r.pattern) for r in merged.collect()) == [(10, "", "*.key"), (10, "sub/", "x"), (11, "sub/", "x"), (12, "", "*.pem"), (12, "sub/", "x")]
    assert [tuple(r) for r in differing.collect()] == [(11, "")]
    foreign = spark.createDataFrame([(c, p) for c in (10, 11, 12, 13, 14) for p in ("a.key", "b.pem", "sub/x", ".policy")], "commit_id long, path string")
    got = {(r.commit_id, r.path): r.message for r in policy.disclosures_by(foreign, parents, rules, ".policy").collect()}
    assert set(got) == {(10, "a.key"), (10, "sub/x"), (11, "sub/x"), (11, ""), (12, "b.pem"), (12, "sub/x")} | {(c, ".policy") for c in (10, 11, 12, 13, 14)}
    assert got[11, ""] == "parents of 11 differ in the policy of ''" and got[12, "b.pem"] == "12 discloses b.pem"


def test_classes_by_scope(spark):
    columns = "scope long, directory string, line int, pattern string, negated boolean, dir_only boolean"
    private = spark.createDataFrame([(1, "", 0, "a", False, False)], columns)
    ignored = spark.createDataFrame([(1, "", 0, "?", False, False), (2, "", 0, "a", False, False)], columns)
    paths = spark.createDataFrame([(s, p) for s in (1, 2, 3) for p in ("a", "b", "cc")], "scope long, path string")
    got = {(r.scope, r.path): r["class"] for r in policy.classify_by(paths, private, ignored, ["scope"]).collect()}
    assert got == {(1, "a"): "hidden", (1, "b"): "ignored", (1, "cc"): "visible", (2, "a"): "ignored", (2, "b"): "visible", (2, "cc"): "visible", (3, "a"): "visible", (3, "b"): "visible", (3, "cc"): "visible"}
    assert {(r.scope, r.path) for r in policy.leaks_by(paths, private, ["scope"]).collect()} == {(1, "a")}


def test_lift_classes(spark):
    one = lambda names: spark.createDataFrame([(n,) for n in names], "node string")
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("e", "x"), ("e", "a"), ("f", "y"), ("g", "f"), ("g", "d"), ("h", "w"), ("i", "e")], "node string, to_node string")
    # x is mapped to another id, y to itself, w to two; z isn't a commit here
    mapped = spark.createDataFrame([("x", "x1"), ("x", "x1"), ("y", "y"), ("w", "w1"), ("w", "w2"), ("z", "z1")], "node string, canonical string")
    got = graph.lift_classes(one("abcdefghixyw" + "a"), edges, mapped, one("cdz"), one("dz")).collect()
    assert sorted((r.node, r["class"], r.canonical, r.reason) for r in got if r.canonical is None) == [
        ("c", "mirror", None, "hidden"), ("d", "mirror", None, "disclosure"), ("e", "mirror", None, "parent"), ("g", "mirror", None, "parent"), ("h", "mirror", None, "parent"), ("i", "mirror", None, "parent"),
    ]
    assert sorted((r.node, r["class"], r.canonical) for r in got if r.canonical is not None) == [
        ("a", "identity", "a"), ("b", "identity", "b"), ("f", "identity", "f"), ("w", "ambiguous", "w1"), ("w", "ambiguous", "w2"), ("x", "mapped", "x1"), ("y", "mapped", "y"),
    ]
    assert graph.lift_classes(one("a").limit(0), edges.limit(0), mapped.limit(0), one("a").limit(0), one("a").limit(0)).count() == 0


def test_pruned_receipts_lower_their_counters(spark):
    receipts = spark.createDataFrame([("r", "k1", 1), ("r", "k2", 2), ("s", "k1", 3), ("s", "k9", 50), ("t", "k1", 4)], "repo string, key string, at int")
    heads = spark.createDataFrame([("r", "k1", "h1"), ("r", "k1", "h2"), ("s", "k1", "h1"), ("s", "k9", "h1"), ("u", "k1", "h1")], "repo string, key string, head string")
    counters = spark.createDataFrame([("r", 2, 2, "x"), ("s", 2, 1, "y"), ("u", 0, 1, "z")], "repo string, receipts int, heads int, note string")
    for limit, left in ((None, {("s", "k9")}), (3, {("s", "k9"), ("t", "k1")}), (0, {("r", "k1"), ("r", "k2"), ("s", "k1"), ("s", "k9"), ("t", "k1")})):
        r, h, c = ordering.prune_receipts(receipts, heads, counters, ["repo"], "key", F.col("at") < 10, ["at"], limit)
        assert {(x.repo, x.key) for x in r.collect()} == left
        got = {x.repo: (x.receipts, x.heads, x.note) for x in c.collect()}
        assert got == ({"r": (2, 2, "x"), "s": (2, 1, "y"), "u": (0, 1, "z")} if limit == 0 else {"r": (0, 0, "x"), "s": (1, 0, "y"), "u": (0, 1, "z")})
        assert h.count() == (5 if limit == 0 else 2)


def test_bins_over_many_blocks(spark):
    rng = random.Random(12)
    for most_objects, block in ((5, 1), (5, 16), (40, 1), (1, 1)):
        want, data = {}, []
        for g in range(3):
            pack, used, k, alone, total = 0, 0, 0, False, 0
            for i in range(rng.choice([1, 150, 400])):
                n = rng.choice([0, 0, 1, 3, 30, 100, 101, 500])
                if i and (alone or n > 100 or used + n > 100 or k >= most_objects):
                    pack, used, k = pack + 1, 0, 0
                used, k, alone = used + n, k + 1, n > 100
                want[g, i] = -1 if n > 100 else pack
                data.append((g, i, n, total))
                total += n
        df = spark.createDataFrame(data, "g int, i long, n long, before long")
        assert {(r.g, r.i): r["pack"] for r in ordering.assign_packs(df, ["g"], "i", "n", "before", 100, most_objects, block).collect()} == want
    assert ordering.assign_packs(df.limit(0), ["g"], "i", "n", "before", 100, 5).count() == 0


def test_bins_sort_two_blocks_at_a_time(spark):
    n = 200_000
    df = spark.range(n).select(F.lit(0).alias("g"), F.col("id").alias("i"), F.lit(1).cast("long").alias("n"), F.col("id").alias("before"))
    got = ordering.assign_packs(df, ["g"], "i", "n", "before", 1000, 4096, 4096).groupBy("pack").count()
    assert got.where("count <> 1000").count() == 0 and got.count() == n // 1000
