"""Operators on small hand-made tables, against expected rows or a plain Python form."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from histora.functions import identity
from histora.operators import codecs, graph, journal, ordering, policy, relations
from histora.operators.stages import written
from histora.plans.registry import QUERIES


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ------------------------------------------------------------------ identity


def test_content_id_and_digest(spark):
    df = spark.createDataFrame([(0, b""), (0, b"hello\n"), (1, b""), (7, b"x"), (0, None)], "kind int, data binary")
    got = [r[0] for r in df.select(identity.content_id(F.col("kind"), F.col("data"))).collect()]
    assert got[:3] == ["e69de29bb2d1d6434b8b29ae775ad8c2e48c5391", "ce013625030ba8dba906f756967f9e9ca394464a", "4b825dc642cb6eb9a060e54bf8d69288fbee4904"]
    assert got[3:] == [None, None]
    digest = [r[0] for r in df.select(identity.digest64(F.col("data"))).collect()]
    assert bytes(digest[1]) == hashlib.blake2b(b"hello\n").digest() and digest[4] is None


def test_names_people_and_addresses(spark):
    df = spark.createDataFrame([("a",)], "x string")
    one = lambda c: df.select(c).first()[0]
    assert bytes(one(identity.change_id(F.lit("zyxwvutsrqponmlkZYXWVUTSRQPONMLK")))) == bytes.fromhex("0123456789abcdef" * 2)
    assert one(identity.change_id(F.lit("a" * 32))) is None
    person = one(identity.signature(F.lit("A B <a@b> 12 -0130")))
    assert tuple(person) == ("A B", "a@b", 12, -90)
    assert one(identity.signature(F.lit("A <a@b> 12 +0160"))) is None
    for name, ok in (("main", True), ("a/b", True), ("a..b", False), ("x.lock", False), ("a b", False), ("a/.b", False), ("a@{b", False), ("", False), ("-x", False)):
        assert one(identity.is_branch_name(F.lit(name))) is ok, name
    assert one(identity.has_credentials(F.lit("https://u:p@h/x"))) and not one(identity.has_credentials(F.lit("https://h/u:p@x")))
    assert one(identity.redact_userinfo(F.lit("https://u:p@h/x"))) == "https://h/x"
    assert one(identity.repo_name_from_url(F.lit("git@h:team/thing.git/?x#y"))) == "thing"
    assert one(identity.push_outcome(F.lit("!"), F.lit("[rejected] (stale info)"))) == "lease-rejected"


def test_header_rewrite(spark):
    df = spark.createDataFrame([([("tree", "t"), ("parent", "p"), ("author", "a"), ("gpgsig", "s"), ("x", "y")], ["q", "r"])], "headers array<struct<name string, value string>>, parents array<string>")
    got = df.select(identity.with_headers(F.col("headers"), F.lit("new"), F.col("parents"), ["gpgsig"]).alias("h")).first().h
    assert [tuple(h) for h in got] == [("tree", "new"), ("parent", "q"), ("parent", "r"), ("author", "a"), ("x", "y")]


# ------------------------------------------------------------------ codecs


def tree_bytes(entries):
    return b"".join(mode + b" " + name + b"\0" + oid for mode, name, oid in entries)


ENTRIES = [(b"100644", b"a", b"1" * 20), (b"40000", b"a.b", b"2" * 20), (b"100755", b"a0", b"3" * 20), (b"160000", b"z", b"4" * 20)]


def test_trees_and_every_mutation(spark):
    good = tree_bytes(ENTRIES)
    assert [e[:2] for e in codecs.parse_tree(good)[0]] == [(0, b"a"), (3, b"a.b"), (1, b"a0"), (5, b"z")]
    ends = {len(tree_bytes(ENTRIES[:i])) for i in range(5)}
    for n in range(len(good)):
        assert (codecs.parse_tree(good[:n])[1] is None) == (n in ends)
    assert codecs.parse_tree(tree_bytes(ENTRIES[::-1]))[1] == "order" and codecs.parse_tree(tree_bytes([ENTRIES[0]] * 2))[1] == "name_repeated"
    flipped = [good[:i] + bytes([good[i] ^ 1]) + good[i + 1 :] for i in range(len(good))]
    sha = hashlib.sha1(b"tree %d\0" % len(good) + good).hexdigest()
    objects = spark.createDataFrame([(1, f"{sha}", f) for f in flipped] + [(1, sha, good)], "kind int, id string, bytes binary")
    audited = codecs.audit_objects(objects)
    assert audited.where("rule = 'id_differs'").count() == len(good)
    assert codecs.tree_entries(objects.where(F.col("bytes") == F.lit(good))).count() == 4


def test_an_object_too_large_is_audited_by_the_other_rules_too(spark, tmp_path):
    entries = [(b"100644", b"f%08d" % i, b"1" * 20) for i in range(30_000)]
    good = tree_bytes(entries)
    parsed, error = codecs.parse_tree(good)
    assert len(good) > 1 << 20 and error is None and [e[1] for e in parsed] == [e[1] for e in entries]
    sha = hashlib.sha1(b"tree %d\0" % len(good) + good).hexdigest()
    objects = spark.createDataFrame([(1, sha, good), (1, "cut", good[:-1])], "kind int, id string, bytes binary")
    assert rows(codecs.audit_objects(objects)) == sorted([(1, sha, "too_large"), *((1, "cut", r) for r in ("too_large", "id_differs", "id_truncated"))])
    # nations of very many and of few customers
    customers = spark.range(30_010).selectExpr("id AS c_custkey", "format_string('Customer#%09d', id) AS c_name", "CAST(if(id < 30000, 1, 2) AS INT) AS c_nationkey")
    customers.write.parquet(f"{tmp_path}/customer.parquet")
    assert rows(QUERIES["object_audit"](spark, str(tmp_path))) == [(1, "id_differs", 2), (1, "id_truncated", 2)]


COMMIT = b"tree " + b"a" * 40 + b"\nparent " + b"b" * 40 + b"\nparent " + b"c" * 40 + b"\nauthor A <a> 1 +0000\ncommitter C <c> 2 +0000\nchange-id zzz\ngpgsig one\n two\n\nsubject\n\nbody"


def test_commits(spark):
    facts = codecs.parse_commit(COMMIT)
    assert facts["error"] is None and facts["parents"] == ["b" * 40, "c" * 40] and facts["message"] == b"subject\n\nbody" and facts["change"] == "zzz"
    for bad in (COMMIT[:20], COMMIT.replace(b"tree ", b"tree x"), COMMIT.replace(b"author", b"auth"), COMMIT.replace(b"gpgsig", b"author"), b" x\n\n", COMMIT.replace(b"\n\n", b"\n", 1)[:300].replace(b"\n\n", b"")):
        assert codecs.parse_commit(bad)["error"], bad
    objects = spark.createDataFrame([(2, "k", COMMIT), (1, "t", tree_bytes(ENTRIES))], "kind int, id string, bytes binary")
    refs = rows(codecs.object_refs(objects))
    assert (2, "k", 3, "a" * 40) in refs and (2, "k", 4, "c" * 40) in refs and len([r for r in refs if r[0] == 1]) == 4


def manifest(objects, chunk=64 << 10):
    import struct

    data = b"".join(d for _, _, d in objects)
    parts = [data[i : i + chunk] for i in range(0, len(data), chunk)]
    hash64 = lambda b: hashlib.blake2b(b).digest()
    head = struct.pack("<4sHHIIIIQ", codecs.MAGIC, 2, 0, chunk, 1, len(objects), len(parts), len(data)) + hash64(data)
    at, entries = 0, b""
    for kind, oid, d in objects:
        entries += struct.pack("<B7x20sQQ", kind, oid, at, len(d))
        at += len(d)
    return head + b"h" * 20 + entries + b"".join(struct.pack("<QI4x64s", i * chunk, len(p), hash64(p)) for i, p in enumerate(parts)), parts


def test_packs(spark, tmp_path):
    from histora.sources import readers

    good, parts = manifest([(0, b"a" * 20, b"x" * 70_000), (1, b"b" * 20, b"y" * 10)])
    assert codecs.parse_manifest(good)["error"] is None
    for n in range(0, len(good), 7):
        assert codecs.parse_manifest(good[:n])["error"]
    (tmp_path / "one").write_bytes(good)
    (tmp_path / "two").write_bytes(good[:-1])
    tables = readers.read_packs(spark, str(tmp_path))
    assert tables["rejected"].count() == 1 and tables["objects"].count() == 2 and tables["heads"].count() == 1
    pack = tables["packs"].first().pack_id
    stored = spark.createDataFrame([(pack, i, p) for i, p in enumerate(parts)], "pack_id binary, position int, chunk binary")
    assert codecs.audit_packs(tables["packs"], tables["chunks"], stored).count() == 0
    wrong = stored.withColumn("chunk", F.when(F.col("position") == 1, F.lit(b"z" * len(parts[1]))).otherwise(F.col("chunk")))
    assert {r.rule for r in codecs.audit_packs(tables["packs"], tables["chunks"], wrong).collect()} == {"digest", "pack_digest"}


def test_ref_terms(spark):
    df = spark.createDataFrame([("a", ["x"]), ("b", ["x", None, "y"]), ("c", ["x", "y"])], "name string, terms array<string>")
    assert sorted(map(str, rows(codecs.ref_terms(df).where("id IS NOT NULL")))) == sorted(map(str, [("a", 0, "x", True), ("b", 0, "x", True), ("b", 2, "y", True)]))


# ------------------------------------------------------------------ sources


def test_readers(spark, tmp_path):
    from histora.sources import readers

    (tmp_path / "v").write_text("# c\nblob|AB|6869\ntree|cd|\n")
    assert [(r.kind, r.id, bytes(r.payload)) for r in readers.read_object_vectors(spark, str(tmp_path / "v")).collect()] == [("blob", "ab", b"hi"), ("tree", "cd", b"")]
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "good").write_text("a" * 40 + "\trefs/heads/x/y\n" + "b" * 40 + "\trefs/heads/z\n")
    (tmp_path / "l" / "bad").write_text("a" * 40 + "\trefs/tags/x\n")
    (tmp_path / "l" / "twice").write_text(("a" * 40 + "\trefs/heads/x\n") * 2)
    good, rejected = readers.read_ref_listings(spark, str(tmp_path / "l"), spark.createDataFrame([("x/y",)], "ref string"))
    assert [r.oid for r in good.collect()] == ["a" * 40] and {r.code for r in rejected.collect()} == {"bad_line", "repeated_ref"}
    (tmp_path / "r").write_text('{"incarnation":"i","machineId":"m"}\n{"incarnation":"i","machineId":"m","x":1}\nno\n')
    ok, bad = readers.read_requests(spark, str(tmp_path / "r"), "claim")
    assert ok.count() == 1 and sorted(r.code for r in bad.collect()) == ["not_json", "unknown_field"]
    (tmp_path / "h").write_text('{"incarnation":"i","idempotencyKey":"k","newHead":"%s","observedHeads":["b","a"]}\n{"incarnation":"i","idempotencyKey":"k","newHead":"%s","observedHeads":["a","a"]}' % ("1" * 128, "1" * 128))
    ok, bad = readers.read_requests(spark, str(tmp_path / "h"), "heads")
    assert ok.first().observedHeads == ["a", "b"] and bad.first().code == "repeated_head"
    assert readers.request_hash(ok).first().fingerprint
    (tmp_path / "p").write_text('[repos.a]\nurl = "u"\nmode = "ref"\nref = "main"\nother = 3\n')
    pins = readers.read_pins(spark, str(tmp_path / "p"))
    assert pins.first().extra == {"other": "3"} and readers.select_pins(pins, spark.createDataFrame([("b",)], "alias string"))[1].count() == 1
    path = str(tmp_path / "t")
    spark.createDataFrame([("k", 1)], "id string, v int").write.parquet(path)
    assert readers.append_objects(spark.createDataFrame([("k", 1), ("n", 2), ("n", 2)], "id string, v int"), path, ["id"], "v") == {"inserted": 1, "existing": 1, "conflicts": 0}
    assert readers.append_objects(spark.createDataFrame([("k", 2)], "id string, v int"), path, ["id"], "v")["conflicts"] == 1
    assert spark.read.parquet(path).count() == 2
    readers.write_table(spark.range(100).withColumn("g", F.col("id") % 2), str(tmp_path / "w"), ["id"], 3, ["g"])
    assert spark.read.parquet(str(tmp_path / "w")).count() == 100


# ------------------------------------------------------------------ graph, ordering


def test_cycles_and_diamonds(spark):
    e = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("x", "y"), ("y", "x"), ("z", "x")]
    edges = spark.createDataFrame(e, "node string, to_node string")
    nodes = spark.createDataFrame([(n,) for n in "abcdxyz"], "node string")
    assert rows(graph.closure(nodes.where("node = 'a'"), edges, ["node"])) == [("a",), ("b",), ("c",), ("d",)]
    levels = {r.node: r.level for r in graph.topo_levels(nodes, edges).collect()}
    assert levels == {"d": 0, "b": 1, "c": 1, "a": 2, "x": None, "y": None, "z": None}
    assert {r.node for r in graph.propagate(nodes, edges, nodes.where("node = 'd'")).where("changed").collect()} == set("abcd")
    pairs = spark.createDataFrame([("d", "a"), ("a", "d"), ("y", "z")], "a string, b string")
    assert {(r.a, r.b): r.is_ancestor for r in graph.is_ancestor(pairs, edges).collect()} == {("d", "a"): True, ("a", "d"): False, ("y", "z"): True}


@pytest.mark.parametrize("seed", range(3))
def test_next_fit_is_the_greedy_one(spark, seed):
    rng = random.Random(seed)
    sizes = {g: [rng.choice([rng.randint(0, 40), rng.randint(0, 12), 120]) for _ in range(rng.randint(1, 70))] for g in range(4)}
    want, data = {}, []
    for g, own in sizes.items():
        pack, used, k, alone, total = 0, 0, 0, False, 0
        for i, n in enumerate(own):
            if i and (alone or n > 100 or used + n > 100 or k >= 8):
                pack, used, k = pack + 1, 0, 0
            used, k, alone = used + n, k + 1, n > 100
            want[g, i] = -1 if n > 100 else pack
            data.append((g, i, n, total))
            total += n
    df = spark.createDataFrame(data, "g int, i long, n long, before long")
    got = {(r.g, r.i): r["pack"] for r in ordering.assign_packs(df, ["g"], "i", "n", "before", 100, 8).collect()}
    assert got == want


def test_chunks_round_trip(spark):
    df = spark.createDataFrame([(i, bytes(range(i % 256)) * 5) for i in range(40)], "k int, data binary")
    parts = ordering.chunk(df, ["k"], "data", 64)
    back = {r.k: bytes(r.bytes) for r in ordering.reassemble(parts.repartition(7), ["k"], "position", "chunk").collect()}
    assert back == {i: bytes(range(i % 256)) * 5 for i in range(1, 40)}
    assert ordering.layout_audit(parts, ["k"], "position").count() == 0


# ------------------------------------------------------------------ journal


def fold(log):
    heads, out = set(), []
    for new, observed in log:
        heads = heads - set(observed) | {new}
        out.append(set(heads))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_head_set_is_the_fold(spark, seed):
    rng = random.Random(seed)
    logs = {g: [(rng.randint(0, 6), [rng.randint(0, 6) for _ in range(rng.randint(0, 3))]) for _ in range(30)] for g in range(5)}
    df = spark.createDataFrame([(g, i + 1, n, o) for g, log in logs.items() for i, (n, o) in enumerate(log)], "g int, c long, new_head long, observed array<long>")
    intervals = journal.head_intervals(df, ["g"], "c").cache()
    for at in (1, 7, 30):
        live = {(r.g, r.head) for r in ordering.heads_as_of(intervals, at).collect()}
        assert live == {(g, h) for g, log in logs.items() for h in fold(log)[at - 1]}


def test_batches_and_requests(spark):
    e = [
        ("r", 1, "begin", "b1", "m", None, "1", None, 0), ("r", 2, "begin", "b2", "m", None, "2", None, 0), ("r", 3, "recover", "b1", "m", None, None, "1", 0),
        ("r", 4, "begin", "b2", "m", None, "2", None, 0), ("r", 5, "begin", "b2", "m", "1", "2", None, 0), ("r", 6, "claim", "b2", "m", None, None, None, 3),
        ("r", 7, "recover", "b2", "m", None, None, "2", 2), ("r", 8, "recover", "b2", "m", None, None, "1", 3), ("r", 9, "recover", "b2", "m", None, None, "9", 3), ("r", 10, "recover", "b1", "m", None, None, "9", 0),
    ]
    df = spark.createDataFrame(e, "repo string, sequence long, kind string, batch_id string, bookmark string, expected string, proposed string, observed string, fence int")
    want = ["begun", "ref_owned", "accepted", "stale_expectation", "begun", "claimed", "stale_fence", "replay_required", "ambiguous", "settled"]
    for parts in (1, 5):
        assert [r.outcome for r in sorted(journal.replay_batches(df.repartition(parts)).collect(), key=lambda r: r.sequence)] == want
    log = spark.createDataFrame([(1, "k", "f"), (2, "k", "f"), (3, "k", "g"), (4, None, "f")], "seq long, key string, fp string")
    assert [r.outcome for r in journal.dedup_requests(log.where("key IS NOT NULL"), ["key"], "seq", "fp").orderBy("seq").collect()] == ["first", "replay", "mismatch"]


def test_verdict_order_and_nulls(spark):
    refs = spark.createDataFrame([("same", "m", "1", "1"), ("new", "m", None, "1"), ("gone", "m", "1", None), ("odd", "m", "1", "2")], "batch_id string, bookmark string, expected string, proposed string")
    seen = spark.createDataFrame([("same", "m", "1"), ("new", "m", None), ("gone", "m", None), ("odd", "x", "1")], "batch_id string, bookmark string, observed string")
    claims = spark.createDataFrame([("new",)], "batch_id string")
    assert dict(rows(relations.batch_verdicts(refs, seen, claims))) == {"same": "accepted", "new": "replay_required", "gone": "accepted", "odd": "invalid"}


# ------------------------------------------------------------------ policy


def test_rules(spark):
    files = spark.createDataFrame([(1, ".policy", "# c\n\nsecret/\n*.key\n!keep.key\n/top"), (1, "sub/.policy", "!x.key\nlocal?")], "scope int, path string, text string")
    rules = [(r.directory, r.line, r.pattern, r.negated, r.dir_only) for r in policy.policy_rules(files).collect()]
    paths = ["secret/keep.key", "a.key", "keep.key", "sub/x.key", "sub/y.key", "sub/local1", "local1", "top", "sub/top", "secret", "sub/secret/z", ".policy"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r.path: r.hidden for r in policy.decide(df, rules, ".policy").collect()}
    assert [p for p in paths if got[p]] == ["secret/keep.key", "a.key", "sub/y.key", "sub/local1", "top", "sub/secret/z", ".policy"]
    assert policy.leaks(df, rules).count() == 6
    anomalies = spark.createDataFrame([(1, "sub/.policy", 0, 2), (1, ".policy", 0, 1)], "scope int, path string, kind int, n_terms int")
    bad = policy.policy_anomalies(anomalies, ".policy", [0, 1])
    assert rows(bad) == [(1, "sub/.policy", "conflicted")]
    held = policy.withheld(df.withColumn("scope", F.lit(1)), bad)
    assert {r.path for r in held.collect()} == {p for p in paths if p.startswith("sub/")}


def test_overlay_forced(spark):
    side = lambda x: spark.createDataFrame(x, "path string, oid string")
    base, left, right = side([("a", "1"), ("b", "1"), ("c", "1")]), side([("a", "1"), ("b", "2"), ("d", "9")]), side([("a", "3"), ("b", "4"), ("c", "1"), ("d", "9")])
    got = {r.path: r.oid or tuple(r.conflict) for r in policy.overlay(base, left, right, side([("d", "")])).collect()}
    assert got == {"a": "3", "b": ("2", "1", "4"), "d": ("9", None, "9")}


def test_tree_ids_match_plain_encoding(spark):
    sha = lambda b: hashlib.sha1(b).hexdigest()
    files = {"a": 0, "a.b/x": 1, "a0": 2, "d/e/f": 0, "d/e.g": 0, "d/e0": 0}
    df = spark.createDataFrame([(1, p, k, sha(p.encode())) for p, k in files.items()], "commit int, path string, kind int, oid string")

    def tree(prefix):
        names = {}
        for p, k in files.items():
            if p.startswith(prefix):
                name, _, below = p[len(prefix) :].partition("/")
                names[name] = (b"40000", tree(prefix + name + "/")) if below else ((b"100644", b"100755", b"120000")[k], sha(p.encode()))
        order = sorted(names, key=lambda n: n + ("/" if names[n][0] == b"40000" else "\0"))
        data = b"".join(names[n][0] + b" " + n.encode() + b"\0" + bytes.fromhex(names[n][1]) for n in order)
        assert codecs.parse_tree(data)[1] is None
        return sha(b"tree %d\0" % len(data) + data)

    got = {r.path: r.id for r in policy.tree_ids(df, ["commit"], written).collect()}
    assert got == {p: tree(p + "/" if p else "") for p in ("", "a.b", "d", "d/e")}


def test_written_survives(spark):
    df = written(spark.range(5), "five")
    assert df.count() == 5 and df.inputFiles()


def test_walks_end_at_levels_and_hits(spark):
    edges = spark.createDataFrame([(i, i - 1) for i in range(1, 12)] + [(20, 5), (20, 11), (5, 30)], "node long, to_node long")
    pairs = spark.createDataFrame([(3, 9), (9, 3), (30, 20), (4, 20), (7, 7), (10, 5), (99, 20)], "a long, b long")
    levels = graph.topo_levels(spark.createDataFrame([(i,) for i in [*range(12), 20, 30]], "node long"), edges)
    want = {(3, 9): True, (9, 3): False, (30, 20): True, (4, 20): True, (7, 7): True, (10, 5): False, (99, 20): False}
    for given in (None, levels):
        assert {(r.a, r.b): r.is_ancestor for r in graph.is_ancestor(pairs, edges, given).collect()} == want
    stopped = graph.topo_levels(levels.select("node"), edges, spark.createDataFrame([(8,)], "node long"))
    assert {r.node: r.level for r in stopped.where("node IN (9, 10, 11)").collect()} == {9: 0, 10: 1, 11: 2} and stopped.where("node = 8").count() == 0
    chain = graph.chain_levels(spark.createDataFrame([(i,) for i in range(40)], "node long"), spark.createDataFrame([(i, i - 1 if i else None) for i in range(40)], "node long, parent long"))
    assert {r.node: r.level for r in chain.collect()} == {i: i for i in range(40)}


def test_policy_identity_bytes(spark):
    import hashlib

    files = [("a", "x/.p", "01" * 20), ("a", ".p", "ff" * 20), ("b", "é" * 200, "00" * 20)]
    got = {r.scope: bytes(r.identity) for r in policy.policy_identity(spark.createDataFrame(files, "scope string, path string, oid string"), ["scope"], b"domain\x00").collect()}
    for scope in ("a", "b"):
        data = b"domain\x00"
        for path, oid in sorted((p.encode(), o) for s, p, o in files if s == scope):
            data += len(path).to_bytes(8, "little") + path + bytes.fromhex(oid)
        assert got[scope] == hashlib.blake2b(data, digest_size=64).digest()


def test_rules_by_scope_are_as_one_list(spark):
    rules = [("", 0, "*.log", False, False), ("", 1, "!x", False, False), ("a/", 0, "keep.log", True, False), ("", 2, "tmp/", False, True), ("a/b/", 3, "/c?", False, False)]
    paths = ["k.log", "a/keep.log", "a/b/cd", "a/b/x/cd", "tmp", "tmp/f", "a/tmp/keep.log", "", ".p", "a/.p"]
    one = spark.createDataFrame([("s", p, 5) for p in paths] + [("t", p, 0) for p in paths], "scope string, path string, kind int")
    table = spark.createDataFrame([("s", *r) for r in rules], "scope string, directory string, line int, pattern string, negated boolean, dir_only boolean")
    got = {(r.scope, r.path): r.hidden for r in policy.decide_by(one, table, ["scope"], ".p").collect()}
    want = {r.path: r.hidden for r in policy.decide(one.where("scope = 's'"), rules, ".p").collect()}
    assert got == {("s", p): h for p, h in want.items()} | {("t", p): p.endswith(".p") for p in paths}
    assert policy.embedded(policy.decide(one, rules)).columns == ["scope", "path", "kind"]
