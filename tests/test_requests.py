"""The journal of requests: the cases that a repository's users meet, one by one, and the stream against the batch form."""

import itertools
import random

from histora.operators import requests as rq
from histora.operators.requests import DAY, Journal, Limits, in_memory
from histora.streaming import jobs


def state(canonical, public, lineage=None):
    return {"canonical": canonical, "public": public, "lineage": lineage}


def ref(bookmark, expected=None, states=(), proposed=None, identity=None, observed=None):
    return {"bookmark": bookmark, "expected": expected, "observed": observed, "identity": identity, "proposed": proposed, "states": list(states)}


def to(bookmark, public, expected=None, canonical=None, lineage=None):
    """A push or fetch of one state to a ref."""
    return ref(bookmark, expected, [state(canonical or f"c-{public}", public, lineage)], 0)


def seen(**at):
    return [ref(b, observed=o) for b, o in at.items()]


class Log:
    def __init__(self, limits=Limits()):
        self.journal, self.n, self.events = Journal(in_memory(), limits), itertools.count(1), []

    def __call__(self, kind, id_, refs=(), machine="m", fence=None, fingerprint="h", at=None, remote="origin", known=True, durable=True):
        n = next(self.n)
        e = {"repo": "r", "sequence": n, "at": n if at is None else at, "kind": kind, "id": id_, "fingerprint": fingerprint, "machine": machine, "remote": remote, "fence": fence, "known": known, "durable": durable, "refs": list(refs)}
        self.events.append(e)
        self.last = self.journal.apply(e)
        return self.last[0]

    def cursors(self):
        return {k.split("\0")[1]: v[0] for k, v in self.journal.maps["cursors"].items()}


def test_batch_of_several_refs_is_all_or_none():
    log = Log()
    assert log("begin", "b1", [to("main", "p1"), to("dev", "p2")]) == "begun" and log.last[1:] == (1, 0)
    assert log("begin", "b2", [to("dev", "p3"), to("new", "p4")]) == "push_in_progress" and log.last[1] == 1
    # the refused batch owns nothing
    assert log("begin", "b3", [to("new", "p4")]) == "begun" and log.last[1] == 2
    assert log("recover", "b1", seen(main="p1"), fence=1) == "observation_set_mismatch"
    assert log("recover", "b1", seen(main="p1", dev="p2", new="p4"), fence=1) == "observation_set_mismatch"
    assert log("recover", "b1", seen(main="p1", dev=None), fence=1) == "remote_state_ambiguous"
    assert log("recover", "b1", seen(main="p1", dev="p2"), fence=1) == "accepted" and log.last[2] == 2
    assert log.cursors() == {"main": "p1", "dev": "p2"}
    assert log("recover", "b3", seen(new=None), fence=2) == "aborted" and log.cursors() == {"main": "p1", "dev": "p2"}
    assert log("begin", "b4", [to("main", "p5", expected="p0")]) == "cursor_stale"
    assert log("begin", "b5", [ref("main", expected="p1")]) == "begun"
    assert log("recover", "b5", seen(main=None), fence=3) == "accepted" and log.cursors() == {"dev": "p2"}


def test_owners_fences_and_replays():
    log = Log()
    assert log("claim", "b1") == "batch_not_found" and log("recover", "b1", fence=0) == "batch_not_found"
    assert log("begin", "b1", [to("main", "p1")], machine="a") == "begun"
    assert log("begin", "b1", [to("main", "p1")], machine="a") == "replayed"
    assert log("begin", "b1", [to("main", "p2")], machine="a", fingerprint="other") == "request_mismatch"
    assert log("claim", "b1", machine="b") == "claimed" and log.last[1] == 2
    assert log("recover", "b1", seen(main="p1"), machine="a", fence=1) == "owner_stale"
    assert log("recover", "b1", seen(main="p1"), machine="a", fence=2) == "owner_stale"
    assert log("recover", "b1", seen(main=None), machine="b", fence=2) == "replay_required"
    assert log("recover", "b1", seen(main="p1"), machine="b", fence=2) == "accepted"
    assert log("recover", "b1", seen(main="x"), machine="b", fence=2) == "replayed"
    assert log("recover", "b1", seen(main="p1"), machine="b", fence=1) == "fence_stale"
    assert log("claim", "b1", machine="c") == "replayed" and log.last[1] == 2
    assert log("begin", "b1", [], fingerprint="h") == "replayed" and log("other", "x") == "kind_unknown"


def test_bindings():
    log = Log()
    assert log("begin", "b1", [to("a", "p1", canonical="c"), to("b", "p2", canonical="c")]) == "canonical_diverged"
    assert log("begin", "b1", [to("a", "p1", canonical="c"), to("b", "p1", canonical="c", lineage="l")]) == "lineage_diverged"
    assert log("begin", "b1", [to("a", "p1", canonical="c")]) == "begun"
    # what is pending binds, too
    assert log("begin", "b2", [to("b", "p2", canonical="c")]) == "canonical_diverged"
    assert log("begin", "b2", [to("b", "p1", canonical="c", lineage="l")]) == "lineage_diverged"
    assert log("begin", "b2", [ref("b", identity="c")]) == "canonical_diverged"
    assert log("fetch", "f1", [to("b", "p1", canonical="c", lineage="l")]) == "lineage_ambiguous"
    assert log("recover", "b1", seen(a=None), fence=1) == "aborted"
    # an aborted batch binds nothing
    assert log("begin", "b2", [ref("b", identity="c")]) == "begun"
    assert log("begin", "b3", [to("a", "p2", canonical="c")]) == "canonical_diverged"
    assert log("recover", "b2", seen(b="c"), fence=2) == "accepted" and log.cursors() == {"b": "c"}
    assert log("fetch", "f1", [to("a", "p2", canonical="c")]) == "canonical_diverged"
    assert log("fetch", "f2", [ref("b", expected="c", states=[state("d", "p3")], proposed=0)]) == "fetched"
    # the cursor has moved on, so the id is no longer the same on both sides
    assert log("fetch", "f1", [to("a", "p2", canonical="c")]) == "fetched"


def test_fetch_preconditions():
    log = Log()
    assert log("fetch", "f1", [to("a", "p1")], known=False) == "remote_not_found"
    assert log("fetch", "f1", [to("a", "p1", expected="p0")]) == "fetch_cursor_stale"
    assert log("fetch", "f1", [to("a", "p1")], durable=False) == "fetch_not_durable" and log("begin", "b", [to("a", "p1")], durable=False) == "not_durable"
    assert log("fetch", "f1", [ref("a", observed="p1")]) == "observed_state_not_found"
    assert log("fetch", "f1", [to("a", "p1")]) == "fetched" and log.last[2] == 1
    assert log("fetch", "f1", [to("a", "p1")]) == "replayed" and log("fetch", "f1", [], fingerprint="x") == "fetch_mismatch"
    assert log("fetch", "f2", [to("a", "p2", expected="p1")]) == "fetched"
    # back to a state that is there
    assert log("fetch", "f3", [ref("a", expected="p2", observed="p1")]) == "fetched" and log.cursors() == {"a": "p1"}
    assert log("begin", "b1", [to("a", "p3", expected="p1")]) == "begun"
    assert log("fetch", "f4", [to("a", "p4", expected="p1")]) == "overlaps_pending"
    assert log("fetch", "f4", [to("a", "p4")], remote="other") == "fetched"
    # states of a pending batch aren't active
    assert log("fetch", "f5", [ref("a", observed="p3")], remote="other") == "fetch_cursor_stale"
    assert log("fetch", "f5", [ref("z", observed="p3")]) == "observed_state_not_found"


def test_limits_count_what_is_pending_and_asked():
    log = Log(Limits(refs=3, pending_states=2, states=4))
    assert log("begin", "b1", [to("a", "p1"), to("b", "p2")]) == "begun"
    assert log("begin", "b2", [to("c", "p3")]) == "pending_state_limit"
    assert log("begin", "b2", [ref("c"), ref("d")]) == "pending_ref_limit"
    assert log("begin", "b2", [ref("c", identity="i")]) == "begun"
    assert log("recover", "b1", seen(a="p1", b="p2"), fence=1) == "accepted"
    # two cursors and one pending addition
    assert log("begin", "b3", [to("d", "p4")]) == "ref_limit" and log("fetch", "f1", [to("d", "p4")]) == "fetched"
    assert log("fetch", "f2", [to("e", "p5")]) == "fetch_ref_limit"
    assert log("fetch", "f2", [to("a", "p5", expected="p1")]) == "fetched"
    assert log("fetch", "f3", [to("a", "p6", expected="p5")]) == "fetch_history_limit"
    assert log("begin", "b3", [to("a", "p6", expected="p5")]) == "history_limit"
    assert log("recover", "b2", seen(c=None), fence=2) == "aborted"


def test_answers_are_kept_for_a_week():
    log = Log()
    assert log("fetch", "f", [to("a", "p1")], at=0) == "fetched"
    assert log("fetch", "f", [to("a", "p1")], at=7 * DAY) == "replayed"
    assert log("fetch", "f", [to("a", "p1")], at=7 * DAY + 1) == "fetch_cursor_stale"
    assert log("begin", "b", [to("b", "p2")], at=8 * DAY) == "begun" and log("recover", "b", seen(b="p2"), fence=1, at=8 * DAY) == "accepted"
    assert log("claim", "b", at=16 * DAY) == "batch_not_found"


def random_log(seed, n=400):
    rng, log = random.Random(seed), Log(Limits(refs=6, pending_states=4, states=60))
    fences = {}
    for _ in range(n):
        id_, bookmarks = f"b{rng.randrange(12)}", rng.sample("abcde", rng.randint(1, 3))
        held = log.journal.maps["batches"].get(id_)
        kind = rng.choice(["begin", "begin", "recover", "claim", "fetch"])
        if kind == "recover" and held and rng.random() < 0.9:
            refs = [ref(r["bookmark"], observed=rq.proposed(r) if rng.random() < 0.8 else r["expected"]) for r in held[5]]
            log("recover", id_, refs, machine=held[1], fence=held[2])
        else:
            at = log.cursors()
            refs = [to(b, f"p{rng.randrange(30)}", expected=at.get(b) if rng.random() < 0.8 else "p0") if rng.random() < 0.8 else ref(b, expected=at.get(b), observed="p1") for b in bookmarks]
            log(kind, id_ if kind != "fetch" else f"f{rng.randrange(30)}", refs, machine=f"m{rng.randrange(2)}", fence=fences.get(id_))
    return log


def check_counts(maps):
    """The counts are those of the maps, as a database would count its rows."""
    n = dict(zip(rq.COUNTS, maps["counts"][""]))
    refs = [r for b in maps["batches"].values() for r in b[5]]
    assert n["cursors"] == len(maps["cursors"]) and n["refs"] == len(refs) == len(maps["owners"])
    assert n["pending"] == sum(len(r["states"]) for r in refs) and n["added"] == sum(r["expected"] is None and rq.proposed(r) is not None for r in refs)
    assert n["states"] == sum(v[2] for v in maps["bindings"].values()) == n["pending"] + sum(maps["active"].values())


def test_counts_stay_right():
    kinds = set()
    for seed in range(6):
        log = random_log(seed)
        check_counts(log.journal.maps)
        journal = Journal(in_memory(), log.journal.limits)
        kinds |= {journal.apply(e)[0] for e in log.events}
    assert {"begun", "claimed", "accepted", "aborted", "fetched", "replayed", "push_in_progress", "overlaps_pending", "owner_stale"} <= kinds


def as_rows(logs):
    out = []
    for i, log in enumerate(logs):
        for e in log.events:
            row = dict(e, repo=f"r{i}")
            row["refs"] = [tuple(r[k] if k != "states" else [(s["canonical"], s["public"], s["lineage"]) for s in r["states"]] for k in ("bookmark", "expected", "observed", "identity", "proposed", "states")) for r in e["refs"]]
            out.append(tuple(row[c] for c in rq.EVENT_COLUMNS))
    return out


def test_batch_and_stream_forms(spark, tmp_path):
    logs = [random_log(seed, 60) for seed in range(5)]
    limits = logs[0].journal.limits
    events = spark.createDataFrame(as_rows(logs), rq.EVENT.replace(": ", ":"))
    want = []
    for i, log in enumerate(logs):
        journal = Journal(in_memory(), limits)
        want += [(f"r{i}", e["sequence"], e["kind"], e["id"], *journal.apply(e)) for e in log.events]
    found = rq.replay_journal(events.repartition(7), limits)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    tables = rq.journal_tables(events, found)
    cursors = {(r.repo, r.bookmark): r.oid for r in tables["cursors"].collect()}
    assert cursors == {(f"r{i}", b): o for i, log in enumerate(logs) for b, o in log.cursors().items()}
    assert tables["rejects"].count() == sum(w[4] not in rq.GOOD for w in want)
    source = str(tmp_path / "in")
    for low in range(0, 60, 20):
        events.where(f"sequence > {low} AND sequence <= {low + 20}").coalesce(1).write.mode("append").parquet(source)
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = jobs.run_to_end(jobs.journal_stream(jobs.tail(spark, source, events.schema, 1), limits), str(tmp_path / "out"), str(tmp_path / "cp"))
        assert sorted(map(tuple, got.collect())) == sorted(want)
    finally:
        spark.conf.unset(name)


def test_durability_and_empty_logs(spark):
    log = Log()
    log("begin", "b1", [to("a", "p1", canonical="c1")])
    log("fetch", "f1", [ref("a", identity="c9")])
    log("claim", "b1")
    log("begin", "b2", [ref("a")])
    events = spark.createDataFrame(as_rows([log]), rq.EVENT.replace(": ", ":"))
    stored = spark.createDataFrame([("c1",), ("p1",)], "id string")
    assert {r.sequence: r.durable for r in rq.with_durability(events, stored).collect()} == {1: True, 2: False, 3: True, 4: True}
    assert rq.replay_journal(events.limit(0)).count() == 0
