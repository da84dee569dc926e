"""The journal of a repository: pushes in batches of refs, their owners and fences, fetches, and what each is refused for.

What a request meets depends on all accepted before it, so a repository's requests are one ordered fold. It works on small maps by
key, never on whole tables, so the same fold runs over dictionaries in a batch job and over keyed state in a stream.
"""

from __future__ import annotations

from collections.abc import Iterator, MutableMapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relations import newest
from .stages import null_safe_join

STATE = "struct<canonical: string, public: string, lineage: string>"
REF = f"struct<bookmark: string, expected: string, observed: string, identity: string, proposed: int, states: array<{STATE}>>"
EVENT = f"repo string, sequence long, at long, kind string, id string, fingerprint string, machine string, remote string, fence long, known boolean, durable boolean, refs array<{REF}>"
EVENT_COLUMNS = ["repo", "sequence", "at", "kind", "id", "fingerprint", "machine", "remote", "fence", "known", "durable", "refs"]
OUTCOME = "repo string, sequence long, kind string, id string, outcome string, fence long, activation long"
#: Outcomes that change something or repeat an answer; all others refuse a request.
GOOD = ("begun", "claimed", "accepted", "aborted", "fetched", "replayed")
DAY = 86_400_000


@dataclass(frozen=True)
class Limits:
    """Refs of a repository, pending states, states in all, and how long answers are remembered, in milliseconds."""

    # The bounds of a repository.
    refs: int = 512
    pending_states: int = 8_192
    states: int = 65_536
    keep: int = 7 * DAY


#: The maps of a repository and what they hold by key.
MAPS = {
    "counts": "the numbers of fences, activations, cursors, pending refs, states and additions, and states",
    "cursors": "remote, bookmark: the id, and whether it is the same on both sides",
    "identities": "id: how many cursors and pending refs have it on both sides",
    "bindings": "canonical id: its public id, its lineage, and how many states have it",
    "active": "remote, bookmark, public id: how many active states",
    "owners": "remote, bookmark: the batch that owns the ref",
    "batches": "batch: its request, owner, fence, and whether it was claimed",
    "results": "batch: request, fence, outcome, time",
    "fetches": "fetch: request, time",
}
COUNTS = ("fence", "activation", "cursors", "refs", "pending", "added", "states")


class Refused(Exception):
    """A request that isn't taken; its text is the code."""


def key(*parts: str | None) -> str:
    return "\0".join("" if p is None else p for p in parts)


class Journal:
    """One repository's journal over maps by key, and the outcome of each request in its order."""

    def __init__(self, maps: dict[str, MutableMapping], limits: Limits = Limits()):
        self.maps, self.limits = maps, limits

    def apply(self, event: dict) -> tuple[str, int, int]:
        """(outcome, fence, activation) after the event, which changes nothing if it is refused."""
        self.counts = dict(zip(COUNTS, self.maps["counts"].get("", [0] * len(COUNTS))))
        try:
            step = {"begin": self._begin, "claim": self._claim, "recover": self._recover, "fetch": self._fetch}.get(event["kind"])
            outcome = step(event) if step else "kind_unknown"
        except Refused as refused:
            outcome = str(refused)
        else:
            self.maps["counts"][""] = [self.counts[c] for c in COUNTS]
        return outcome, self.counts["fence"], self.counts["activation"]

    # ------------------------------------------------------------------ requests

    def _begin(self, e: dict) -> str:
        known = self._remembered("results", e) or self.maps["batches"].get(e["id"])
        if known:
            return self._replayed(known[0], e, "request_mismatch")
        refs, n = e["refs"] or [], self.counts
        states = sum(len(r["states"] or []) for r in refs)
        adds = sum(r["expected"] is None and proposed(r) is not None for r in refs)
        self._within(n["refs"] + len(refs), self.limits.refs, "pending_ref_limit")
        self._within(n["pending"] + states, self.limits.pending_states, "pending_state_limit")
        self._within(n["states"] + states, self.limits.states, "history_limit")
        self._within(n["cursors"] + n["added"] + adds, self.limits.refs, "ref_limit")
        if e["durable"] is False:
            raise Refused("not_durable")
        self._check_bindings(refs, "lineage_diverged")
        self._check_cursors(e, "cursor_stale")
        self._check_owners(e, "push_in_progress")
        n["fence"] += 1
        self.maps["batches"][e["id"]] = [e["fingerprint"], e["machine"], n["fence"], False, e["remote"], refs]
        for r in refs:
            self.maps["owners"][key(e["remote"], r["bookmark"])] = e["id"]
            self._add("identities", r["identity"], 1)
            for s in r["states"] or []:
                self._bind(s, 1)
        n["refs"], n["pending"], n["states"], n["added"] = n["refs"] + len(refs), n["pending"] + states, n["states"] + states, n["added"] + adds
        return "begun"

    def _claim(self, e: dict) -> str:
        if self._remembered("results", e):
            return "replayed"
        batch = self._batch(e)
        self.counts["fence"] += 1
        self.maps["batches"][e["id"]] = [batch[0], e["machine"], self.counts["fence"], True, *batch[4:]]
        return "claimed"

    def _recover(self, e: dict) -> str:
        known = self._remembered("results", e)
        if known:
            if known[1] != e["fence"]:
                raise Refused("fence_stale")
            return "replayed"
        _, machine, fence, claimed, _, refs = self._batch(e)
        if (fence, machine) != (e["fence"], e["machine"]):
            raise Refused("owner_stale")
        seen = {r["bookmark"]: r["observed"] for r in e["refs"] or []}
        if len(seen) != len(e["refs"] or []) or seen.keys() != {r["bookmark"] for r in refs}:
            raise Refused("observation_set_mismatch")
        if all(seen[r["bookmark"]] == proposed(r) for r in refs):
            return self._settle(e, "accepted")
        if any(seen[r["bookmark"]] != r["expected"] for r in refs):
            raise Refused("remote_state_ambiguous")
        if claimed:
            raise Refused("replay_required")
        return self._settle(e, "aborted")

    def _settle(self, e: dict, outcome: str) -> str:
        fingerprint, _, fence, _, remote, refs = self.maps["batches"][e["id"]]
        n = self.counts
        for r in refs:
            states = r["states"] or []
            del self.maps["owners"][key(remote, r["bookmark"])]
            self._add("identities", r["identity"], -1)
            n["refs"], n["pending"], n["added"] = n["refs"] - 1, n["pending"] - len(states), n["added"] - (r["expected"] is None and proposed(r) is not None)
            if outcome == "accepted":
                self._activate(remote, r)
                self._move(remote, r["bookmark"], proposed(r), r["identity"] is not None)
            else:
                n["states"] -= len(states)
                for s in states:
                    self._bind(s, -1)
        del self.maps["batches"][e["id"]]
        self.maps["results"][e["id"]] = [fingerprint, fence, outcome, e["at"]]
        return outcome

    def _fetch(self, e: dict) -> str:
        known = self._remembered("fetches", e)
        if known:
            return self._replayed(known[0], e, "fetch_mismatch")
        refs, n = e["refs"] or [], self.counts
        if e["known"] is False:
            raise Refused("remote_not_found")
        self._check_cursors(e, "fetch_cursor_stale")
        self._check_owners(e, "overlaps_pending")
        if e["durable"] is False:
            raise Refused("fetch_not_durable")
        self._check_bindings(refs, "lineage_ambiguous")
        states = sum(len(r["states"] or []) for r in refs)
        self._within(n["states"] + states, self.limits.states, "fetch_history_limit")
        self._within(n["cursors"] + sum(r["expected"] is None for r in refs), self.limits.refs, "fetch_ref_limit")
        for r in refs:
            if r["proposed"] is None and r["identity"] is None and key(e["remote"], r["bookmark"], r["observed"]) not in self.maps["active"]:
                raise Refused("observed_state_not_found")
        for r in refs:
            n["states"] += len(r["states"] or [])
            for s in r["states"] or []:
                self._bind(s, 1)
            self._activate(e["remote"], r)
            self._move(e["remote"], r["bookmark"], r["observed"] if proposed(r) is None else proposed(r), r["identity"] is not None)
        self.maps["fetches"][e["id"]] = [e["fingerprint"], e["at"]]
        return "fetched"

    # ------------------------------------------------------------------ what they share

    def _within(self, value: int, bound: int, code: str) -> None:
        if value > bound:
            raise Refused(code)

    def _replayed(self, fingerprint: str, e: dict, code: str) -> str:
        if fingerprint != e["fingerprint"]:
            raise Refused(code)
        return "replayed"

    def _remembered(self, name: str, e: dict) -> list | None:
        """An earlier answer, unless it is older than answers are kept."""
        found = self.maps[name].get(e["id"])
        return found if found and found[-1] >= e["at"] - self.limits.keep else None

    def _batch(self, e: dict) -> list:
        found = self.maps["batches"].get(e["id"])
        if not found:
            raise Refused("batch_not_found")
        return found

    def _check_cursors(self, e: dict, code: str) -> None:
        for r in e["refs"] or []:
            if self.maps["cursors"].get(key(e["remote"], r["bookmark"]), [None])[0] != r["expected"]:
                raise Refused(code)

    def _check_owners(self, e: dict, code: str) -> None:
        if any(key(e["remote"], r["bookmark"]) in self.maps["owners"] for r in e["refs"] or []):
            raise Refused(code)

    def _check_bindings(self, refs: list[dict], lineage_code: str) -> None:
        """One canonical id has one public id, one lineage, and is either the same on both sides or isn't: within the request, then among what is stored."""
        asked: dict[str, tuple] = {}
        for r in refs:
            same = [(r["identity"], r["identity"], None, True)] if r["identity"] is not None else []
            for canonical, *binding in [(s["canonical"], s["public"], s["lineage"], False) for s in r["states"] or []] + same:
                was = asked.setdefault(canonical, tuple(binding))
                if was[0] != binding[0]:
                    raise Refused("canonical_diverged")
                if was != tuple(binding):
                    raise Refused(lineage_code)
        for canonical, (public, lineage, identity) in asked.items():
            if canonical != public and canonical in self.maps["identities"]:
                raise Refused("canonical_diverged")
            stored = self.maps["bindings"].get(canonical)
            if stored and (identity or stored[0] != public):
                raise Refused("canonical_diverged")
            if stored and stored[1] != lineage:
                raise Refused(lineage_code)

    def _add(self, name: str, k: str | None, n: int) -> None:
        if k is not None:
            total = self.maps[name].get(k, 0) + n
            if total:
                self.maps[name][k] = total
            else:
                del self.maps[name][k]

    def _bind(self, s: dict, n: int) -> None:
        total = self.maps["bindings"].get(s["canonical"], [None, None, 0])[2] + n
        if total:
            self.maps["bindings"][s["canonical"]] = [s["public"], s["lineage"], total]
        else:
            del self.maps["bindings"][s["canonical"]]

    def _activate(self, remote: str, r: dict) -> None:
        for s in r["states"] or []:
            self._add("active", key(remote, r["bookmark"], s["public"]), 1)
        self.counts["activation"] += len(r["states"] or []) + (r["identity"] is not None)

    def _move(self, remote: str, bookmark: str, oid: str | None, identity: bool) -> None:
        """The ref's cursor is at oid from now on, or gone."""
        at = key(remote, bookmark)
        was = self.maps["cursors"].get(at)
        if was:
            self._add("identities", was[0] if was[1] else None, -1)
            self.counts["cursors"] -= 1
            del self.maps["cursors"][at]
        if oid is not None:
            self.maps["cursors"][at] = [oid, identity]
            self._add("identities", oid if identity else None, 1)
            self.counts["cursors"] += 1


def proposed(ref: dict) -> str | None:
    """The public id that a ref is to have: that of its proposed state, or its id on both sides; null deletes it."""
    return ref["identity"] if ref["proposed"] is None else ref["states"][ref["proposed"]]["public"]


def in_memory() -> dict[str, MutableMapping]:
    return {name: {} for name in MAPS}


def outcomes(journal: Journal, events: list[dict]) -> list[tuple]:
    return [(e["repo"], e["sequence"], e["kind"], e["id"], *journal.apply(e)) for e in events]


def replay_journal(events: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(repo, sequence, kind, id, outcome, fence, activation) of each event (columns as EVENT), in the repository's order.

    begin opens a batch of refs, all or none, gives it an owner and the repository's next fence; claim gives it to another
    machine; recover settles it by what the remote holds now, for the owner of the latest fence; fetch moves cursors. fence and activation are the repository's after the event.
    Repositories are dealt over tasks, where their sorted events stream by; of a repository only what MAPS names is held.
    """
    names = [c.split(" ")[0] for c in OUTCOME.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, journal = object(), Journal({})
        for batch in batches:
            rows = []
            for e in batch.to_pylist():
                if e["repo"] != now:
                    now, journal = e["repo"], Journal(in_memory(), limits)
                rows += outcomes(journal, [e])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], names)

    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    return events.select(*EVENT_COLUMNS).repartition("repo").sortWithinPartitions("repo", "sequence").mapInArrow(run, OUTCOME)


def with_durability(events: DataFrame, objects: DataFrame) -> DataFrame:
    """events with durable: whether all ids that their states and identities name are among objects (id)."""
    states = F.flatten(F.transform("refs", lambda r: F.coalesce(r["states"], F.expr(f"CAST(array() AS array<{STATE.replace(': ', ':')}>)"))))
    ids = F.concat(F.transform(states, lambda s: s["canonical"]), F.transform(states, lambda s: s["public"]), F.transform("refs", lambda r: r["identity"]))
    named = events.where("kind IN ('begin', 'fetch')").select("repo", "sequence", F.explode(F.array_distinct(ids)).alias("id")).where("id IS NOT NULL")
    missing = named.join(objects.select("id"), "id", "left_anti").select("repo", "sequence").distinct().withColumn("_missing", F.lit(True))
    return null_safe_join(events, missing, ["repo", "sequence"], "left").withColumn("durable", F.col("_missing").isNull()).drop("_missing")


def journal_tables(events: DataFrame, found: DataFrame) -> dict[str, DataFrame]:
    """What the outcomes leave: results of batches, rejected requests, and cursors (repo, remote, bookmark, oid)."""
    done = found.where("outcome IN ('accepted', 'aborted')")
    opened = found.where("outcome = 'begun'").select("repo", "id", F.col("sequence").alias("_begun"))
    # a batch's refs are those of the last beginning before it was settled
    last = done.where("outcome = 'accepted'").join(opened, ["repo", "id"]).where("_begun < sequence").groupBy("repo", "id", "sequence").agg(F.max("_begun").alias("_begun"))
    pushed = last.join(events.select("repo", F.col("sequence").alias("_begun"), "remote", "refs"), ["repo", "_begun"])
    fetched = found.where("outcome = 'fetched'").select("repo", "sequence").join(events.select("repo", "sequence", "remote", "refs"), ["repo", "sequence"])
    moved = lambda df, other: df.select("repo", "sequence", "remote", F.inline(F.transform("refs", lambda r: F.struct(r["bookmark"].alias("bookmark"), F.coalesce(F.get(r["states"], r["proposed"])["public"], r["identity"], other(r)).alias("oid")))))
    moves = moved(pushed, lambda r: F.lit(None)).unionByName(moved(fetched, lambda r: r["observed"]))
    cursors = newest(moves, ["repo", "remote", "bookmark"], ["sequence"], ["oid"]).where("oid IS NOT NULL")
    return {"results": done.drop("kind"), "rejects": found.where(~F.col("outcome").isin(*GOOD)), "cursors": cursors}
