"""State from logs: upserts, idempotent requests, head sets, batch folds, the repository directory."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relations import newest


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """table with changes laid over it: of each key the row that is last in order; changes win ties."""
    rows = table.withColumn("_change", F.lit(0)).unionByName(changes.withColumn("_change", F.lit(1)))
    return newest(rows, keys, [*order, "_change"], [c for c in table.columns if c not in keys]).select(*table.columns)


def insert_ignore(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti").select(*table.columns))


def current_cursors(events: DataFrame, key: list[str], order: str) -> DataFrame:
    """Per ref the kind and value of its latest event, so that identity and pair cursors of a ref exclude each other."""
    return newest(events, key, [order], ["kind", "value", order])


def dedup_requests(log: DataFrame, key: list[str], order: str, fingerprint: str) -> DataFrame:
    """log with outcome: first for the first request of a key, replay for equal later ones, mismatch for others.

    The first of a key is a minimum with map-side combine; joining it back splits hot keys where adaptive execution does.
    """
    first = log.groupBy(*key).agg(F.min(F.struct(order, fingerprint)).alias("_first"))
    joined = log.join(first, key)
    outcome = F.when(F.col(order) == F.col(f"_first.{order}"), "first").when(F.col(fingerprint).eqNullSafe(F.col(f"_first.{fingerprint}")), "replay").otherwise("mismatch")
    return joined.withColumn("outcome", outcome).drop("_first")


def head_intervals(log: DataFrame, group: list[str], order: str) -> DataFrame:
    """(group, head, added_at, removed_at): when heads were in the set. log: (group, order, new_head, observed array).

    A transaction takes the heads it observed out and puts its own in. A head leaves with the first strictly later
    transaction that observes it; adding a head that is there changes nothing.
    """
    added = log.select(*group, F.col("new_head").alias("head"), F.col(order).alias("_at"), F.lit(1).alias("_add"))
    taken = log.select(*group, F.explode("observed").alias("head"), F.col(order).alias("_at"), F.lit(0).alias("_add")).where("head IS NOT NULL").distinct()
    events = added.unionByName(taken)
    # within a transaction the removal comes first
    later = Window.partitionBy(*group, "head").orderBy("_at", "_add").rowsBetween(1, Window.unboundedFollowing)
    earlier = Window.partitionBy(*group, "head").orderBy("_at", "_add").rowsBetween(Window.unboundedPreceding, -1)
    marked = events.withColumn("removed_at", F.min(F.when(F.col("_add") == 0, F.col("_at"))).over(later)).withColumn("_was", F.last("_add").over(earlier))
    return marked.where("_add = 1 AND coalesce(_was, 0) = 0").select(*group, "head", F.col("_at").alias("added_at"), "removed_at")


def head_set(log: DataFrame, group: list[str], order: str) -> DataFrame:
    """(group, head, added_at): the heads after the whole log."""
    return head_intervals(log, group, order).where("removed_at IS NULL").drop("removed_at")


# The lifecycle of a repository.
TRANSITIONS = {(None, "provisioning"), ("provisioning", "active"), ("provisioning", "deleted"), ("active", "retiring"), ("retiring", "deleted")}


def lifecycle_violations(events: DataFrame, key: list[str], order: list[str], allowed: set | frozenset = frozenset(TRANSITIONS)) -> DataFrame:
    """Events that the state before them doesn't allow, with that state; repeating a state is allowed."""
    before = F.lag("status").over(Window.partitionBy(*key).orderBy(*order))
    rows = events.withColumn("previous", before)
    ok = F.col("status").eqNullSafe(F.col("previous"))
    for a, b in sorted(allowed, key=str):
        ok |= F.col("previous").eqNullSafe(F.lit(a)) & (F.col("status") == b)
    return rows.where(~ok)


def repository_states(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return newest(events, key, order, ["status", *order])


def expired_provisional(repositories: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    return repositories.where((F.col("status") == "provisioning") & (F.col("created_at") + F.expr(f"INTERVAL {hours} HOURS") <= now))


def name_collisions(repositories: DataFrame) -> DataFrame:
    """(user_id, name, n): names that several repositories of a user that aren't deleted have."""
    return repositories.where("status <> 'deleted'").groupBy("user_id", "name").agg(F.count("*").alias("n")).where("n > 1")


def rename_collisions(repositories: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (repository_id, user_id, new_name) for a name that another live repository of the user has."""
    live = repositories.where("status <> 'deleted'").select(F.col("repository_id").alias("_other"), "user_id", F.col("name").alias("new_name"))
    return requests.join(live, ["user_id", "new_name"]).where("_other <> repository_id").drop("_other").distinct()


def active_repositories(repositories: DataFrame) -> DataFrame:
    return repositories.where("status = 'active'").orderBy("user_id", "name", "repository_id")


def resolve_names(names: DataFrame, repositories: DataFrame) -> DataFrame:
    return names.join(repositories.where("status = 'active'").select("user_id", "name", "repository_id"), ["user_id", "name"])


def cascade_delete(tables: dict[str, DataFrame], keys: DataFrame, key: list[str]) -> dict[str, DataFrame]:
    return {name: t.join(keys.select(*key), key, "left_anti") for name, t in tables.items()}


def installable(packs: DataFrame, chunks: DataFrame, violations: DataFrame, missing: DataFrame) -> DataFrame:
    """Packs all of whose chunks are there, without violations or missing references."""
    complete = chunks.groupBy("pack_id").agg(F.count("*").alias("n"), F.bool_and("received").alias("all_there"))
    ready = packs.join(complete, "pack_id").where("all_there AND n = chunk_count").select(*packs.columns)
    return ready.join(violations.select("pack_id"), "pack_id", "left_anti").join(missing.select("pack_id"), "pack_id", "left_anti")


def sync_plan(local: DataFrame, cloud: DataFrame, accepted: DataFrame, key: str) -> DataFrame:
    """(key, to_upload, to_download, needs_merge): heads only the machine has that aren't accepted, heads only the cloud
    has, and whether the union holds more than one."""
    a = local.select(key, "head", F.lit(1).alias("_local"))
    b = cloud.select(key, "head", F.lit(1).alias("_cloud"))
    c = accepted.select(key, "head", F.lit(1).alias("_accepted"))
    rows = a.join(b, [key, "head"], "full_outer").join(c, [key, "head"], "left")
    return rows.groupBy(key).agg(
        F.count_if(F.col("_local").isNotNull() & F.col("_cloud").isNull() & F.col("_accepted").isNull()).alias("to_upload"),
        F.count_if(F.col("_local").isNull()).alias("to_download"), (F.count("*") > 1).alias("needs_merge"),
    )


def catalog_conflicts(entries: DataFrame, keys: dict[str, tuple[list[str], str]]) -> DataFrame:
    """(rule, key): keys that are bound to several values. keys: rule -> (key columns, bound column)."""
    out = None
    for rule, (key, bound) in keys.items():
        found = entries.groupBy(*key).agg(F.count_distinct(bound).alias("_n")).where("_n > 1").select(F.lit(rule).alias("rule"), F.concat_ws("/", *key).alias("key"))
        out = found if out is None else out.unionByName(found)
    return out


FOLD = "repo string, sequence long, batch_id string, bookmark string, outcome string"


class BatchFold:
    """What one repository's batch events have led to: cursors, open batches, the refs these own, and settled batches.

    begin opens a batch on a ref if the cursor is as expected and no open batch owns the ref; claim raises the batch's
    fence; recover settles it for the owner of the latest fence: accepted if the observed id is the proposed one (the
    cursor moves), aborted if it is the expected one and nothing was claimed, replay_required if it was, else ambiguous.
    A settled batch doesn't change. The state grows with refs and batches, not with events.
    """

    def __init__(self, state: dict | None = None):
        state = state or {}
        self.cursors: dict = state.get("cursors", {})
        self.open: dict = state.get("open", {})
        self.settled: dict = state.get("settled", {})
        self.owner_of = {b[0]: i for i, b in self.open.items()}

    def state(self) -> dict:
        return {"cursors": self.cursors, "open": self.open, "settled": self.settled}

    def apply(self, kind: str, batch_id: str, bookmark: str, expected, proposed, observed, fence: int) -> str:
        if kind == "begin":
            if batch_id in self.settled or batch_id in self.open:
                return "replayed"
            if bookmark in self.owner_of:
                return "ref_owned"
            if self.cursors.get(bookmark) != expected:
                return "stale_expectation"
            self.open[batch_id] = [bookmark, expected, proposed, 0, False]
            self.owner_of[bookmark] = batch_id
            return "begun"
        if batch_id in self.settled:
            return "settled"
        if batch_id not in self.open:
            return "unknown_batch"
        batch = self.open[batch_id]
        if kind == "claim":
            if fence <= batch[3]:
                return "stale_fence"
            batch[3], batch[4] = fence, True
            return "claimed"
        if fence != batch[3]:
            return "stale_fence"
        bookmark, was, new, _, claimed = batch
        outcome = "accepted" if observed == new else ("replay_required" if claimed else "aborted") if observed == was else "ambiguous"
        if outcome in ("accepted", "aborted"):
            del self.open[batch_id], self.owner_of[bookmark]
            self.settled[batch_id] = outcome
            if outcome == "accepted":
                self.cursors[bookmark] = new
        return outcome

    def rows(self, events: pd.DataFrame) -> list[tuple]:
        value = lambda x: None if x is None or x != x else x
        return [
            (e.repo, e.sequence, e.batch_id, e.bookmark, self.apply(e.kind, e.batch_id, e.bookmark, value(e.expected), value(e.proposed), value(e.observed), int(e.fence)))
            for e in events.itertuples(index=False)
        ]


FOLD_COLUMNS = ["repo", "sequence", "batch_id", "bookmark", "outcome"]


def fold_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The outcome of each event of rows in the order of repository and sequence; of a repository only its state is held."""
    now, fold = None, BatchFold()
    for rows in batches:
        out: list[tuple] = []
        for repo, events in rows.groupby("repo", sort=False, dropna=False):
            if repo != now:
                now, fold = repo, BatchFold()
            out += fold.rows(events)
        yield pd.DataFrame(out, columns=FOLD_COLUMNS)


def replay_batches(events: DataFrame) -> DataFrame:
    """The outcome of each event (repo, sequence, kind, batch_id, bookmark, expected, proposed, observed, fence).

    Events of a repository depend on each other, so it is the unit of order. Repositories are dealt over tasks, where their
    sorted events stream by.
    """
    return events.repartition("repo").sortWithinPartitions("repo", "sequence").mapInPandas(fold_batches, FOLD)


def replay_fetches(requests: DataFrame, durable: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) fetches (repo, sequence, bookmark, expected, observed): rejected are those whose observed id
    isn't stored, and those whose expected cursor isn't what the accepted ones before them left.

    A fetch is accepted if its expectation is the observed id of the last accepted one on its ref. Requests on a ref form
    one order, so a ref is the unit; refs are dealt over tasks.
    """
    stored = durable.select(F.col("id").alias("observed"), F.lit(True).alias("_stored"))
    rows = requests.join(stored, "observed", "left")

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        cursor, out = None, []
        for e in group.sort_values("sequence").itertuples(index=False):
            expected = None if e.expected is None or e.expected != e.expected else e.expected
            code = "not_durable" if e.stored is not True else "stale_expectation" if expected != cursor else "accepted"
            cursor = e.observed if code == "accepted" else cursor
            out.append((e.repo, e.sequence, e.bookmark, e.observed, code))
        return pd.DataFrame(out, columns=["repo", "sequence", "bookmark", "observed", "outcome"])

    done = rows.withColumnRenamed("_stored", "stored").groupBy("repo", "bookmark").applyInPandas(fold, "repo string, sequence long, bookmark string, observed string, outcome string")
    return done.where("outcome = 'accepted'"), done.where("outcome <> 'accepted'")
