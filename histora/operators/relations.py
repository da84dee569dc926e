"""Joins, set relations and aggregates over tables of objects, references, refs and journal states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stages import null_safe_join


def missing_references(refs: DataFrame, objects: DataFrame, kind_of: dict[int, int]) -> DataFrame:
    """Edges whose target isn't stored. kind_of maps reference kinds to object kinds; kinds not in it are exempt."""
    wanted = refs.withColumn("kind", mapped(F.col("reference_kind"), kind_of)).where("kind IS NOT NULL")
    return wanted.join(objects.select("kind", F.col("id").alias("referenced_id")), ["kind", "referenced_id"], "left_anti").drop("kind")


def mapped(column: Column, values: dict) -> Column:
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(column == k, F.lit(v)).otherwise(out)
    return out


def kind_mismatches(refs: DataFrame, objects: DataFrame, kind_of: dict[int, int]) -> DataFrame:
    """Edges whose target is stored under another kind than the reference says, and under that kind not at all."""
    wanted = refs.withColumn("expected", mapped(F.col("reference_kind"), kind_of)).where("expected IS NOT NULL")
    stored = objects.select(F.col("kind").alias("stored"), F.col("id").alias("referenced_id"))
    wrong = wanted.join(stored, "referenced_id").where("stored <> expected")
    return wrong.join(stored.withColumnRenamed("stored", "expected"), ["referenced_id", "expected"], "left_anti")


def present(candidates: DataFrame, store: DataFrame, keys: list[str]) -> DataFrame:
    return candidates.join(store.select(*keys), keys, "left_semi")


def absent(candidates: DataFrame, store: DataFrame, keys: list[str]) -> DataFrame:
    return candidates.join(store.select(*keys), keys, "left_anti")


def subtraction_counts(closure: DataFrame, known: DataFrame, keys: list[str], size: str) -> DataFrame:
    """(discovered, skipped, packed, packed_bytes): what is left of closure without known."""
    marked = closure.join(known.select(*keys, F.lit(1).alias("_known")).distinct(), keys, "left")
    new = F.col("_known").isNull()
    return marked.agg(
        F.count("*").alias("discovered"), F.count_if(~new).alias("skipped"), F.count_if(new).alias("packed"), F.coalesce(F.sum(F.when(new, F.col(size))), F.lit(0)).alias("packed_bytes")
    )


def active_cursors(cursors: DataFrame, states: DataFrame, identity: DataFrame) -> DataFrame:
    """(remote, bookmark, canonical, public, lineage): cursors with their state, and identity cursors, whose one id
    stands on either side and which have no lineage."""
    pairs = cursors.join(states, ["remote", "bookmark", "state_id"]).select("remote", "bookmark", "canonical", "public", "lineage")
    same = identity.select("remote", "bookmark", F.col("oid").alias("canonical"), F.col("oid").alias("public"), F.lit(None).cast(pairs.schema["lineage"].dataType).alias("lineage"))
    return pairs.unionByName(same)


def pending_refs(batch_refs: DataFrame, states: DataFrame) -> DataFrame:
    """Each pending ref with its proposed public id: that of its state, or its identity."""
    joined = batch_refs.join(states.select("state_id", "public"), "state_id", "left")
    return joined.withColumn("proposed", F.coalesce("public", "identity")).drop("public")


def replay(states: DataFrame, key: list[str], order: str, value: str, proposed: str) -> DataFrame:
    """Per key: its values in order, and the 1-based place of the proposed one, 0 if there is none."""
    listed = F.array_sort(F.collect_list(F.struct(order, value)))
    grouped = states.groupBy(*key).agg(listed.alias("_all"), F.max(proposed).alias("_proposed"))
    return grouped.select(*key, F.col(f"_all.{value}").alias("states"), F.array_position(f"_all.{value}", F.col("_proposed")).alias("proposed_at"))


def stale_expectations(requests: DataFrame, cursors: DataFrame, keys: list[str]) -> DataFrame:
    """Requests whose expected id isn't the cursor's; no cursor and no expectation agree."""
    joined = requests.join(cursors.select(*keys, F.col("oid").alias("actual")), keys, "left")
    return joined.where(~F.col("actual").eqNullSafe(F.col("expected")))


def not_durable(requests: DataFrame, columns: list[str], objects: DataFrame) -> DataFrame:
    """(request columns, oid): ids named in columns that no stored object has."""
    named = requests.withColumn("oid", F.explode(F.array_distinct(F.array(*columns)))).where("oid IS NOT NULL")
    return named.join(objects.select(F.col("id").alias("oid")), "oid", "left_anti")


def binding_conflicts(bindings: DataFrame, key: list[str], bound: list[str]) -> DataFrame:
    """Keys that are bound to several combinations, nulls counting as values of their own."""
    found = bindings.groupBy(*key).agg(F.size(F.collect_set(F.struct(*bound))).alias("n_bindings"))
    return found.where("n_bindings > 1")


def stored_binding_conflicts(bindings: DataFrame, stored: DataFrame) -> DataFrame:
    """(canonical, code): requested bindings against stored ones of the same canonical id."""
    old = stored.select("canonical", F.col("public").alias("old_public"), F.col("lineage").alias("old_lineage")).distinct()
    identity, was = F.col("canonical") == F.col("public"), F.col("canonical") == F.col("old_public")
    code = F.when(identity != was, "identity_mixed").when(~F.col("public").eqNullSafe(F.col("old_public")), "public_differs")
    code = code.when(~F.col("lineage").eqNullSafe(F.col("old_lineage")), "lineage_differs")
    return bindings.join(old, "canonical").withColumn("code", code).where("code IS NOT NULL").select("canonical", "public", "old_public", "code").distinct()


def newest(states: DataFrame, key: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Per key the values of the row that is last in order; map-side maxima, so hot keys aren't gathered."""
    top = states.groupBy(*key).agg(F.max(F.struct(*order, *[v for v in values if v not in order])).alias("_top"))
    return top.select(*key, *(F.col(f"_top.{v}").alias(v) for v in values))


def lineage_conflicts(requests: DataFrame, states: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Requests whose lineage isn't that of the newest state of their key."""
    last = newest(states, key, order, ["lineage"]).withColumnRenamed("lineage", "active_lineage")
    return requests.join(last, key).where(~F.col("lineage").eqNullSafe(F.col("active_lineage")))


def overlapping_pending(requests: DataFrame, pending: DataFrame, key: list[str]) -> DataFrame:
    return requests.join(pending.select(*key).distinct(), key, "left_semi")


def resolve_seeds(seeds: DataFrame, mapping: DataFrame, parents: DataFrame, mapped_parents: DataFrame) -> DataFrame:
    """(public, canonical, outcome) for each seed. One canonical id: mapped. Several: the one whose parents are the
    mapped parents of the public id; none or several such: ambiguous. None at all: unmapped.

    parents: (canonical, parents array); mapped_parents: (public, parents array).
    """
    options = seeds.select("public").join(mapping, "public", "left").join(parents, "canonical", "left")
    options = options.join(mapped_parents.withColumnRenamed("parents", "wanted"), "public", "left")
    fits = F.col("parents").eqNullSafe(F.col("wanted"))
    found = options.groupBy("public").agg(
        F.count_distinct("canonical").alias("n"), F.min("canonical").alias("one"), F.count_distinct(F.when(fits, F.col("canonical"))).alias("n_fit"), F.min(F.when(fits, F.col("canonical"))).alias("fit")
    )
    outcome = F.when(F.col("n") == 0, "unmapped").when((F.col("n") == 1) | (F.col("n_fit") == 1), "mapped").otherwise("ambiguous")
    canonical = F.when(F.col("n") == 1, F.col("one")).when(F.col("n_fit") == 1, F.col("fit"))
    return found.select("public", canonical.alias("canonical"), outcome.alias("outcome"))


def mapping_conflicts(mappings: DataFrame) -> DataFrame:
    """Canonical ids with several public ids."""
    return mappings.groupBy("canonical").agg(F.count_distinct("public").alias("n_public")).where("n_public > 1")


def classify_refs(local: DataFrame, cursors: DataFrame, key: list[str]) -> DataFrame:
    """(key, outcome): missing (no cursor, no target), create, delete, up-to-date or update of each ref on either side."""
    a = local.select(*key, F.col("oid").alias("target"))
    b = cursors.select(*key, F.col("oid").alias("cursor"))
    outcome = F.when(F.col("target").isNull() & F.col("cursor").isNull(), "missing").when(F.col("target").isNull(), "delete").when(F.col("cursor").isNull(), "create")
    return a.join(b, key, "full_outer").withColumn("outcome", outcome.when(F.col("target") == F.col("cursor"), "up-to-date").otherwise("update"))


def classify_fetch(observed: DataFrame, cursors: DataFrame, key: list[str]) -> DataFrame:
    """(key, outcome): new, up-to-date or moved for each observed ref."""
    joined = observed.join(cursors.select(*key, F.col("oid").alias("cursor")), key, "left")
    return joined.withColumn("outcome", F.when(F.col("cursor").isNull(), "new").when(F.col("cursor") == F.col("oid"), "up-to-date").otherwise("moved"))


def ref_delta(view_refs: DataFrame, heads: DataFrame, key: list[str]) -> DataFrame:
    """Refs of either side whose targets differ; absent counts as null."""
    a = view_refs.select(*key, F.col("oid").alias("view_oid"))
    b = heads.select(*key, F.col("oid").alias("head_oid"))
    return a.join(b, key, "full_outer").where(~F.col("view_oid").eqNullSafe(F.col("head_oid")))


def authorized(requests: DataFrame, repositories: DataFrame, key: list[str]) -> DataFrame:
    """Requests that match an active repository in all of key."""
    return requests.join(repositories.where("status = 'active'").select(*key), key, "left_semi")


def unauthorized(requests: DataFrame, repositories: DataFrame, key: list[str]) -> DataFrame:
    return null_safe_join(requests, repositories.where("status = 'active'").select(*key).na.drop(), key, "left_anti")


def new_heads(current: DataFrame, accepted: DataFrame, root: str) -> DataFrame:
    """Current heads that aren't accepted, without the root."""
    return current.join(accepted.select("head").distinct(), "head", "left_anti").where(F.col("head") != F.lit(root)).distinct()


def observed_refs(updates: DataFrame, report: DataFrame, key: list[str]) -> DataFrame:
    """Each requested ref with the observed id; one that the report lacks has the outcome not_reported, a deletion that
    took effect deleted, an id as proposed accepted, one as expected unchanged, others differ."""
    seen = report.select(*key, F.col("oid").alias("observed"), F.lit(True).alias("_seen"))
    new = F.coalesce("identity", "proposed")
    outcome = F.when(F.col("_seen").isNull(), "not_reported").when(new.isNull() & F.col("observed").isNull(), "deleted")
    outcome = outcome.when(new.eqNullSafe(F.col("observed")), "accepted").when(F.col("expected").eqNullSafe(F.col("observed")), "unchanged").otherwise("differs")
    return updates.join(seen, key, "left").withColumn("outcome", outcome).drop("_seen")


def deletion_candidates(cursors: DataFrame, local: DataFrame, tracked: DataFrame, requested: DataFrame, key: list[str]) -> DataFrame:
    """Cursors of tracked refs that are gone locally and not requested already."""
    return cursors.join(local.select(*key), key, "left_anti").join(tracked.select(*key), key, "left_semi").join(requested.select(*key), key, "left_anti")


def ineligible(requests: DataFrame, targets: DataFrame, remote_refs: DataFrame, remotes: DataFrame) -> DataFrame:
    """(remote, bookmark, code): requests that can't be carried out, with the first reason that applies.

    targets: (bookmark, n_terms); remote_refs: (remote, bookmark, tracked); remotes: (remote).
    """
    counted = requests.groupBy("remote", "bookmark").agg(F.count("*").alias("n"))
    joined = counted.join(targets.select("bookmark", "n_terms"), "bookmark", "left").join(remote_refs.select("remote", "bookmark", "tracked"), ["remote", "bookmark"], "left")
    joined = joined.join(remotes.select("remote", F.lit(True).alias("_known")), "remote", "left")
    code = F.when(F.col("_known").isNull(), "remote_unknown").when(F.col("n") > 1, "duplicate_request").when(F.col("n_terms") > 1, "conflicted").when(~F.col("tracked"), "untracked")
    return joined.withColumn("code", code).where("code IS NOT NULL").select("remote", "bookmark", "code")


def reconcile_catalogs(directory: DataFrame, catalog: DataFrame, workspaces: DataFrame, key: list[str]) -> DataFrame:
    """(key, outcome, renamed, paths): available where both know it, directory_only, or missing_from_directory;
    whether the names differ; and the checkouts in order."""
    paths = workspaces.groupBy(*key).agg(F.array_sort(F.collect_set("path")).alias("paths"))
    a = directory.select(*key, F.col("name").alias("directory_name"), F.lit(True).alias("_a"))
    b = catalog.select(*key, F.col("name").alias("machine_name"), F.lit(True).alias("_b"))
    joined = a.join(b, key, "full_outer").join(paths, key, "left")
    outcome = F.when(F.col("_b").isNull(), "directory_only").when(F.col("_a").isNull(), "missing_from_directory").otherwise("available")
    renamed = F.col("_a").isNotNull() & F.col("_b").isNotNull() & ~F.col("directory_name").eqNullSafe(F.col("machine_name"))
    return joined.select(*key, outcome.alias("outcome"), renamed.alias("renamed"), F.coalesce("paths", F.array().cast("array<string>")).alias("paths"))


def pin_updates(pins: DataFrame, listing: DataFrame) -> DataFrame:
    """(alias, commit, new_commit, outcome) of pins that move or are passed over.

    Mode default follows the head of the address, ref the named ref; exact pins and those of other backends are passed
    over. listing: (url, ref, oid), the head as ref HEAD.
    """
    wanted = pins.withColumn("_ref", F.when(F.col("mode") == "default", F.lit("HEAD")).when(F.col("mode") == "ref", F.col("ref")))
    found = wanted.join(listing.select("url", F.col("ref").alias("_ref"), F.col("oid").alias("new_commit")), ["url", "_ref"], "left")
    outcome = F.when(F.col("mode") == "exact", "skipped_exact").when(~F.col("mode").isin("default", "ref"), "skipped_foreign")
    outcome = outcome.when(F.col("new_commit").isNull(), "ref_not_found").when(~F.col("new_commit").eqNullSafe(F.col("commit")), "advanced")
    return found.withColumn("outcome", outcome).where("outcome IS NOT NULL").select("alias", "commit", "new_commit", "outcome")


# ------------------------------------------------------------------ aggregates


def store_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) for each table, with zero for empty ones."""
    return reduce(DataFrame.unionByName, (t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()))


def state_for_observed(observed: DataFrame, states: DataFrame, key: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Per observed (key, public): the values of the newest state with that public id."""
    return observed.join(newest(states, [*key, "public"], order, values), [*key, "public"])


def high_water(df: DataFrame, sequence: str) -> DataFrame:
    return df.agg(F.coalesce(F.max(sequence), F.lit(0)).alias("high_water"))


def batch_verdicts(refs: DataFrame, observations: DataFrame, claims: DataFrame) -> DataFrame:
    """(batch_id, verdict): accepted if all observed ids are as proposed, aborted if all are as expected (replay_required
    if the batch is claimed), invalid if the observed refs aren't those of the batch, else ambiguous.

    All-proposed is tested first, so a batch without change is accepted.
    """
    a = refs.select("batch_id", "bookmark", "expected", "proposed", F.lit(True).alias("_a"))
    b = observations.select("batch_id", "bookmark", "observed", F.lit(True).alias("_b"))
    joined = a.join(b, ["batch_id", "bookmark"], "full_outer")
    grouped = joined.groupBy("batch_id").agg(
        F.bool_and(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("exact"),
        F.bool_and(F.col("observed").eqNullSafe(F.col("proposed"))).alias("all_proposed"),
        F.bool_and(F.col("observed").eqNullSafe(F.col("expected"))).alias("all_expected"),
    )
    claimed = claims.select("batch_id", F.lit(True).alias("claimed")).distinct()
    verdict = F.when(~F.col("exact"), "invalid").when(F.col("all_proposed"), "accepted").when(F.col("all_expected") & F.col("claimed").isNotNull(), "replay_required")
    verdict = verdict.when(F.col("all_expected"), "aborted").otherwise("ambiguous")
    return grouped.join(claimed, "batch_id", "left").select("batch_id", verdict.alias("verdict"))


def quota_usage(df: DataFrame, key: list[str], counters: dict[str, Column], limits: dict[str, int]) -> DataFrame:
    """Per key and counter: used, the limit and what is left of it. A counter is a condition on rows."""
    used = df.groupBy(*key).agg(*(F.count_if(c).alias(name) for name, c in counters.items()))
    rule = F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("used"), F.lit(limits[n]).cast("long").alias("bound")) for n in counters))
    return used.select(*key, F.inline(rule)).withColumn("headroom", F.col("bound") - F.col("used"))


def sync_status(repos: DataFrame, heads: DataFrame, accepted: DataFrame, outbox: DataFrame, key: str) -> DataFrame:
    """(key, has_state, pending): pending is the outbox' size if there is one, else the number of heads not accepted."""
    open_ = heads.join(accepted.select(key, "head"), [key, "head"], "left_anti").groupBy(key).agg(F.count("*").alias("unaccepted"))
    state = accepted.select(key).distinct().withColumn("_state", F.lit(True))
    boxed = outbox.groupBy(key).agg(F.count("*").alias("boxed"))
    joined = repos.select(key).join(state, key, "left").join(open_, key, "left").join(boxed, key, "left")
    return joined.select(key, F.col("_state").isNotNull().alias("has_state"), F.coalesce("boxed", "unaccepted", F.lit(0)).alias("pending"))


def pending_report(batches: DataFrame, key: list[str]) -> DataFrame:
    """(key, bookmarks, owner): the names in order, joined, and the first twelve digits of the owner."""
    return batches.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set("bookmark")), ", ").alias("bookmarks"), F.substring(F.min("owner"), 1, 12).alias("owner"))


def workspaces(views: DataFrame, commits: DataFrame, current: str) -> DataFrame:
    """(workspace, commit_id, title, current): the map of working copies with the first line of what each commit says."""
    listed = views.select(F.explode("working_copies").alias("workspace", "commit_id"))
    title = F.split(F.col("description"), "\n")[0]
    return listed.join(commits.select("commit_id", title.alias("title")), "commit_id", "left").withColumn("current", F.col("workspace") == current)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def limit_audit(df: DataFrame, key: list[str], measures: dict[str, tuple[Column, int]]) -> DataFrame:
    """(key, rule, value, bound): groups beyond a bound. A measure is an aggregate and its bound."""
    found = df.groupBy(*key).agg(*(m.alias(name) for name, (m, _) in measures.items()))
    rule = F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).cast("long").alias("value"), F.lit(b).cast("long").alias("bound")) for n, (_, b) in measures.items()))
    return found.select(*key, F.inline(rule)).where("value > bound")


def push_status(lines: DataFrame, requested: DataFrame) -> DataFrame:
    """(ref, outcome) for each requested ref; those without a line are not_reported. lines: (ref, flag, summary)."""
    from ..functions.identity import push_outcome

    told = lines.select("ref", push_outcome(F.col("flag"), F.col("summary")).alias("outcome"))
    return requested.select("ref").join(told, "ref", "left").withColumn("outcome", F.coalesce("outcome", F.lit("not_reported")))


def merge_counts(added: DataFrame, stored: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(inserted, existing, conflicts): new keys, keys with equal value, and keys with another value."""
    new = added.groupBy(*keys).agg(F.min(value).alias("_value"), F.count_distinct(value).alias("_n"))
    joined = new.join(stored.select(*keys, F.col(value).alias("_old"), F.lit(True).alias("_there")), keys, "left")
    conflict = (F.col("_n") > 1) | (F.col("_there").isNotNull() & ~F.col("_old").eqNullSafe(F.col("_value")))
    return joined.agg(
        F.count_if(~conflict & F.col("_there").isNull()).alias("inserted"), F.count_if(~conflict & F.col("_there").isNotNull()).alias("existing"), F.count_if(conflict).alias("conflicts")
    )
