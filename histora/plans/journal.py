"""Queries over the journal of requests: each user's events as pushes, claims, recoveries and fetches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import requests
from ..streaming import jobs
from .registry import query
from .streams import in_time
from .tables import table

#: Bounds that are small enough to be met.
LIMITS = requests.Limits(refs=3, pending_states=2, states=9)


def journal_events(spark, sf):
    """Events as requests on three refs, one or two at a time, and ids of which some aren't stored."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("u"), F.col("event_id").alias("i"), F.abs(F.floor("value")).cast("long").alias("v"))
    state = "named_struct('canonical', concat('c', x), 'public', concat('p', (x + IF(v % 13 = 0, 1, 0)) % 3), 'lineage', CASE WHEN v % 17 = 0 THEN 'z' WHEN x % 2 = 1 THEN 'l' END)"
    ref = f"""named_struct('bookmark', concat('k', (i + j) % 3), 'expected', IF((v + i + j) % 3 = 0, NULL, concat('p', (v + j) % 3)),
        'observed', IF((v + i) % 5 = 0, NULL, concat('p', x % 3)), 'identity', IF(s = 0, concat('c', x), NULL), 'proposed', IF(s > 1, 0, NULL), 'states', IF(s > 1, array({state}), array()))"""
    rows = e.withColumn("j", F.explode(F.sequence(F.lit(0), (F.col("i") % 2).cast("int")))).withColumn("x", F.expr("(v + j * (i % 4 - 1)) % 6")).withColumn("s", F.expr("(i + v + j) % 7"))
    refs = rows.groupBy("u", "i", "v").agg(F.array_sort(F.collect_list(F.struct("j", F.expr(ref).alias("r")))).alias("_r")).withColumn("refs", F.expr(f"CAST(_r.r AS array<{requests.REF}>)"))
    events = refs.select(
        F.concat(F.lit("u"), "u").alias("repo"), F.col("i").cast("long").alias("sequence"), F.col("i").cast("long").alias("at"),
        F.expr("CASE WHEN v % 8 < 3 THEN 'begin' WHEN v % 8 = 3 THEN 'claim' WHEN v % 8 < 6 THEN 'recover' ELSE 'fetch' END").alias("kind"),
        F.expr("IF(v % 8 < 6, concat('b', i % 6), concat('f', i % 9))").alias("id"), F.expr("IF(v % 16 = 0, 'x', 'h')").alias("fingerprint"),
        F.expr("concat('m', IF(v % 8 = 3, v, i) % 2)").alias("machine"), F.lit("origin").alias("remote"), F.expr("1 + v % 3").alias("fence"), F.lit(True).alias("known"), "refs",
    )
    keys = table(spark, sf, "region").select(F.col("r_regionkey").cast("string").alias("k"))
    stored = keys.select(F.explode(F.array(F.concat(F.lit("c"), "k"), F.concat(F.lit("p"), "k"))).alias("id"))
    return requests.with_durability(events, stored)


# Folds the log step by step over lists of rows, one for each table that a repository's database would have.
JOURNAL_SQL = f"""
WITH RECURSIVE ok AS (SELECT list(concat('c', r_regionkey)) || list(concat('p', r_regionkey)) AS ok FROM region),
x AS (SELECT user_id AS u, event_id AS i, CAST(abs(floor(value)) AS BIGINT) AS v FROM events),
y AS (SELECT *, list_transform(range(0, 1 + i % 2), lambda j: {{'j': j, 'x': (v + j * (i % 4 - 1)) % 6, 's': (i + v + j) % 7}}) AS js FROM x),
z AS (SELECT *, list_transform(js, lambda t: {{
    'b': concat('k', (i + t.j) % 3), 'e': CASE WHEN (v + i + t.j) % 3 <> 0 THEN concat('p', (v + t.j) % 3) END, 'o': CASE WHEN (v + i) % 5 <> 0 THEN concat('p', t.x % 3) END,
    'd': CASE WHEN t.s = 0 THEN concat('c', t.x) END, 'c': CASE WHEN t.s > 1 THEN concat('c', t.x) END,
    'p': CASE WHEN t.s > 1 THEN concat('p', (t.x + CASE WHEN v % 13 = 0 THEN 1 ELSE 0 END) % 3) END,
    'l': CASE WHEN t.s > 1 THEN CASE WHEN v % 17 = 0 THEN 'z' WHEN t.x % 2 = 1 THEN 'l' END END}}) AS refs FROM y),
ev AS (SELECT concat('u', u) AS repo, row_number() OVER (PARTITION BY u ORDER BY i) AS k, i AS seq, refs,
    CASE WHEN v % 8 < 3 THEN 'begin' WHEN v % 8 = 3 THEN 'claim' WHEN v % 8 < 6 THEN 'recover' ELSE 'fetch' END AS kind,
    CASE WHEN v % 8 < 6 THEN concat('b', i % 6) ELSE concat('f', i % 9) END AS id, CASE WHEN v % 16 = 0 THEN 'x' ELSE 'h' END AS h,
    concat('m', CASE WHEN v % 8 = 3 THEN v ELSE i END % 2) AS m, 1 + v % 3 AS f,
    len(list_filter(list_transform(refs, lambda t: t.c) || list_transform(refs, lambda t: t.p) || list_transform(refs, lambda t: t.d), lambda t: t IS NOT NULL AND NOT list_contains(ok, t))) = 0 AS durable
    FROM z, ok),
st AS (
SELECT DISTINCT repo, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq, '' AS kind, '' AS id, '' AS outcome, CAST(0 AS BIGINT) AS fence, CAST(0 AS BIGINT) AS act,
    CAST([] AS STRUCT(b VARCHAR, o VARCHAR, d BOOLEAN)[]) AS cur, CAST([] AS STRUCT(c VARCHAR, p VARCHAR, l VARCHAR, b VARCHAR, id VARCHAR)[]) AS hist,
    CAST([] AS STRUCT(id VARCHAR, h VARCHAR, m VARCHAR, f BIGINT, cl BOOLEAN, refs STRUCT(b VARCHAR, e VARCHAR, o VARCHAR, d VARCHAR, c VARCHAR, p VARCHAR, l VARCHAR)[])[]) AS op,
    CAST([] AS STRUCT(id VARCHAR, h VARCHAR, f BIGINT)[]) AS res, CAST([] AS STRUCT(id VARCHAR, h VARCHAR)[]) AS fet FROM ev
UNION ALL
SELECT repo, k, seq, kind, id, outcome, CASE WHEN outcome IN ('begun', 'claimed') THEN fence + 1 ELSE fence END,
    act + CASE WHEN outcome IN ('accepted', 'fetched') THEN len(list_filter(took, lambda t: t.c IS NOT NULL OR t.d IS NOT NULL)) ELSE 0 END,
    CASE WHEN outcome IN ('accepted', 'fetched') THEN list_filter(cur, lambda t: NOT list_contains(list_transform(took, lambda w: w.b), t.b))
        || list_filter(list_transform(took, lambda t: {{'b': t.b, 'o': coalesce(t.p, t.d, CASE WHEN outcome = 'fetched' THEN t.o END), 'd': t.d IS NOT NULL}}), lambda t: t.o IS NOT NULL) ELSE cur END,
    CASE outcome WHEN 'begun' THEN hist || list_transform(ss, lambda t: {{'c': t.c, 'p': t.p, 'l': t.l, 'b': t.b, 'id': id}})
        WHEN 'fetched' THEN hist || list_transform(ss, lambda t: {{'c': t.c, 'p': t.p, 'l': t.l, 'b': t.b, 'id': NULL}})
        WHEN 'accepted' THEN list_transform(hist, lambda t: {{'c': t.c, 'p': t.p, 'l': t.l, 'b': t.b, 'id': CASE WHEN t.id IS DISTINCT FROM id_ THEN t.id END}})
        WHEN 'aborted' THEN list_filter(hist, lambda t: t.id IS DISTINCT FROM id_) ELSE hist END,
    CASE WHEN outcome = 'begun' THEN op || [{{'id': id, 'h': h, 'm': m, 'f': fence + 1, 'cl': false, 'refs': refs}}]
        WHEN outcome = 'claimed' THEN list_filter(op, lambda t: t.id <> id_) || [{{'id': id, 'h': b.h, 'm': m, 'f': fence + 1, 'cl': true, 'refs': b.refs}}]
        WHEN outcome IN ('accepted', 'aborted') THEN list_filter(op, lambda t: t.id <> id_) ELSE op END,
    CASE WHEN outcome IN ('accepted', 'aborted') THEN res || [{{'id': id, 'h': b.h, 'f': b.f}}] ELSE res END, CASE WHEN outcome = 'fetched' THEN fet || [{{'id': id, 'h': h}}] ELSE fet END
FROM (
SELECT *, CASE kind
    WHEN 'begin' THEN CASE WHEN coalesce(r.h, b.h) IS NOT NULL THEN CASE WHEN coalesce(r.h, b.h) = h THEN 'replayed' ELSE 'request_mismatch' END
        WHEN len(pend) + len(refs) > {LIMITS.refs} THEN 'pending_ref_limit' WHEN len(list_filter(hist, lambda t: t.id IS NOT NULL)) + len(ss) > {LIMITS.pending_states} THEN 'pending_state_limit'
        WHEN len(hist) + len(ss) > {LIMITS.states} THEN 'history_limit'
        WHEN len(cur) + len(list_filter(pend || refs, lambda t: t.e IS NULL AND coalesce(t.p, t.d) IS NOT NULL)) > {LIMITS.refs} THEN 'ref_limit'
        WHEN NOT durable THEN 'not_durable' WHEN bad = 'lineage' THEN 'lineage_diverged' WHEN bad IS NOT NULL THEN bad WHEN stale THEN 'cursor_stale' WHEN owned THEN 'push_in_progress' ELSE 'begun' END
    WHEN 'claim' THEN CASE WHEN r.h IS NOT NULL THEN 'replayed' WHEN b.h IS NULL THEN 'batch_not_found' ELSE 'claimed' END
    WHEN 'recover' THEN CASE WHEN r.h IS NOT NULL THEN CASE WHEN r.f = f THEN 'replayed' ELSE 'fence_stale' END WHEN b.h IS NULL THEN 'batch_not_found'
        WHEN b.f <> f OR b.m <> m THEN 'owner_stale' WHEN list_sort(list_transform(b.refs, lambda t: t.b)) <> list_sort(list_transform(refs, lambda t: t.b)) THEN 'observation_set_mismatch'
        WHEN len(list_filter(b.refs, lambda t: coalesce(t.p, t.d) IS DISTINCT FROM list_filter(refs, lambda w: w.b = t.b)[1].o)) = 0 THEN 'accepted'
        WHEN len(list_filter(b.refs, lambda t: t.e IS DISTINCT FROM list_filter(refs, lambda w: w.b = t.b)[1].o)) > 0 THEN 'remote_state_ambiguous'
        WHEN b.cl THEN 'replay_required' ELSE 'aborted' END
    ELSE CASE WHEN g.h IS NOT NULL THEN CASE WHEN g.h = h THEN 'replayed' ELSE 'fetch_mismatch' END WHEN stale THEN 'fetch_cursor_stale' WHEN owned THEN 'overlaps_pending' WHEN NOT durable THEN 'fetch_not_durable'
        WHEN bad = 'lineage' THEN 'lineage_ambiguous' WHEN bad IS NOT NULL THEN bad WHEN len(hist) + len(ss) > {LIMITS.states} THEN 'fetch_history_limit'
        WHEN len(cur) + len(list_filter(refs, lambda t: t.e IS NULL)) > {LIMITS.refs} THEN 'fetch_ref_limit'
        WHEN len(list_filter(refs, lambda t: t.c IS NULL AND t.d IS NULL AND len(list_filter(hist, lambda w: w.id IS NULL AND w.b = t.b AND w.p IS NOT DISTINCT FROM t.o)) = 0)) > 0 THEN 'observed_state_not_found'
        ELSE 'fetched' END END AS outcome,
    CASE WHEN kind = 'recover' THEN b.refs ELSE refs END AS took
FROM (
SELECT *, len(list_filter(refs, lambda t: t.e IS DISTINCT FROM list_filter(cur, lambda w: w.b = t.b)[1].o)) > 0 AS stale,
    len(list_filter(refs, lambda t: list_contains(list_transform(pend, lambda w: w.b), t.b))) > 0 AS owned,
    coalesce(CASE WHEN len(bs) = 2 AND bs[1].c = bs[2].c AND bs[1].p <> bs[2].p THEN 'canonical_diverged' WHEN len(bs) = 2 AND bs[1].c = bs[2].c AND (bs[1].l IS DISTINCT FROM bs[2].l OR bs[1].d <> bs[2].d) THEN 'lineage' END,
        list_filter(list_transform(bs, lambda t: CASE WHEN t.c <> t.p AND list_contains(ident, t.c) THEN 'canonical_diverged'
            WHEN len(list_filter(hist, lambda w: w.c = t.c AND (t.d OR w.p <> t.p))) > 0 THEN 'canonical_diverged'
            WHEN len(list_filter(hist, lambda w: w.c = t.c AND w.l IS DISTINCT FROM t.l)) > 0 THEN 'lineage' END), lambda t: t IS NOT NULL)[1]) AS bad
FROM (
SELECT st.* EXCLUDE (k, seq, kind, id, outcome), ev.k, ev.seq, ev.kind, ev.id, ev.id AS id_, ev.h, ev.m, ev.f, ev.refs, ev.durable,
    list_filter(op, lambda t: t.id = ev.id)[1] AS b, list_filter(res, lambda t: t.id = ev.id)[1] AS r, list_filter(fet, lambda t: t.id = ev.id)[1] AS g,
    list_filter(ev.refs, lambda t: t.c IS NOT NULL) AS ss, flatten(list_transform(op, lambda t: t.refs)) AS pend,
    list_transform(list_filter(cur, lambda t: t.d), lambda t: t.o) || list_transform(list_filter(flatten(list_transform(op, lambda t: t.refs)), lambda t: t.d IS NOT NULL), lambda t: t.d) AS ident,
    list_transform(list_filter(ev.refs, lambda t: coalesce(t.c, t.d) IS NOT NULL), lambda t: {{'c': coalesce(t.c, t.d), 'p': coalesce(t.p, t.d), 'l': t.l, 'd': t.d IS NOT NULL}}) AS bs
FROM st JOIN ev ON ev.repo = st.repo AND ev.k = st.k + 1))))
SELECT repo, seq AS sequence, kind, id, outcome, fence, act AS activation FROM st WHERE k > 0
"""


@query("replay_journal", JOURNAL_SQL)
def replay_journal(spark, sf):
    """The outcome of every request, repository by repository."""
    return requests.replay_journal(journal_events(spark, sf), LIMITS)


@query("stream_journal", JOURNAL_SQL)
def stream_journal(spark, sf):
    """The same outcomes from a stream over several triggers, whose state is kept in maps by key."""
    rows = journal_events(spark, sf)
    source = in_time(spark, rows, "sequence", "journal")
    name = "spark.sql.streaming.stateStore.providerClass"
    kept = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return jobs.run_to_end(jobs.journal_stream(jobs.tail(spark, source, rows.schema, 4), LIMITS), f"{source}-out", f"{source}-checkpoint")
    finally:
        spark.conf.unset(name) if kept is None else spark.conf.set(name, kept)
