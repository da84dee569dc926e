"""Queries on refs, journal states, packs and the repository directory: joins, aggregates and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import journal, relations
from .registry import query
from .tables import REPOSITORIES_SQL, STATES_SQL, repositories, states, table

KEY = ["remote", "bookmark"]
S = f"WITH s AS ({STATES_SQL})"
NEWEST = f"SELECT remote, bookmark, arg_max(public, activation_seq) AS public, max(activation_seq) AS activation_seq FROM ({STATES_SQL}) GROUP BY remote, bookmark"


def newest(spark, sf):
    return relations.newest(states(spark, sf), KEY, ["activation_seq"], ["public", "activation_seq"])


@query("newest_state", NEWEST)
def newest_state(spark, sf):
    return newest(spark, sf)


@query("state_for_observed", S + " SELECT remote, bookmark, public, max(state_id) AS state_id FROM s WHERE public < '2' GROUP BY ALL")
def state_for_observed(spark, sf):
    """The newest state of each ref with the public ids observed, those that sort before 2."""
    s = states(spark, sf)
    observed = s.where("public < '2'").select(*KEY, "public").distinct()
    return relations.state_for_observed(observed, s, KEY, ["activation_seq"], ["state_id"])


@query(
    "active_cursors",
    S + f", n AS ({NEWEST}) SELECT s.remote, s.bookmark, s.canonical, s.public, s.lineage FROM n JOIN s ON s.state_id = n.activation_seq WHERE s.remote = n.remote AND s.bookmark = n.bookmark UNION ALL SELECT 'r9', concat('i', c_custkey), c_name, c_name, NULL FROM customer",
)
def active_cursors(spark, sf):
    cursors = newest(spark, sf).select(*KEY, F.col("activation_seq").alias("state_id"))
    identity = table(spark, sf, "customer").select(F.lit("r9").alias("remote"), F.concat(F.lit("i"), "c_custkey").alias("bookmark"), F.col("c_name").alias("oid"))
    return relations.active_cursors(cursors, states(spark, sf), identity)


@query(
    "pending_refs",
    "SELECT o_orderkey AS state_id, o_custkey AS batch_id, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END AS identity, coalesce(l.public, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END) AS proposed "
    "FROM orders LEFT JOIN (SELECT event_id AS state_id, CAST(value AS BIGINT)::VARCHAR AS public FROM events WHERE event_type = 'purchase' AND value = floor(value)) l ON l.state_id = o_orderkey",
)
def pending_refs(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("state_id"), F.col("o_custkey").alias("batch_id"), F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")).alias("identity"))
    s = table(spark, sf, "events").where("event_type = 'purchase' AND value = floor(value)").select(F.col("event_id").alias("state_id"), F.col("value").cast("long").cast("string").alias("public"))
    return relations.pending_refs(o, s)


@query(
    "replay_view",
    "SELECT l_orderkey AS batch_id, array_to_string(list(l_partkey ORDER BY l_linenumber, l_partkey), ',') AS states, CAST(coalesce(list_position(list(l_partkey ORDER BY l_linenumber, l_partkey), max(l_partkey)), 0) AS BIGINT) AS proposed_at FROM lineitem GROUP BY l_orderkey",
)
def replay_view(spark, sf):
    """An order's parts in the order of its lines, and where the largest stands."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("batch_id"), "l_linenumber", "l_partkey")
    out = relations.replay(lines, ["batch_id"], "l_linenumber", "l_partkey", "l_partkey")
    return out.withColumn("states", F.array_join(F.col("states").cast("array<string>"), ","))


@query(
    "stale_expectations",
    S + f", n AS ({NEWEST}), q AS (SELECT remote, bookmark, min(public) AS expected FROM s GROUP BY ALL UNION ALL SELECT 'r0', concat('x', o_custkey), NULL FROM (SELECT DISTINCT o_custkey FROM orders)) "
    "SELECT q.remote, q.bookmark, q.expected, n.public AS actual FROM q LEFT JOIN n ON n.remote = q.remote AND n.bookmark = q.bookmark WHERE n.public IS DISTINCT FROM q.expected",
)
def stale_expectations(spark, sf):
    """Requests that expect a ref's least public id; those on new refs expect none and agree."""
    asked = states(spark, sf).groupBy(*KEY).agg(F.min("public").alias("expected"))
    new = table(spark, sf, "orders").select(F.lit("r0").alias("remote"), F.concat(F.lit("x"), "o_custkey").alias("bookmark"), F.lit(None).cast("string").alias("expected")).distinct()
    return relations.stale_expectations(asked.unionByName(new), newest(spark, sf).withColumnRenamed("public", "oid"), KEY)


@query("not_durable", "SELECT l_orderkey, l_linenumber, oid FROM (SELECT l_orderkey, l_linenumber, unnest(list_distinct([l_partkey, l_suppkey])) AS oid FROM lineitem) WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = oid)")
def not_durable(spark, sf):
    lines = table(spark, sf, "lineitem")
    found = relations.not_durable(lines, ["l_partkey", "l_suppkey"], table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")))
    return found.select("l_orderkey", "l_linenumber", "oid")


@query("binding_conflicts", S + " SELECT canonical, CAST(count(*) AS INTEGER) AS n_bindings FROM (SELECT DISTINCT canonical, public, lineage FROM s) GROUP BY canonical HAVING count(*) > 1")
def binding_conflicts(spark, sf):
    return relations.binding_conflicts(states(spark, sf), ["canonical"], ["public", "lineage"])


@query(
    "stored_binding_conflicts",
    S + """, a AS (SELECT * FROM s WHERE remote = 'r0'), b AS (SELECT DISTINCT canonical, public, lineage FROM s WHERE remote = 'r1')
    SELECT DISTINCT * FROM (SELECT a.canonical, a.public, b.public AS old_public, CASE WHEN (a.canonical = a.public) <> (a.canonical = b.public) THEN 'identity_mixed' WHEN a.public IS DISTINCT FROM b.public THEN 'public_differs'
    WHEN a.lineage IS DISTINCT FROM b.lineage THEN 'lineage_differs' END AS code FROM a JOIN b USING (canonical)) WHERE code IS NOT NULL""",
)
def stored_binding_conflicts(spark, sf):
    s = states(spark, sf)
    return relations.stored_binding_conflicts(s.where("remote = 'r0'"), s.where("remote = 'r1'"))


@query(
    "lineage_conflicts",
    S + f", n AS (SELECT remote, bookmark, max_by(struct_pack(l := lineage), activation_seq).l AS active_lineage FROM s GROUP BY ALL), q AS (SELECT DISTINCT remote, bookmark, lineage FROM s) "
    "SELECT q.remote, q.bookmark, q.lineage, n.active_lineage FROM q JOIN n USING (remote, bookmark) WHERE q.lineage IS DISTINCT FROM n.active_lineage",
)
def lineage_conflicts(spark, sf):
    s = states(spark, sf)
    return relations.lineage_conflicts(s.select(*KEY, "lineage").distinct(), s, KEY, ["activation_seq"])


@query("overlapping_pending", S + " SELECT state_id, remote, bookmark FROM s WHERE lineage = 'view' AND EXISTS (SELECT 1 FROM s t WHERE t.remote = s.remote AND t.bookmark = s.bookmark AND t.lineage = 'purchase' AND t.public > '9')")
def overlapping_pending(spark, sf):
    s = states(spark, sf)
    return relations.overlapping_pending(s.where("lineage = 'view'").select("state_id", *KEY), s.where("lineage = 'purchase' AND public > '9'"), KEY)


@query(
    "authorized",
    f"WITH r AS ({REPOSITORIES_SQL}) SELECT o_orderkey, o_custkey AS repository_id, c_nationkey AS user_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE EXISTS (SELECT 1 FROM r WHERE r.repository_id = o_custkey AND r.user_id = c_nationkey AND status = 'active')",
)
def authorized(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("repository_id"), F.col("c_nationkey").alias("user_id"))
    asked = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("repository_id")).join(c, "repository_id")
    return relations.authorized(asked, repositories(spark, sf), ["repository_id", "user_id"])


@query("new_heads", "SELECT DISTINCT concat(l_partkey, '/', l_returnflag) AS head FROM lineitem WHERE l_returnflag IN ('A', 'N') AND NOT EXISTS (SELECT 1 FROM part WHERE p_size > 25 AND p_partkey = l_partkey AND l_returnflag = 'A') AND NOT (l_partkey = 0 AND l_returnflag = 'N')")
def new_heads(spark, sf):
    current = table(spark, sf, "lineitem").where("l_returnflag IN ('A', 'N')").select(F.concat_ws("/", "l_partkey", "l_returnflag").alias("head"))
    accepted = table(spark, sf, "part").where("p_size > 25").select(F.concat_ws("/", "p_partkey", F.lit("A")).alias("head"))
    return relations.new_heads(current, accepted, "0/N")


OBSERVED = """
WITH u AS (SELECT user_id AS bookmark, min(value) AS expected, max(value) AS proposed, CAST(NULL AS DOUBLE) AS identity FROM events GROUP BY 1),
o AS (SELECT user_id AS bookmark, max(value) AS oid FROM events WHERE event_type <> 'error' GROUP BY 1 HAVING count(*) > 5)
SELECT u.bookmark, expected, proposed, o.oid AS observed, CASE WHEN o.bookmark IS NULL THEN 'not_reported' WHEN proposed IS NULL AND oid IS NULL THEN 'deleted' WHEN proposed IS NOT DISTINCT FROM oid THEN 'accepted'
WHEN expected IS NOT DISTINCT FROM oid THEN 'unchanged' ELSE 'differs' END AS outcome FROM u LEFT JOIN o USING (bookmark)
"""


@query("observed_refs", OBSERVED)
def observed_refs(spark, sf):
    e = table(spark, sf, "events").withColumnRenamed("user_id", "bookmark")
    asked = e.groupBy("bookmark").agg(F.min("value").alias("expected"), F.max("value").alias("proposed")).withColumn("identity", F.lit(None).cast("double"))
    report = e.where("event_type <> 'error'").groupBy("bookmark").agg(F.max("value").alias("oid"), F.count("*").alias("n")).where("n > 5").drop("n")
    return relations.observed_refs(asked, report, ["bookmark"]).drop("identity")


@query(
    "ineligible",
    """WITH q AS (SELECT l_returnflag AS remote, l_partkey AS bookmark, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT q.remote, q.bookmark, CASE WHEN q.remote = 'R' THEN 'remote_unknown' WHEN q.n > 1 THEN 'duplicate_request' WHEN p_size > 40 THEN 'conflicted' WHEN p_retailprice < 950 THEN 'untracked' END AS code
    FROM q LEFT JOIN part ON p_partkey = q.bookmark WHERE q.remote = 'R' OR q.n > 1 OR p_size > 40 OR p_retailprice < 950""",
)
def ineligible(spark, sf):
    asked = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("remote"), F.col("l_partkey").alias("bookmark"))
    p = table(spark, sf, "part")
    targets = p.select(F.col("p_partkey").alias("bookmark"), F.when(F.col("p_size") > 40, 3).otherwise(1).alias("n_terms"))
    known = p.select(F.explode(F.array(F.lit("A"), F.lit("N"))).alias("remote"), F.col("p_partkey").alias("bookmark"), (F.col("p_retailprice") >= 950).alias("tracked"))
    return relations.ineligible(asked, targets, known, known.select("remote").distinct())


CLASSIFY = "WITH a AS (SELECT o_custkey AS k, max(o_orderkey) AS target FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, max(o_orderkey) AS c FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1)"


@query("classify_refs", CLASSIFY + """ SELECT coalesce(a.k, b.k) AS bookmark, target, c AS "cursor", CASE WHEN target IS NULL AND c IS NULL THEN 'missing' WHEN target IS NULL THEN 'delete' WHEN c IS NULL THEN 'create' WHEN target = c THEN 'up-to-date' ELSE 'update' END AS outcome FROM a FULL JOIN b ON a.k = b.k""")
def classify_refs(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "bookmark")
    top = lambda rows: rows.groupBy("bookmark").agg(F.max("o_orderkey").alias("oid"))
    return relations.classify_refs(top(o.where("o_orderstatus <> 'F'")), top(o.where("o_orderpriority <> '5-LOW'")), ["bookmark"])


@query("classify_fetch", CLASSIFY + """ SELECT a.k AS bookmark, target AS oid, c AS "cursor", CASE WHEN c IS NULL THEN 'new' WHEN c = target THEN 'up-to-date' ELSE 'moved' END AS outcome FROM a LEFT JOIN b ON a.k = b.k""")
def classify_fetch(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "bookmark")
    top = lambda rows: rows.groupBy("bookmark").agg(F.max("o_orderkey").alias("oid"))
    return relations.classify_fetch(top(o.where("o_orderstatus <> 'F'")), top(o.where("o_orderpriority <> '5-LOW'")), ["bookmark"])


@query("ref_delta", CLASSIFY + " SELECT coalesce(a.k, b.k) AS bookmark, target AS view_oid, c AS head_oid FROM a FULL JOIN b ON a.k = b.k WHERE target IS DISTINCT FROM c")
def ref_delta(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "bookmark")
    top = lambda rows: rows.groupBy("bookmark").agg(F.max("o_orderkey").alias("oid"))
    return relations.ref_delta(top(o.where("o_orderstatus <> 'F'")), top(o.where("o_orderpriority <> '5-LOW'")), ["bookmark"])


@query("deletion_candidates", "SELECT c_custkey AS bookmark FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AND c_acctbal > 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '2-HIGH')")
def deletion_candidates(spark, sf):
    c = table(spark, sf, "customer").withColumnRenamed("c_custkey", "bookmark")
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "bookmark")
    return relations.deletion_candidates(c.select("bookmark"), o.where("o_orderpriority = '1-URGENT'"), c.where("c_acctbal > 0"), o.where("o_orderpriority = '2-HIGH'"), ["bookmark"])


@query(
    "reconcile_catalogs",
    """WITH d AS (SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_acctbal > 1000), m AS (SELECT c_custkey AS k, CASE WHEN c_nationkey < 5 THEN lower(c_name) ELSE c_name END AS name FROM customer WHERE c_mktsegment <> 'BUILDING'),
    w AS (SELECT o_custkey AS k, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS paths FROM orders GROUP BY 1)
    SELECT coalesce(d.k, m.k) AS repository_id, CASE WHEN m.k IS NULL THEN 'directory_only' WHEN d.k IS NULL THEN 'missing_from_directory' ELSE 'available' END AS outcome, d.k IS NOT NULL AND m.k IS NOT NULL AND d.name <> m.name AS renamed,
    coalesce(w.paths, '') AS paths FROM d FULL JOIN m ON d.k = m.k LEFT JOIN w ON w.k = coalesce(d.k, m.k)""",
)
def reconcile_catalogs(spark, sf):
    c = table(spark, sf, "customer").withColumnRenamed("c_custkey", "repository_id")
    directory = c.where("c_acctbal > 1000").select("repository_id", F.col("c_name").alias("name"))
    catalog = c.where("c_mktsegment <> 'BUILDING'").select("repository_id", F.when(F.col("c_nationkey") < 5, F.lower("c_name")).otherwise(F.col("c_name")).alias("name"))
    work = table(spark, sf, "orders").select(F.col("o_custkey").alias("repository_id"), F.col("o_orderpriority").alias("path"))
    return relations.reconcile_catalogs(directory, catalog, work, ["repository_id"]).withColumn("paths", F.array_join("paths", ","))


PIN_MODE = "CASE p_size % 4 WHEN 0 THEN 'default' WHEN 1 THEN 'ref' WHEN 2 THEN 'exact' ELSE 'other' END"


@query(
    "pin_updates",
    f"""WITH p AS (SELECT p_partkey AS alias, p_brand AS url, {PIN_MODE} AS mode, p_type AS ref, p_name AS c FROM part), l AS (SELECT p_brand AS url, 'HEAD' AS ref, max(p_name) AS oid FROM part GROUP BY 1 UNION ALL
    SELECT p_brand, p_type, min(p_name) FROM part WHERE p_size < 25 GROUP BY 1, 2), j AS (SELECT p.*, l.oid FROM p LEFT JOIN l ON l.url = p.url AND l.ref = CASE mode WHEN 'default' THEN 'HEAD' WHEN 'ref' THEN p.ref END),
    o AS (SELECT alias, c AS "commit", oid AS new_commit, CASE WHEN mode = 'exact' THEN 'skipped_exact' WHEN mode = 'other' THEN 'skipped_foreign' WHEN oid IS NULL THEN 'ref_not_found' WHEN oid <> c THEN 'advanced' END AS outcome FROM j) SELECT * FROM o WHERE outcome IS NOT NULL""",
)
def pin_updates(spark, sf):
    p = table(spark, sf, "part")
    pins = p.select(F.col("p_partkey").alias("alias"), F.col("p_brand").alias("url"), F.expr(PIN_MODE).alias("mode"), F.col("p_type").alias("ref"), F.col("p_name").alias("commit"))
    heads = p.groupBy(F.col("p_brand").alias("url")).agg(F.max("p_name").alias("oid")).withColumn("ref", F.lit("HEAD"))
    named = p.where("p_size < 25").groupBy(F.col("p_brand").alias("url"), F.col("p_type").alias("ref")).agg(F.min("p_name").alias("oid"))
    return relations.pin_updates(pins, heads.unionByName(named))


@query(
    "seed_resolution",
    """WITH m AS (SELECT DISTINCT l_suppkey AS public, l_partkey AS canonical FROM lineitem WHERE l_quantity > 48), j AS (SELECT s_suppkey AS public, m.canonical, p_size = s_nationkey AS fits FROM supplier LEFT JOIN m ON m.public = s_suppkey LEFT JOIN part ON p_partkey = m.canonical),
    g AS (SELECT public, count(DISTINCT canonical) AS n, min(canonical) AS one, count(DISTINCT canonical) FILTER (fits) AS nf, min(canonical) FILTER (fits) AS f FROM j GROUP BY 1)
    SELECT public, CASE WHEN n = 1 THEN one WHEN nf = 1 THEN f END AS canonical, CASE WHEN n = 0 THEN 'unmapped' WHEN n = 1 OR nf = 1 THEN 'mapped' ELSE 'ambiguous' END AS outcome FROM g""",
)
def seed_resolution(spark, sf):
    """Suppliers as public ids, the parts of their large lines as canonical ones; sizes and nations stand for parents."""
    seeds = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("public"), F.array("s_nationkey").alias("parents"))
    mapping = table(spark, sf, "lineitem").where("l_quantity > 48").select(F.col("l_suppkey").alias("public"), F.col("l_partkey").alias("canonical")).distinct()
    parents = table(spark, sf, "part").select(F.col("p_partkey").alias("canonical"), F.array("p_size").alias("parents"))
    return relations.resolve_seeds(seeds, mapping, parents, seeds)


@query("mapping_conflicts", S + " SELECT canonical, count(DISTINCT public) AS n_public FROM s GROUP BY canonical HAVING count(DISTINCT public) > 1")
def mapping_conflicts(spark, sf):
    return relations.mapping_conflicts(states(spark, sf))


HALVES = "SELECT md5(coalesce(text, '')) AS id, max(coalesce(strlen(text), 0)) AS size FROM documents"


@query("inventory", f"WITH a AS ({HALVES} GROUP BY 1), b AS ({HALVES} WHERE source >= 'src5' GROUP BY 1) SELECT id, EXISTS (SELECT 1 FROM b WHERE b.id = a.id) AS present FROM a")
def inventory(spark, sf):
    d = table(spark, sf, "documents").select(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("id"), "source")
    some, store = d.select("id").distinct(), d.where("source >= 'src5'").select("id").distinct()
    return relations.present(some, store, ["id"]).withColumn("present", F.lit(True)).unionByName(relations.absent(some, store, ["id"]).withColumn("present", F.lit(False)))


@query(
    "known_subtraction",
    f"WITH a AS ({HALVES} GROUP BY 1), b AS ({HALVES} WHERE source >= 'src5' GROUP BY 1) SELECT count(*) AS discovered, count(b.id) AS skipped, count(*) - count(b.id) AS packed, CAST(coalesce(sum(a.size) FILTER (b.id IS NULL), 0) AS BIGINT) AS packed_bytes FROM a LEFT JOIN b USING (id)",
)
def known_subtraction(spark, sf):
    d = table(spark, sf, "documents").select(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("id"), "source", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    return relations.subtraction_counts(d.groupBy("id").agg(F.max("size").alias("size")), d.where("source >= 'src5'"), ["id"], "size")


@query("merge_counts", "WITH a AS (SELECT l_suppkey AS k, min(l_partkey) AS v, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1) SELECT count(*) FILTER (n = 1 AND s_suppkey IS NULL) AS inserted, count(*) FILTER (n = 1 AND s_suppkey IS NOT NULL AND s_nationkey = v) AS existing, count(*) FILTER (n > 1 OR (s_suppkey IS NOT NULL AND s_nationkey <> v)) AS conflicts FROM a LEFT JOIN supplier ON s_suppkey = k")
def merge_counts(spark, sf):
    new = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("v"))
    return relations.merge_counts(new, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").cast("long").alias("v")), ["k"], "v")


@query("store_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("documents", "pages", "benchmark", "lineitem", "events")))
def store_counts(spark, sf):
    return relations.store_counts({t: table(spark, sf, t) for t in ("documents", "pages", "benchmark", "lineitem", "events")})


@query(
    "batch_verdicts",
    """WITH r AS (SELECT l_orderkey AS b, l_linenumber AS k, min(l_partkey) % 3 AS e, max(l_suppkey) % 3 AS p FROM lineitem GROUP BY ALL), o AS (SELECT l_orderkey AS b, l_linenumber AS k, CASE WHEN o_orderstatus = 'F' THEN max(l_suppkey) % 3 WHEN o_orderstatus = 'O' THEN min(l_partkey) % 3 ELSE 1 END AS v
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber < 7 GROUP BY l_orderkey, l_linenumber, o_orderstatus), g AS (SELECT coalesce(r.b, o.b) AS b, bool_and(r.b IS NOT NULL AND o.b IS NOT NULL) AS x, bool_and(v IS NOT DISTINCT FROM p) AS ap, bool_and(v IS NOT DISTINCT FROM e) AS ae FROM r FULL JOIN o ON r.b = o.b AND r.k = o.k GROUP BY 1)
    SELECT b AS batch_id, CASE WHEN NOT x THEN 'invalid' WHEN ap THEN 'accepted' WHEN ae AND o_orderkey IS NOT NULL THEN 'replay_required' WHEN ae THEN 'aborted' ELSE 'ambiguous' END AS verdict FROM g LEFT JOIN orders ON o_orderkey = b AND o_orderpriority = '1-URGENT'""",
)
def batch_verdicts(spark, sf):
    line = table(spark, sf, "lineitem")
    refs = line.groupBy(F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("bookmark")).agg((F.min("l_partkey") % 3).alias("expected"), (F.max("l_suppkey") % 3).alias("proposed"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("batch_id"), "o_orderstatus", "o_orderpriority")
    seen = refs.where("bookmark < 7").join(o, "batch_id").select("batch_id", "bookmark", F.when(F.col("o_orderstatus") == "F", F.col("proposed")).when(F.col("o_orderstatus") == "O", F.col("expected")).otherwise(F.lit(1)).alias("observed"))
    return relations.batch_verdicts(refs, seen, o.where("o_orderpriority = '1-URGENT'"))


@query(
    "quota_usage",
    S + " SELECT remote, rule, used, bound, bound - used AS headroom FROM (SELECT remote, unnest([{'rule': 'states', 'used': n, 'bound': 65536}, {'rule': 'unlined', 'used': m, 'bound': 512}], recursive := true) FROM (SELECT remote, count(*) AS n, count(*) FILTER (lineage IS NULL) AS m FROM s GROUP BY 1))",
)
def quota_usage(spark, sf):
    counters = {"states": F.lit(True), "unlined": F.col("lineage").isNull()}
    return relations.quota_usage(states(spark, sf), ["remote"], counters, {"states": 65_536, "unlined": 512})


@query(
    "sync_status",
    """SELECT c_custkey AS repository_id, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS has_state, coalesce((SELECT nullif(count(*), 0) FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT'),
    (SELECT nullif(count(*), 0) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'F'), 0) AS pending FROM customer""",
)
def sync_status(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("repository_id"), F.col("o_orderkey").alias("head"), "o_orderstatus", "o_orderpriority")
    repos = table(spark, sf, "customer").select(F.col("c_custkey").alias("repository_id"))
    return relations.sync_status(repos, o, o.where("o_orderstatus = 'F'"), o.where("o_orderpriority = '1-URGENT'"), "repository_id")


@query("pending_report", "SELECT o_custkey AS repository_id, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS bookmarks, substr(min(md5(CAST(o_orderkey AS VARCHAR))), 1, 12) AS owner FROM orders GROUP BY 1")
def pending_report(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("repository_id"), F.col("o_orderpriority").alias("bookmark"), F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("owner"))
    return relations.pending_report(o, ["repository_id"])


@query("workspaces", "SELECT role AS workspace, commit_id, split_part(c.text, chr(10), 1) AS title, role = 'user' AS current FROM (SELECT conv_id, role, min(concat(conv_id, ':', turn)) AS commit_id FROM conversations GROUP BY ALL) w LEFT JOIN (SELECT concat(conv_id, ':', turn) AS commit_id, max(text) AS text FROM conversations GROUP BY 1) c USING (commit_id)")
def workspaces(spark, sf):
    """Each conversation's roles as working copies at their first turns."""
    c = table(spark, sf, "conversations").withColumn("commit_id", F.concat_ws(":", "conv_id", "turn"))
    at = c.groupBy("conv_id", "role").agg(F.min("commit_id").alias("commit_id"))
    views = at.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "commit_id"))).alias("working_copies"))
    return relations.workspaces(views, c.groupBy("commit_id").agg(F.max("text").alias("description")), "user")


@query("id_collisions", "SELECT md5(coalesce(text, '')) AS id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def id_collisions(spark, sf):
    return relations.duplicates(table(spark, sf, "documents").select(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("id")), ["id"])


@query(
    "limit_audit",
    "WITH g AS (SELECT source, count(*) AS objects, sum(coalesce(strlen(text), 0)) AS bytes, max(coalesce(strlen(text), 0)) AS largest FROM documents GROUP BY 1) SELECT source, 'bytes' AS rule, CAST(bytes AS BIGINT) AS value, 100000 AS bound FROM g WHERE bytes > 100000 UNION ALL SELECT source, 'largest', largest, 20000 FROM g WHERE largest > 20000 UNION ALL SELECT source, 'objects', objects, 65536 FROM g WHERE objects > 65536",
)
def limit_audit(spark, sf):
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    return relations.limit_audit(table(spark, sf, "documents"), ["source"], {"objects": (F.count("*"), 65_536), "bytes": (F.sum(size), 100_000), "largest": (F.max(size), 20_000)})


# ------------------------------------------------------------------ logs


@query(
    "upsert_cursors",
    "WITH a AS (SELECT user_id AS bookmark, event_id AS seq, value, 0 AS c FROM events WHERE event_type = 'view' UNION ALL SELECT user_id, event_id, -value, 1 FROM events WHERE event_type <> 'view' AND value > 50) SELECT bookmark, max(seq) AS seq, arg_max(value, seq) AS value FROM a GROUP BY 1",
)
def upsert_cursors(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("bookmark"), F.col("event_id").alias("seq"), "value", "event_type")
    return journal.upsert(e.where("event_type = 'view'").drop("event_type"), e.where("event_type <> 'view' AND value > 50").withColumn("value", -F.col("value")).drop("event_type"), ["bookmark"], ["seq"])


@query("insert_ignored", "SELECT s_suppkey AS id FROM supplier UNION SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 45")
def insert_ignored(spark, sf):
    rows = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id"))
    return journal.insert_ignore(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")), rows, ["id"])


@query("current_cursors", "SELECT user_id AS bookmark, arg_max(event_type, event_id) AS kind, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1")
def current_cursors(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("bookmark"), F.col("event_type").alias("kind"), "value", "event_id")
    return journal.current_cursors(e, ["bookmark"], "event_id")


@query(
    "dedup_requests",
    "WITH e AS (SELECT event_id, user_id, hour(ts) AS key, event_type AS fp FROM events), f AS (SELECT user_id, key, min(event_id) AS first, arg_min(fp, event_id) AS ff FROM e GROUP BY ALL) SELECT event_id, CASE WHEN event_id = first THEN 'first' WHEN fp = ff THEN 'replay' ELSE 'mismatch' END AS outcome FROM e JOIN f USING (user_id, key)",
)
def dedup_requests(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", F.hour("ts").alias("key"), "event_type")
    return journal.dedup_requests(e, ["user_id", "key"], "event_id", "event_type").select("event_id", "outcome")


HEADS = """
WITH RECURSIVE h AS (SELECT user_id AS repo, row_number() OVER w AS c, CAST(floor(value) AS BIGINT) % 7 AS new, lag(CAST(floor(value) AS BIGINT) % 7) OVER w AS o1, CAST(floor(value) AS BIGINT) % 5 AS o2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
add AS (SELECT repo, new AS head, c AS tm, 1 AS a FROM h), tak AS (SELECT DISTINCT repo, head, c AS tm, 0 AS a FROM (SELECT repo, c, o1 AS head FROM h UNION ALL SELECT repo, c, o2 FROM h) WHERE head IS NOT NULL),
m AS (SELECT *, min(CASE WHEN a = 0 THEN tm END) OVER (PARTITION BY repo, head ORDER BY tm, a ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS removed_at, lag(a) OVER (PARTITION BY repo, head ORDER BY tm, a) AS was FROM (SELECT * FROM add UNION ALL SELECT * FROM tak)),
i AS (SELECT repo, head, tm AS added_at, removed_at FROM m WHERE a = 1 AND coalesce(was, 0) = 0)
"""


def transactions(spark, sf):
    """Head transactions of users: the new head, and the heads observed: the one before and another."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf, "events").withColumn("new_head", F.floor("value") % 7)
    e = e.select(F.col("user_id").alias("repo"), F.row_number().over(w).alias("cursor"), "new_head", F.lag("new_head").over(w).alias("_before"), (F.floor("value") % 5).alias("_other"))
    return e.select("repo", "cursor", "new_head", F.array("_before", "_other").alias("observed"))


@query("head_set", HEADS + "SELECT repo, head, added_at FROM i WHERE removed_at IS NULL")
def head_set(spark, sf):
    return journal.head_set(transactions(spark, sf), ["repo"], "cursor").withColumn("added_at", F.col("added_at").cast("long"))


@query("heads_as_of", HEADS + "SELECT repo, head, added_at, removed_at FROM i WHERE added_at <= 20 AND (removed_at IS NULL OR removed_at > 20)")
def heads_as_of(spark, sf):
    from ..operators import ordering

    return ordering.heads_as_of(journal.head_intervals(transactions(spark, sf), ["repo"], "cursor"), 20)


def batch_events(spark, sf):
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_type").isin("view", "signup"), "begin").when(F.col("event_type") == "click", "claim").otherwise("recover")
    cut = lambda n: F.when(F.floor("value") % n != 0, (F.floor("value") % n).cast("string"))
    return e.select(
        F.concat(F.lit("u"), F.col("user_id") % 50).alias("repo"), F.col("event_id").alias("sequence"), kind.alias("kind"), F.concat(F.lit("b"), F.floor("event_id") % 97).alias("batch_id"), F.concat(F.lit("m"), F.floor("event_id") % 3).alias("bookmark"),
        cut(2).alias("expected"), cut(3).alias("proposed"), cut(4).alias("observed"), (F.floor("value") % 2).cast("int").alias("fence"),
    )


@query("replay_batches")
def replay_batches(spark, sf):
    """Events as batch requests, folded per repository. Order-dependent, so it has no SQL; a step-by-step test covers it."""
    return journal.replay_batches(batch_events(spark, sf))


@query("replay_fetches")
def replay_fetches(spark, sf):
    """Events as fetches whose observed ids must be stored, and whose expectation the last accepted one."""
    e = batch_events(spark, sf).select("repo", "sequence", "bookmark", "expected", F.coalesce("proposed", F.lit("0")).alias("observed"))
    stored = table(spark, sf, "region").select(F.col("r_regionkey").cast("string").alias("id"))
    ok, bad = journal.replay_fetches(e, stored)
    return ok.unionByName(bad)


STATUS = "CASE o_orderstatus WHEN 'O' THEN 'provisioning' WHEN 'P' THEN 'active' ELSE 'retiring' END"


@query(
    "lifecycle_violations",
    f"""WITH e AS (SELECT o_custkey AS repository_id, o_orderkey, {STATUS} AS status, o_orderdate FROM orders), p AS (SELECT *, lag(status) OVER (PARTITION BY repository_id ORDER BY o_orderdate, o_orderkey) AS previous FROM e)
    SELECT repository_id, o_orderkey, status, previous FROM p WHERE status IS DISTINCT FROM previous AND NOT ((previous IS NULL AND status = 'provisioning') OR (coalesce(previous, '') = 'provisioning' AND status IN ('active', 'deleted'))
    OR (coalesce(previous, '') = 'active' AND status = 'retiring') OR (coalesce(previous, '') = 'retiring' AND status = 'deleted'))""",
)
def lifecycle_violations(spark, sf):
    e = table(spark, sf, "orders").select(F.col("o_custkey").alias("repository_id"), "o_orderkey", F.expr(STATUS).alias("status"), "o_orderdate")
    return journal.lifecycle_violations(e, ["repository_id"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("repository_states", f"SELECT o_custkey AS repository_id, arg_max({STATUS}, (o_orderdate, o_orderkey)) AS status, max(o_orderdate) AS o_orderdate, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def repository_states(spark, sf):
    e = table(spark, sf, "orders").select(F.col("o_custkey").alias("repository_id"), "o_orderkey", F.expr(STATUS).alias("status"), "o_orderdate")
    return journal.repository_states(e, ["repository_id"], ["o_orderdate", "o_orderkey"])


R = f"WITH r AS ({REPOSITORIES_SQL})"


@query("expired_provisional", R + " SELECT repository_id, user_id, name, status, created_at FROM r WHERE status = 'provisioning' AND created_at + INTERVAL 24 HOURS <= TIMESTAMP '1995-03-01'")
def expired_provisional(spark, sf):
    return journal.expired_provisional(repositories(spark, sf), F.lit("1995-03-01").cast("timestamp"))


@query("name_collisions", R + " SELECT user_id, name, count(*) AS n FROM r WHERE status <> 'deleted' GROUP BY ALL HAVING count(*) > 1")
def name_collisions(spark, sf):
    return journal.name_collisions(repositories(spark, sf))


@query("rename_collisions", R + " SELECT DISTINCT a.user_id, a.name AS new_name, a.repository_id FROM r a JOIN r b ON b.user_id = a.user_id AND b.name = a.name AND b.status <> 'deleted' AND b.repository_id <> a.repository_id WHERE a.status = 'active'")
def rename_collisions(spark, sf):
    r = repositories(spark, sf)
    return journal.rename_collisions(r, r.where("status = 'active'").select("repository_id", "user_id", F.col("name").alias("new_name")))


@query("active_repositories", R + " SELECT repository_id, user_id, name, status, created_at FROM r WHERE status = 'active'")
def active_repositories(spark, sf):
    return journal.active_repositories(repositories(spark, sf))


@query("resolved_names", R + " SELECT n.user_id, n.name, r.repository_id FROM (SELECT s_nationkey AS user_id, right(s_name, 2) AS name FROM supplier) n JOIN r ON r.user_id = n.user_id AND r.name = n.name AND r.status = 'active'")
def resolved_names(spark, sf):
    names = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("user_id"), F.substring("s_name", -2, 2).alias("name"))
    return journal.resolve_names(names, repositories(spark, sf))


@query("cascade_delete", "SELECT 'orders' AS name, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_acctbal >= 0")
def cascade_delete(spark, sf):
    c = table(spark, sf, "customer").withColumnRenamed("c_custkey", "key")
    left = journal.cascade_delete({"orders": table(spark, sf, "orders").withColumnRenamed("o_custkey", "key"), "customer": c}, c.where("c_acctbal < 0"), ["key"])
    return relations.store_counts(left)


@query(
    "installable",
    """WITH c AS (SELECT l_orderkey AS pack_id, count(*) AS n, bool_and(l_linestatus = 'F' OR l_quantity > 5) AS ok FROM lineitem GROUP BY 1) SELECT c.pack_id, CAST(o_custkey % 3 + 3 AS INTEGER) AS chunk_count FROM c JOIN orders ON o_orderkey = c.pack_id
    WHERE ok AND n = o_custkey % 3 + 3 AND o_orderstatus <> 'P' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = c.pack_id AND l_suppkey = 1)""",
)
def installable(spark, sf):
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "pack_id")  # noqa: E741
    packs = o.select(F.col("o_orderkey").alias("pack_id"), (F.col("o_custkey") % 3 + 3).cast("int").alias("chunk_count"))
    chunks = l.select("pack_id", ((F.col("l_linestatus") == "F") | (F.col("l_quantity") > 5)).alias("received"))
    return journal.installable(packs, chunks, o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("pack_id")), l.where("l_suppkey = 1"))


@query(
    "sync_plan",
    """WITH a AS (SELECT o_custkey AS k, o_orderkey AS h FROM orders WHERE o_orderstatus <> 'F'), b AS (SELECT o_custkey AS k, o_orderkey AS h FROM orders WHERE o_orderstatus <> 'O'), c AS (SELECT o_orderkey AS h FROM orders WHERE o_orderpriority = '1-URGENT')
    SELECT coalesce(a.k, b.k) AS repository_id, count(*) FILTER (b.h IS NULL AND c.h IS NULL) AS to_upload, count(*) FILTER (a.h IS NULL) AS to_download, count(*) > 1 AS needs_merge FROM a FULL JOIN b ON a.k = b.k AND a.h = b.h LEFT JOIN c ON c.h = coalesce(a.h, b.h) GROUP BY 1""",
)
def sync_plan(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("repository_id"), F.col("o_orderkey").alias("head"), "o_orderstatus", "o_orderpriority")
    return journal.sync_plan(o.where("o_orderstatus <> 'F'"), o.where("o_orderstatus <> 'O'"), o.where("o_orderpriority = '1-URGENT'"), "repository_id")


@query("catalog_conflicts", R + " SELECT 'name' AS rule, concat(user_id, '/', name) AS key FROM r GROUP BY user_id, name HAVING count(DISTINCT repository_id) > 1 UNION ALL SELECT 'status', status FROM r GROUP BY status HAVING count(DISTINCT user_id) > 1")
def catalog_conflicts(spark, sf):
    return journal.catalog_conflicts(repositories(spark, sf), {"name": (["user_id", "name"], "repository_id"), "status": (["status"], "user_id")})
