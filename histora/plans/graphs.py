"""Queries on the foreign-key graph, conversation chains and page paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import depth, graph, policy, relations
from .registry import query
from .tables import (
    CUSTOMER, EDGES_SQL, IGNORED, NODES_SQL, ORDER, PART, PATHS_SQL, RULES, TURNS_SQL, edges, nodes, paths, table, turns,
)

KIND_OF = {k: k for k in range(1, 8)}
REFS = "SELECT kind AS object_kind, id AS object_id, to_kind AS reference_kind, to_id AS referenced_id FROM e"


def refs(spark, sf):
    return edges(spark, sf).select(F.col("kind").alias("object_kind"), F.col("id").alias("object_id"), F.col("to_kind").alias("reference_kind"), F.col("to_id").alias("referenced_id"))


def stored(spark, sf):
    """The nodes taken as stored: finished orders, customers with a positive balance, and all others."""
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.lit(ORDER).alias("kind"), F.col("o_orderkey").alias("id"))
    c = table(spark, sf, "customer").where("c_acctbal > 0").select(F.lit(CUSTOMER).alias("kind"), F.col("c_custkey").alias("id"))
    rest = nodes(spark, sf).where(f"kind NOT IN ({ORDER}, {CUSTOMER})")
    return o.unionByName(c).unionByName(rest)


STORED_SQL = f"""
SELECT 6 AS kind, o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 3, c_custkey FROM customer WHERE c_acctbal > 0
UNION ALL SELECT kind, id FROM ({NODES_SQL}) WHERE kind NOT IN (6, 3)
"""


@query("missing_references", f"WITH e AS ({EDGES_SQL}), s AS ({STORED_SQL}) {REFS} WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.kind = e.to_kind AND s.id = e.to_id)")
def missing_references(spark, sf):
    return relations.missing_references(refs(spark, sf), stored(spark, sf), KIND_OF)


@query(
    "kind_mismatches",
    f"""WITH e AS ({EDGES_SQL}), s AS (SELECT DISTINCT * FROM ({STORED_SQL})) SELECT e.kind AS object_kind, e.id AS object_id, e.to_kind AS reference_kind, e.to_id AS referenced_id,
    e.to_kind AS expected, s.kind AS stored FROM e JOIN s ON s.id = e.to_id AND s.kind <> e.to_kind WHERE e.to_kind = 6
    AND NOT EXISTS (SELECT 1 FROM s WHERE s.kind = 6 AND s.id = e.to_id)""",
)
def kind_mismatches(spark, sf):
    return relations.kind_mismatches(refs(spark, sf).where(f"reference_kind = {ORDER}"), stored(spark, sf).distinct(), KIND_OF)


CLOSURE = f"""
WITH RECURSIVE e AS MATERIALIZED ({EDGES_SQL}), r AS (
  SELECT c_custkey AS head, 3 AS kind, c_custkey AS id FROM customer UNION SELECT r.head, e.to_kind, e.to_id FROM r JOIN e ON e.kind = r.kind AND e.id = r.id)
"""


def customers(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("head"), F.lit(CUSTOMER).alias("kind"), F.col("c_custkey").alias("id"))


@query("closure_sizes", CLOSURE + "SELECT head, count(*) AS reached, count(*) FILTER (kind = 5) AS parts FROM r GROUP BY head")
def closure_sizes(spark, sf):
    """How much each customer's history reaches, and how many parts."""
    found = graph.closure(customers(spark, sf), edges(spark, sf), ["kind", "id"], ["head"])
    return found.groupBy("head").agg(F.count("*").alias("reached"), F.count_if(F.col("kind") == PART).alias("parts"))


@query(
    "closure_with_stop",
    f"""WITH RECURSIVE e AS MATERIALIZED ({EDGES_SQL}), stop AS (SELECT 6 AS kind, o_orderkey AS id FROM orders WHERE o_orderstatus = 'F'), r AS (
    SELECT 3 AS kind, c_custkey AS id FROM customer UNION SELECT e.to_kind, e.to_id FROM r JOIN e ON e.kind = r.kind AND e.id = r.id
    WHERE NOT EXISTS (SELECT 1 FROM stop WHERE stop.kind = e.to_kind AND stop.id = e.to_id)) SELECT kind, count(*) AS n FROM r GROUP BY kind""",
)
def closure_with_stop(spark, sf):
    """What all customers reach, by kind, without finished orders and what is behind them alone."""
    stop = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.lit(ORDER).alias("kind"), F.col("o_orderkey").alias("id"))
    found = graph.closure(customers(spark, sf).drop("head"), edges(spark, sf), ["kind", "id"], stop=stop)
    return found.groupBy("kind").agg(F.count("*").alias("n"))


@query(
    "incomplete_closure",
    f"""WITH RECURSIVE e AS MATERIALIZED ({EDGES_SQL}), s AS ({STORED_SQL}), r AS (SELECT 3 AS kind, c_custkey AS id FROM customer UNION SELECT e.to_kind, e.to_id FROM r JOIN e ON e.kind = r.kind AND e.id = r.id)
    SELECT kind, id FROM r WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.kind = r.kind AND s.id = r.id) AND NOT (kind = 3 AND id = 0)""",
)
def incomplete_closure(spark, sf):
    zero = spark.range(1).select(F.lit(CUSTOMER).alias("kind"), "id")
    return graph.incomplete(customers(spark, sf).drop("head"), edges(spark, sf), ["kind", "id"], [stored(spark, sf)], zero)


@query(
    "to_fetch",
    f"""WITH RECURSIVE e AS MATERIALIZED ({EDGES_SQL}), r AS (SELECT 6 AS kind, o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' UNION SELECT e.to_kind, e.to_id FROM r JOIN e ON e.kind = r.kind AND e.id = r.id)
    SELECT kind, id FROM r WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE r.kind = 7 AND l_orderkey * 8 + l_linenumber = r.id AND l_returnflag = 'R')""",
)
def to_fetch(spark, sf):
    heads = table(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.lit(ORDER).alias("kind"), F.col("o_orderkey").alias("id"))
    local = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.lit(7).alias("kind"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"))
    return graph.to_fetch(heads, edges(spark, sf), ["kind", "id"], local)


@query(
    "closure_members",
    f"""WITH RECURSIVE e AS MATERIALIZED ({EDGES_SQL}), r AS (SELECT 6 AS kind, o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT e.to_kind, e.to_id FROM r JOIN e ON e.kind = r.kind AND e.id = r.id)
    SELECT DISTINCT id AS part FROM r WHERE kind = 5""",
)
def closure_members(spark, sf):
    """The distinct parts that the closure of urgent orders names."""
    heads = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.lit(ORDER).alias("kind"), F.col("o_orderkey").alias("id"))
    return graph.closure(heads, edges(spark, sf), ["kind", "id"]).where(f"kind = {PART}").select(F.col("id").alias("part")).distinct()


CHAIN = f"WITH RECURSIVE t AS MATERIALIZED ({TURNS_SQL}), p AS (SELECT node, node AS ancestor, 0 AS distance FROM t UNION ALL SELECT p.node, t.parent, p.distance + 1 FROM p JOIN t ON t.node = p.ancestor WHERE t.parent IS NOT NULL)"


@query("ancestor_pairs", CHAIN + " SELECT * FROM p")
def ancestor_pairs(spark, sf):
    t = turns(spark, sf)
    return graph.ancestors(t, t)


@query("turn_levels", CHAIN + " SELECT node, max(distance) AS level FROM p GROUP BY node")
def turn_levels(spark, sf):
    t = turns(spark, sf)
    return graph.chain_levels(t, t)


@query(
    "kind_levels",
    """SELECT kind, CAST(level AS INTEGER) AS level, count(*) AS n FROM (SELECT 1 AS kind, 0 AS level FROM region UNION ALL SELECT 2, CASE WHEN r_regionkey IS NULL THEN 0 ELSE 1 END FROM nation LEFT JOIN region ON r_regionkey = n_regionkey
    UNION ALL SELECT 4, CASE WHEN n_nationkey IS NULL THEN 0 WHEN r_regionkey IS NULL THEN 1 ELSE 2 END FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey) GROUP BY ALL""",
)
def kind_levels(spark, sf):
    """Levels of the part of the graph that suppliers, nations and regions make."""
    return levels(spark, sf, "kind IN (1, 2, 4)")


def levels(spark, sf, some):
    name = lambda kind, id_: F.concat_ws(":", kind, id_)
    n = nodes(spark, sf).where(some).select(name("kind", "id").alias("node"))
    e = edges(spark, sf).where(some).select(name("kind", "id").alias("node"), name("to_kind", "to_id").alias("to_node"))
    found = graph.topo_levels(n, e)
    return found.groupBy(F.split("node", ":")[0].cast("int").alias("kind"), "level").agg(F.count("*").alias("n"))


@query(
    "graph_levels",
    """WITH n AS (SELECT n_nationkey AS id, CASE WHEN r_regionkey IS NULL THEN 0 ELSE 1 END AS level FROM nation LEFT JOIN region ON r_regionkey = n_regionkey),
    s AS (SELECT s_suppkey AS id, coalesce(n.level + 1, 0) AS level FROM supplier LEFT JOIN n ON n.id = s_nationkey),
    l AS (SELECT l_orderkey, l_orderkey * 8 + l_linenumber AS id, max(greatest(coalesce(s.level + 1, 0), CASE WHEN p_partkey IS NULL THEN 0 ELSE 1 END)) AS level FROM lineitem LEFT JOIN s ON s.id = l_suppkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY ALL),
    o AS (SELECT o_orderkey AS id, o_custkey, coalesce(max(l.level) + 1, 0) AS level FROM orders LEFT JOIN l ON l.l_orderkey = o_orderkey GROUP BY ALL),
    c AS (SELECT c_custkey AS id, greatest(coalesce(max(o.level) + 1, 0), coalesce(max(n.level) + 1, 0)) AS level FROM customer LEFT JOIN o ON o.o_custkey = c_custkey LEFT JOIN n ON n.id = c_nationkey GROUP BY c_custkey)
    SELECT kind, CAST(level AS INTEGER) AS level, count(*) AS n FROM (SELECT 1 AS kind, 0 AS level FROM region UNION ALL SELECT 2, level FROM n UNION ALL SELECT 3, level FROM c UNION ALL SELECT 4, level FROM s
    UNION ALL SELECT 5, 0 FROM part UNION ALL SELECT 6, level FROM o UNION ALL SELECT 7, level FROM l) GROUP BY ALL""",
)
def graph_levels(spark, sf):
    """Levels of the whole graph."""
    return levels(spark, sf, "true")


@query(
    "observed_outside",
    CHAIN + " SELECT a.node AS head, b.node AS observed FROM t a JOIN t b ON split_part(a.node, ':', 2) = split_part(b.node, ':', 2) AND CAST(split_part(a.node, ':', 1) AS BIGINT) = CAST(split_part(b.node, ':', 1) AS BIGINT) + 1 UNION ALL "
    "SELECT t.node, t.parent FROM t WHERE t.parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM p WHERE p.node = t.node AND p.ancestor = t.parent)",
)
def observed_outside(spark, sf):
    """Each turn observes its parent and the same turn of the conversation before; the latter isn't in its ancestry."""
    t = turns(spark, sf)
    of = t.select("node", "parent", F.split("node", ":")[0].cast("long").alias("c"), F.split("node", ":")[1].alias("k"))
    other = of.alias("a").join(of.select(F.col("node").alias("observed"), (F.col("c") + 1).alias("c"), "k"), ["c", "k"]).select(F.col("node").alias("head"), "observed")
    own = t.where("parent IS NOT NULL").select(F.col("node").alias("head"), F.col("parent").alias("observed"))
    return graph.outside_ancestry(other.unionByName(own), t.where("parent IS NOT NULL").select("node", F.col("parent").alias("to_node")))


MERGED = """
WITH RECURSIVE t AS (SELECT DISTINCT conv_id AS c, turn AS k, concat(conv_id, ':', turn) AS node FROM conversations),
e AS (SELECT a.node, b.node AS to_node FROM t a JOIN t b ON a.c = b.c AND a.k = b.k + 1 UNION ALL SELECT a.node, b.node FROM t a JOIN t b ON a.c = b.c + 1 AND a.k = b.k WHERE a.k % 3 = 0 AND a.c % 4 <> 0),
"""


def merged_turns(spark, sf):
    """(c, k, node) of turns, and edges (node, position, to_node): to the turn before, and from every third turn to the same one of the conversation before."""
    t = table(spark, sf, "conversations").select(F.col("conv_id").alias("c"), F.col("turn").alias("k")).distinct()
    name = lambda c, k: F.concat_ws(":", c, k)
    there = t.select("c", "k")
    before = t.join(there.select("c", (F.col("k") + 1).alias("k")), ["c", "k"], "left_semi").select(name("c", "k").alias("node"), F.lit(0).alias("position"), name("c", F.col("k") - 1).alias("to_node"))
    beside = t.where("k % 3 = 0 AND c % 4 <> 0").join(there.select((F.col("c") + 1).alias("c"), "k"), ["c", "k"], "left_semi")
    beside = beside.select(name("c", "k").alias("node"), F.lit(1).alias("position"), name(F.col("c") - 1, "k").alias("to_node"))
    return t.withColumn("node", name("c", "k")), before.unionByName(beside)


@query(
    "merge_levels",
    MERGED + """s AS (SELECT node FROM t WHERE NOT (k % 5 = 4 AND c % 3 = 0)), i AS (SELECT e.* FROM e JOIN s USING (node) JOIN s u ON u.node = e.to_node),
    r AS (SELECT node, 0 AS level FROM s UNION SELECT i.node, r.level + 1 FROM r JOIN i ON i.to_node = r.node) SELECT node, CAST(max(level) AS BIGINT) AS level FROM r GROUP BY node""",
)
def merge_levels(spark, sf):
    """Levels of turns whose conversations merge, some turns being stops."""
    t, e = merged_turns(spark, sf)
    return depth.levels(t, e, t.where("k % 5 = 4 AND c % 3 = 0"))


@query(
    "merge_ancestry",
    MERGED + """p AS (SELECT node AS b, node FROM t UNION SELECT p.b, e.to_node FROM p JOIN e ON e.node = p.node)
    SELECT x.node AS a, y.node AS b, EXISTS (SELECT 1 FROM p WHERE p.b = y.node AND p.node = x.node) AS is_ancestor FROM t x JOIN t y ON y.c = x.c + 1 AND y.k = x.k + 1""",
)
def merge_ancestry(spark, sf):
    """Whether each turn descends from the one before it in the conversation before."""
    t, e = merged_turns(spark, sf)
    pairs = t.select(F.col("node").alias("a"), (F.col("c") + 1).alias("c"), (F.col("k") + 1).alias("k")).join(t.select(F.col("node").alias("b"), "c", "k"), ["c", "k"])
    return depth.is_ancestor(pairs, e)


@query("frontier", f"WITH t AS ({TURNS_SQL}) SELECT node FROM t WHERE NOT EXISTS (SELECT 1 FROM t u WHERE u.parent = t.node)")
def frontier(spark, sf):
    t = turns(spark, sf)
    return graph.frontier(t.select("node"), t.where("parent IS NOT NULL").select("node", F.col("parent").alias("to_node")))


@query(
    "non_descendants",
    CHAIN + """, c AS (SELECT split_part(node, ':', 1) AS conv, max(CAST(split_part(node, ':', 2) AS BIGINT)) AS last FROM t GROUP BY 1)
    SELECT concat('c', conv) AS bookmark, concat(conv, ':', last) AS head, concat(conv, ':', 9) AS "cursor" FROM c WHERE last <> 9""",
)
def non_descendants(spark, sf):
    """Conversations whose last turn doesn't descend from a tenth one."""
    t = turns(spark, sf)
    last = t.groupBy(F.split("node", ":")[0].alias("conv")).agg(F.max(F.split("node", ":")[1].cast("long")).alias("last"))
    heads = last.select(F.concat(F.lit("c"), "conv").alias("bookmark"), F.concat_ws(":", "conv", "last").alias("oid"))
    cursors = last.select(F.concat(F.lit("c"), "conv").alias("bookmark"), F.concat_ws(":", "conv", F.lit(9)).alias("oid"))
    return graph.rewritten_refs(heads, cursors, t.where("parent IS NOT NULL").select("node", F.col("parent").alias("to_node")), ["bookmark"])


@query(
    "mark_sweep",
    f"""WITH RECURSIVE e AS MATERIALIZED ({EDGES_SQL}), r AS (SELECT 6 AS kind, o_orderkey AS id FROM orders WHERE o_totalprice > 400000 UNION SELECT e.to_kind, e.to_id FROM r JOIN e ON e.kind = r.kind AND e.id = r.id)
    SELECT concat('5:', p_partkey) AS node, 'unreachable' AS reason FROM part WHERE NOT EXISTS (SELECT 1 FROM r WHERE kind = 5 AND id = p_partkey) UNION ALL SELECT concat('6:', o_orderkey), 'broken_root' FROM orders WHERE o_totalprice > 400000""",
)
def mark_sweep(spark, sf):
    """Parts that no large order reaches; the orders themselves aren't in the store of parts."""
    name = lambda kind, id_: F.concat_ws(":", kind, id_)
    roots = table(spark, sf, "orders").where("o_totalprice > 400000").select(name(F.lit(ORDER), "o_orderkey").alias("node"))
    e = edges(spark, sf).select(name("kind", "id").alias("node"), name("to_kind", "to_id").alias("to_node"))
    return graph.mark_and_sweep(roots, e, table(spark, sf, "part").select(name(F.lit(PART), "p_partkey").alias("node")))


@query(
    "rewritten_commits",
    CHAIN + ", h AS (SELECT concat(conv_id, ':', turn) AS node FROM conversations WHERE role = 'assistant' AND strlen(text) > 300) SELECT node, bool_or(ancestor IN (SELECT node FROM h)) AS changed FROM p GROUP BY node",
)
def rewritten_commits(spark, sf):
    """A turn is rewritten if a long answer is among it and the turns before it."""
    t = turns(spark, sf)
    changed = table(spark, sf, "conversations").where("role = 'assistant' AND octet_length(text) > 300").select(F.concat_ws(":", "conv_id", "turn").alias("node")).distinct()
    return graph.propagate(t, t.where("parent IS NOT NULL").select("node", F.col("parent").alias("to_node")), changed)


@query(
    "lift_classes",
    CHAIN + """, h AS (SELECT concat(conv_id, ':', turn) AS node FROM conversations WHERE role = 'system'), s AS (SELECT node, bool_or(ancestor IN (SELECT node FROM h)) AS changed FROM p GROUP BY node)
    SELECT s.node, CASE WHEN changed THEN 'mirror' ELSE 'identity' END AS class, t.parent FROM s JOIN t ON t.node = s.node""",
)
def lift_classes(spark, sf):
    """Turns after a system turn are mirrored, the others are the same on either side."""
    t = turns(spark, sf)
    touched = table(spark, sf, "conversations").where("role = 'system'").select(F.concat_ws(":", "conv_id", "turn").alias("node")).distinct()
    out = graph.propagate(t, t.where("parent IS NOT NULL").select("node", F.col("parent").alias("to_node")), touched)
    return out.join(t, "node").select("node", F.when(F.col("changed"), "mirror").otherwise("identity").alias("class"), "parent")


@query(
    "states_for_ref",
    CHAIN + """, m AS (SELECT concat(conv_id, ':', turn) AS node, any_value(role) AS role FROM conversations GROUP BY 1), l AS (SELECT node FROM t WHERE NOT EXISTS (SELECT 1 FROM t u WHERE u.parent = t.node))
    SELECT p.node AS head, p.ancestor AS state FROM p JOIN l ON l.node = p.node JOIN m ON m.node = p.ancestor WHERE m.role <> 'user' OR p.distance = 0""",
)
def states_for_ref(spark, sf):
    """From each conversation's last turn, the turns it reaches but those that users journaled; the last turn itself stays."""
    t = turns(spark, sf)
    step = t.where("parent IS NOT NULL").select("node", F.col("parent").alias("to_node"))
    heads = graph.frontier(t.select("node"), step)
    reached = graph.closure(heads.select(F.col("node").alias("head"), "node"), step, ["node"], ["head"])
    known = table(spark, sf, "conversations").where("role = 'user'").select(F.concat_ws(":", "conv_id", "turn").alias("node")).distinct()
    new = reached.join(known, "node", "left_anti").unionByName(reached.where("node = head")).distinct()
    return new.select("head", F.col("node").alias("state"))


# ------------------------------------------------------------------ paths


def decision_sql(rules, name="hidden"):
    """An ancestor's last matching rule, deeper directories first, then later lines; any excluded ancestor excludes the path."""
    ordered = sorted(rules, key=lambda r: (r[0].count("/"), r[1]), reverse=True)
    cases = ""
    for directory, _, pattern, negated, dir_only in ordered:
        regex = policy.glob_to_regex(pattern).replace("'", "''")
        test = f"regexp_matches(substr(a, {len(directory) + 1}), '{regex}')"
        test += f" AND starts_with(a, '{directory}')" if directory else ""
        test += " AND d" if dir_only else ""
        cases += f" WHEN {test} THEN {'false' if negated else 'true'}"
    return f"""SELECT commit_id, path, bool_or(CASE{cases} ELSE false END) AS {name} FROM (
      SELECT commit_id, path, array_to_string(list_slice(s, 1, i), '/') AS a, i < len(s) AS d
      FROM (SELECT commit_id, path, string_split(path, '/') AS s, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM ({PATHS_SQL}))) GROUP BY commit_id, path"""


@query("path_decisions", decision_sql(RULES))
def path_decisions(spark, sf):
    return policy.decide(paths(spark, sf), RULES)


@query("public_paths", f"SELECT commit_id, path FROM ({decision_sql(RULES)}) WHERE NOT hidden")
def public_paths(spark, sf):
    return policy.public_paths(policy.decide(paths(spark, sf), RULES))


@query("leaks", f"SELECT commit_id, path FROM ({decision_sql(RULES)}) WHERE hidden")
def leaks(spark, sf):
    """Paths that the rules hide, taken for a public tree."""
    return policy.leaks(paths(spark, sf), RULES)


@query(
    "two_policy_classes",
    f"SELECT commit_id, path, CASE WHEN hidden THEN 'hidden' WHEN ignored THEN 'ignored' ELSE 'visible' END AS class FROM ({decision_sql(RULES)}) JOIN ({decision_sql(IGNORED, 'ignored')}) USING (commit_id, path)",
)
def two_policy_classes(spark, sf):
    return policy.classify_paths(paths(spark, sf), RULES, IGNORED)


@query("disclosures", f"SELECT commit_id, path, concat(commit_id, ' discloses ', path) AS message FROM ({decision_sql(RULES)}) WHERE hidden")
def disclosures(spark, sf):
    return policy.disclosures(paths(spark, sf), RULES)


@query("policy_files", f"SELECT commit_id, path FROM ({PATHS_SQL}) WHERE path = '25' OR path LIKE '%/25'")
def policy_files(spark, sf):
    return policy.policy_files(paths(spark, sf), "25")


@query(
    "policy_anomalies",
    f"SELECT scope, path, CASE WHEN n > 1 THEN 'conflicted' ELSE 'not_a_file' END AS reason FROM (SELECT split_part(path, '/', 1) AS scope, path, count(*) AS n, max(commit_id % 7) AS kind FROM ({PATHS_SQL}) GROUP BY ALL) WHERE regexp_matches(path, '(^|/)index$') AND (n > 1 OR kind > 1)",
)
def policy_anomalies(spark, sf):
    p = paths(spark, sf).groupBy(F.split("path", "/")[0].alias("scope"), "path").agg(F.count("*").alias("n_terms"), F.max(F.col("commit_id") % 7).alias("kind"))
    return policy.policy_anomalies(p, "index", [0, 1])


@query(
    "policy_identity_sha",
    f"""SELECT scope, sha256(concat('hidden;', string_agg(concat(strlen(path), ':', path, '=', oid), ';' ORDER BY path, oid))) AS identity
    FROM (SELECT split_part(path, '/', 1) AS scope, path, CAST(commit_id AS VARCHAR) AS oid FROM ({PATHS_SQL})) GROUP BY scope""",
)
def policy_identity_sha(spark, sf):
    files = paths(spark, sf).select(F.split("path", "/")[0].alias("scope"), "path", F.col("commit_id").cast("string").alias("oid"))
    return policy.set_identity(files, ["scope"], "hidden", 256)


OVERLAY = """
WITH d AS (SELECT concat(lang, '/', doc_id % 500) AS path, source, md5(coalesce(text, '')) AS oid FROM documents),
b AS (SELECT path, min(oid) AS oid FROM d GROUP BY path), x AS (SELECT path, min(oid) AS oid FROM d WHERE source < 'src5' GROUP BY path), y AS (SELECT path, max(oid) AS oid FROM d WHERE source >= 'src2' GROUP BY path),
j AS (SELECT coalesce(b.path, x.path, y.path) AS path, b.oid AS b, x.oid AS l, y.oid AS r FROM b FULL JOIN x ON x.path = b.path FULL JOIN y ON y.path = coalesce(b.path, x.path))
SELECT path, CASE WHEN l IS NOT DISTINCT FROM r OR b IS NOT DISTINCT FROM r THEN l WHEN b IS NOT DISTINCT FROM l THEN r END AS oid,
CASE WHEN l IS NOT DISTINCT FROM r OR b IS NOT DISTINCT FROM r OR b IS NOT DISTINCT FROM l THEN NULL ELSE concat_ws('|', coalesce(l, '-'), coalesce(b, '-'), coalesce(r, '-')) END AS conflict FROM j
"""


@query("overlay_paths", f"SELECT * FROM ({OVERLAY}) WHERE oid IS NOT NULL OR conflict IS NOT NULL")
def overlay_paths(spark, sf):
    """Documents as three versions of a tree: all of them, the early sources and the late ones."""
    return overlaid(spark, sf, F.col("doc_id") % 500)


@query("overlay_documents", f"SELECT * FROM ({OVERLAY.replace('doc_id % 500', 'doc_id')}) WHERE oid IS NOT NULL OR conflict IS NOT NULL")
def overlay_documents(spark, sf):
    """The same with a path for each document."""
    return overlaid(spark, sf, F.col("doc_id"))


def overlaid(spark, sf, number):
    d = table(spark, sf, "documents").select(F.concat_ws("/", "lang", number.cast("string")).alias("path"), "source", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("oid"))
    side = lambda rows, agg: rows.groupBy("path").agg(agg("oid").alias("oid"))
    out = policy.overlay(side(d, F.min), side(d.where("source < 'src5'"), F.min), side(d.where("source >= 'src2'"), F.max))
    return out.withColumn("conflict", F.array_join("conflict", "|", "-"))


@query("tree_paths", "SELECT r_regionkey AS commit_id, concat(r_name, '/', n_name, '/', c_name) AS path, 0 AS kind, CAST(c_custkey AS VARCHAR) AS oid FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def tree_paths(spark, sf):
    """Regions, nations and customers as directories and files below one root a region."""
    from ..operators.stages import written

    r, n, c = (table(spark, sf, t) for t in ("region", "nation", "customer"))
    name = lambda kind, key: F.concat_ws(":", F.lit(kind), key)
    entries = r.select(name("root", "r_regionkey").alias("tree"), F.lit(3).alias("kind"), F.col("r_name").alias("name"), name("r", "r_regionkey").alias("oid"))
    entries = entries.unionByName(n.select(name("r", "n_regionkey").alias("tree"), F.lit(3).alias("kind"), F.col("n_name").alias("name"), name("n", "n_nationkey").alias("oid")))
    entries = entries.unionByName(c.select(name("n", "c_nationkey").alias("tree"), F.lit(0).alias("kind"), F.col("c_name").alias("name"), F.col("c_custkey").cast("string").alias("oid")))
    return policy.tree_paths(r.select(F.col("r_regionkey").alias("commit_id"), name("root", "r_regionkey").alias("tree")), entries, written)


@query(
    "tree_ids",
    f"""WITH f AS (SELECT split_part(path, '/', 1) AS dir, path AS p, sha1(CAST(max(commit_id) AS VARCHAR)) AS oid FROM ({PATHS_SQL}) WHERE len(string_split(path, '/')) = 2 GROUP BY ALL), e AS (SELECT dir, string_agg(hex(encode('100644 ') || encode(split_part(p, '/', 2)) || '\\x00'::BLOB || unhex(oid)), '' ORDER BY encode(split_part(p, '/', 2))) AS h FROM f GROUP BY dir),
    t AS (SELECT dir AS path, sha1(encode('tree ' || CAST(length(h) // 2 AS VARCHAR)) || '\\x00'::BLOB || unhex(h)) AS id FROM e), r AS (SELECT string_agg(hex(encode('40000 ') || encode(path) || '\\x00'::BLOB || unhex(id)), '' ORDER BY encode(path || '/')) AS h FROM t)
    SELECT path, id FROM t UNION ALL SELECT '', sha1(encode('tree ' || CAST(length(h) // 2 AS VARCHAR)) || '\\x00'::BLOB || unhex(h)) FROM r WHERE h IS NOT NULL""",
)
def tree_ids(spark, sf):
    """Pages with a path of two parts as files of one tree; a file's id is that of the last page there."""
    from ..operators.stages import written

    two = paths(spark, sf).where("size(split(path, '/')) = 2").groupBy("path").agg(F.sha1(F.max("commit_id").cast("string").cast("binary")).alias("oid")).withColumn("kind", F.lit(0))
    return policy.tree_ids(two, [], written)
