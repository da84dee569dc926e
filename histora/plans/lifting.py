"""Queries on public trees, rules of several parents, lifted commits and pruned receipts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, ordering, policy
from ..operators.stages import written
from .formats import RULES_SQL, customer_rules
from .graphs import CHAIN
from .registry import query
from .tables import PATHS_SQL, paths, table, turns

REGEX = r"""concat(CASE WHEN contains(rtrim(pattern, '/'), '/') THEN '^' ELSE '^(?:[^/]+/)*' END,
  replace(replace(replace(trim(pattern, '/'), '.', '\.'), '?', '[^/]'), '*', '[^/]*'), '$')"""


def decided_sql(rules: str, found: str) -> str:
    """CTEs that end in decided (commit_id, scope, path, hidden) for found (commit_id, scope, path) by rules of the scope."""
    return f"""r AS (SELECT *, {REGEX} AS regex FROM ({rules})), q AS (SELECT *, string_split(path, '/') AS s FROM ({found})),
    a AS (SELECT commit_id, scope, path, unnest(list_transform(range(1, len(s) + 1), lambda i: {{'a': array_to_string(list_slice(s, 1, i), '/'), 'd': i < len(s)}})) AS x FROM q),
    h AS (SELECT a.commit_id, a.path, a.x.a AS a, arg_max(NOT r.negated, (strlen(r.directory), r.line)) AS out FROM a JOIN r ON r.scope = a.scope AND starts_with(a.x.a, r.directory)
      AND regexp_matches(substr(a.x.a, strlen(r.directory) + 1), r.regex) AND (a.x.d OR NOT r.dir_only) GROUP BY ALL),
    decided AS (SELECT q.commit_id, q.path, coalesce(bool_or(h.out), false) AS hidden FROM q LEFT JOIN h ON h.commit_id = q.commit_id AND h.path = q.path GROUP BY q.commit_id, q.path)"""


BY_CUSTOMER = f"SELECT commit_id, commit_id // 3 AS scope, path FROM ({PATHS_SQL})"


def by_customer(spark, sf):
    return paths(spark, sf).withColumn("scope", F.floor(F.col("commit_id") / 3))


@query("scoped_leaks", f"WITH {decided_sql(RULES_SQL, BY_CUSTOMER)} SELECT commit_id, path FROM decided WHERE hidden")
def scoped_leaks(spark, sf):
    """Pages as public trees, each held against the rules of its own commit."""
    return policy.leaks_by(by_customer(spark, sf), policy.policy_rules(customer_rules(spark, sf)), ["scope"]).select("commit_id", "path")


IGNORED_SQL = "SELECT c_custkey AS scope, '' AS directory, 0 AS line, concat('*', c_custkey % 10) AS pattern, false AS negated, false AS dir_only FROM customer"


@query(
    "scoped_classes",
    f"""SELECT commit_id, path, CASE WHEN p.hidden THEN 'hidden' WHEN i.hidden THEN 'ignored' ELSE 'visible' END AS class
    FROM (WITH {decided_sql(RULES_SQL, BY_CUSTOMER)} SELECT * FROM decided) p JOIN (WITH {decided_sql(IGNORED_SQL, BY_CUSTOMER)} SELECT * FROM decided) i USING (commit_id, path)""",
)
def scoped_classes(spark, sf):
    """Private and other rules of each page's customer."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("scope"), F.lit("ignored").alias("path"), F.concat(F.lit("*"), F.col("c_custkey") % 10).alias("text"))
    found = policy.classify_by(by_customer(spark, sf), policy.policy_rules(customer_rules(spark, sf)), policy.policy_rules(c), ["scope"])
    return found.select("commit_id", "path", "class")


PARENTS = f"""SELECT commit_id, unnest(CASE commit_id % 4 WHEN 0 THEN [commit_id // 3, commit_id // 3 + 3] WHEN 1 THEN [commit_id // 3, commit_id // 3 + 1]
  WHEN 2 THEN [commit_id // 3, commit_id // 3] ELSE [] END) AS parent FROM ({PATHS_SQL})"""


@query(
    "parent_disclosures",
    f"""WITH files AS (SELECT scope, directory, string_agg(concat_ws(' ', line, pattern, negated, dir_only), ';' ORDER BY line) AS f FROM ({RULES_SQL}) GROUP BY ALL),
    met AS (SELECT commit_id, directory, min(f) = max(f) AS same, min(parent) AS parent FROM ({PARENTS}) JOIN files ON scope = parent GROUP BY ALL),
    merged AS (SELECT commit_id AS scope, c.directory, line, pattern, negated, dir_only FROM met JOIN ({RULES_SQL}) c ON c.scope = met.parent AND c.directory = met.directory WHERE same),
    {decided_sql("SELECT * FROM merged", f"SELECT commit_id, commit_id AS scope, path FROM ({PATHS_SQL})")}
    SELECT commit_id, path, concat(commit_id, ' discloses ', path) AS message FROM decided WHERE hidden
    UNION ALL SELECT commit_id, directory, concat('parents of ', commit_id, ' differ in the policy of ''', directory, '''') FROM met WHERE NOT same""",
)
def parent_disclosures(spark, sf):
    """Pages as foreign commits of no, one or two parents, which are customers with rules of their own."""
    p = paths(spark, sf)
    first, n = F.floor(F.col("commit_id") / 3), F.col("commit_id") % 4
    parents = F.when(n == 0, F.array(first, first + 3)).when(n == 1, F.array(first, first + 1)).when(n == 2, F.array(first, first)).otherwise(F.array())
    return policy.disclosures_by(p, p.select("commit_id", F.explode(parents).alias("parent")), policy.policy_rules(customer_rules(spark, sf)))


SHELF = """SELECT doc_id % 7 AS commit, concat_ws('/', coalesce(lang, 'none'), coalesce(source, 'none'), CAST(doc_id // 50 AS VARCHAR), CAST(doc_id AS VARCHAR)) AS path,
  min(CASE WHEN doc_id % 7 = 6 AND doc_id % 100 = 6 THEN 5 ELSE 0 END) AS kind, min(sha1(coalesce(text, ''))) AS oid, min(doc_id % 50 = 8 OR source = 'src1' AND doc_id // 50 % 3 = 0) AS hidden
  FROM documents GROUP BY doc_id, lang, source"""


def level_sql(d: int) -> str:
    """The trees at depth d of files at depth 4, from the entries below."""
    below = "SELECT commit, path, '100644' AS mode, oid, '' AS slash FROM seen" if d == 3 else f"SELECT commit, path, '40000', id, '/' FROM t{d + 1}"
    name = "split_part(path, '/', -1)"
    where = f"array_to_string(list_slice(string_split(path, '/'), 1, {d}), '/')" if d else "''"
    entry = f"hex(encode(mode || ' ' || {name}) || '\\x00'::BLOB || unhex(oid))"
    return f"""t{d} AS (SELECT commit, dir AS path, sha1(encode('tree ' || CAST(length(h) // 2 AS VARCHAR)) || '\\x00'::BLOB || unhex(h)) AS id FROM (
      SELECT commit, {where} AS dir, string_agg({entry}, '' ORDER BY encode({name} || slash)) AS h FROM ({below}) AS e(commit, path, mode, oid, slash) GROUP BY 1, 2))"""


@query(
    "public_tree_ids",
    f"""WITH d AS ({SHELF}), bad AS (SELECT commit, path FROM d WHERE NOT hidden AND kind = 5), good AS (SELECT * FROM d WHERE commit NOT IN (SELECT commit FROM bad)), seen AS (SELECT * FROM good WHERE NOT hidden),
    {", ".join(level_sql(d) for d in (3, 2, 1, 0))}, lost AS (SELECT DISTINCT commit, unnest(['', split_part(path, '/', 1), array_to_string(list_slice(string_split(path, '/'), 1, 2), '/'), array_to_string(list_slice(string_split(path, '/'), 1, 3), '/')]) AS path FROM good WHERE hidden),
    t AS (SELECT * FROM t0 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3)
    SELECT t.commit, t.path, t.id, lost.path IS NOT NULL AS encoded, CAST(NULL AS VARCHAR) AS error FROM t LEFT JOIN lost ON lost.commit = t.commit AND lost.path = t.path
    UNION ALL SELECT commit, path, NULL, false, 'embedded_repository' FROM bad""",
)
def public_tree_ids(spark, sf):
    """All documents as files four directories deep in seven commits: what is left without the hidden ones, and what had to be encoded."""
    d = table(spark, sf, "documents")
    none = lambda c: F.coalesce(c, F.lit("none"))
    shelf = F.floor(F.col("doc_id") / 50)
    path = F.concat_ws("/", none("lang"), none("source"), shelf.cast("string"), F.col("doc_id").cast("string"))
    kind = F.when((F.col("doc_id") % 7 == 6) & (F.col("doc_id") % 100 == 6), 5).otherwise(0)
    hidden = (F.col("doc_id") % 50 == 8) | (F.col("source") == "src1") & (shelf % 3 == 0)
    rows = d.select((F.col("doc_id") % 7).alias("commit"), path.alias("path"), kind.alias("kind"), F.sha1(F.coalesce("text", F.lit("")).cast("binary")).alias("oid"), hidden.alias("hidden"))
    rows = rows.groupBy("commit", "path").agg(F.min("kind").alias("kind"), F.min("oid").alias("oid"), F.min("hidden").alias("hidden"))
    files = written(rows, "shelf")
    return policy.public_trees(files, policy.tree_ids(files, ["commit"], written), ["commit"], written)


LIFTED = """, c AS (SELECT concat(conv_id, ':', turn) AS node, max(turn) AS turn, bool_or(strlen(text) > 400) AS disclosed, bool_or(turn % 7 = 2) AS hidden FROM conversations GROUP BY 1),
m AS (SELECT node, CASE WHEN turn = 0 THEN node ELSE concat('private:', node) END AS canonical FROM c WHERE turn = 0 OR turn % 5 = 3),
s AS (SELECT c.node, CASE WHEN disclosed THEN 'disclosure' WHEN hidden THEN 'hidden' END AS own, CASE WHEN disclosed OR hidden OR q.canonical <> q.node THEN true ELSE false END AS start
  FROM c JOIN t ON t.node = c.node LEFT JOIN m q ON q.node = t.parent), n AS (SELECT p.node, min(p.distance) AS distance FROM p JOIN m ON m.node = p.ancestor GROUP BY 1),
l AS (SELECT p.node, bool_or(s.start AND (n.distance IS NULL OR p.distance < n.distance)) AS mirror FROM p JOIN s ON s.node = p.ancestor LEFT JOIN n ON n.node = p.node GROUP BY 1)
SELECT l.node, CASE WHEN m.node IS NOT NULL THEN 'mapped' WHEN mirror THEN 'mirror' ELSE 'identity' END AS class, CASE WHEN m.node IS NOT NULL THEN m.canonical WHEN NOT mirror THEN l.node END AS canonical,
CASE WHEN m.node IS NULL AND mirror THEN coalesce(s.own, 'parent') END AS reason FROM l JOIN s ON s.node = l.node LEFT JOIN m ON m.node = l.node"""


@query("lifted_turns", CHAIN + LIFTED)
def lifted_turns(spark, sf):
    """Turns as public commits: first ones are the same on either side, some others have a private form; long texts disclose, every seventh turn has a policy before it."""
    c = table(spark, sf, "conversations").groupBy(F.concat_ws(":", "conv_id", "turn").alias("node")).agg(
        F.max("turn").alias("turn"), F.max(F.octet_length("text") > 400).alias("disclosed"), F.max(F.col("turn") % 7 == 2).alias("hidden")
    )
    c = written(c, "turns")
    parents = turns(spark, sf).where("parent IS NOT NULL").select("node", F.col("parent").alias("to_node"))
    mapped = c.where("turn = 0 OR turn % 5 = 3").select("node", F.when(F.col("turn") == 0, F.col("node")).otherwise(F.concat(F.lit("private:"), "node")).alias("canonical"))
    return graph.lift_classes(c, parents, mapped, c.where("hidden"), c.where("disclosed"))


@query(
    "pruned_counters",
    """WITH gone AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' ORDER BY o_orderdate, o_custkey, o_orderkey LIMIT 256),
    n AS (SELECT o_custkey, count(*) AS receipts FROM orders GROUP BY 1), k AS (SELECT o_custkey, count(*) AS heads FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1),
    g AS (SELECT o_custkey, count(*) AS receipts FROM gone GROUP BY 1), h AS (SELECT o_custkey, count(*) AS heads FROM lineitem JOIN gone ON o_orderkey = l_orderkey GROUP BY 1)
    SELECT n.o_custkey AS custkey, n.receipts - coalesce(g.receipts, 0) AS receipts, coalesce(k.heads, 0) - coalesce(h.heads, 0) AS heads
    FROM n LEFT JOIN k ON k.o_custkey = n.o_custkey LEFT JOIN g ON g.o_custkey = n.o_custkey LEFT JOIN h ON h.o_custkey = n.o_custkey""",
)
def pruned_counters(spark, sf):
    """Orders as receipts of customers, lines as their heads: what the counters are after one bounded pass."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("key"), "o_orderdate")
    heads = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber").join(o.select("custkey", "key"), "key")
    counters = o.groupBy("custkey").agg(F.count("*").alias("receipts")).join(heads.groupBy("custkey").agg(F.count("*").alias("heads")), "custkey", "left")
    counters = counters.select("custkey", "receipts", F.coalesce("heads", F.lit(0)).alias("heads"))
    expired = F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp")
    return ordering.prune_receipts(o, heads, counters, ["custkey"], "key", expired, ["o_orderdate"], 256)[2]
