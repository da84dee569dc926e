"""Queries that write the driver's tables in the formats of the sources, and read them back; rules, headers and projections."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import identity
from ..operators import codecs, graph, policy, projection
from ..operators.stages import shared_dir, written
from ..sources import readers
from ..streaming import jobs
from .registry import query
from .streams import nation_trees
from .tables import PATHS_SQL, TURNS_SQL, paths, table, turns


def place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def blob_sql(text: str, kind: str = "blob") -> str:
    return f"sha1(encode('{kind} ' || CAST(strlen({text}) AS VARCHAR)) || '\\x00'::BLOB || encode({text}))"


def blobs(spark, sf):
    """(doc_id, kind, id, bytes): documents as objects."""
    d = table(spark, sf, "documents").select("doc_id", F.lit(0).alias("kind"), F.coalesce("text", F.lit("")).cast("binary").alias("bytes"))
    return d.select("doc_id", "kind", identity.content_id(F.col("kind"), F.col("bytes")).alias("id"), "bytes")


# ------------------------------------------------------------------ sources and sinks


@query("object_vectors", f"SELECT 'blob' AS kind, {blob_sql('t')} AS id, sha256(t) AS sha, CAST(strlen(t) AS INTEGER) AS n FROM (SELECT coalesce(text, '') AS t FROM documents)")
def object_vectors(spark, sf):
    """Documents as lines of object vectors with a comment before each, read back."""
    lines = blobs(spark, sf).select(F.explode(F.array(F.concat(F.lit("# "), "doc_id"), F.concat(F.lit("blob|"), "id", F.lit("|"), F.lower(F.hex("bytes"))))).alias("value"))
    path = place(spark, "vectors")
    lines.write.text(path)
    return readers.read_object_vectors(spark, path).select("kind", "id", F.sha2("payload", 256).alias("sha"), F.octet_length("payload").alias("n"))


PACK = 64


def doc_packs(spark, sf):
    """(pack, content, chunks): every PACK documents as a pack."""
    return written(codecs.packed_objects(blobs(spark, sf).withColumn("pack", F.floor(F.col("doc_id") / PACK)), "pack"), "packs")


OBJECTS_SQL = f"SELECT DISTINCT doc_id // {PACK} AS pack, {blob_sql('t')} AS id, CAST(strlen(t) AS BIGINT) AS n FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"


@query(
    "pack_objects",
    f"""SELECT pack, CAST(row_number() OVER w - 1 AS INTEGER) AS position, 0 AS kind, id, CAST(sum(n) OVER w - n AS BIGINT) AS byte_offset, n AS byte_length
    FROM ({OBJECTS_SQL}) WINDOW w AS (PARTITION BY pack ORDER BY id)""",
)
def pack_objects(spark, sf):
    """The objects of packs of documents, from the packs' manifests."""
    made = doc_packs(spark, sf)
    found = codecs.pack_tables(written(codecs.manifests(made), "manifests"))["objects"]
    named = made.select("pack", identity.digest64(F.col("content")).alias("pack_id"))
    return found.join(named, "pack_id").select("pack", "position", "kind", F.lower(F.hex("id")).alias("id"), "byte_offset", "byte_length")


@query(
    "pack_audit",
    f"""WITH p AS (SELECT pack, sum(n) AS total FROM ({OBJECTS_SQL}) GROUP BY pack HAVING sum(n) > 0 AND pack % 5 IN (1, 2, 3))
    SELECT pack, 0 AS position, CASE pack % 5 WHEN 1 THEN 'digest' WHEN 2 THEN 'length' ELSE 'missing' END AS rule FROM p
    UNION ALL SELECT pack, NULL, 'pack_digest' FROM p WHERE pack % 5 < 3 OR total > {codecs.LEAST_CHUNK}""",
)
def pack_audit(spark, sf):
    """Stored chunks against their manifests: of some packs the first chunk has another byte, lacks its last one, or isn't there."""
    made = doc_packs(spark, sf).withColumn("pack_id", identity.digest64(F.col("content")))
    tables = codecs.pack_tables(written(codecs.manifests(made), "manifests"))
    stored = made.select("pack", "pack_id", F.posexplode("chunks").alias("position", "chunk"))
    first, turn = F.col("position") == 0, F.col("pack") % 5
    changed = F.when(first & (turn == 1), F.concat(F.lit(b"\x01"), F.expr("substring(chunk, 2)"))).when(first & (turn == 2), F.expr("substring(chunk, 1, octet_length(chunk) - 1)")).otherwise(F.col("chunk"))
    stored = stored.where(~(first & (turn == 3))).select("pack_id", "position", changed.alias("chunk"))
    wrong = codecs.audit_packs(tables["packs"], tables["chunks"], stored)
    return wrong.join(made.select("pack", "pack_id"), "pack_id").select("pack", "position", "rule")


def requests(spark, sf):
    """Recover requests in JSON, one an event: some with another field, without incarnation, or cut."""
    e = table(spark, sf, "events")
    seen = lambda n: F.struct(F.concat(F.lit("b"), F.col("event_id") % n).alias("bookmark"), F.col("event_type").alias("liveOid"))
    body = F.to_json(F.struct(
        F.when(F.col("event_id") % 13 != 5, "i1").alias("incarnation"), F.concat(F.lit("m"), "user_id").alias("machineId"), F.col("event_id").alias("fence"),
        F.array(seen(5), seen(3)).alias("observations"), F.when(F.col("event_id") % 11 == 4, 1).alias("more"),
    ))
    path = place(spark, "requests")
    e.select(F.when(F.col("event_id") % 17 == 6, F.substr(body, F.lit(2))).otherwise(body).alias("value")).write.text(path)
    return readers.read_requests(spark, path, "recover")


CODES_SQL = """SELECT *, CASE WHEN event_id % 17 = 6 THEN 'not_json' WHEN event_id % 11 = 4 THEN 'unknown_field' WHEN event_id % 13 = 5 THEN 'incarnation_missing'
WHEN event_id % 5 = event_id % 3 THEN 'repeated_name' ELSE 'ok' END AS code FROM events"""


@query("request_codes", f"SELECT event_id, code FROM ({CODES_SQL})")
def request_codes(spark, sf):
    """Which requests are rejected, and why."""
    good, bad = requests(spark, sf)
    found = bad.select(F.regexp_extract("raw", '"fence":([0-9]+)', 1).cast("long").alias("event_id"), "code")
    return good.select(F.col("fence").alias("event_id"), F.lit("ok").alias("code")).unionByName(found)


@query(
    "request_fingerprints",
    f"""SELECT event_id, sha256(concat('{{"incarnation":"i1","machineId":"m', user_id, '","fence":', event_id, ',"observations":[',
    '{{"bookmark":"b', least(event_id % 5, event_id % 3), '","liveOid":"', event_type, '"}},{{"bookmark":"b', greatest(event_id % 5, event_id % 3), '","liveOid":"', event_type, '"}}]}}')) AS fingerprint
    FROM ({CODES_SQL}) WHERE code = 'ok'""",
)
def request_fingerprints(spark, sf):
    """Fingerprints of the good requests: lists are in the order of their names, whatever it was in the request."""
    good, _ = requests(spark, sf)
    return readers.request_hash(good, 256).select(F.col("fence").alias("event_id"), "fingerprint")


GOOD_PUSH = (
    '{"incarnation":"i","batchId":"ID","machineId":"m","remote":"o","updates":[{"bookmark":"b","expectedOldOid":null,'
    '"states":[{"canonicalOid":"c","publicOid":"p","hiddenSetId":null}],"proposedState":0,"identityOid":null}]}'
)
#: What is replaced in a good push, and the code that this gives.
FAULTS = [
    ("", "", "ok"), ('"machineId":"m",', "", "machineId_missing"), ('"remote":"o"', '"remote":5', "remote_type"), ('"proposedState":0', '"proposedState":4', "state_outside"),
    ('"publicOid":"p"', '"publicOid":"c"', "identity_mapping"), ('"identityOid":null', '"identityOid":"p"', "identity_with_states"),
    ('"proposedState":0', '"proposedState":null', "states_without_proposal"), (',"hiddenSetId":null', "", "state_hiddenSetId_missing"), ('"expectedOldOid":null,', "", "item_expectedOldOid_missing"),
    ('"updates":[', '"more":1,"updates":[', "unknown_field"), ('"bookmark":"b"', '"bookmark":["b"]', "item_bookmark_type"), ('"states":[', '"states":[7,', "state_invalid"),
]


@query("push_codes", f"SELECT event_id, CASE event_id % {len(FAULTS)} {' '.join(f"WHEN {k} THEN '{code}'" for k, (_, _, code) in enumerate(FAULTS))} END AS code FROM events")
def push_codes(spark, sf):
    """Pushes of which all but one in twelve have a fault, each of another sort."""
    e = table(spark, sf, "events").select("event_id")
    good = F.replace(F.lit(GOOD_PUSH), F.lit("ID"), F.col("event_id").cast("string"))
    body = good
    for k, (was, now, _) in enumerate(FAULTS):
        if was:
            body = F.when(F.col("event_id") % len(FAULTS) == k, F.replace(good, F.lit(was), F.lit(now))).otherwise(body)
    path = place(spark, "pushes")
    e.select(body.alias("value")).write.text(path)
    ok, bad = readers.read_requests(spark, path, "push")
    found = ok.select("raw", F.lit("ok").alias("code")).unionByName(bad)
    return found.select(F.regexp_extract("raw", '"batchId":"([0-9]+)"', 1).cast("long").alias("event_id"), "code")


def pins(spark, sf):
    s = table(spark, sf, "supplier")
    field = lambda name, value: F.concat(F.lit(f'{name} = "'), value, F.lit('"\n'))
    text = F.concat(
        F.lit("[repos.s"), "s_suppkey", F.lit("]\n"), field("backend", F.lit("git")), field("url", F.concat(F.lit("https://host/"), "s_name")),
        F.when(F.col("s_suppkey") % 2 == 0, field("mode", F.lit("exact"))).otherwise(""), field("commit", F.sha1(F.col("s_name").cast("binary"))), F.lit("nation = "), "s_nationkey", F.lit("\n"),
    )
    path = place(spark, "pins")
    s.select(text.alias("value")).repartition(4).write.text(path)
    return readers.read_pins(spark, path)


@query(
    "pinned_sources",
    "SELECT concat('s', s_suppkey) AS alias, 'git' AS backend, concat('https://host/', s_name) AS url, CASE WHEN s_suppkey % 2 = 0 THEN 'exact' END AS mode, sha1(s_name) AS commit, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier",
)
def pinned_sources(spark, sf):
    """Suppliers as pinned sources; a field that isn't known is kept."""
    return pins(spark, sf).select("alias", "backend", "url", "mode", "commit", F.col("extra")["nation"].alias("nation"))


@query("selected_pins", "SELECT concat('s', s_suppkey * 2) AS alias, s_suppkey * 2 IN (SELECT s_suppkey FROM supplier) AS found FROM supplier")
def selected_pins(spark, sf):
    """Pins by their aliases, and the aliases that no pin has."""
    wanted = table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey") * 2).alias("alias"))
    there, unknown = readers.select_pins(written(pins(spark, sf), "pins"), wanted)
    return there.select("alias", F.lit(True).alias("found")).unionByName(unknown.select("alias", F.lit(False).alias("found")))


@query("clustered_table", "SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM lineitem")
def clustered_table(spark, sf):
    """Lines written in ranges of parts, a folder a return flag, and read again."""
    path = place(spark, "lines")
    readers.write_table(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"), path, ["l_partkey", "l_orderkey"], 8, ["l_returnflag"])
    return spark.read.parquet(path).select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")


LISTED = 40


def listings(spark, sf):
    """Every LISTED customers as a listing of heads; some have a line that isn't one, or a head twice."""
    c = table(spark, sf, "customer").select(F.floor(F.col("c_custkey") / LISTED).alias("listing"), "c_custkey")
    line = F.concat(F.sha1(F.col("c_custkey").cast("string").cast("binary")), F.lit("\trefs/heads/c"), "c_custkey")
    odd = c.where("listing % 7 = 2").select("listing").distinct().select("listing", F.lit("0123\trefs/heads/x").alias("value"))
    again = c.where("listing % 11 = 1").groupBy("listing").agg(F.min("c_custkey").alias("c_custkey")).select("listing", line.alias("value"))
    path = place(spark, "listings")
    c.select("listing", line.alias("value")).unionByName(odd).unionByName(again).repartition("listing").write.partitionBy("listing").text(path)
    return readers.read_ref_listings(spark, path, table(spark, sf, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("ref")).distinct())


def _listing():
    return F.regexp_extract("file", "listing=([0-9]+)", 1).cast("long").alias("listing")


@query(
    "ref_listings",
    f"SELECT c_custkey // {LISTED} AS listing, concat('c', c_custkey) AS ref, sha1(CAST(c_custkey AS VARCHAR)) AS oid FROM customer WHERE c_custkey // {LISTED} % 7 <> 2 AND c_custkey // {LISTED} % 11 <> 1 AND c_custkey IN (SELECT o_custkey FROM orders)",
)
def ref_listings(spark, sf):
    """Heads of good listings that belong to customers with orders."""
    return listings(spark, sf)[0].select(_listing(), "ref", "oid")


@query(
    "rejected_listings",
    f"""WITH c AS (SELECT c_custkey // {LISTED} AS listing, min(c_custkey) AS least FROM customer GROUP BY 1)
    SELECT listing, '0123' || chr(9) || 'refs/heads/x' AS line, 'bad_line' AS code FROM c WHERE listing % 7 = 2 UNION ALL SELECT listing, concat('c', least), 'repeated_ref' FROM c WHERE listing % 11 = 1""",
)
def rejected_listings(spark, sf):
    return listings(spark, sf)[1].select(_listing(), "line", "code")


# ------------------------------------------------------------------ commits, targets, reports


def order_commits(spark, sf):
    """(kind, id, bytes): orders as commits; one in ten lacks its committer."""
    o = table(spark, sf, "orders")
    oid = lambda prefix, c: F.sha1(F.concat(F.lit(prefix), c).cast("binary"))
    text = F.concat(
        F.lit("tree "), oid("t", "o_orderkey"), F.lit("\nparent "), oid("c", "o_custkey"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("\nparent "), oid("d", "o_custkey"))).otherwise(""),
        F.lit("\nauthor A <a@x> "), "o_orderkey", F.lit(" +0000"), F.when(F.col("o_orderkey") % 10 == 3, "").otherwise("\ncommitter C <c@x> 1 -0130"),
        F.lit("\nchange-id zzkk\n\norder "), "o_orderkey", F.lit("\n"),
    )
    return o.select(F.lit(2).alias("kind"), F.col("o_orderkey").cast("string").alias("id"), text.cast("binary").alias("bytes"))


@query(
    "commit_facts",
    """SELECT CAST(o_orderkey AS VARCHAR) AS commit_id, sha1(concat('t', o_orderkey)) AS tree, concat(sha1(concat('c', o_custkey)), CASE WHEN o_orderkey % 3 = 0 THEN concat(',', sha1(concat('d', o_custkey))) ELSE '' END) AS parents,
    concat('A <a@x> ', o_orderkey, ' +0000') AS author, CASE WHEN o_orderkey % 10 = 3 THEN 'committer_missing' END AS error, concat('order ', o_orderkey, chr(10)) AS message, 'zzkk' AS change FROM orders""",
)
def commit_facts(spark, sf):
    found = codecs.commit_facts(order_commits(spark, sf))
    return found.select("commit_id", "tree", F.array_join("parents", ",").alias("parents"), "author", "error", F.col("message").cast("string").alias("message"), "change")


@query(
    "commit_refs",
    """SELECT 2 AS object_kind, CAST(o_orderkey AS VARCHAR) AS object_id, k AS reference_kind, id AS referenced_id FROM (
      SELECT o_orderkey, 3 AS k, sha1(concat('t', o_orderkey)) AS id FROM orders UNION ALL SELECT o_orderkey, 4, sha1(concat('c', o_custkey)) FROM orders
      UNION ALL SELECT o_orderkey, 4, sha1(concat('d', o_custkey)) FROM orders WHERE o_orderkey % 3 = 0) WHERE o_orderkey % 10 <> 3""",
)
def commit_refs(spark, sf):
    """Edges from commits that can be read to trees and parents."""
    return codecs.object_refs(written(order_commits(spark, sf), "commits"))


@query(
    "rewritten_headers",
    """SELECT o_orderkey, concat_ws(';', 'tree=new', CASE WHEN o_orderkey % 2 = 0 THEN concat('parent=', o_custkey) END, concat('author=', o_orderpriority), 'encoding=x') AS headers FROM orders""",
)
def rewritten_headers(spark, sf):
    """Headers of commits with a new tree and new parents, without signatures."""
    head = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    old = F.array(head("tree", F.lit("old")), head("parent", F.col("o_orderkey")), head("author", F.col("o_orderpriority")), head("gpgsig", F.lit("s")), head("encoding", F.lit("x")))
    parents = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.col("o_custkey").cast("string"))).otherwise(F.array().cast("array<string>"))
    new = identity.with_headers(old, F.lit("new"), parents, projection.SIGNATURES)
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(F.transform(new, lambda h: F.concat_ws("=", h["name"], h["value"])), ";").alias("headers"))


@query(
    "ref_terms",
    """WITH l AS (SELECT l_orderkey, list(CASE WHEN l_partkey % 5 > 0 THEN l_partkey END ORDER BY l_linenumber, l_partkey) AS terms FROM lineitem GROUP BY 1),
    t AS (SELECT l_orderkey, unnest(terms) AS id, CAST(generate_subscripts(terms, 1) - 1 AS INTEGER) AS position FROM l WHERE len(terms) % 2 = 1)
    SELECT l_orderkey AS name, position, id, position % 2 = 0 AS added FROM t""",
)
def ref_terms(spark, sf):
    """The parts of an order as the terms of a target; orders with an even number of lines are none."""
    line = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("name")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("_t"))
    return codecs.ref_terms(line.select("name", F.transform("_t", lambda t: F.when(t["l_partkey"] % 5 > 0, t["l_partkey"])).alias("terms")))


FLAG_SQL = "CASE o_orderkey % 7 WHEN 0 THEN ' ' WHEN 1 THEN '+' WHEN 2 THEN '*' WHEN 3 THEN '-' WHEN 4 THEN '=' ELSE '!' END"


@query(
    "push_status",
    """SELECT o_orderkey AS ref, CASE WHEN o_orderkey % 3 = 0 THEN 'not reported' WHEN o_orderkey % 7 < 3 THEN 'updated' WHEN o_orderkey % 7 = 3 THEN 'deleted' WHEN o_orderkey % 7 = 4 THEN 'up-to-date'
    WHEN o_orderkey % 4 = 0 THEN 'lease-rejected' WHEN o_orderkey % 4 = 1 THEN 'remote-rejected' ELSE 'other' END AS outcome FROM orders""",
)
def push_status(spark, sf):
    """What a report says of each order's ref; of some it says nothing."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("ref"), F.expr(FLAG_SQL).alias("flag"), (F.col("o_orderkey") % 4).alias("_r"))
    summary = F.when(F.col("_r") == 0, "[rejected] (stale info)").when(F.col("_r") == 1, "[remote rejected] (hook)").otherwise("abc..def")
    return identity.push_status(o.where("ref % 3 > 0").select("ref", "flag", summary.alias("summary")), o)


@query("tree_entries_sql", "SELECT CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) - 1 AS INTEGER) AS position, c_name AS name, sha1(CAST(c_custkey AS VARCHAR)) AS oid FROM customer")
def tree_entries_sql(spark, sf):
    """Trees decoded by the table function in SQL."""
    codecs.register_functions(spark)
    return spark.sql("SELECT position, CAST(name AS STRING) AS name, lower(hex(oid)) AS oid FROM {trees}, LATERAL tree_entries(bytes)", trees=nation_trees(spark, sf))


# ------------------------------------------------------------------ rules of their own for each commit


def customer_rules(spark, sf):
    """(scope, path, text): a policy file a customer, at the top or below en."""
    c = table(spark, sf, "customer")
    digit = lambda n: (F.col("c_custkey") % n).cast("string")
    text = F.concat_ws("\n", F.lit("# rules"), F.lit(""), F.concat(F.lit("*"), digit(10), F.lit(".html")), F.concat(F.lit("!"), digit(7), F.lit("*")), F.lit("de/"), F.concat(F.lit("/en/"), digit(8), F.lit("?  ")))
    return c.select(F.col("c_custkey").alias("scope"), F.when(F.col("c_custkey") % 3 == 0, "en/.private").otherwise(".private").alias("path"), text.alias("text"))


RULES_SQL = """SELECT c_custkey AS scope, CASE WHEN c_custkey % 3 = 0 THEN 'en/' ELSE '' END AS directory, CAST(line AS INTEGER) AS line,
CASE line WHEN 2 THEN concat('*', c_custkey % 10, '.html') WHEN 3 THEN concat(c_custkey % 7, '*') WHEN 4 THEN 'de/' ELSE concat('/en/', c_custkey % 8, '?') END AS pattern, line = 3 AS negated, line = 4 AS dir_only
FROM customer, range(2, 6) r(line)"""


@query("policy_rules", RULES_SQL)
def policy_rules(spark, sf):
    return policy.policy_rules(customer_rules(spark, sf))


@query(
    "scoped_decisions",
    rf"""WITH r AS (SELECT *, concat(CASE WHEN contains(rtrim(pattern, '/'), '/') THEN '^' ELSE '^(?:[^/]+/)*' END, replace(replace(replace(trim(pattern, '/'), '.', '\.'), '?', '[^/]'), '*', '[^/]*'), '$') AS regex FROM ({RULES_SQL})),
    p AS (SELECT commit_id, commit_id // 3 AS scope, path, string_split(path, '/') AS s FROM ({PATHS_SQL})),
    a AS (SELECT commit_id, scope, path, unnest(list_transform(range(1, len(s) + 1), lambda i: {{'a': array_to_string(list_slice(s, 1, i), '/'), 'd': i < len(s)}})) AS x FROM p),
    h AS (SELECT a.commit_id, a.path, a.x.a AS a, arg_max(NOT r.negated, (strlen(r.directory), r.line)) AS out FROM a JOIN r ON r.scope = a.scope AND starts_with(a.x.a, r.directory)
      AND regexp_matches(substr(a.x.a, strlen(r.directory) + 1), r.regex) AND (a.x.d OR NOT r.dir_only) GROUP BY ALL)
    SELECT p.commit_id, p.path, coalesce(bool_or(h.out), false) OR p.path = '.private' OR ends_with(p.path, '/.private') AS hidden FROM p LEFT JOIN h ON h.commit_id = p.commit_id AND h.path = p.path GROUP BY p.commit_id, p.path""",
)
def scoped_decisions(spark, sf):
    """Every three pages by the rules of the customer of that number."""
    p = paths(spark, sf).withColumn("scope", F.floor(F.col("commit_id") / 3))
    return policy.decide_by(p, policy_rules(spark, sf), ["scope"], ".private").select("commit_id", "path", "hidden")


ENTRIES_SQL = f"""SELECT commit_id % 20 AS scope, concat(regexp_extract(path, '^(.*/)?', 0), '.private') AS path, CASE WHEN count(*) > 9 THEN 3 ELSE 1 END AS n_terms, max(commit_id % 4) AS kind FROM ({PATHS_SQL}) GROUP BY 1, 2"""


def private_entries(spark, sf):
    """(scope, path, n_terms, kind): a policy entry in each directory that holds pages."""
    p = paths(spark, sf).select((F.col("commit_id") % 20).alias("scope"), F.concat(F.regexp_extract("path", "^(.*/)?", 0), F.lit(".private")).alias("path"), (F.col("commit_id") % 4).alias("kind"))
    return p.groupBy("scope", "path").agg(F.when(F.count("*") > 9, 3).otherwise(1).alias("n_terms"), F.max("kind").alias("kind"))


ANOMALIES_SQL = f"SELECT scope, path, CASE WHEN n_terms > 1 THEN 'conflicted' ELSE 'not_a_file' END AS reason FROM ({ENTRIES_SQL}) WHERE n_terms > 1 OR kind > 1"


@query("anomalous_entries", ANOMALIES_SQL)
def anomalous_entries(spark, sf):
    """Policy entries that are in conflict or no files."""
    return policy.policy_anomalies(private_entries(spark, sf), ".private", [0, 1])


@query(
    "withheld_paths",
    f"""WITH d AS (SELECT scope, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM ({ANOMALIES_SQL}))
    SELECT DISTINCT p.commit_id, p.path FROM ({PATHS_SQL}) p JOIN d ON d.scope = p.commit_id % 20 AND (d.dir = '' OR starts_with(p.path, concat(d.dir, '/')))""",
)
def withheld_paths(spark, sf):
    p = paths(spark, sf).withColumn("scope", F.col("commit_id") % 20)
    return policy.withheld(p, anomalous_entries(spark, sf)).select("commit_id", "path")


# ------------------------------------------------------------------ projections and timeouts


def turn_commits(spark, sf):
    """Turns of conversations as commits, ids and trees being digests of their names and texts."""
    c = table(spark, sf, "conversations").groupBy(F.concat_ws(":", "conv_id", "turn").alias("node")).agg(F.min("role").alias("role"), F.min(F.coalesce("text", F.lit(""))).alias("text"))
    oid = lambda col: F.sha1(col.cast("binary"))
    rows = c.join(turns(spark, sf), "node")
    parents = F.when(F.col("parent").isNull(), F.array().cast("array<string>")).otherwise(F.array(oid(F.col("parent"))))
    head = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    headers = F.concat(F.array(head("tree", oid(F.col("text")))), F.transform(parents, lambda p: head("parent", p)), F.array(head("author", F.col("role")), head("gpgsig", F.lit("a\nb")), head("encoding", F.lit("x\ny"))))
    conflicted = F.octet_length("text") % 29 == 0
    commits = rows.select(oid(F.col("node")).alias("commit_id"), oid(F.col("text")).alias("tree"), parents.alias("parents"), headers.alias("headers"), F.col("node").alias("message"), conflicted.alias("conflicted"))
    changed = rows.where("octet_length(text) % 5 = 0").select(oid(F.col("text")).alias("tree"), oid(F.concat(F.lit("public "), "text")).alias("public_tree")).distinct()
    return commits, changed


PROJECTED = f"""
WITH RECURSIVE c AS (SELECT concat(conv_id, ':', turn) AS node, min(role) AS role, min(coalesce(text, '')) AS text FROM conversations GROUP BY 1),
t AS ({TURNS_SQL}),
r AS (SELECT c.node, t.parent, sha1(c.node) AS id, sha1(c.text) AS tree, CASE WHEN strlen(c.text) % 5 = 0 THEN sha1('public ' || c.text) ELSE sha1(c.text) END AS pub, strlen(c.text) % 29 = 0 AS bad, c.role FROM c JOIN t ON t.node = c.node),
w AS (
  SELECT node, id, CASE WHEN bad THEN NULL WHEN pub = tree THEN id ELSE {blob_sql("concat('tree ', pub, chr(10), 'author ', role, chr(10), 'encoding x', chr(10), ' y', chr(10), chr(10), node)", 'commit')} END AS public_id,
    CASE WHEN NOT bad THEN pub <> tree END AS rewritten, CASE WHEN bad THEN 'conflicted' END AS error FROM r WHERE parent IS NULL
  UNION ALL
  SELECT r.node, r.id, CASE WHEN r.bad OR w.error IS NOT NULL THEN NULL WHEN r.pub = r.tree AND w.public_id = w.id THEN r.id
    ELSE {blob_sql("concat('tree ', r.pub, chr(10), 'parent ', w.public_id, chr(10), 'author ', r.role, chr(10), 'encoding x', chr(10), ' y', chr(10), chr(10), r.node)", 'commit')} END,
    CASE WHEN NOT r.bad AND w.error IS NULL THEN r.pub <> r.tree OR w.public_id <> w.id END, CASE WHEN r.bad THEN 'conflicted' WHEN w.error IS NOT NULL THEN 'parent_failed' END
  FROM r JOIN w ON r.parent = w.node)
"""


@query("projected_commits", PROJECTED + "SELECT id AS canonical_id, public_id, rewritten, error FROM w")
def projected_commits(spark, sf):
    """Turns with their public ids: a turn is rewritten if its text has another public form or its parent is rewritten."""
    commits, changed = turn_commits(spark, sf)
    return projection.project_commits(written(commits, "commits"), changed)


@query(
    "projection_mappings",
    PROJECTED + "SELECT 'mapping' AS kind, id AS canonical_id, public_id FROM w WHERE rewritten UNION ALL SELECT 'head', w.id, coalesce(w.public_id, w.id) FROM w WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.parent = w.node)",
)
def projection_mappings(spark, sf):
    """New mappings of the projection, and the public ids of the last turns."""
    commits, changed = turn_commits(spark, sf)
    commits = written(commits, "commits")
    edges = commits.select(F.col("commit_id").alias("node"), F.explode("parents").alias("to_node"))
    heads = graph.frontier(commits.select(F.col("commit_id").alias("node")), edges).select(F.col("node").alias("head"))
    none = spark.createDataFrame([], "canonical_id string, public_id string")
    out = projection.projection_result(projection.project_commits(commits, changed), heads, none, none.select("canonical_id"))
    new = out["new_mappings"].select(F.lit("mapping").alias("kind"), "canonical_id", "public_id")
    return new.unionByName(out["public_heads"].select(F.lit("head").alias("kind"), F.col("head").alias("canonical_id"), "public_id"))


@query("provisional_timeouts", "SELECT CAST(c_custkey AS BIGINT) AS repository_id, TIMESTAMP '2020-01-02 00:00:00' + to_hours(CAST(c_custkey % 500 AS BIGINT)) AS expired_at FROM customer WHERE c_mktsegment = 'AUTOMOBILE'")
def provisional_timeouts(spark, sf):
    """Repositories still provisional a day after they were made; later events move the time on."""
    at = F.timestamp_seconds(F.lit(1_577_836_800) + F.col("c_custkey") % 500 * 3_600)
    status = F.when(F.col("c_mktsegment") == "AUTOMOBILE", "provisioning").otherwise("active")
    events = table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("repository_id"), status.alias("status"), at.alias("at"))
    source = place(spark, "timeouts")
    for part in (events, *(spark.range(1).select(F.lit(-i).cast("long").alias("repository_id"), F.lit("active").alias("status"), F.timestamp_seconds(F.lit(1_700_000_000 + i)).alias("at")) for i in (1, 2))):
        part.write.mode("append").parquet(source)
        found = jobs.run_to_end(jobs.provisional_timeouts(jobs.tail(spark, source, events.schema, 1_000)), f"{source}-out", f"{source}-checkpoint")
    return found
