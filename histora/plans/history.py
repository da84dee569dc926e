"""Queries on content identifiers, sequences, pages, packs and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity
from ..operators import ordering, relations
from .registry import query
from .tables import PACKS_SQL, packs, table

@query("content_ids", f"SELECT doc_id, sha1(encode('blob ' || CAST(strlen(coalesce(text, '')) AS VARCHAR)) || '\\x00'::BLOB || encode(coalesce(text, ''))) AS id FROM documents")
def content_ids(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", identity.content_id(F.lit(0), F.coalesce("text", F.lit("")).cast("binary")).alias("id"))


@query("digest64")
def digest64(spark, sf):
    """BLAKE2b-512 of every text; SQL has no such function, a test compares it with hashlib."""
    return table(spark, sf, "documents").select("doc_id", F.lower(F.hex(identity.digest64(F.coalesce("text", F.lit("")).cast("binary")))).alias("digest"))


@query(
    "url_hygiene",
    r"""SELECT page_id, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#@]*:[^/?#@]*@') AS credentials, regexp_replace(url, '^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@]*@', '\1') AS redacted,
    nullif(regexp_replace(regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '([^/:]*)$', 1), '\.git$', ''), '') AS name
    FROM (SELECT page_id, unnest([url, replace(url, '://', '://user:word@'), concat(url, '.git')]) AS url FROM pages)""",
)
def url_hygiene(spark, sf):
    """Page addresses as they are, with a user and password, and as addresses of repositories."""
    p = table(spark, sf, "pages").select("page_id", F.explode(F.array("url", F.replace("url", F.lit("://"), F.lit("://user:word@")), F.concat("url", F.lit(".git")))).alias("url"))
    return p.select("page_id", identity.has_credentials(F.col("url")).alias("credentials"), identity.redact_userinfo(F.col("url")).alias("redacted"), identity.repo_name_from_url(F.col("url")).alias("name"))


@query(
    "identifier_predicates",
    r"""SELECT w, regexp_full_match(w, '[0-9a-f]{8}') AS hex8, regexp_full_match(w, '[A-Za-z0-9][A-Za-z0-9._-]{0,99}') AND NOT ends_with(w, '.') AS repo_name,
    w <> '' AND NOT (regexp_matches(w, '[\x00-\x20\x7f~^:?*\[\\]') OR contains(w, '..') OR contains(w, '@{') OR contains(w, '//')) AND NOT (starts_with(w, '/') OR ends_with(w, '/') OR starts_with(w, '.') OR ends_with(w, '.') OR ends_with(w, '.lock') OR starts_with(w, '-')) AND w <> '@' AS remote_name,
    strlen(w) > 0 AND strlen(w) <= 12 AS bounded FROM (SELECT DISTINCT unnest(string_split(coalesce(text, ''), ' ')) AS w FROM documents)""",
)
def identifier_predicates(spark, sf):
    """The distinct words of all documents against the rules for identifiers."""
    w = table(spark, sf, "documents").select(F.explode(F.split(F.coalesce("text", F.lit("")), " ")).alias("w")).distinct()
    c = F.col("w")
    return w.select("w", identity.is_hex(c, 8).alias("hex8"), identity.is_repo_name(c).alias("repo_name"), identity.is_remote_name(c).alias("remote_name"), identity.is_bounded(c, 12).alias("bounded"))


@query("change_ids", "SELECT doc_id, change, substr(md5(coalesce(text, '')), 1, 32) AS back FROM (SELECT doc_id, text, translate(md5(coalesce(text, '')), '0123456789abcdef', 'zyxwvutsrqponmlk') AS change FROM documents)")
def change_ids(spark, sf):
    """Digests in reverse digits, and decoded again."""
    d = table(spark, sf, "documents").select("doc_id", F.translate(F.md5(F.coalesce("text", F.lit("")).cast("binary")), identity.DIGITS, identity.REVERSED).alias("change"))
    return d.withColumn("back", F.lower(F.hex(identity.change_id(F.col("change")))))


@query(
    "signatures",
    "SELECT c_custkey, c_name AS name, concat(c_custkey, '@n', c_nationkey) AS email, CAST(c_custkey * 86400 AS BIGINT) AS seconds, CAST(CASE WHEN c_nationkey % 2 = 0 THEN -1 ELSE 1 END * (c_nationkey % 14 * 60 + 30) AS INTEGER) AS tz_minutes FROM customer",
)
def signatures(spark, sf):
    """Customers as person lines, parsed."""
    zone = F.concat(F.when(F.col("c_nationkey") % 2 == 0, "-").otherwise("+"), F.lpad((F.col("c_nationkey") % 14).cast("string"), 2, "0"), F.lit("30"))
    line = F.concat("c_name", F.lit(" <"), "c_custkey", F.lit("@n"), "c_nationkey", F.lit("> "), (F.col("c_custkey") * 86_400).cast("string"), F.lit(" "), zone)
    return table(spark, sf, "customer").select("c_custkey", identity.signature(line).alias("s")).select("c_custkey", "s.*")


# ------------------------------------------------------------------ sequences and pages


@query(
    "next_page",
    "WITH p AS (SELECT event_id, user_id FROM events WHERE event_id > 300 AND event_id <= (SELECT max(event_id) FROM events) ORDER BY event_id LIMIT 256) SELECT event_id, user_id, (SELECT count(*) FROM events WHERE event_id > 300) > 256 AS has_more, (SELECT max(event_id) FROM p) AS next_after FROM p",
)
def next_page(spark, sf):
    """The page of the catalog after event 300: paging is the feature, so it has a limit."""
    return ordering.next_page(table(spark, sf, "events").select("event_id", "user_id"), "event_id", 300)


@query("since_high_water", "SELECT event_id, user_id FROM events WHERE event_id > 300")
def since_high_water(spark, sf):
    return ordering.read_since(table(spark, sf, "events").select("event_id", "user_id"), "event_id", 300)


@query("high_water", "SELECT coalesce(max(event_id), 0) AS high_water FROM events")
def high_water(spark, sf):
    return relations.high_water(table(spark, sf, "events"), "event_id")


@query("assign_sequence", "SELECT o_custkey, o_orderkey, c_nationkey + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS sequence FROM orders JOIN customer ON c_custkey = o_custkey")
def assign_sequence(spark, sf):
    """Orders numbered on from their customer's stored maximum, which the nation stands for."""
    start = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("high_water"))
    new = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return ordering.assign_sequence(new, ["o_custkey"], ["o_orderkey"], start, F.floor(F.col("o_orderkey") / 4096))


@query("batches", "SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 16 AS batch FROM events")
def batches(spark, sf):
    return ordering.batches(table(spark, sf, "events").select("user_id", "event_id"), ["user_id"], ["event_id"], 16, F.floor(F.col("event_id") / 4096))


@query("first_violation", "SELECT l_orderkey, min(l_linenumber) AS l_linenumber, arg_min(l_partkey, (l_linenumber, l_partkey)) AS l_partkey FROM lineitem WHERE l_quantity > 25 GROUP BY 1")
def first_violation(spark, sf):
    """Each order's first line with more than 25 pieces."""
    v = table(spark, sf, "lineitem").where("l_quantity > 25")
    return ordering.first_violation(v, ["l_orderkey"], ["l_linenumber", "l_partkey"], ["l_linenumber", "l_partkey"])


@query("ordered_names", "SELECT p_name, p_brand, count(*) AS n FROM part GROUP BY ALL ORDER BY p_name, p_brand")
def ordered_names(spark, sf):
    return table(spark, sf, "part").groupBy("p_name", "p_brand").agg(F.count("*").alias("n")).orderBy("p_name", "p_brand")


@query("retirement_queue", "SELECT c_nationkey, c_custkey, rank FROM (SELECT c_nationkey, c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END, c_acctbal, c_custkey) AS INTEGER) AS rank FROM customer) WHERE rank <= 64")
def retirement_queue(spark, sf):
    """Per nation the first 64 customers: those of one segment, then the poorest. The rank is the feature."""
    c = table(spark, sf, "customer")
    return ordering.priority_queue(c, ["c_nationkey"], F.col("c_mktsegment") == "BUILDING", ["c_acctbal", "c_custkey"], 64).select("c_nationkey", "c_custkey", "rank")


@query("prune_expired", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 256)")
def prune_expired(spark, sf):
    """Lines left when the 256 oldest expired orders go: a pass is bounded by design."""
    o, line = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "key"), table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "key")
    _, children = ordering.prune(o, line, "key", F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp"), ["o_orderdate", "key"], 256)
    return children.select(F.col("key").alias("l_orderkey"), "l_linenumber", "l_partkey")


@query(
    "snapshot_audit",
    "SELECT 'sequence_repeated' AS rule, CAST(l_partkey AS VARCHAR) AS key FROM lineitem GROUP BY l_partkey HAVING count(*) > 1 UNION ALL SELECT 'ref_repeated', concat(l_suppkey, '/', l_orderkey) FROM lineitem GROUP BY l_suppkey, l_orderkey HAVING count(*) > 1 UNION ALL SELECT 'identity_mapping', CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_suppkey = l_linenumber",
)
def snapshot_audit(spark, sf):
    line = table(spark, sf, "lineitem")
    mappings = line.select("l_partkey", F.col("l_suppkey").cast("long").alias("canonical"), F.col("l_linenumber").cast("long").alias("public"))
    cursors = line.select(F.col("l_suppkey").alias("remote"), F.col("l_orderkey").alias("bookmark"))
    return ordering.snapshot_audit(mappings, cursors, "l_partkey")


# ------------------------------------------------------------------ packs

BUCKET = 512


@query("pack_offsets", f"SELECT source, doc_id, byte_length, CAST(coalesce(sum(byte_length) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset FROM ({PACKS_SQL})")
def pack_offsets(spark, sf):
    """Running offsets of the documents of each source, dealt by ranges of ids."""
    return ordering.prefix_sums(packs(spark, sf), ["source"], ["doc_id"], F.col("byte_length"), "byte_offset", F.floor(F.col("doc_id") / BUCKET))


MOST_BYTES, MOST_OBJECTS = 20_000, 16


@query(
    "pack_assignment",
    f"""WITH RECURSIVE d AS (SELECT source, doc_id, byte_length AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM ({PACKS_SQL})),
    w AS (SELECT source, doc_id, n, i, 0::BIGINT AS pack, n AS used, 1 AS k, n > {MOST_BYTES} AS alone FROM d WHERE i = 0 UNION ALL
    SELECT d.source, d.doc_id, d.n, d.i, CASE WHEN x THEN w.pack + 1 ELSE w.pack END, CASE WHEN x THEN d.n ELSE w.used + d.n END, CASE WHEN x THEN 1 ELSE w.k + 1 END, d.n > {MOST_BYTES}
    FROM w JOIN d ON d.source = w.source AND d.i = w.i + 1, LATERAL (SELECT w.alone OR d.n > {MOST_BYTES} OR w.used + d.n > {MOST_BYTES} OR w.k >= {MOST_OBJECTS} AS x))
    SELECT source, doc_id, CASE WHEN n > {MOST_BYTES} THEN -1 ELSE pack END AS pack FROM w""",
)
def pack_assignment(spark, sf):
    """Next-fit bins of the documents of each source."""
    rows = ordering.prefix_sums(packs(spark, sf), ["source"], ["doc_id"], F.col("byte_length"), "before", F.floor(F.col("doc_id") / BUCKET))
    rows = ordering.prefix_sums(rows, ["source"], ["doc_id"], F.lit(1).cast("long"), "i", F.floor(F.col("doc_id") / BUCKET))
    return ordering.assign_packs(rows, ["source"], "i", "byte_length", "before", MOST_BYTES, MOST_OBJECTS).select("source", "doc_id", "pack")


@query(
    "layout_audit",
    f"WITH d AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS position, byte_length, coalesce(sum(byte_length) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN byte_length % 10 = 7 THEN 1 ELSE 0 END AS byte_offset FROM ({PACKS_SQL})), "
    "l AS (SELECT *, coalesce(lag(byte_offset + byte_length) OVER (PARTITION BY source ORDER BY position), 0) AS e FROM d) SELECT source, position, 'not_contiguous' AS rule FROM l WHERE byte_offset <> e",
)
def layout_audit(spark, sf):
    """Layouts in which the offsets of some documents are one too large."""
    rows = ordering.prefix_sums(packs(spark, sf), ["source"], ["doc_id"], F.col("byte_length"), "byte_offset", F.floor(F.col("doc_id") / BUCKET))
    rows = ordering.prefix_sums(rows, ["source"], ["doc_id"], F.lit(1).cast("long"), "position", F.floor(F.col("doc_id") / BUCKET))
    return ordering.layout_audit(rows.withColumn("byte_offset", F.col("byte_offset") + F.when(F.col("byte_length") % 10 == 7, 1).otherwise(0)), ["source"], "position")


SIZE = 256


def chunks(spark, sf):
    return ordering.chunk(table(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("data")), ["doc_id"], "data", SIZE)


CHUNKS = f"SELECT doc_id, CAST(i AS INTEGER) AS position, CAST(i * {SIZE} AS BIGINT) AS byte_offset, CAST(least({SIZE}, strlen(text) - i * {SIZE}) AS BIGINT) AS byte_length FROM (SELECT doc_id, text, unnest(range((strlen(text) + {SIZE - 1}) // {SIZE})) AS i FROM documents)"


@query("chunk_table", CHUNKS)
def chunk_table(spark, sf):
    return chunks(spark, sf).drop("chunk")


@query("reassembled", "SELECT doc_id, sha256(text) AS sha FROM documents WHERE text <> ''")
def reassembled(spark, sf):
    return ordering.reassemble(chunks(spark, sf), ["doc_id"], "position", "chunk").select("doc_id", F.sha2("bytes", 256).alias("sha"))


PACKED = f"SELECT source, doc_id, CAST(coalesce(sum(byte_length) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a, byte_length AS n FROM ({PACKS_SQL})"
PIECE = 8_192


@query(
    "chunk_overlap",
    f"""WITH p AS ({PACKED}), c AS (SELECT source, CAST(i AS INTEGER) AS position, i * {PIECE} AS lo, least((i + 1) * {PIECE}, total) AS hi FROM (SELECT source, total, unnest(range(CAST((total + {PIECE - 1}) // {PIECE} AS BIGINT))) AS i FROM (SELECT source, sum(n) AS total FROM p GROUP BY 1)))
    SELECT c.source, c.position, p.doc_id AS object, CAST(greatest(p.a, c.lo) AS BIGINT) AS lo, CAST(least(p.a + p.n, c.hi) AS BIGINT) AS hi FROM p JOIN c ON c.source = p.source AND p.a < c.hi AND p.a + p.n > c.lo AND p.n > 0""",
)
def chunk_overlap(spark, sf):
    """Which bytes of which documents lie in which chunk of the pack of their source."""
    rows = ordering.prefix_sums(packs(spark, sf), ["source"], ["doc_id"], F.col("byte_length"), "start", F.floor(F.col("doc_id") / BUCKET))
    objects = rows.select("source", F.col("doc_id").alias("object"), "start", (F.col("start") + F.col("byte_length")).alias("end"))
    total = objects.groupBy("source").agg(F.max("end").alias("total")).where("total > 0")
    cut = total.select("source", "total", F.explode(F.sequence(F.lit(0), F.floor((F.col("total") - 1) / PIECE).cast("int"))).alias("position"))
    lo = F.col("position").cast("long") * PIECE
    pieces = cut.select("source", "position", lo.alias("byte_offset"), F.least(F.lit(PIECE), F.col("total") - lo).alias("byte_length"))
    return ordering.overlap(pieces, objects, ["source"], PIECE)


@query("pack_metrics", f"SELECT source, count(*) AS objects, CAST(sum(byte_length) AS BIGINT) AS bytes, count(*) FILTER (byte_length > 5000) AS large FROM ({PACKS_SQL}) GROUP BY 1")
def pack_metrics(spark, sf):
    return packs(spark, sf).groupBy("source").agg(F.count("*").alias("objects"), F.sum("byte_length").alias("bytes"), F.count_if(F.col("byte_length") > 5_000).alias("large"))
