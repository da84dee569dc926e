"""The driver's tables bound to the relations that the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Node kinds of the foreign-key graph.
REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDER, LINE = range(1, 8)


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """(kind, id) of every row of the star schema; a line's id is its order's times eight plus its number."""
    def of(name: str, kind: int, column: str) -> DataFrame:
        return table(spark, sf, name).select(F.lit(kind).alias("kind"), F.col(column).cast("long").alias("id"))

    lines = table(spark, sf, "lineitem").select(F.lit(LINE).alias("kind"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"))
    out = lines
    for name, kind, column in (("region", REGION, "r_regionkey"), ("nation", NATION, "n_nationkey"), ("customer", CUSTOMER, "c_custkey"), ("supplier", SUPPLIER, "s_suppkey"), ("part", PART, "p_partkey"), ("orders", ORDER, "o_orderkey")):
        out = out.unionByName(of(name, kind, column))
    return out


NODES_SQL = """
SELECT 7 AS kind, l_orderkey * 8 + l_linenumber AS id FROM lineitem UNION ALL SELECT 1, r_regionkey FROM region UNION ALL SELECT 2, n_nationkey FROM nation
UNION ALL SELECT 3, c_custkey FROM customer UNION ALL SELECT 4, s_suppkey FROM supplier UNION ALL SELECT 5, p_partkey FROM part UNION ALL SELECT 6, o_orderkey FROM orders
"""


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """(kind, id, to_kind, to_id): a customer's orders, an order's lines, a line's part and supplier, their nations and regions."""
    t = lambda name: table(spark, sf, name)
    line = F.col("l_orderkey") * 8 + F.col("l_linenumber")

    def of(df: DataFrame, kind: int, key, to_kind: int, to) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), key.cast("long").alias("id"), F.lit(to_kind).alias("to_kind"), to.cast("long").alias("to_id"))

    parts = [
        of(t("orders"), CUSTOMER, F.col("o_custkey"), ORDER, F.col("o_orderkey")),
        of(t("lineitem"), ORDER, F.col("l_orderkey"), LINE, line),
        of(t("lineitem"), LINE, line, PART, F.col("l_partkey")),
        of(t("lineitem"), LINE, line, SUPPLIER, F.col("l_suppkey")),
        of(t("supplier"), SUPPLIER, F.col("s_suppkey"), NATION, F.col("s_nationkey")),
        of(t("customer"), CUSTOMER, F.col("c_custkey"), NATION, F.col("c_nationkey")),
        of(t("nation"), NATION, F.col("n_nationkey"), REGION, F.col("n_regionkey")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


EDGES_SQL = """
SELECT 3 AS kind, o_custkey AS id, 6 AS to_kind, o_orderkey AS to_id FROM orders UNION ALL SELECT 6, l_orderkey, 7, l_orderkey * 8 + l_linenumber FROM lineitem
UNION ALL SELECT 7, l_orderkey * 8 + l_linenumber, 5, l_partkey FROM lineitem UNION ALL SELECT 7, l_orderkey * 8 + l_linenumber, 4, l_suppkey FROM lineitem
UNION ALL SELECT 4, s_suppkey, 2, s_nationkey FROM supplier UNION ALL SELECT 3, c_custkey, 2, c_nationkey FROM customer UNION ALL SELECT 2, n_nationkey, 1, n_regionkey FROM nation
"""


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """(node, parent): a conversation's turns as a chain, the first without parent."""
    t = table(spark, sf, "conversations").select("conv_id", "turn").distinct()
    name = lambda turn: F.concat_ws(":", "conv_id", turn)
    before = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit(True).alias("_there"))
    return t.join(before, ["conv_id", "turn"], "left").select(name(F.col("turn")).alias("node"), F.when(F.col("_there"), name(F.col("turn") - 1)).alias("parent"))


TURNS_SQL = """
SELECT concat(a.conv_id, ':', a.turn) AS node, CASE WHEN b.turn IS NOT NULL THEN concat(a.conv_id, ':', b.turn) END AS parent
FROM (SELECT DISTINCT conv_id, turn FROM conversations) a LEFT JOIN (SELECT DISTINCT conv_id, turn FROM conversations) b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1
"""


def states(spark: SparkSession, sf: str) -> DataFrame:
    """(state_id, remote, bookmark, canonical, public, lineage, activation_seq) from events: the user is the ref, the
    hour the canonical id, the value rounded the public one, the type the lineage, null for clicks."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("state_id"), F.concat(F.lit("r"), F.col("user_id") % 3).alias("remote"), F.concat(F.lit("b"), "user_id").alias("bookmark"),
        F.date_format(F.date_trunc("hour", "ts"), "yyyyMMddHH").alias("canonical"), F.floor("value").cast("string").alias("public"),
        F.when(F.col("event_type") != "click", F.col("event_type")).alias("lineage"), F.col("event_id").alias("activation_seq"),
    )


STATES_SQL = """
SELECT event_id AS state_id, concat('r', user_id % 3) AS remote, concat('b', user_id) AS bookmark, strftime(date_trunc('hour', ts), '%Y%m%d%H') AS canonical,
CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS public, CASE WHEN event_type <> 'click' THEN event_type END AS lineage, event_id AS activation_seq FROM events
"""


def paths(spark: SparkSession, sf: str) -> DataFrame:
    """(commit_id, path): the path of each page's address, without query and fragment; the top page is index."""
    p = table(spark, sf, "pages")
    path = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://[^/?#]*/?([^?#]*)", 1), "/+$", "")
    return p.select(F.col("page_id").alias("commit_id"), F.when(path == "", "index").otherwise(path).alias("path"))


PATHS_SQL = r"""
SELECT page_id AS commit_id, CASE WHEN p = '' THEN 'index' ELSE p END AS path
FROM (SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*/?([^?#]*)', 1), '/+$', '') AS p FROM pages)
"""

#: Rules (directory, line, pattern, negated, dir_only) over page paths.
RULES = [("", 0, "*.html", False, False), ("", 1, "de/", False, True), ("", 2, "1*", False, False), ("en/", 0, "9*.html", True, False), ("en/", 1, "2?", False, False), ("", 3, "12*", True, False)]
IGNORED = [("", 0, "fr/", False, True), ("", 1, "*7", False, False)]


def packs(spark: SparkSession, sf: str) -> DataFrame:
    """(source, doc_id, byte_length): documents as objects of the pack of their source."""
    return table(spark, sf, "documents").select("source", "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("byte_length"))


PACKS_SQL = "SELECT source, doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS byte_length FROM documents"


def repositories(spark: SparkSession, sf: str) -> DataFrame:
    """(repository_id, user_id, name, status, created_at): customers, their nation as user, segment as status, and when
    their first order was."""
    c = table(spark, sf, "customer")
    first = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").alias("created_at"))
    status = F.when(F.col("c_mktsegment") == "BUILDING", "active").when(F.col("c_mktsegment") == "MACHINERY", "deleted").when(F.col("c_mktsegment") == "AUTOMOBILE", "provisioning").otherwise("retiring")
    return c.join(first, "c_custkey", "left").select(F.col("c_custkey").alias("repository_id"), F.col("c_nationkey").alias("user_id"), F.substring("c_name", -2, 2).alias("name"), status.alias("status"), "created_at")


REPOSITORIES_SQL = """
SELECT c_custkey AS repository_id, c_nationkey AS user_id, right(c_name, 2) AS name,
CASE c_mktsegment WHEN 'BUILDING' THEN 'active' WHEN 'MACHINERY' THEN 'deleted' WHEN 'AUTOMOBILE' THEN 'provisioning' ELSE 'retiring' END AS status,
(SELECT min(o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS created_at FROM customer
"""
