"""Queries over views and operations: each turn of a conversation as an operation and its view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import operations as ops
from ..operators.stages import written
from .registry import query
from .tables import table

REFS = ops.REFS.replace(": ", " ")
VIEW_FACTS = f"STRUCT<heads ARRAY<STRING>, refs {REFS}, git_head ARRAY<STRING>, workspaces MAP<STRING, STRING>>"


def commit(turn: str, sep: str = "||") -> str:
    return f"sha1(concat(conv_id, ':', {turn}))"


def store(kind: str, turn: str) -> str:
    text = f"concat('{kind}:', conv_id, ':', {turn}"
    return f"concat(sha2({text}), 256), sha2({text}, '+'), 256))"


def spoken(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))


def views(spark, sf):
    """(conv_id, turn, id, bytes): each turn's view."""
    now, before = commit("turn"), commit("turn - 1")
    facts = f"""CAST(named_struct(
        'heads', IF(turn % 4 = 0, array({now}, {before}), array({now})),
        'refs', filter(array(
            named_struct('remote', CAST(NULL AS STRING), 'sort', 'bookmark', 'name', role, 'terms', array({now}), 'tracked', CAST(NULL AS BOOLEAN)),
            IF(turn % 2 = 1, named_struct('remote', CAST(NULL AS STRING), 'sort', 'tag', 'name', concat('v', turn), 'terms', array({now}), 'tracked', CAST(NULL AS BOOLEAN)), NULL),
            named_struct('remote', CAST(NULL AS STRING), 'sort', 'git', 'name', concat('refs/heads/', role),
                'terms', IF(turn % 3 = 0, array({now}, CAST(NULL AS STRING), {before}), array({now})), 'tracked', CAST(NULL AS BOOLEAN)),
            named_struct('remote', 'origin', 'sort', 'bookmark', 'name', role, 'terms', array({before}), 'tracked', turn % 2 = 0)), r -> r IS NOT NULL),
        'git_head', IF(turn % 5 = 0, array(CAST(NULL AS STRING)), array({now})),
        'workspaces', map('default', {now})) AS {VIEW_FACTS})"""
    return ops.encoded_ops(spoken(spark, sf).select("conv_id", "turn", F.expr(facts).alias("facts")), ops.VIEW)


def operations(spark, sf, parents: bool = True):
    """(conv_id, turn, id, bytes): each turn's operation on its view, after that of the turn before (every fifth: after two)."""
    one, two = store("op", "turn - 1"), store("op", "turn - 2")
    facts = f"""named_struct(
        'view', {store("view", "turn")}, 'parents', {f"IF(turn % 5 = 0, array({one}, {two}), array({one}))" if parents else "CAST(array() AS ARRAY<STRING>)"},
        'start_ms', CAST(turn * 1000 AS BIGINT), 'start_offset', CAST(-(turn % 3) * 60 AS INT), 'end_ms', CAST(turn * 1000 + length(text) AS BIGINT), 'end_offset', 0,
        'description', text, 'hostname', concat('h', conv_id % 7), 'username', role, 'snapshot', turn % 2 = 0, 'workspace', IF(turn % 4 = 0, NULL, 'default'),
        'attributes', map('turn', CAST(turn AS STRING), 'args', role),
        'predecessors', IF(turn % 3 = 1, NULL, map({commit("turn")}, array({commit("turn - 1")}))))"""
    return ops.encoded_ops(spoken(spark, sf).select("conv_id", "turn", F.expr(facts).alias("facts")), ops.OPERATION)


def stored(objects, kind: str):
    """The objects under ids of their own, which SQL can make, too."""
    return objects.withColumn("id", F.expr(store(kind, "turn")))


def in_sql(text: str) -> str:
    return text.replace("sha2(", "sha256(").replace(", 256)", ")")


NOW, BEFORE = commit("turn"), commit("turn - 1")
VIEW_SQL = f"""
SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN concat({NOW}, ',', {BEFORE}) ELSE {NOW} END AS heads,
array_to_string(list_sort(list_filter([concat('bookmark|-|', role, '|-|', {NOW}), CASE WHEN turn % 2 = 1 THEN concat('tag|-|v', turn, '|-|', {NOW}) END,
concat('git|-|refs/heads/', role, '|-|', CASE WHEN turn % 3 = 0 THEN concat({NOW}, ',none,', {BEFORE}) ELSE {NOW} END),
concat('bookmark|origin|', role, '|', CASE WHEN turn % 2 = 0 THEN 'true' ELSE 'false' END, '|', {BEFORE})], lambda x: x IS NOT NULL)), ';') AS refs,
CASE WHEN turn % 5 = 0 THEN 'none' ELSE {NOW} END AS git_head, concat('default=', {NOW}) AS workspaces FROM conversations
"""


@query("view_facts", VIEW_SQL)
def view_facts(spark, sf):
    """What the turns' views hold, from their bytes."""
    f = ops.op_facts(views(spark, sf), ops.VIEW).where("facts.error IS NULL AND facts.id = id")
    none = lambda terms: F.array_join(terms, ",", "none")
    ref = lambda r: F.concat_ws("|", r["sort"], F.coalesce(r["remote"], F.lit("-")), r["name"], F.coalesce(r["tracked"].cast("string"), F.lit("-")), none(r["terms"]))
    refs = F.array_join(F.array_sort(F.transform("facts.refs", ref)), ";").alias("refs")
    workspaces = F.array_join(F.transform(F.map_entries("facts.workspaces"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("workspaces")
    return f.select("conv_id", "turn", F.array_join("facts.heads", ",").alias("heads"), refs, none(F.col("facts.git_head")).alias("git_head"), workspaces)


OPERATION_SQL = f"""
SELECT conv_id, turn, {in_sql(store("view", "turn"))} AS view,
CASE WHEN turn % 5 = 0 THEN concat({in_sql(store("op", "turn - 1"))}, ',', {in_sql(store("op", "turn - 2"))}) ELSE {in_sql(store("op", "turn - 1"))} END AS parents,
CAST(turn * 1000 AS BIGINT) AS start_ms, CAST(-(turn % 3) * 60 AS INTEGER) AS start_offset, CAST(turn * 1000 + length(coalesce(text, '')) AS BIGINT) AS end_ms,
sha256(coalesce(text, '')) AS description_sha256, concat('h', conv_id % 7) AS hostname, role AS username, turn % 2 = 0 AS snapshot,
CASE WHEN turn % 4 <> 0 THEN 'default' END AS workspace, concat('turn=', turn, ',args=', role) AS attributes,
CASE WHEN turn % 3 <> 1 THEN concat({NOW}, '<', {BEFORE}) END AS predecessors FROM conversations
"""


@query("op_facts", OPERATION_SQL)
def op_facts(spark, sf):
    """What the turns' operations hold, from their bytes."""
    f = ops.op_facts(operations(spark, sf), ops.OPERATION).where("facts.error IS NULL AND facts.id = id").select("conv_id", "turn", "facts.*")
    pairs = F.array_join(F.transform(F.map_entries("attributes"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("attributes")
    held = F.array_join(F.transform(F.map_entries("predecessors"), lambda e: F.concat_ws("<", e["key"], F.array_join(e["value"], "+"))), ",").alias("predecessors")
    return f.select(
        "conv_id", "turn", "view", F.array_join("parents", ",").alias("parents"), "start_ms", "start_offset", "end_ms", F.sha2(F.col("description").cast("binary"), 256).alias("description_sha256"),
        "hostname", "username", "snapshot", "workspace", pairs, held,
    )


V, O, O1, O2 = (in_sql(store(*x)) for x in (("view", "turn"), ("op", "turn"), ("op", "turn - 1"), ("op", "turn - 2")))
OP_REFS_SQL = f"""
SELECT 0 AS object_kind, {V} AS object_id, 0 AS reference_kind, {NOW} AS referenced_id FROM conversations UNION SELECT 0, {V}, 0, {BEFORE} FROM conversations
UNION SELECT 1, {O}, 1, {V} FROM conversations UNION SELECT 1, {O}, 2, {O1} FROM conversations UNION SELECT 1, {O}, 2, {O2} FROM conversations WHERE turn % 5 = 0
UNION SELECT 1, {O}, 0, {NOW} FROM conversations WHERE turn % 3 <> 1 UNION SELECT 1, {O}, 0, {BEFORE} FROM conversations WHERE turn % 3 <> 1
"""


@query("op_refs", OP_REFS_SQL)
def op_refs(spark, sf):
    """The edges of all views and operations."""
    of_views = ops.op_refs(ops.op_facts(stored(views(spark, sf), "view"), ops.VIEW), ops.VIEW)
    return of_views.unionByName(ops.op_refs(ops.op_facts(stored(operations(spark, sf), "op"), ops.OPERATION), ops.OPERATION))


VIEW_RULES = {1: "truncated", 2: "head_repeated", 3: "key_repeated", 4: "terms", 5: "id_differs", 6: "state", 7: "not_utf8"}
OPERATION_RULES = {1: "truncated", 2: "not_canonical", 3: "id_width", 4: "parentless", 5: "id_differs", 6: "wire_type", 7: "not_canonical"}


def _rules_sql(name: str, rules: dict[int, str]) -> str:
    cases = " ".join(f"WHEN {k} THEN '{rule}'" for k, rule in rules.items())
    return f"SELECT '{name}' AS object, conv_id, turn, CASE turn % 8 {cases} END AS rule FROM conversations WHERE turn % 8 <> 0"


@query("op_audit", f"{_rules_sql('view', VIEW_RULES)} UNION ALL {_rules_sql('operation', OPERATION_RULES)}")
def op_audit(spark, sf):
    """Views and operations of which seven in eight are altered, each in its turn's way."""
    case = F.col("turn") % 8
    cut = F.when(case == 1, F.expr("substring(bytes, 1, octet_length(bytes) - 1)"))
    more = lambda k, code: F.when(case == k, F.concat("bytes", F.expr(code)))
    other_id = F.when(case == 5, F.sha2("id", 512)).otherwise(F.col("id"))
    # one more head that is there, workspace that is there, remote ref without terms, remote ref of state 5, tag whose name isn't text
    v = views(spark, sf).withColumn("_now", F.expr(f"unhex({NOW})"))
    v_bytes = F.coalesce(
        cut, F.when(case == 2, F.concat("bytes", F.expr("X'0A14'"), "_now")), F.when(case == 3, F.concat("bytes", F.expr("X'421F0A0764656661756C741214'"), "_now")),
        more(4, "X'5A080A017812030A0179'"), more(6, "X'5A0C0A017812070A017912001805'"), more(7, "X'32030A01FF'"), F.col("bytes"),
    )
    # a field that isn't known, a parent of three bytes, no parents, a group, a number that is longer than need be
    o = written(operations(spark, sf), "operations")
    orphans = operations(spark, sf, parents=False).where(case == 4)
    o = o.where(case != 4).unionByName(orphans)
    o_bytes = F.coalesce(cut, more(2, "X'7801'"), more(3, "X'1203616263'"), more(6, "X'7B'"), more(7, "X'288100'"), F.col("bytes"))
    found = [
        ops.audit_ops(ops.op_facts(objects.select("conv_id", "turn", other_id.alias("id"), changed.alias("bytes")), kind)).select(F.lit(name).alias("object"), "conv_id", "turn", "rule")
        for name, objects, changed, kind in (("view", v, v_bytes, ops.VIEW), ("operation", o, o_bytes, ops.OPERATION))
    ]
    return found[0].unionByName(found[1])
