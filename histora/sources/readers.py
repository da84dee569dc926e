"""Readers of object vectors, packs, requests, ref listings and pins, and sinks that don't overwrite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.codecs import manifests, pack_tables
from ..operators.relations import merge_counts


def read_object_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(kind, id, payload) of 'kind|id|hex' lines; lines that begin with # are comments."""
    rows = spark.read.csv(path, sep="|", comment="#", schema="kind string, id string, payload string")
    return rows.select("kind", F.lower("id").alias("id"), F.unhex(F.coalesce("payload", F.lit(""))).alias("payload"))


def read_packs(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """packs, objects, chunks, heads and rejected of a folder of manifests."""
    return pack_tables(manifests(spark.read.format("binaryFile").load(path)))


def read_ref_listings(spark: SparkSession, path: str, requested: DataFrame | None = None, most: int = 256) -> tuple[DataFrame, DataFrame]:
    """((file, ref, oid), (file, line, code)) of listings of 'oid<TAB>refs/heads/name' lines.

    A listing with a bad line, a repeated ref or more than most heads is rejected as a whole; of the others the
    requested refs are kept.
    """
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("line")).where("line <> ''")
    part = F.split("line", "\t")
    ok = (F.size(part) == 2) & part[0].rlike("^[0-9a-f]{40}$") & part[1].startswith("refs/heads/")
    rows = lines.select("file", "line", F.when(ok, F.substring(part[1], 12, 1 << 20)).alias("ref"), F.when(ok, part[0]).alias("oid"))
    bad = rows.where("ref IS NULL").select("file", "line", F.lit("bad_line").alias("code"))
    twice = rows.where("ref IS NOT NULL").groupBy("file", "ref").count().where("count > 1").select("file", F.col("ref").alias("line"), F.lit("repeated_ref").alias("code"))
    many = rows.groupBy("file").count().where(F.col("count") > most).select("file", F.col("count").cast("string").alias("line"), F.lit("too_many_heads").alias("code"))
    rejected = bad.unionByName(twice).unionByName(many)
    good = rows.join(rejected.select("file").distinct(), "file", "left_anti").select("file", "ref", "oid")
    return (good if requested is None else good.join(requested.select("ref"), "ref", "left_semi").select("file", "ref", "oid")), rejected


#: Schemas of requests by kind; unknown fields make a request bad.
STATE = "struct<canonicalOid string, publicOid string, hiddenSetId string>"
REQUESTS = {
    "push": f"incarnation string, batchId string, machineId string, remote string, updates array<struct<bookmark string, expectedOldOid string, states array<{STATE}>, proposedState int, identityOid string>>",
    "fetch": f"incarnation string, fetchId string, machineId string, remote string, refs array<struct<bookmark string, observedPublicOid string, expectedCursorOid string, states array<{STATE}>, proposedState int, identityOid string>>",
    "claim": "incarnation string, machineId string",
    "recover": "incarnation string, machineId string, fence long, observations array<struct<bookmark string, liveOid string>>",
    "heads": "incarnation string, idempotencyKey string, newHead string, observedHeads array<string>",
}
LISTS = {"push": "updates", "fetch": "refs", "recover": "observations"}


#: Fields that may be null; all must be there.
NULLABLE = {"expectedOldOid", "expectedCursorOid", "proposedState", "identityOid", "hiddenSetId", "liveOid"}
KINDS = {"string": "STRING", "int": "BIGINT", "long": "BIGINT"}


def _kind(value: Column) -> Column:
    """The JSON type of a variant, VOID for null; null if there is no value."""
    return F.schema_of_variant(value)


def _field_code(keys: Column, value, fields: dict[str, str], label: str) -> Column:
    """The first of fields (name -> type) that is missing, null though it mustn't be, or of another type, as code; null if none is."""
    code = F.lit(None).cast("string")
    for name, kind in reversed(fields.items()):
        found = _kind(value(name))
        wrong = F.lit(False) if kind not in KINDS else ~F.coalesce(found, F.lit("VOID")).isin(KINDS[kind], "VOID")
        gone = ~F.coalesce(F.array_contains(keys, name), F.lit(False))
        if name not in NULLABLE:
            gone = gone | F.coalesce(found, F.lit("VOID")).eqNullSafe(F.lit("VOID"))
        code = F.when(gone, f"{label}{name}_missing").when(wrong, f"{label}{name}_type").otherwise(code)
    return code


def _items_code(items: Column, fields: dict[str, str], label: str) -> Column:
    """The code of the first item (map of variants) that has other fields than these, or such of other types."""
    known = F.array(*map(F.lit, fields))
    one = lambda m: F.when(m.isNull(), f"{label}invalid").when(F.size(F.array_except(F.map_keys(m), known)) > 0, f"{label}unknown_field").otherwise(_field_code(F.map_keys(m), lambda n: m[n], fields, label))
    return F.get(F.filter(F.transform(items, one), lambda c: c.isNotNull()), F.lit(0))


def read_requests(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """(requests, (raw, code)) of lines of JSON. Lists are sorted by name.

    A request is rejected if it isn't a JSON object, has a field that its schema doesn't know or lacks one, has null where NULLABLE
    doesn't allow it, or a value of another type, in any depth; if it repeats a name or a mapping, points outside its
    states, maps an id to itself, has states without proposing one (push), has an id that is the same on both sides along with states, or
    proposes another id than the observed one (fetch).
    """
    raw = spark.read.text(path).select(F.col("value").alias("raw")).where("trim(raw) <> ''")
    schema = REQUESTS[kind]
    top = _fields(schema)
    parsed = raw.select("raw", F.from_json("raw", schema, {"mode": "PERMISSIVE"}).alias("r"), F.json_object_keys("raw").alias("_keys"), F.try_parse_json("raw").alias("_v"))
    value = lambda name: F.try_variant_get("_v", f"$.{name}", "variant")
    code = F.when(F.col("_keys").isNull() | F.col("_v").isNull(), "not_json").when(F.size(F.array_except("_keys", F.array(*map(F.lit, top)))) > 0, "unknown_field")
    own = _field_code(F.col("_keys"), value, {n: t for n, t in top.items() if n != LISTS.get(kind)}, "")
    code = code.when(own.isNotNull(), own)
    if kind in LISTS:
        items, inner = F.col(f"r.{LISTS[kind]}"), _fields(top[LISTS[kind]][len("array<struct<") : -2])
        each = F.try_variant_get("_v", f"$.{LISTS[kind]}", "array<map<string,variant>>")
        wrong = _items_code(each, inner, "item_")
        code = code.when(items.isNull() | each.isNull(), "list_missing").when(wrong.isNotNull(), wrong)
        if "states" in inner:
            states = F.transform(each, lambda m: F.try_variant_get(m["states"], "$", "array<map<string,variant>>"))
            inside = F.get(F.filter(F.transform(states, lambda s: _items_code(s, _fields(STATE[len("struct<") : -1]), "state_")), lambda c: c.isNotNull()), F.lit(0))
            code = code.when(F.exists(states, lambda s: s.isNull()), "item_states_type").when(inside.isNotNull(), inside)
        code = code.when(F.size(F.array_distinct(F.transform(items, lambda u: u["bookmark"]))) < F.size(items), "repeated_name")
    if kind in ("push", "fetch"):
        some = lambda rule: F.coalesce(F.exists(items, rule), F.lit(False))
        code = code.when(some(lambda u: u["proposedState"].isNotNull() & ((u["proposedState"] < 0) | (u["proposedState"] >= F.size(u["states"])))), "state_outside")
        code = code.when(some(lambda u: F.exists(u["states"], lambda s: s["canonicalOid"] == s["publicOid"])), "identity_mapping")
        code = code.when(some(lambda u: u["identityOid"].isNotNull() & (u["proposedState"].isNotNull() | (F.size(u["states"]) > 0))), "identity_with_states")
        if kind == "push":
            code = code.when(some(lambda u: u["identityOid"].isNull() & u["proposedState"].isNull() & (F.size(u["states"]) > 0)), "states_without_proposal")
            pairs = lambda u: F.transform(u["states"], lambda s: F.struct(s["canonicalOid"], s["publicOid"]))
            code = code.when(some(lambda u: F.size(F.array_distinct(pairs(u))) < F.size(u["states"])), "repeated_mapping")
        else:
            given = lambda u: F.coalesce(u["identityOid"], F.get(u["states"], u["proposedState"])["publicOid"])
            code = code.when(some(lambda u: given(u).isNotNull() & (given(u) != u["observedPublicOid"])), "proposal_not_observed")
    if kind == "heads":
        heads = F.col("r.observedHeads")
        head = F.coalesce(F.col("r.newHead"), F.lit(""))
        code = code.when(heads.isNull() | F.exists(heads, lambda h: h.isNull()), "observedHeads_missing").when(~head.rlike("^[0-9a-f]{128}$") | head.rlike("^0+$"), "new_head_invalid")
        code = code.when(F.size(F.array_distinct(heads)) < F.size(heads), "repeated_head")
    checked = parsed.withColumn("code", code)
    good = checked.where("code IS NULL").select("raw", "r.*")
    if kind in LISTS:
        good = good.withColumn(LISTS[kind], F.array_sort(LISTS[kind], lambda a, b: F.when(a["bookmark"] < b["bookmark"], -1).when(a["bookmark"] > b["bookmark"], 1).otherwise(0)))
    if kind == "heads":
        good = good.withColumn("observedHeads", F.array_sort("observedHeads"))
    return good, checked.where("code IS NOT NULL").select("raw", "code")


def _fields(schema: str) -> dict[str, str]:
    """The names of a schema's fields on the top level, and their types."""
    return {name: kind for name, _, kind in (f.partition(" ") for f in _top_fields(schema))}


def _top_fields(schema: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[last:i].strip())
            last = i + 1
    return [*out, schema[last:].strip()]


def request_hash(requests: DataFrame, bits: int = 512) -> DataFrame:
    """requests with fingerprint: SHA-2 of so many bits of their fields as JSON in the order of the schema, lists sorted."""
    return requests.withColumn("fingerprint", F.sha2(F.to_json(F.struct(*[c for c in requests.columns if c != "raw"]), {"ignoreNullFields": "false"}).cast("binary"), bits))


def read_pins(spark: SparkSession, path: str) -> DataFrame:
    """(alias, backend, url, subdir, mode, ref, commit, extra) of TOML files of pinned sources; a table a source, fields
    that aren't known are kept in extra."""
    import tomllib

    import pandas as pd

    known = ["backend", "url", "subdir", "mode", "ref", "commit"]

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch["value"]:
                for alias, fields in tomllib.loads(text).get("repos", {}).items():
                    rows.append((alias, *(fields.get(k) for k in known), {k: str(v) for k, v in fields.items() if k not in known}))
            yield pd.DataFrame(rows, columns=["alias", *known, "extra"])

    schema = "alias string, " + ", ".join(f"{k} string" for k in known) + ", extra map<string, string>"
    return spark.read.text(path, wholetext=True).mapInPandas(run, schema)


def select_pins(pins: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the pins named, the aliases that no pin has)."""
    return pins.join(aliases.select("alias"), "alias", "left_semi"), aliases.select("alias").join(pins, "alias", "left_anti")


def write_table(df: DataFrame, path: str, sort_by: list[str], partitions: int, partition_by: list[str] | None = None) -> None:
    """Parquet, clustered: ranges of sort_by over the files and sorted within, so that row groups can be skipped."""
    writer = df.repartitionByRange(partitions, *sort_by).sortWithinPartitions(*sort_by).write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_objects(added: DataFrame, path: str, keys: list[str], value: str) -> dict[str, int]:
    """Appends the rows whose keys the table at path lacks, and says how many were inserted, there, or in conflict;
    nothing is appended if any is in conflict. A run that broke off finds its rows as existing."""
    spark = added.sparkSession
    stored = spark.read.schema(added.schema).parquet(path)
    counts = merge_counts(added, stored, keys, value).first().asDict()
    if not counts["conflicts"]:
        added.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti").write.mode("append").parquet(path)
    return counts
