"""Byte codecs as Arrow jobs: trees, commits and pack manifests to rows; audits of what they hold."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import content_id

# Modes of tree entries and the reference kinds they stand for; a tree's mode may have a leading zero.
MODES = {b"100644": 0, b"100755": 1, b"120000": 2, b"40000": 3, b"040000": 3, b"160000": 5}
TREE, COMMIT, GITLINK = 3, 4, 5
ID_BYTES, HASH_BYTES = 20, 64
# Fixed value: the header that names the trees of a conflict.
CONFLICT_TREES = "jj:trees"


def parse_tree(data: bytes) -> tuple[list[tuple[int, bytes, bytes]], str | None]:
    """Entries (kind, name, oid) of a tree, and what is wrong with it, if anything is."""
    out: list[tuple[int, bytes, bytes]] = []
    at, last = 0, b""
    while at < len(data):  # by places: what is left isn't copied for each entry
        blank = data.find(b" ", at)
        if blank < 0:
            return [], "mode_missing"
        mode = data[at:blank]
        if mode not in MODES:
            return [], "mode_unknown"
        zero = data.find(b"\0", blank + 1)
        if zero < 0:
            return [], "name_unterminated"
        name = data[blank + 1 : zero]
        if name in (b"", b".", b"..") or b"/" in name:
            return [], "name_invalid"
        at = zero + 1 + ID_BYTES
        if len(data) < at:
            return [], "id_truncated"
        kind, oid = MODES[mode], data[zero + 1 : at]
        # directories sort as if their name ended in a slash
        place = name + (b"/" if kind == TREE else b"\0")
        if out and out[-1][1] == name:
            return [], "name_repeated"
        if out and place <= last:
            return [], "order"
        out.append((kind, name, oid))
        last = place
    return out, None


def tree_entries(objects: DataFrame, key: str = "id", data: str = "bytes") -> DataFrame:
    """(tree, position, kind, name, oid, error): an entry a row; a tree that can't be read has one row with the error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for tree, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                entries, error = parse_tree(raw or b"")
                rows += [(tree, None, None, None, None, error)] if error else [(tree, i, *e, None) for i, e in enumerate(entries)]
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    names = ["tree", "position", "kind", "name", "oid", "error"]
    types = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string()]
    return objects.select(F.col(key).cast("string"), data).mapInArrow(run, "tree string, position int, kind int, name binary, oid binary, error string")


def split_headers(data: bytes) -> tuple[list[tuple[str, bytes]], bytes, str | None]:
    """A commit's headers (continued lines joined by line feeds), its message, and what is wrong."""
    head, gap, message = data.partition(b"\n\n")
    if not gap and not data.endswith(b"\n"):
        return [], b"", "headers_unterminated"
    out: list[tuple[str, bytes]] = []
    for line in head.rstrip(b"\n").split(b"\n"):
        if line.startswith(b" "):
            if not out:
                return [], b"", "continuation_first"
            out[-1] = (out[-1][0], out[-1][1] + b"\n" + line[1:])
            continue
        name, blank, value = line.partition(b" ")
        if not blank or not name:
            return [], b"", "header_invalid"
        out.append((name.decode("utf-8", "replace"), value))
    return out, message, None


def parse_commit(data: bytes) -> dict:
    """Facts of a commit; error says why it can't be read. Headers come in the order tree, parents, author, committer,
    and those names don't appear later."""
    headers, message, error = split_headers(data)
    facts = {"tree": None, "parents": [], "author": None, "committer": None, "change": None, "trees": [], "message": message, "error": error}
    if error:
        return facts
    order = ["tree", "parent", "author", "committer"]
    at = 0
    for name, value in headers:
        text = value.decode("utf-8", "replace")
        if name in order:
            place = order.index(name)
            if place < at or (place == at and name != "parent" and at > 0 and facts.get(name)) or at > 3:
                return facts | {"error": f"{name}_unexpected"}
            at = place
        if name in ("tree", "parent"):
            if len(text) != 2 * ID_BYTES or set(text) - set("0123456789abcdef"):
                return facts | {"error": f"{name}_invalid"}
        if name == "tree":
            if facts["tree"]:
                return facts | {"error": "tree_unexpected"}
            facts["tree"] = text
        elif name == "parent":
            facts["parents"].append(text)
        elif name in ("author", "committer"):
            facts[name] = text
        elif name == "change-id":
            facts["change"] = facts["change"] or text
        elif name == CONFLICT_TREES:
            facts["trees"] = text.split(" ")
        if name == "committer":
            at = 4
    missing = next((n for n in ("tree", "author", "committer") if not facts[n]), None)
    return facts | ({"error": f"{missing}_missing"} if missing else {})


def commit_facts(objects: DataFrame, key: str = "id", data: str = "bytes") -> DataFrame:
    """(commit_id, tree, parents, author, committer, change, trees, message, error), one row a commit."""
    fields = ["tree", "parents", "author", "committer", "change", "trees", "message", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            facts = [parse_commit(raw or b"") for raw in batch.column(1).to_pylist()]
            columns = [pa.array([f[n] for f in facts], t) for n, t in zip(fields, types)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), *columns], ["commit_id", *fields])

    texts = pa.list_(pa.string())
    types = [pa.string(), texts, pa.string(), pa.string(), pa.string(), texts, pa.binary(), pa.string()]
    schema = "commit_id string, tree string, parents array<string>, author string, committer string, change string, trees array<string>, message binary, error string"
    return objects.select(F.col(key).cast("string"), data).mapInArrow(run, schema)


def object_refs(objects: DataFrame) -> DataFrame:
    """(object_kind, object_id, reference_kind, referenced_id): the distinct edges of trees and commits (kind, id in hex, bytes)."""
    entries = tree_entries(objects.where("kind = 1")).where("error IS NULL")
    trees = entries.select(F.lit(1).alias("object_kind"), F.col("tree").alias("object_id"), F.col("kind").alias("reference_kind"), F.lower(F.hex("oid")).alias("referenced_id"))
    facts = commit_facts(objects.where("kind = 2")).where("error IS NULL")
    to = F.array_union(F.array(F.struct(F.lit(TREE).alias("k"), F.col("tree").alias("id"))), F.transform("parents", lambda p: F.struct(F.lit(COMMIT).alias("k"), p.alias("id"))))
    to = F.array_union(to, F.transform("trees", lambda t: F.struct(F.lit(TREE).alias("k"), t.alias("id"))))
    commits = facts.select(F.lit(2).alias("object_kind"), F.col("commit_id").alias("object_id"), F.explode(to).alias("to")).select("object_kind", "object_id", F.col("to.k").alias("reference_kind"), F.col("to.id").alias("referenced_id"))
    return trees.unionByName(commits).distinct()


def audit_contents(objects: DataFrame) -> DataFrame:
    """(kind, id, rule) for objects whose id isn't that of their content, or that can't be read, however large they are."""
    differs = ~F.col("id").eqNullSafe(content_id(F.col("kind"), F.col("bytes")))
    wrong = objects.where(differs).select("kind", "id", F.lit("id_differs").alias("rule"))
    trees = tree_entries(objects.where("kind = 1")).where("error IS NOT NULL").select(F.lit(1).alias("kind"), F.col("tree").alias("id"), F.col("error").alias("rule"))
    commits = commit_facts(objects.where("kind = 2")).where("error IS NOT NULL").select(F.lit(2).alias("kind"), F.col("commit_id").alias("id"), F.col("error").alias("rule"))
    return wrong.unionByName(trees).unionByName(commits)


def audit_objects(objects: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(kind, id, rule): audit_contents, and objects that are too large; an object has a row for each rule that it breaks."""
    large = objects.where(F.octet_length("bytes") > most).select("kind", "id", F.lit("too_large").alias("rule"))
    return large.unionByName(audit_contents(objects))


# The manifest's first bytes, version, and the sizes of its header and entries; lengths are little-endian.
MAGIC, VERSION = b"DSPK", 2
HEADER_BYTES, HEAD_BYTES, OBJECT_BYTES, CHUNK_BYTES = 96, 20, 44, 80
# Bounds of a pack.
LEAST_CHUNK, MOST_CHUNK, MOST_PACK, MOST_OBJECT, MOST_OBJECTS, MOST_HEADS = 64 << 10, 8 << 20, 64 << 20, 1 << 20, 65_536, 4_096


def parse_manifest(data: bytes) -> dict:
    """A pack's manifest, with the rule that it breaks as error."""
    bad = lambda rule: {"error": rule}
    if len(data) < HEADER_BYTES:
        return bad("header_truncated")
    magic, version, zero, chunk_bytes, heads, objects, chunks, length = struct.unpack("<4sHHIIIIQ", data[:32])
    if magic != MAGIC or version != VERSION or zero:
        return bad("header_invalid")
    if not LEAST_CHUNK <= chunk_bytes <= MOST_CHUNK:
        return bad("chunk_size")
    if not 0 < objects <= MOST_OBJECTS or heads > MOST_HEADS or chunks > MOST_PACK // LEAST_CHUNK or length > MOST_PACK:
        return bad("count_or_length_out_of_bounds")
    if len(data) != HEADER_BYTES + heads * HEAD_BYTES + objects * OBJECT_BYTES + chunks * CHUNK_BYTES:
        return bad("length_differs_from_counts")
    at = HEADER_BYTES
    head_ids = [data[at + i * HEAD_BYTES : at + (i + 1) * HEAD_BYTES] for i in range(heads)]
    at += heads * HEAD_BYTES
    entries = [struct.unpack("<B7s20sQQ", data[at + i * OBJECT_BYTES : at + (i + 1) * OBJECT_BYTES]) for i in range(objects)]
    at += objects * OBJECT_BYTES
    parts = [struct.unpack("<QI4s64s", data[at + i * CHUNK_BYTES : at + (i + 1) * CHUNK_BYTES]) for i in range(chunks)]
    if any(a >= b for a, b in zip(head_ids, head_ids[1:])) or any((a[0], a[2]) >= (b[0], b[2]) for a, b in zip(entries, entries[1:])):
        return bad("order")
    if any(e[0] > 2 or any(e[1]) for e in entries) or any(any(p[2]) for p in parts):
        return bad("entry_invalid")
    if any(e[4] > MOST_OBJECT for e in entries):
        return bad("object_too_large")
    for ranges, fixed in (([e[3:5] for e in entries], None), ([p[:2] for p in parts], chunk_bytes)):
        end = 0
        for i, (offset, size) in enumerate(ranges):
            if offset != end or (fixed and (not 0 < size <= fixed or (size != fixed and i + 1 < len(ranges)))):
                return bad("ranges")
            end += size
        if end != length:
            return bad("ranges")
    return {
        "error": None, "chunk_bytes": chunk_bytes, "pack_length": length, "pack_hash": data[32:96], "heads": head_ids,
        "objects": [{"kind": e[0], "id": e[2], "byte_offset": e[3], "byte_length": e[4]} for e in entries],
        "chunks": [{"byte_offset": p[0], "byte_length": p[1], "hash": p[3]} for p in parts],
    }


def pack_of(objects: list[tuple[int, bytes, bytes]], chunk_bytes: int = LEAST_CHUNK, heads: tuple[bytes, ...] = ()) -> tuple[bytes, list[bytes]]:
    """(manifest, chunks) of a pack of objects (kind, id, bytes), which parse_manifest reads back."""
    objects = sorted(objects)
    whole = b"".join(data for _, _, data in objects)
    chunks = [whole[i : i + chunk_bytes] for i in range(0, len(whole), chunk_bytes)]
    digest = lambda b: hashlib.blake2b(b, digest_size=HASH_BYTES).digest()
    out, at = [struct.pack("<4sHHIIIIQ", MAGIC, VERSION, 0, chunk_bytes, len(heads), len(objects), len(chunks), len(whole)), digest(whole), *sorted(heads)], 0
    for kind, oid, data in objects:
        out.append(struct.pack("<B7s20sQQ", kind, bytes(7), oid, at, len(data)))
        at += len(data)
    out += [struct.pack("<QI4s64s", i * chunk_bytes, len(c), bytes(4), digest(c)) for i, c in enumerate(chunks)]
    return b"".join(out), chunks


def packed_objects(objects: DataFrame, pack: str) -> DataFrame:
    """(pack, content, chunks): the manifest and the chunks of each pack of objects (pack, kind, id in hex, bytes). A pack
    has a bounded size (assign_packs), so it is put together in one group."""

    def build(group: pa.Table) -> pa.Table:
        rows = {(k, bytes.fromhex(i)): b for k, i, b in zip(*(group[c].to_pylist() for c in ("kind", "id", "bytes")))}
        manifest, chunks = pack_of([(*key, data) for key, data in rows.items()])
        return pa.table({"pack": group[pack][:1].cast(pa.int64()), "content": pa.array([manifest], pa.binary()), "chunks": pa.array([chunks], pa.list_(pa.binary()))})

    return objects.select(F.col(pack).cast("long"), "kind", "id", "bytes").groupBy(pack).applyInArrow(build, "pack long, content binary, chunks array<binary>")


class TreeEntries:
    """A table function for SQL: LATERAL tree_entries(bytes) gives (position, kind, name, oid, error)."""

    def eval(self, data: bytes):
        entries, error = parse_tree(data or b"")
        if error:
            yield None, None, None, None, error
        for i, (kind, name, oid) in enumerate(entries):
            yield i, kind, name, oid, None


def register_functions(spark) -> None:
    """Makes tree_entries, digest64 and glob_to_regex known to the session's SQL."""
    from ..functions.identity import digest64
    from .policy import glob_regex

    spark.udtf.register("tree_entries", F.udtf(TreeEntries, returnType="position int, kind int, name binary, oid binary, error string"))
    spark.udf.register("digest64", digest64)
    spark.udf.register("glob_to_regex", glob_regex)


def manifests(files: DataFrame) -> DataFrame:
    """(pack_id, error, chunk_bytes, pack_length, pack_hash, heads, objects, chunks) of manifests in the column content;
    a pack's id is the BLAKE2b digest of its manifest."""
    types = {
        "error": pa.string(), "chunk_bytes": pa.int32(), "pack_length": pa.int64(), "pack_hash": pa.binary(), "heads": pa.list_(pa.binary()),
        "objects": pa.list_(pa.struct([("kind", pa.int32()), ("id", pa.binary()), ("byte_offset", pa.int64()), ("byte_length", pa.int64())])),
        "chunks": pa.list_(pa.struct([("byte_offset", pa.int64()), ("byte_length", pa.int64()), ("hash", pa.binary())])),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(0).to_pylist()
            found = [parse_manifest(r or b"") for r in raw]
            ids = pa.array([hashlib.blake2b(r or b"", digest_size=HASH_BYTES).digest() for r in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([f.get(n) for f in found], t) for n, t in types.items())], ["pack_id", *types])

    schema = (
        "pack_id binary, error string, chunk_bytes int, pack_length long, pack_hash binary, heads array<binary>, "
        "objects array<struct<kind int, id binary, byte_offset long, byte_length long>>, chunks array<struct<byte_offset long, byte_length long, hash binary>>"
    )
    return files.select("content").mapInArrow(run, schema)


def pack_tables(decoded: DataFrame) -> dict[str, DataFrame]:
    """packs, objects, chunks, heads and rejected of decoded manifests, each with its position in the pack."""
    good = decoded.where("error IS NULL")
    spread = lambda c: good.select("pack_id", F.posexplode(c).alias("position", "_x"))
    return {
        "packs": good.select("pack_id", "chunk_bytes", "pack_length", "pack_hash", F.size("objects").alias("object_count"), F.size("chunks").alias("chunk_count")),
        "objects": spread("objects").select("pack_id", "position", "_x.*"),
        "chunks": spread("chunks").select("pack_id", "position", "_x.*"),
        "heads": spread("heads").select("pack_id", "position", F.col("_x").alias("id")),
        "rejected": decoded.where("error IS NOT NULL").select("pack_id", "error"),
    }


def audit_packs(packs: DataFrame, chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """(pack_id, position, rule): chunks that are missing or whose bytes differ in length or digest, and packs whose
    bytes have another digest (position null). stored: (pack_id, position, chunk). A pack is at most 64 MiB, so its
    chunks are hashed in order in one group."""
    from ..functions.identity import digest64

    joined = chunks.join(stored, ["pack_id", "position"], "left")
    rule = F.when(F.col("chunk").isNull(), "missing").when(F.octet_length("chunk") != F.col("byte_length"), "length").when(digest64(F.col("chunk")) != F.col("hash"), "digest")
    wrong = joined.withColumn("rule", rule).where("rule IS NOT NULL").select("pack_id", "position", "rule")

    def whole(group: pa.Table) -> pa.Table:
        digest = hashlib.blake2b(digest_size=HASH_BYTES)
        for part in group.sort_by("position")["chunk"].to_pylist():
            digest.update(part)
        return pa.table({"pack_id": group["pack_id"][:1].cast(pa.binary()), "digest": pa.array([digest.digest()], pa.binary())})

    hashed = stored.select("pack_id", "position", "chunk").groupBy("pack_id").applyInArrow(whole, "pack_id binary, digest binary")
    differs = packs.join(hashed, "pack_id").where("digest <> pack_hash").select("pack_id", F.lit(None).cast("int").alias("position"), F.lit("pack_digest").alias("rule"))
    return wrong.unionByName(differs)


def ref_terms(targets: DataFrame) -> DataFrame:
    """(name, position, id, added) of ref targets (name, terms): terms add at even places and remove at odd ones.
    Targets with an even number of terms are invalid and have no rows."""
    odd = targets.where(F.size("terms") % 2 == 1)
    return odd.select("name", F.posexplode_outer("terms").alias("position", "id")).withColumn("added", F.col("position") % 2 == 0)
