"""Path policies: rules, decisions, leaks, public trees, overlays."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..functions.identity import content_id, digest64
from .stages import null_safe_join


def glob_to_regex(pattern: str) -> str:
    """A rule's pattern as a regular expression over a path relative to the rule's directory.

    ** is any number of directories, * and ? stay within a name, a pattern without an inner slash matches at any depth.
    """
    anchored = "/" in pattern.rstrip("/")
    rest, out = pattern.strip("/"), ""
    i = 0
    while i < len(rest):
        if rest.startswith("**/", i) and (i == 0 or rest[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif rest[i:] == "**" and (i == 0 or rest[i - 1] == "/"):
            out, i = out + ".+", i + 2
        elif rest[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif rest[i] == "?":
            out, i = out + "[^/]", i + 1
        elif rest[i] == "[" and "]" in rest[i + 2 :]:
            end = rest.index("]", i + 2)
            inner = rest[i + 1 : end]
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]", end + 1
        elif rest[i] == "\\" and i + 1 < len(rest):
            out, i = out + _quoted(rest[i + 1]), i + 2
        else:
            out, i = out + _quoted(rest[i]), i + 1
    return f"^{'' if anchored else '(?:[^/]+/)*'}{out}$"


def _quoted(c: str) -> str:
    return c if c.isalnum() or c in "_-/ " else "\\" + c


def policy_rules(files: DataFrame) -> DataFrame:
    """(scope, directory, line, pattern, negated, dir_only) of policy files (scope, path, text); comments and blank
    lines make no rule. The directory is that of the file, with a slash at its end unless it is the top."""
    lines = files.select("scope", F.regexp_extract("path", r"^(.*/)?[^/]*$", 1).alias("directory"), F.posexplode(F.split("text", "\r?\n")).alias("line", "raw"))
    lines = lines.withColumn("raw", F.regexp_replace("raw", r"(?<!\\) +$", "")).where(~F.col("raw").startswith("#") & (F.col("raw") != ""))
    lines = lines.withColumn("negated", F.col("raw").startswith("!")).withColumn("raw", F.regexp_replace("raw", r"^!", "")).withColumn("dir_only", F.col("raw").endswith("/"))
    return lines.where(F.regexp_replace("raw", "/+", "") != "").select("scope", "directory", "line", F.col("raw").alias("pattern"), "negated", "dir_only")


def ancestors_of(path: Column) -> Column:
    """The path's directories from the top down and the path itself, as struct(path, depth, is_dir)."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("path"), i.alias("depth"), (i < F.size(parts)).alias("is_dir")))


def _private(path: Column, policy_name: str | None) -> Column:
    return F.lit(False) if policy_name is None else (path == policy_name) | path.endswith("/" + policy_name)


def _decision(rules: list[tuple[str, int, str, bool, bool]], policy_name: str | None) -> Column:
    """Whether the column path is hidden: looks at the path's row alone."""
    ordered = sorted(rules, key=lambda r: (r[0].count("/"), r[1]))

    def excluded(a: Column) -> Column:
        out = F.lit(False)
        for directory, _, pattern, negated, dir_only in ordered:
            hit = F.substr(a["path"], F.lit(len(directory) + 1)).rlike(glob_to_regex(pattern))
            if directory:
                hit &= a["path"].startswith(directory)
            if dir_only:
                hit &= a["is_dir"]
            out = F.when(hit, F.lit(not negated)).otherwise(out)
        return out

    return F.exists(ancestors_of(F.col("path")), excluded) | _private(F.col("path"), policy_name)


def decide(paths: DataFrame, rules: list[tuple[str, int, str, bool, bool]], policy_name: str | None = None) -> DataFrame:
    """(columns of paths, hidden) by one list of rules (directory, line, pattern, negated, dir_only) for all paths.

    For each ancestor and the path itself the last matching rule holds, deeper files before shallower ones; a path under
    an excluded directory is excluded whatever later rules say. Policy files themselves are always hidden.
    """
    return paths.withColumn("hidden", _decision(rules, policy_name))


@pandas_udf(StringType())
def glob_regex(patterns: pd.Series) -> pd.Series:
    """glob_to_regex over a column of patterns."""
    return patterns.map(glob_to_regex, na_action="ignore")


def decide_by(paths: DataFrame, rules: DataFrame, scope: list[str], policy_name: str | None = None) -> DataFrame:
    """(columns of paths, hidden) by the rules of each path's scope (scope, directory, line, pattern, negated, dir_only), as
    policy_rules() makes them.

    The rules of a scope, such as a commit, are put together into one row in the order in which they hold, so paths meet
    them by one join, which adaptive execution splits where a scope has very many paths. Patterns are compiled once a rule.
    """
    rule = F.struct(
        (F.length("directory") - F.length(F.replace("directory", F.lit("/"), F.lit("")))).alias("depth"), F.col("line"), F.col("directory"),
        glob_regex("pattern").alias("regex"), F.col("negated"), F.col("dir_only"),
    )
    together = rules.groupBy(*scope).agg(F.array_sort(F.collect_list(rule)).alias("_rules"))

    def hit(a: Column, r: Column) -> Column:
        below = F.substr(a["path"], F.length(r["directory"]) + 1)
        return F.startswith(a["path"], r["directory"]) & F.regexp_like(below, r["regex"]) & (~r["dir_only"] | a["is_dir"])

    def excluded(a: Column) -> Column:
        return F.aggregate("_rules", F.lit(False), lambda out, r: F.when(hit(a, r), ~r["negated"]).otherwise(out))

    hidden = F.coalesce(F.exists(ancestors_of(F.col("path")), excluded), F.lit(False)) | _private(F.col("path"), policy_name)
    return paths.join(together, scope, "left").select(*paths.columns, hidden.alias("hidden"))


def policy_files(paths: DataFrame, name: str) -> DataFrame:
    """Paths whose last part is name."""
    return paths.where((F.col("path") == name) | F.col("path").endswith("/" + name))


def classify_paths(paths: DataFrame, private: list, ignored: list) -> DataFrame:
    """(columns of paths, class): hidden by the private rules, else ignored by the others, else visible."""
    return paths.withColumn("class", F.when(_decision(private, None), "hidden").when(_decision(ignored, None), "ignored").otherwise("visible"))


def policy_anomalies(entries: DataFrame, name: str, file_kinds: list[int]) -> DataFrame:
    """(scope, path, reason): policy entries that aren't one plain file: conflicted, or of another kind."""
    found = policy_files(entries, name).withColumn("reason", F.when(F.col("n_terms") > 1, "conflicted").when(~F.col("kind").isin(*file_kinds), "not_a_file"))
    return found.where("reason IS NOT NULL").select("scope", "path", "reason")


def withheld(paths: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Paths at or below the directory of an anomalous policy entry of their scope."""
    directories = anomalies.select("scope", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("directory")).distinct()
    above = F.concat(F.array(F.lit("")), F.transform(F.filter(ancestors_of(F.col("path")), lambda a: a["is_dir"]), lambda a: a["path"]))
    each = paths.withColumn("directory", F.explode(above))
    return each.join(directories, ["scope", "directory"], "left_semi").drop("directory").distinct()


def public_paths(decided: DataFrame) -> DataFrame:
    return decided.where("NOT hidden").drop("hidden")


def embedded(decided: DataFrame) -> DataFrame:
    """Visible paths (with kind) that are embedded repositories, kind 5: a public tree can't hold them, so each is an error."""
    return decided.where("NOT hidden AND kind = 5").drop("hidden")


def classify_by(paths: DataFrame, private: DataFrame, ignored: DataFrame, scope: list[str], policy_name: str | None = None) -> DataFrame:
    """(columns of paths, class): hidden by the private rules of the path's scope, else ignored by its other rules, else visible."""
    hidden = decide_by(paths, private, scope, policy_name).withColumnRenamed("hidden", "_hidden")
    both = decide_by(hidden, ignored, scope)
    return both.select(*paths.columns, F.when(F.col("_hidden"), "hidden").when(F.col("hidden"), "ignored").otherwise("visible").alias("class"))


def leaks(public: DataFrame, rules: list, policy_name: str | None = None) -> DataFrame:
    """Paths of public trees that one list of rules for all of them hides."""
    return decide(public, rules, policy_name).where("hidden").drop("hidden")


def leaks_by(public: DataFrame, rules: DataFrame, scope: list[str], policy_name: str | None = None) -> DataFrame:
    """Paths of public trees that the rules of their scope, such as the commit that was projected, hide."""
    return decide_by(public, rules, scope, policy_name).where("hidden").drop("hidden")


def disclosures(foreign: DataFrame, rules: list) -> DataFrame:
    """(commit_id, path, message): paths of foreign commits that one list of rules hides."""
    return _disclosed(leaks(foreign, rules))


def _disclosed(found: DataFrame) -> DataFrame:
    return found.select("commit_id", "path", F.format_string("%s discloses %s", F.col("commit_id").cast("string"), "path").alias("message"))


def rules_of_parents(parents: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rules that hold in what a commit's parents merge into, (commit_id, directory, line, pattern, negated, dir_only),
    and (commit_id, directory) of policy files that differ between them, whose rules hold nowhere.

    parents: (commit_id, parent), any number a commit, repeats allowed; rules: by scope, which is the parent. A file that
    one parent has alone is merged in. The rules of a file are one row, so parents are compared file by file without
    bringing a commit's files together.
    """
    rule = F.struct("line", "pattern", "negated", "dir_only")
    files = rules.groupBy("scope", "directory").agg(F.array_sort(F.collect_set(rule)).alias("_file"))
    met = parents.join(files, parents["parent"] == files["scope"]).groupBy("commit_id", "directory").agg(F.min("_file").alias("_file"), F.max("_file").alias("_other"))
    merged = met.where("_file = _other").select("commit_id", "directory", F.explode("_file").alias("_rule"))
    return merged.select("commit_id", "directory", "_rule.*"), met.where("_file <> _other").select("commit_id", "directory")


def disclosures_by(foreign: DataFrame, parents: DataFrame, rules: DataFrame, policy_name: str | None = None) -> DataFrame:
    """(commit_id, path, message): paths of foreign commits that the rules of their own parents hide, and the directories
    in whose policy the parents differ.

    foreign: (commit_id, path); parents and rules as for rules_of_parents(). Commits without parents disclose nothing but
    policy files.
    """
    merged, differing = rules_of_parents(parents, rules)
    found = _disclosed(leaks_by(foreign.select("commit_id", "path"), merged, ["commit_id"], policy_name))
    known = differing.join(foreign.select("commit_id").distinct(), "commit_id", "left_semi")
    message = F.format_string("parents of %s differ in the policy of '%s'", F.col("commit_id").cast("string"), "directory")
    return found.unionByName(known.select("commit_id", F.col("directory").alias("path"), message.alias("message")))


def overlay(base: DataFrame, left: DataFrame, right: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """(path, oid, conflict): a three-way overlay. Equal sides agree; a side equal to the base gives way to the other;
    else the terms of the conflict are left, base and right. Paths in forced are in conflict whatever the sides say."""
    b, x, y = (d.select("path", F.col("oid").alias(c)) for d, c in ((base, "_b"), (left, "_l"), (right, "_r")))
    joined = b.join(x, "path", "full_outer").join(y, "path", "full_outer")
    if forced is not None:
        joined = joined.join(forced.select("path", F.lit(True).alias("_forced")), "path", "left")
    else:
        joined = joined.withColumn("_forced", F.lit(None).cast("boolean"))
    same = lambda p, q: F.col(p).eqNullSafe(F.col(q))
    settled = F.when(F.col("_forced"), False).otherwise(same("_l", "_r") | same("_b", "_l") | same("_b", "_r"))
    oid = F.when(same("_l", "_r") | same("_b", "_r"), F.col("_l")).otherwise(F.col("_r"))
    out = joined.select("path", F.when(settled, oid).alias("oid"), F.when(~settled, F.array("_l", "_b", "_r")).alias("conflict"))
    return out.where("oid IS NOT NULL OR conflict IS NOT NULL")


def tree_paths(roots: DataFrame, entries: DataFrame, written) -> DataFrame:
    """(commit_id, path, kind, oid): files under each root, any depth.

    Sub-trees are flattened once each, level by level, as (tree, path) tables that are joined to the roots at the end.
    entries: (tree, kind, name, oid); kind 3 is a tree. written cuts lineage.
    """
    level = written(roots.select("commit_id", F.col("tree").alias("_tree"), F.lit("").alias("_prefix")), "trees")
    parts = []
    while level.limit(1).count():
        below = level.join(entries.withColumnRenamed("tree", "_tree"), "_tree").withColumn("path", F.concat("_prefix", "name"))
        parts.append(below.where("kind <> 3").select("commit_id", "path", "kind", "oid"))
        level = written(below.where("kind = 3").select("commit_id", F.col("oid").alias("_tree"), F.concat("path", F.lit("/")).alias("_prefix")), "trees")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def set_identity(files: DataFrame, scope: list[str], tag: str, bits: int = 512) -> DataFrame:
    """(scope, identity): SHA-2 of so many bits of a domain tag and, in byte order of their paths, each path with its length and its
    blob id. A scope's policy files are few; scopes without any have no row."""
    part = F.struct(F.col("path").cast("binary").alias("path"), F.col("oid").alias("oid"))
    grouped = files.groupBy(*scope).agg(F.array_sort(F.collect_list(part)).alias("_parts"))
    text = F.array_join(F.transform("_parts", lambda p: F.concat(F.octet_length(p["path"]).cast("string"), F.lit(":"), p["path"].cast("string"), F.lit("="), p["oid"])), ";")
    return grouped.select(*scope, F.sha2(F.concat(F.lit(tag + ";"), text).cast("binary"), bits).alias("identity"))


def policy_identity(files: DataFrame, scope: list[str], domain: bytes) -> DataFrame:
    """(scope, identity): BLAKE2b-512 of the domain's bytes and, in byte order of their paths, of each policy file the
    path's length as eight little-endian bytes, the path and the blob id. Scopes without policy files have no row.

    files: (scope, path, oid in hex).
    """
    path = F.col("path").cast("binary")
    size = F.octet_length(path).cast("long")
    length = F.concat(*(F.unhex(F.lpad(F.hex(F.shiftrightunsigned(size, 8 * i).bitwiseAND(F.lit(255))), 2, "0")) for i in range(8)))
    part = F.struct(path.alias("path"), F.concat(length, path, F.unhex("oid")).alias("data"))
    grouped = files.groupBy(*scope).agg(F.array_sort(F.collect_list(part)).alias("_parts"))
    data = F.aggregate("_parts", F.lit(domain), lambda out, p: F.concat(out, p["data"]))
    return grouped.select(*scope, digest64(data).alias("identity"))


def tree_ids(files: DataFrame, scope: list[str], written) -> DataFrame:
    """(scope, path, id): the id of each directory's tree, the top's path being empty; directories without files have none.

    files: (scope, path, kind, oid in hex), kinds 0 file, 1 executable, 2 symlink, 3 a directory whose id is known already,
    5 an embedded repository. Levels are encoded from the deepest
    up: a directory's entries are sorted as if directories' names ended in a slash, put together and hashed. A
    directory's entries are bounded by the size of one object. written cuts lineage.
    """
    mode = F.when(F.col("kind") == 1, "100755").when(F.col("kind") == 2, "120000").when(F.col("kind") == 3, "40000").when(F.col("kind") == 5, "160000").otherwise("100644")
    place = F.concat(F.col("name").cast("binary"), F.unhex(F.when(F.col("kind") == 3, "2F").otherwise("00")))
    entry = F.concat(mode.cast("binary"), F.lit(b" "), F.col("name").cast("binary"), F.unhex(F.lit("00")), F.unhex("oid"))
    parts = F.split("path", "/")
    rows = files.select(*scope, "path", "kind", "oid", F.size(parts).alias("_depth"))
    rows = written(rows, "files")
    depth = rows.agg(F.coalesce(F.max("_depth"), F.lit(0))).first()[0]
    above = written(rows.where(F.col("_depth") == depth).drop("_depth"), "level")
    out = None
    for d in range(depth, 0, -1):
        named = above.withColumn("name", F.substring_index("path", "/", -1))
        directory = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
        grouped = named.groupBy(*scope, directory.alias("path")).agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), entry.alias("entry")))).alias("_e"))
        data = F.aggregate("_e", F.lit(b""), lambda acc, e: F.concat(acc, e["entry"]))
        trees = written(grouped.select(*scope, "path", content_id(F.lit(1), data).alias("id")), "trees")
        out = trees if out is None else out.unionByName(trees)
        if d > 1:
            here = rows.where(F.col("_depth") == d - 1).drop("_depth")
            above = here.unionByName(trees.select(*scope, "path", F.lit(3).alias("kind"), F.col("id").alias("oid")))
    return out if out is not None else files.limit(0).select(*scope, "path", F.col("oid").alias("id"))


#: Id of the tree without entries, a fixed value.
EMPTY_TREE = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"


def public_trees(decided: DataFrame, trees: DataFrame, scope: list[str], written) -> DataFrame:
    """(scope, path, id, encoded, error): the directories that are left without hidden paths, and their trees' ids.

    Only directories with a hidden path or an empty tree below them are encoded; all others keep the id that they have in
    trees, and their entries aren't looked at. Directories of which nothing is left go, but the top, which may be the
    empty tree. A visible embedded repository (kind 5) is an error: its scope has a row with its path and the error, one
    for each, and no ids.

    decided: (scope, path, kind, oid, hidden); trees: (scope, path, id) of all directories before, the top's path being
    empty. Repeated rows of either count once. Empty tables give an empty table.
    """
    decided = written(decided.select(*scope, "path", "kind", "oid", "hidden").distinct(), "decided")
    trees = trees.select(*scope, "path", "id").distinct()
    refused = decided.where("NOT hidden AND kind = 5").select(*scope, "path")
    bad = written(refused, "refused")
    if scope:
        decided, trees = (null_safe_join(d, bad.select(*scope).distinct(), scope, "left_anti") for d in (decided, trees))
    elif bad.limit(1).count():
        decided, trees = decided.limit(0), trees.limit(0)
    parent = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    lost = decided.where("hidden").select(*scope, "path").unionByName(trees.where((F.col("id") == EMPTY_TREE) & (F.col("path") != "")).select(*scope, "path"))
    # one row a directory before its ancestors are made
    touched = lost.select(*scope, parent.alias("path")).distinct()
    above = F.concat(F.array(F.lit("")), F.transform(F.filter(ancestors_of(F.col("path")), lambda a: a["path"] != ""), lambda a: a["path"]))
    changed = written(touched.select(*scope, F.explode(F.array_distinct(above)).alias("path")).distinct(), "changed")
    kept = written(null_safe_join(trees.where((F.col("id") != EMPTY_TREE) | (F.col("path") == "")), changed, [*scope, "path"], "left_anti"), "kept")
    files = decided.where("NOT hidden").select(*scope, "path", F.col("kind").cast("int").alias("kind"), "oid")
    entries = files.unionByName(kept.where("path <> ''").select(*scope, "path", F.lit(3).alias("kind"), F.col("id").alias("oid"))).withColumn("_name", F.col("path"))
    within = null_safe_join(entries.withColumn("path", parent), changed, [*scope, "path"], "left_semi")
    encoded = tree_ids(within.select(*scope, F.col("_name").alias("path"), "kind", "oid"), scope, written)
    bare = null_safe_join(changed.where("path = ''"), encoded.where("path = ''").select(*scope, "path"), [*scope, "path"], "left_anti")
    made = encoded.unionByName(bare.select(*scope, "path", F.lit(EMPTY_TREE).alias("id"))).withColumn("encoded", F.lit(True))
    out = made.unionByName(kept.withColumn("encoded", F.lit(False))).withColumn("error", F.lit(None).cast("string"))
    return out.unionByName(bad.select(*scope, "path", F.lit(None).cast("string").alias("id"), F.lit(False).alias("encoded"), F.lit("embedded_repository").alias("error")))
