"""Content identifiers and the rules for identifiers, names, people and addresses, as column expressions."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType

# Object kinds and the names that their identifiers are computed with.
KINDS = {0: "blob", 1: "tree", 2: "commit"}
# The reverse hexadecimal digits of change identifiers and what they stand for.
REVERSED, DIGITS = "zyxwvutsrqponmlk", "0123456789abcdef"


def kind_name(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, name in KINDS.items():
        out = F.when(kind == k, F.lit(name)).otherwise(out)
    return out


def content_id(kind: Column, data: Column) -> Column:
    """SHA-1 in hex of the kind's name, a blank, the length, a zero byte, and the bytes; null for other kinds or null bytes."""
    head = F.concat(kind_name(kind), F.lit(" "), F.octet_length(data).cast("string"))
    return F.sha1(F.concat(head.cast("binary"), F.unhex(F.lit("00")), data))


@pandas_udf(BinaryType())
def digest64(data: pd.Series) -> pd.Series:
    """BLAKE2b of 64 bytes; null stays null."""
    return data.map(lambda b: None if b is None else hashlib.blake2b(b, digest_size=64).digest())


def change_id(text: Column) -> Column:
    """The 16 bytes of a change identifier of 32 reverse hexadecimal digits in either case, null for other texts."""
    low = F.lower(text)
    return F.when(low.rlike("^[k-z]{32}$"), F.unhex(F.translate(low, REVERSED, DIGITS)))


_PERSON = r"^([^<>\n]*?) ?<([^<>\n]*)> (-?[0-9]{1,18}) ([+-])([0-9]{2})([0-9]{2})$"


def signature(line: Column) -> Column:
    """struct(name, email, seconds, tz_minutes) of 'Name <email> seconds +hhmm', null if it isn't one."""
    part = lambda i: F.regexp_extract(line, _PERSON, i)
    minutes = part(5).try_cast("int") * 60 + part(6).try_cast("int")
    ok = line.rlike(_PERSON) & (part(6).try_cast("int") < 60)
    zone = F.when(part(4) == "-", -minutes).otherwise(minutes)
    return F.when(ok, F.struct(part(1).alias("name"), part(2).alias("email"), part(3).try_cast("long").alias("seconds"), zone.cast("int").alias("tz_minutes")))


def is_hex(text: Column, digits: int) -> Column:
    return F.coalesce(text.rlike(f"^[0-9a-f]{{{digits}}}$"), F.lit(False))


def is_bounded(text: Column, most: int) -> Column:
    """Not empty and at most so many bytes of UTF-8."""
    return F.coalesce((F.octet_length(text) > 0) & (F.octet_length(text) <= most), F.lit(False))


def is_repo_name(text: Column) -> Column:
    """A letter or digit, then letters, digits, dots, underscores and hyphens, 100 in all; not ending in a dot."""
    return F.coalesce(text.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,99}$") & ~text.endswith("."), F.lit(False))


def is_remote_name(text: Column) -> Column:
    """A name that is safe within a ref: no control characters, blanks or ~^:?*[\\, no '..', '@{' or '//', no dot or
    slash at either end of it and no '.lock' at its end."""
    bad = text.rlike(r"[\x00-\x20\x7f~^:?*\[\\]") | text.contains("..") | text.contains("@{") | text.contains("//")
    ends = text.startswith("/") | text.endswith("/") | text.startswith(".") | text.endswith(".") | text.endswith(".lock") | text.startswith("-")
    return F.coalesce((F.length(text) > 0) & ~bad & ~ends & (text != "@"), F.lit(False))


def is_branch_name(text: Column) -> Column:
    """A remote name whose parts between slashes don't begin with a dot or end in '.lock'."""
    return is_remote_name(text) & ~F.coalesce(text.contains("/.") | text.contains(".lock/"), F.lit(True))


def has_credentials(url: Column) -> Column:
    """Whether an address has user:password@ before its host."""
    return F.coalesce(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#@]*:[^/?#@]*@"), F.lit(False))


def redact_userinfo(url: Column) -> Column:
    return F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@]*@", "$1")


def repo_name_from_url(url: Column) -> Column:
    """The last part of an address' path without query, slashes at the end and '.git'; null if nothing is left."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"/+$", "")
    name = F.regexp_replace(F.regexp_extract(path, r"([^/:]*)$", 1), r"\.git$", "")
    return F.when(name != "", name)


def without_headers(headers: Column, names: list[str]) -> Column:
    """The headers (structs with a name) that aren't among names, in their order."""
    return F.filter(headers, lambda h: ~h["name"].isin(*names))


def with_headers(headers: Column, tree: Column, parents: Column, signatures: list[str]) -> Column:
    """The headers of a rewritten commit: the new tree, the new parents, then the others but old ones and signatures."""
    head = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    rest = F.transform(without_headers(headers, ["tree", "parent", *signatures]), lambda h: F.struct(h["name"].alias("name"), h["value"].alias("value")))
    return F.concat(F.array(head("tree", tree)), F.transform(parents, lambda p: head("parent", p)), rest)


# What the flag of a push report line says.
FLAGS = {" ": "updated", "+": "updated", "*": "updated", "-": "deleted", "=": "up-to-date"}


def push_status(lines, requested):
    """(ref, outcome) of requested refs by the lines (ref, flag, summary) of a push report; those without one are not reported."""
    found = lines.groupBy("ref").agg(F.first(push_outcome(F.col("flag"), F.col("summary"))).alias("outcome"))
    return requested.select("ref").join(found, "ref", "left").select("ref", F.coalesce("outcome", F.lit("not reported")).alias("outcome"))


def push_outcome(flag: Column, summary: Column) -> Column:
    out = F.when(summary.contains("stale info"), "lease-rejected").when(summary.contains("remote rejected"), "remote-rejected").otherwise("other")
    for f, name in FLAGS.items():
        out = F.when(flag == f, F.lit(name)).otherwise(out)
    return out
