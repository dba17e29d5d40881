"""Digests and their text form, wire rows, and entry serialisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGEST_BYTES = 32
#: First words of the version messages; callers may pass a prefix of their own.
GREETING, OFFER, CHOICE, ACCEPTED = "INVENTORY:", "CAPS:", "USE:", "READY"
VERSIONS = (3,)


def digest(content: Column) -> Column:
    """A 32-byte digest; SHA-256, the widest built-in of that size."""
    return F.unhex(F.sha2(content, 256))


def hex_digest(content: Column) -> Column:
    """The digest as the chunker writes it."""
    return F.sha2(content, 256)


def to_base64url(binary: Column) -> Column:
    """URL-safe base64 with padding."""
    return F.translate(F.base64(binary), "+/\r\n", "-_")


def from_base64url(text: Column, size: int = DIGEST_BYTES) -> Column:
    """The bytes, or null unless the text is base64 of ``size`` bytes."""
    ok = text.rlike(r"^[A-Za-z0-9_-]*={0,2}$") & (F.length(text) % 4 == 0)
    out = F.when(ok, F.unbase64(F.translate(text, "-_", "+/")))
    return F.when(F.octet_length(out) == size, out)


def parse_versions(message: Column, prefix: str) -> Column:
    """array<int> after a prefix, null if the message is malformed."""
    items = F.transform(F.split(F.substr(message, F.lit(len(prefix) + 1)), ","), lambda v: F.trim(v).try_cast("int"))
    return F.when(message.startswith(prefix) & ~F.exists(items, lambda v: v.isNull() | (v < 0)), items)


def format_versions(versions: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.array_join(F.transform(versions, lambda v: v.cast("string")), ","))


def parse_ready(message: Column) -> Column:
    """struct(ok, version) of READY or READY:n."""
    version = F.when(message.startswith(ACCEPTED + ":"), F.trim(F.substr(message, F.lit(len(ACCEPTED) + 2))).try_cast("int"))
    return F.struct(((message == ACCEPTED) | version.isNotNull()).alias("ok"), version.alias("version"))


def is_version_supported(version: Column) -> Column:
    return F.array_contains(F.array(*map(F.lit, VERSIONS)), version)


#: Fields after the type letter, by kind of line (fixed values of the colon format).
LINE_FIELDS = {"F": 8, "D": 7, "L": 8, "C": 4}


def parse_line(line: Column) -> Column:
    """A colon row as a struct with ``error``; more fields than needed are ignored."""
    f = F.split(F.trim(line), ":")
    kind = F.get(f, F.lit(0))
    need = F.coalesce(*(F.when(kind == k, F.lit(n)) for k, n in LINE_FIELDS.items()))
    number = lambda i: F.get(f, F.lit(i)).try_cast("long")
    entry, chunk = kind.isin("F", "D", "L"), kind == "C"
    target = F.when(kind == "L", F.nullif(F.get(f, F.lit(7)), F.lit("")))
    size = F.when(kind == "F", number(7)).when(entry, F.lit(0).cast("long")).when(chunk, number(2))
    bad_entry = entry & (number(2).isNull() | number(3).isNull() | number(4).isNull() | number(5).isNull() | number(6).isNull() | size.isNull())
    bad_chunk = chunk & (number(1).isNull() | number(2).isNull())
    error = F.when(need.isNull(), "unknown type").when(F.size(f) < need, "too few fields").when(bad_entry | bad_chunk, "invalid number")
    ok = error.isNull()
    return F.struct(
        error.alias("error"), F.when(ok, kind).alias("tp"),
        F.when(ok & entry, F.get(f, F.lit(1))).alias("path"),
        *(F.when(ok & entry, number(i)).alias(n) for i, n in ((2, "mode"), (3, "uid"), (4, "gid"), (5, "ctime"), (6, "mtime"))),
        F.when(ok, size).alias("size"), F.when(ok, target).alias("target"),
        F.when(ok & chunk, number(1)).alias("offset"), F.when(ok & chunk, F.get(f, F.lit(3))).alias("hash"),
    )


def entry_json(tp="tp", path="path", mode="mode", uid="uid", gid="gid", ctime="ctime", mtime="mtime", size="size", target="target") -> Column:
    """An inventory row as one listing line; symlinks are spelt S there."""
    return F.to_json(F.struct(
        F.when(F.col(tp) == "L", "S").otherwise(F.col(tp)).alias("typ"), F.col(path).alias("pth"), F.col(mode).alias("mod"), F.col(uid).alias("uid"), F.col(gid).alias("gid"),
        F.col(ctime).alias("ct"), F.col(mtime).alias("mt"), F.col(size).alias("sz"), F.col(target).alias("tgt"),
    ))


def chunk_json(hash_: Column, offset: Column, size: Column) -> Column:
    return F.to_json(F.struct(F.lit("C").alias("typ"), offset.alias("off"), size.alias("len"), hash_.alias("hsh")))


def state_json() -> Column:
    """An inventory row in the snapshot's short keys."""
    chunks = F.transform("chunks", lambda c: F.struct(c["hash"].alias("h"), c["offset"].alias("of"), c["size"].alias("sz")))
    return F.to_json(F.struct(*(F.col(c).alias(k) for c, k in (("tp", "tp"), ("path", "p"), ("mode", "md"), ("uid", "usr"), ("gid", "grp"), ("ctime", "ct"), ("mtime", "mt"), ("size", "sz"))), chunks.alias("ch"), F.col("target").alias("tgt")))


def log_line(level: Column, message: Column) -> Column:
    """A log record as its listing line."""
    mark = F.when(level == "error", "!").otherwise("#")
    letter = F.upper(F.left(level, F.lit(1)))
    return F.concat(mark, letter, F.lit(":"), message)


def commit_response(renamed: Column, failed: Column) -> Column:
    return F.concat(F.lit("OK:"), renamed.cast("string"), F.lit(":"), failed.cast("string"))


def parse_commit_response(message: Column) -> Column:
    """struct(ok, renamed, failed); a commit with failures is not ok."""
    number = lambda i: F.regexp_extract(message, r"^OK(?::(\d+):(\d+))?$", i).try_cast("long")
    failed = F.coalesce(number(2), F.lit(0).cast("long"))
    return F.struct((message.startswith("OK") & (failed == 0)).alias("ok"), number(1).alias("renamed"), failed.alias("failed"))
