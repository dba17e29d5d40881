"""Snapshots of the reconciled state, and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..schemas import PREV_STATE, TYPE_ALIASES

SUFFIX = ".profile.json"
_CHUNK = "array<struct<h:string,of:long,sz:long>>"
ENTRY = f"struct<tp:string,p:string,md:long,usr:long,grp:long,ct:long,mt:long,sz:long,ch:{_CHUNK},tgt:string>"


def load(spark: SparkSession, path: str) -> DataFrame:
    """The saved state; an absent one is empty, a corrupt one an error."""
    if not storage.exists(spark, path):
        return spark.createDataFrame([], PREV_STATE)
    return spark.read.schema(PREV_STATE).parquet(path)


def save(state: DataFrame, path: str) -> None:
    """Write aside, then swap: a failed write leaves the old state."""
    spark = state.sparkSession
    new, old = f"{path}.new", f"{path}.old"
    storage.delete(spark, new)
    state.select(*PREV_STATE.fieldNames()).write.parquet(new)
    storage.delete(spark, old)
    if storage.exists(spark, path):
        storage.rename(spark, path, old)
    if not storage.rename(spark, new, path):
        raise OSError(f"could not move {new} to {path}")
    storage.delete(spark, old)


def clear(spark: SparkSession, path: str) -> bool:
    return storage.delete(spark, path)


#: A string or a comment of JSON5, or a comma before a closing bracket.
_TOKENS = r"""("(?:[^"\\]|\\.)*")|('(?:[^'\\]|\\.)*')|//[^\n]*|/\*(?s:.*?)\*/|,(?=(?:\s|//[^\n]*|/\*(?s:.*?)\*/)*[}\]])"""
_JSON5 = {"allowComments": "true", "allowUnquotedFieldNames": "true", "allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true", "allowNumericLeadingZeros": "true"}


def json5(text: Column) -> Column:
    """JSON5 as what Spark's parser takes with ``_JSON5``: no comments, no commas before closing brackets."""
    return F.regexp_replace(text, _TOKENS, "$1$2")


def from_json_text(rows: DataFrame) -> DataFrame:
    """Entries of JSON or JSON5 states (value): a map path -> entry, or {files, timestamp} around it."""
    text = json5(F.col("value"))
    wrapped = F.from_json(text, f"struct<files:map<string,{ENTRY}>,timestamp:long>", _JSON5)
    flat = F.from_json(text, f"map<string,{ENTRY}>", _JSON5)
    files = F.coalesce(wrapped["files"], flat)
    e = rows.select(F.explode(files).alias("key", "e"))
    aliases = F.create_map(*(F.lit(x) for kv in TYPE_ALIASES.items() for x in kv))
    return e.select(
        F.coalesce("e.p", "key").alias("path"), F.try_element_at(aliases, F.col("e.tp")).alias("tp"), F.col("e.md").alias("mode"), F.col("e.usr").alias("uid"), F.col("e.grp").alias("gid"),
        F.col("e.ct").alias("ctime"), F.col("e.mt").alias("mtime"), F.col("e.sz").alias("size"), F.transform("e.ch", lambda c: F.struct(c["h"].alias("hash"), c["of"].alias("offset"), c["sz"].alias("size"))).alias("chunks"), F.col("e.tgt").alias("target"),
    )


def profiles(names: DataFrame) -> DataFrame:
    """Sorted profile names of file names (name)."""
    return names.filter(F.col("name").endswith(SUFFIX)).select(F.left("name", F.length("name") - len(SUFFIX)).alias("profile")).orderBy("profile")


def list_profiles(spark: SparkSession, folder: str) -> DataFrame:
    return profiles(spark.createDataFrame([(n,) for n in storage.names(spark, folder)], "name string"))
