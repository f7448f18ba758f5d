"""Embedded files as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def listed(names: DataFrame, filespecs: DataFrame, streams: DataFrame) -> DataFrame:
    """Name-tree entries (doc, key, ref) with their file name, size and checksum; what does not resolve is null."""
    rows = names.join(filespecs.select("doc", "ref", "filename", "stream"), ["doc", "ref"], "left")
    return rows.join(streams.select("doc", "stream", F.octet_length("data").cast("long").alias("size"), F.md5("data").alias("checksum")), ["doc", "stream"], "left")


def copied(target: DataFrame, source: DataFrame, prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """``target`` with ``source``'s entries (doc, key, ref) under a prefix, and the keys that both have, which make the copy an error."""
    new = source.withColumn("key", F.concat(F.lit(prefix), "key"))
    return target.unionByName(new), target.select("doc", "key").intersect(new.select("doc", "key"))


def ascii_name(name: Column) -> Column:
    """A file name with every other character than printable ASCII replaced."""
    return F.regexp_replace(name, r"[^\x20-\x7e]", "_")
