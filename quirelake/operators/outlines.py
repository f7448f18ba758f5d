"""Outlines and destinations as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .trees import walk


def resolve_destinations(items: DataFrame, names: DataFrame, strings: DataFrame) -> DataFrame:
    """``items`` (kind, key, ...) with ``dest``: a name is looked up in ``names``, a string in ``strings`` (key, dest), anything else is null."""
    places = names.withColumn("kind", F.lit("name")).unionByName(strings.withColumn("kind", F.lit("string")))
    return items.join(places, ["kind", "key"], "left")


def for_pages(outlines: DataFrame, pages: DataFrame) -> DataFrame:
    """Outline items (doc, id, parent, ordinal, dest) by the page they lead to, level by level; ``page`` is null for those that lead nowhere."""
    rows = walk(outlines).select("doc", "id", "depth", "path").join(outlines.select("doc", "id", "dest"), ["doc", "id"])
    return rows.join(pages.select("doc", F.col("ref").alias("dest"), "page"), ["doc", "dest"], "left")
