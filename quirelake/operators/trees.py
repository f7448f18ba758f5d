"""Trees by parent links: paths, preorder and level order, inheritance, dotted names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut


def walk(nodes: DataFrame, carried: str | None = None, named: str | None = None) -> DataFrame:
    """Nodes (doc, id, parent, ordinal, ...) with depth, path and order; roots have no parent.

    carried: a column whose nearest value upwards is returned as ``inherited``.
    named: a column whose values from the root down are joined by dots as ``full_name``.
    A node that no root leads to, as in a cycle, has no row; a node is not entered again below itself.
    """
    own = F.col(carried) if carried else F.lit(None).cast("string")
    name = F.col(named) if named else F.lit(None).cast("string")
    rows = nodes.select("doc", "id", "parent", "ordinal", own.alias("own"), name.alias("name"))
    level = cut(rows.where("parent is null").select("doc", "id", "parent", F.lit(0).cast("long").alias("depth"), F.array(F.col("ordinal").cast("long")).alias("path"), F.col("own").alias("inherited"), F.coalesce("name", F.lit("")).alias("full_name"), F.array("id").alias("above")))
    out, depth = level, 0
    while not level.isEmpty():
        depth += 1
        above = level.select("doc", F.col("id").alias("parent"), "path", "inherited", "full_name", "above")
        full = F.when(F.col("name").isNull(), F.col("full_name")).when(F.col("full_name") == "", F.col("name")).otherwise(F.concat_ws(".", "full_name", "name"))
        level = cut(rows.join(above, ["doc", "parent"]).where(~F.array_contains("above", F.col("id"))).select("doc", "id", "parent", F.lit(depth).cast("long").alias("depth"), F.concat("path", F.array(F.col("ordinal").cast("long"))).alias("path"), F.coalesce("own", "inherited").alias("inherited"), full.alias("full_name"), F.concat("above", F.array("id")).alias("above")))
        out = out.unionAll(level)
    return out.drop("above")
