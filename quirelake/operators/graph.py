"""References between objects: resolution, closure, users, garbage, renumbering.

Edges are rows (src, dst) of longs. ``closure`` advances a frontier; each round joins only
what the round before has found, and is written to the shared folder every few rounds.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset and the master is local, as in tests, a temporary folder is made and set;
    a cluster without a shared folder is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quirelake-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back, so that its lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/quirelake/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def resolve(edges: DataFrame, objects: DataFrame, ref: str, key: str) -> DataFrame:
    """Each edge with its object's columns; a dangling reference keeps nulls."""
    return edges.join(objects.withColumnRenamed(key, ref), ref, "left")


def dangling(edges: DataFrame, objects: DataFrame, ref: str, key: str) -> DataFrame:
    return edges.join(objects.select(F.col(key).alias(ref)), ref, "left_anti")


def closure(seeds: DataFrame, edges: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """(seed, node, depth) of every node that each seed reaches, itself at 0. Nodes in ``stop`` are reached but not left."""
    seen = cut(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).cast("long").alias("depth")))
    frontier, depth = seen, 0
    while True:
        depth += 1
        at = frontier if stop is None or depth == 1 else frontier.join(stop.select("node"), "node", "left_anti")
        found = at.join(edges, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        found = cut(found.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth).cast("long")))
        if found.isEmpty():
            return seen
        seen, frontier = seen.unionAll(found), found
        if depth % 5 == 0:
            seen = cut(seen)


def reachable(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes that any seed reaches, as one set. Frontiers are appended; only every fifth round rewrites what is seen."""
    one = cut(seeds.select(F.col("seed").alias("node")).distinct())
    frontier, depth = one, 0
    while True:
        depth += 1
        found = cut(frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(one, "node", "left_anti"))
        if found.isEmpty():
            return one
        one, frontier = one.unionAll(found), found
        if depth % 5 == 0:
            one = cut(one)


def follow(refs: DataFrame, links: DataFrame, most: int = 64) -> DataFrame:
    """(start, target, hops): where each ``start`` leads along links (src, dst), at most ``most`` of them; a cycle ends there too."""
    rows = cut(refs.select("start", F.col("start").alias("target"), F.lit(0).cast("long").alias("hops")))
    step = links.select(F.col("src").alias("target"), "dst")
    out = None
    for _ in range(most):
        rows = cut(rows.join(step, "target", "left"))
        ended = rows.where("dst is null").drop("dst")
        out = ended if out is None else out.unionByName(ended)
        rows = rows.where("dst is not null").select("start", F.col("dst").alias("target"), (F.col("hops") + 1).alias("hops"))
        if rows.isEmpty():
            return out
    return rows if out is None else out.unionByName(rows)


def users(reached: DataFrame) -> DataFrame:
    """How many seeds use each node, and the least and largest of them."""
    return reached.groupBy("node").agg(F.count(F.lit(1)).alias("n_users"), F.min("seed").alias("first_user"), F.max("seed").alias("last_user"))


def renumber(objects: DataFrame, doc: str, key: str) -> DataFrame:
    """Dense new numbers from 1 within a document, in order of the old ones."""
    return objects.withColumn("new_num", F.row_number().over(Window.partitionBy(doc).orderBy(key)).cast("long"))


def remap_first(refs: DataFrame, mapping: DataFrame, old: str, position: str, new: str) -> DataFrame:
    """Each reference with the new number of the first place its target went to, null if it was removed."""
    first = mapping.groupBy(old).agg(F.min_by(new, position).alias(new))
    return refs.join(first, old, "left")


def copy_objects(edges: DataFrame, chosen: DataFrame, numbers: int = 1000) -> DataFrame:
    """References within a copy of the nodes in ``chosen``: src, dst and their new numbers, dense from 1; null for what is not copied.

    Numbers are dealt by ranges of nodes: a range's first number is the count of all ranges below, of which there are at most ``numbers``.
    """
    new = number_densely(chosen.select("node").distinct(), "node", numbers)
    rows = edges.join(new.select(F.col("node").alias("src"), F.col("number").alias("new_src")), "src")
    return rows.join(new.select(F.col("node").alias("dst"), F.col("number").alias("new_dst")), "dst", "left").select("src", "dst", "new_src", "new_dst")


def number_densely(rows: DataFrame, key: str, ranges: int = 1000) -> DataFrame:
    """``rows`` with ``number``, 1, 2 ... in order of a numeric ``key``, without one window over the table."""
    cuts = rows.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 10 * ranges)).head()[0] or []
    cuts = F.lit(sorted(set(cuts))).cast("array<bigint>")
    rows = rows.withColumn("_range", F.size(F.filter(cuts, lambda c: c < F.col(key))))
    sizes = rows.groupBy("_range").count()
    before = sizes.withColumn("_before", F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)))  # at most ``ranges`` rows
    rows = rows.join(F.broadcast(before.select("_range", F.coalesce("_before", F.lit(0)).alias("_before"))), "_range")
    return rows.withColumn("number", F.row_number().over(Window.partitionBy("_range").orderBy(key)) + F.col("_before")).drop("_range", "_before")


def survivors(refs: DataFrame, kept: DataFrame, ref: str, new: str) -> DataFrame:
    """The rule for page references of structure elements, beads and annotations: remapped where the page stays, dropped (null) where it went."""
    return refs.join(kept.select(F.col("old").alias(ref), F.col("new").alias(new)), ref, "left")


def fold_members(users: DataFrame, containers: DataFrame) -> DataFrame:
    """(node, user) with members of an object stream (node, container) replaced by their container, once each."""
    return users.join(containers, "node", "left").select(F.coalesce("container", "node").alias("node"), "user").distinct()


def users_of_members(users: DataFrame, containers: DataFrame) -> DataFrame:
    """How many different users the members of each container have together, the least and the largest of them."""
    pairs = users.join(containers, "node").select("container", "user").distinct()
    return pairs.groupBy("container").agg(F.count(F.lit(1)).alias("n_users"), F.min("user").alias("first_user"), F.max("user").alias("last_user"))


def add_objects(objects: DataFrame, new: DataFrame, key: str, order: str, numbers: int = 1000) -> DataFrame:
    """``new`` with ``key``: the numbers after the largest one of ``objects``, dense, in the given order."""
    last = objects.agg(F.coalesce(F.max(key), F.lit(0))).head()[0]
    return number_densely(new, order, numbers).withColumn(key, F.col("number") + F.lit(last)).drop("number")


def compressible(objects: DataFrame) -> DataFrame:
    """Objects (num, gen, kind) that may go into an object stream: generation 0 where no later one exists, no streams, signatures or encryption dictionaries."""
    newest = objects.groupBy("num").agg(F.max("gen").alias("gen")).where("gen = 0")
    return objects.join(newest, ["num", "gen"], "left_semi").where(~F.coalesce(F.col("kind").isin("stream", "signature", "encrypt"), F.lit(False)))


def shares(refs: DataFrame, doc: str) -> DataFrame:
    """For each document whether one of its references (doc, ref) occurs more than once; a direct value has a null reference."""
    counts = refs.groupBy(doc, "ref").agg(F.count("ref").alias("n"))
    return counts.groupBy(doc).agg((F.max("n") > 1).alias("shared"))
