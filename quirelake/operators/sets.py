"""Set operations on documents: merging, comparing, registering and naming."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut


def register(entries: DataFrame, keys: list[str], section: str, first_wins: bool = True) -> DataFrame:
    """One entry for each key: of the first section (chain of updates) or the last (reconstruction); ties by the other columns."""
    rest = [c for c in entries.columns if c not in keys]
    best = (F.min if first_wins else F.max)(F.struct(section, *[c for c in rest if c != section]))
    return entries.groupBy(*keys).agg(best.alias("_best")).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest])


def suppress_freed(entries: DataFrame, freed: DataFrame, key: str, section: str) -> DataFrame:
    """Without the entries of a number that an earlier section has freed."""
    first = freed.groupBy(key).agg(F.min(section).alias("_freed"))
    return entries.join(first, key, "left").where(F.col("_freed").isNull() | (F.col(section) <= F.col("_freed"))).drop("_freed")


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def compare(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows of only one side, repeats counted: side is ``actual`` or ``expected``. One grouped sum of +1 and -1."""
    both = actual.withColumn("_n", F.lit(1)).unionByName(expected.withColumn("_n", F.lit(-1)))
    left = both.groupBy(*actual.columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    left = left.withColumn("side", F.when(F.col("_n") > 0, "actual").otherwise("expected"))
    return left.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.abs("_n")))).drop("_n", "_k")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with equal keys; null equals null, and every row of ``new`` stays."""
    given = new.select(*[F.col(k).alias(f"_new_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in keys]
    return old.join(given, same, "left_anti").unionByName(new)


def delete(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` without those whose keys are in ``gone``."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def visible(entries: DataFrame, objects: DataFrame, ref: str, key: str) -> DataFrame:
    """Dictionary entries without those whose value resolves to null; a direct value (no reference) stays."""
    found = objects.where(F.col("value").isNotNull()).select(F.col(key).alias(ref))
    return entries.where(F.col(ref).isNull()).unionByName(entries.where(F.col(ref).isNotNull()).join(found, ref, "left_semi").select(entries.columns))


def _count_before(rows: DataFrame, keys: list[str], order: list[Column], counted: Column) -> DataFrame:
    """``rows`` with ``_before``: of the rows ahead in the group of ``keys``, how many are ``counted``.

    A group of any size is cut by ranges of its order; as ranges are sorted, at most one group goes on into each.
    """
    rows = rows.withColumn("_counted", counted.cast("long"))
    rows = cut(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    sums = rows.groupBy("_part", *keys).agg(F.sum("_counted").alias("_sum"))
    earlier = F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    carried = sums.select(F.col("_part").alias("_into"), *[F.col(k).alias(f"{k}_") for k in keys], earlier.alias("_carried")).where("_carried > 0")  # at most a row for each range
    here = F.sum("_counted").over(Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_here", here - F.col("_counted"))
    goes_on = [F.col("_part") == F.col("_into"), *[F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]]
    rows = rows.join(F.broadcast(carried), goes_on, "left").withColumn("_before", F.col("_here") + F.coalesce("_carried", F.lit(0)))
    return rows.drop("_counted", "_part", "_here", "_into", "_carried", *[f"{k}_" for k in keys])


def unique_names(names: DataFrame, doc: str, order: str, name: str) -> DataFrame:
    """``names`` with ``unique_name``: name, name+1, name+2 ... in order, each free of all names before it. A null order comes last, a null name stays null.

    A name is numbered by how often it stands before. Only a name that reads as another one's (n+2 beside n) depends on more:
    whichever comes first has it. It is a mark among the rows of the other name, where counting tells which comes first, and
    from the marks alone follows which numbers a name has to pass over. The different names of such a family in a document
    meet in one task, each once; rows never do.
    """
    keys, suffix = ["_doc", "_name"], r"\+([1-9][0-9]{0,17})\z"
    own = names.select("*", F.col(doc).alias("_doc"), F.col(name).alias("_name"), F.col(order).alias("_order"), F.lit(0).alias("_mark"))
    first = own.where(F.col("_name").rlike(suffix)).groupBy(*keys).agg(F.min("_order").alias("_order"))
    marks = first.select("_doc", F.regexp_replace("_name", suffix, "").alias("_name"), "_order", F.lit(1).alias("_mark"), F.col("_name").alias("_taken"), F.regexp_extract("_name", suffix, 1).try_cast("long").alias("_number"))
    bases = own.select(F.col("_doc").alias("_doc_"), F.col("_name").alias("_name_"))
    marks = marks.join(bases, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys], "left_semi")
    rows = _count_before(own.unionByName(marks, allowMissingColumns=True), keys, [F.col("_order").asc_nulls_last(), F.col("_mark").asc()], F.col("_mark") == 0)
    marks = rows.where("_mark = 1").select(*keys, "_taken", "_number", "_before")
    rows = rows.where("_mark = 0").drop("_taken", "_number").withColumnRenamed("_before", "_at")
    number = F.col("_at")
    if not marks.isEmpty():

        def passed_over(pdf: pd.DataFrame) -> pd.DataFrame:
            """From which occurrence on, counted from 0, a name's numbers are one more, once for each number passed over."""
            of: dict = {}
            for base, taken, k, before in zip(pdf["_name"], pdf["_taken"], pdf["_number"], pdf["_before"], strict=True):
                of.setdefault(base, []).append((k, before, taken))
            out, lost = [], set()
            for base in sorted(of, key=len):  # a name is longer than the one it reads as
                passed = int(base in lost)
                for k, before, taken in sorted(of[base]):
                    if before <= k - passed:
                        out.append((base, k - passed))
                        passed += 1
                    else:
                        out.append((taken, 0))
                        lost.add(taken)
            return pd.DataFrame({"_doc": [pdf["_doc"].iloc[0]] * len(out), "_name": [x for x, _ in out], "_at": [n for _, n in out]})

        kind = names.schema[doc].dataType.simpleString()
        family = marks.withColumn("_family", F.regexp_replace("_name", r"(\+[1-9][0-9]{0,17})+\z", ""))
        steps = family.groupBy("_doc", "_family").applyInPandas(passed_over, f"_doc {kind}, _name string, _at long").withColumn("_mark", F.lit(1))
        rows = _count_before(rows.unionByName(steps, allowMissingColumns=True), keys, [F.col("_at").asc(), F.col("_mark").desc()], F.col("_mark") == 1).where("_mark = 0")
        number = F.col("_at") + F.col("_before")
    unique = F.when(number == 0, F.col("_name")).otherwise(F.concat("_name", F.lit("+"), number.cast("string")))
    return rows.select(*names.columns, unique.alias("unique_name"))
