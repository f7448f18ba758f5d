"""Page labels and number trees: at-or-below lookup, rendering, merging of ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))
LARGEST = 100_000


def at_or_below(probes: DataFrame, keys: DataFrame, by: str, on: str, value: str) -> DataFrame:
    """Each probe with ``found_key`` and ``found_value`` of the largest key at or below it; null if there is none.

    One shuffle by ``by``; the two sides are merged by a sort, not joined by range.
    """
    side = probes.withColumn("_probe", F.lit(1))
    rows = side.unionByName(keys.select(by, on, F.struct(F.col(on).alias("k"), F.col(value).alias("v")).alias("_key")).withColumn("_probe", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(on, "_probe").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_key", F.last("_key", ignorenulls=True).over(w)).where("_probe = 1")
    return rows.select(*probes.columns, F.col("_key.k").alias("found_key"), F.col("_key.v").alias("found_value"))


def _within(number: Column, largest: int | None) -> Column:
    return number >= 1 if largest is None else number.between(1, largest)


def to_alpha(number: Column, largest: int | None = LARGEST) -> Column:
    """a .. z, aa .. zz, aaa: one letter repeated; empty below 1 and above ``largest`` (None: no limit), null for null."""
    i = number.cast("long") - 1
    text = F.repeat(F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), F.pmod(i, F.lit(26)).cast("int") + 1, F.lit(1)), F.floor(i / 26).cast("int") + 1)
    return F.when(_within(number, largest), text).when(number.isNotNull(), "")


def to_roman(number: Column, largest: int | None = LARGEST) -> Column:
    """Lower-case Roman numeral, thousands all as m; empty below 1 and above ``largest`` (None: no limit), null for null."""
    pieces, rest = [], number.cast("long")
    for n, sign in _ROMAN:
        pieces.append(F.repeat(F.lit(sign), F.floor(rest / n).cast("int")))
        rest = rest % n
    return F.when(_within(number, largest), F.concat(*pieces)).when(number.isNotNull(), "")


def render(style: Column, prefix: Column, number: Column, largest: int | None = LARGEST) -> Column:
    """Label text: D decimal, r and R Roman, a and A letters, no style no number. ``largest``: as in ``to_alpha``."""
    text = F.when(style == "D", number.cast("string")).when(style == "r", to_roman(number, largest)).when(style == "R", F.upper(to_roman(number, largest))).when(style == "a", to_alpha(number, largest)).when(style == "A", F.upper(to_alpha(number, largest))).otherwise("")
    return F.concat(F.coalesce(prefix, F.lit("")), text)


def merge_adjacent(ranges: DataFrame, doc: str) -> DataFrame:
    """Label ranges (start_idx, style, prefix, start) without those that go on from the one before.

    A null prefix differs from an empty one.
    """
    w = Window.partitionBy(doc).orderBy("start_idx")
    before = {c: F.lag(c).over(w) for c in ("start_idx", "style", "prefix", "start")}
    goes_on = before["style"].eqNullSafe(F.col("style")) & before["prefix"].eqNullSafe(F.col("prefix")) & (F.col("start") - before["start"] == F.col("start_idx") - before["start_idx"])
    return ranges.withColumn("_on", F.coalesce(goes_on, F.lit(False))).where("not _on").drop("_on")


def effective(pages: DataFrame, ranges: DataFrame, doc: str, largest: int | None = LARGEST) -> DataFrame:
    """Each page (doc, page from 0) with ``label``: of the range at or below it, else its number from 1. ``largest``: as in ``to_alpha``."""
    keys = ranges.select(doc, F.col("start_idx").alias("page"), F.struct("start_idx", "style", "prefix", "start").alias("range"))
    rows = at_or_below(pages, keys, doc, "page", "range")
    r = F.col("found_value")
    text = F.when(r.isNull(), (F.col("page") + 1).cast("string")).otherwise(render(r["style"], r["prefix"], F.coalesce(r["start"], F.lit(1)) + F.col("page") - r["start_idx"], largest))
    return rows.withColumn("label", text).drop("found_key", "found_value")


def for_span(spans: DataFrame, ranges: DataFrame, doc: str) -> DataFrame:
    """Label ranges of a span (doc, first, last, new_first) of pages: moved to ``new_first``, the first one as it stands at the span's start.

    A span in no range starts with decimal numbers of the pages.
    """
    opening = at_or_below(spans.withColumn("page", F.col("first")), ranges.select(doc, F.col("start_idx").alias("page"), F.struct("start_idx", "style", "prefix", "start").alias("range")), doc, "page", "range")
    r = F.col("found_value")
    head = opening.select(doc, F.col("new_first").alias("start_idx"), F.when(r.isNull(), "D").otherwise(r["style"]).alias("style"), r["prefix"].alias("prefix"), F.when(r.isNull(), F.col("first") + 1).otherwise(r["start"] + F.col("first") - r["start_idx"]).alias("start"))
    inner = ranges.join(spans, doc).where((F.col("start_idx") > F.col("first")) & (F.col("start_idx") <= F.col("last")))
    return head.unionByName(inner.select(doc, (F.col("start_idx") - F.col("first") + F.col("new_first")).alias("start_idx"), "style", "prefix", "start"))


def neighbours(keys: DataFrame, by: str, on: str) -> DataFrame:
    """Keys of a tree with the one before and after each, null at the ends."""
    w = Window.partitionBy(by).orderBy(on)
    return keys.withColumn("previous", F.lag(on).over(w)).withColumn("next", F.lead(on).over(w))


def key_bounds(keys: DataFrame, by: str, on: str) -> DataFrame:
    """Number of keys, the smallest and the largest of each tree."""
    return keys.groupBy(by).agg(F.count(F.lit(1)).alias("n_keys"), F.min(on).alias("smallest"), F.max(on).alias("largest"))


def find(probes: DataFrame, keys: DataFrame, by: str, on: str, value: str) -> DataFrame:
    """Each probe with ``found_value`` of the key equal to it, null if there is none; of equal keys the least value."""
    return probes.join(keys.groupBy(by, on).agg(F.min(value).alias("found_value")), [by, on], "left")
