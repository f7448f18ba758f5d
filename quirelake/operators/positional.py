"""Positional operators: ranges of pages, interleaving, chunks, splices and overlay pairs.

All work on rows with a document key and a 1-based position within it. Windows are
partitioned by the document or the job, never over the whole table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_entry = re.compile(r"(z|r?\d+)(?:-(z|r?\d+))?(?::(odd|even))?$")


@dataclass(frozen=True)
class RangeEntry:
    """``first`` to ``last`` (either may fall), a parity counted by position within the entry."""

    first: str
    last: str
    parity: str | None


def parse_range(text: str) -> list[RangeEntry]:
    """Entries of ``1-3,z,r2-1:odd``; the empty text is all pages."""
    out = []
    for part in (text or "1-z").split(","):
        m = _entry.match(part.strip())
        if not m:
            raise ValueError(f"not a page range: {part!r}")
        out.append(RangeEntry(m[1], m[2] or m[1], m[3]))
    return out


def _bound(token: str, count: Column) -> Column:
    if token == "z":
        return count
    return count - int(token[1:]) + 1 if token[0] == "r" else F.lit(int(token)).cast("long")


def resolve_range(counts: DataFrame, text: str, count: str = "n") -> DataFrame:
    """``counts`` exploded to one row for each selected page: out_pos (from 1), page. Pages out of range are an error."""
    n = F.col(count).cast("long")
    entries = []
    for e in parse_range(text):
        a, b = _bound(e.first, n), _bound(e.last, n)
        fits = (F.least(a, b) >= 1) & (F.greatest(a, b) <= n)
        checked = F.when(fits, a).otherwise(F.raise_error(F.concat(F.lit(f"page range {text} does not fit "), n.cast("string"))).cast("long"))
        pages = F.sequence(checked, b, F.when(a <= b, F.lit(1)).otherwise(F.lit(-1)).cast("long"))
        if e.parity:
            keep = 0 if e.parity == "odd" else 1
            pages = F.filter(pages, _at(keep))
        entries.append(pages)
    return counts.select("*", F.posexplode(F.concat(*entries)).alias("_pos", "page")).withColumn("out_pos", (F.col("_pos") + 1).cast("long")).drop("_pos")


def _at(keep: int):
    return lambda _, i: i % 2 == keep


def numbered(rows: DataFrame, doc: str, *order: str) -> DataFrame:
    """``rows`` with ``page``, their 1-based position in the document, and ``n``, its pages."""
    w = Window.partitionBy(doc)
    return rows.withColumn("page", F.row_number().over(w.orderBy(*order)).cast("long")).withColumn("n", F.count(F.lit(1)).over(w))


def select_pages(pages: DataFrame, doc: str, text: str) -> DataFrame:
    """The pages of each document that a range selects, with ``out_pos``. ``pages`` has page and n."""
    counts = pages.groupBy(doc).agg(F.max("n").alias("n"))
    return resolve_range(counts, text).drop("n").join(pages, [doc, "page"])


def collate(selected: DataFrame, job: str, source: str, n: int, position: str = "out_pos") -> DataFrame:
    """Round-robin: ``n`` pages from each source of a job in turn, exhausted sources skipped; adds ``collated``."""
    if n < 1:
        raise ValueError("collate needs at least one page")
    w = Window.partitionBy(job).orderBy(F.floor((F.col(position) - 1) / n), source, position)
    return selected.withColumn("collated", F.row_number().over(w).cast("long"))


def combine(selected: DataFrame, job: str, source: str, position: str = "out_pos") -> DataFrame:
    """Selections of a job's sources one after another; adds ``combined``."""
    return selected.withColumn("combined", F.row_number().over(Window.partitionBy(job).orderBy(source, position)).cast("long"))


def split_chunks(counts: DataFrame, size: int, stem: Column, extension: str = ".pdf", count: str = "n") -> DataFrame:
    """One row for each chunk of ``size`` pages: chunk, first, last, name. Numbers are padded to the digits of the page count."""
    n = F.col(count).cast("long")
    rows = counts.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / size))))
    rows = rows.withColumn("first", F.col("chunk") * size + 1).withColumn("last", F.least(n, (F.col("chunk") + 1) * size))
    width = F.length(n.cast("string"))
    shown = [F.lpad(F.col(c).cast("string"), width, F.lit("0")) for c in ("first", "last")]
    return rows.withColumn("name", F.concat(stem, F.lit("-"), *([shown[0]] if size == 1 else [shown[0], F.lit("-"), shown[1]]), F.lit(extension)))


def even_split(rows: DataFrame, doc: str, *order: str, limit: int = 100) -> DataFrame:
    """Groups of equal size, ceil(n / limit) of them in a document; adds ``stream`` and ``index``."""
    w = Window.partitionBy(doc)
    n = F.count(F.lit(1)).over(w)
    size = F.ceil(n / F.ceil(n / limit))
    rows = rows.withColumn("_r", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_size", size)
    return rows.withColumn("stream", F.floor(F.col("_r") / F.col("_size")).cast("long")).withColumn("index", (F.col("_r") % F.col("_size")).cast("long")).drop("_r", "_size")


def splice(pages: DataFrame, doc: str, start: int, stop: int, inserted: DataFrame) -> DataFrame:
    """Pages ``start`` to ``stop`` (1-based, end excluded) replaced by ``inserted`` (doc, page, ...); adds ``out_pos``."""
    kept = pages.where((F.col("page") < start) | (F.col("page") >= stop))
    rows = kept.withColumn("_k", F.when(F.col("page") < start, 0).otherwise(2)).unionByName(inserted.withColumn("_k", F.lit(1)))
    return rows.withColumn("out_pos", F.row_number().over(Window.partitionBy(doc).orderBy("_k", "page")).cast("long")).drop("_k")


def overlay_pairs(targets: DataFrame, sources: DataFrame, doc: str, from_pages: int) -> DataFrame:
    """The i-th target page with the i-th source page up to ``from_pages``, then the other source pages in a cycle.

    Without pages to repeat, targets beyond stay unpaired and are left out.
    """
    counts = sources.groupBy(doc).agg(F.max("page").alias("_n"))
    rows = targets.join(counts, doc)
    last = F.least(F.lit(from_pages).cast("long"), F.col("_n"))
    again = F.col("_n") - last
    page = F.when(F.col("page") <= last, F.col("page")).when(again > 0, last + 1 + (F.col("page") - last - 1) % F.greatest(again, F.lit(1)))
    rows = rows.withColumn("_from", page).where("_from is not null").drop("_n")
    return rows.join(sources.select(doc, F.col("page").alias("_from"), *[F.col(c).alias(f"from_{c}") for c in sources.columns if c not in (doc, "page")]), [doc, "_from"]).withColumnRenamed("_from", "from_page")


def order_overlays(entries: DataFrame, page: str, kind: str, order: str) -> DataFrame:
    """Sources laid on each page with their ``place`` from 1: underlays first, then in the order given."""
    w = Window.partitionBy(page).orderBy(F.when(F.col(kind) == "underlay", 0).otherwise(1), order)
    return entries.withColumn("place", F.row_number().over(w).cast("long"))


def rotate_pages(pages: DataFrame, doc: str, text: str, rotated: Column) -> DataFrame:
    """``pages`` with ``rotate`` replaced by ``rotated`` where a range selects the page."""
    chosen = select_pages(pages.select(doc, "page", "n"), doc, text).select(doc, "page").distinct().withColumn("_chosen", F.lit(True))
    rows = pages.join(chosen, [doc, "page"], "left")
    return rows.withColumn("rotate", F.when(F.col("_chosen"), rotated).otherwise(F.col("rotate"))).drop("_chosen")


def duplicate_pages(pages: DataFrame, doc: str, times: Column) -> DataFrame:
    """Each page ``times`` times, one after the other, with ``copy`` from 0 and ``out_pos`` in the document; not at all for 0."""
    rows = pages.withColumn("copy", F.explode(F.when(times > 0, F.sequence(F.lit(0).cast("long"), (times - 1).cast("long"))).otherwise(F.array().cast("array<bigint>"))))
    return rows.withColumn("out_pos", F.row_number().over(Window.partitionBy(doc).orderBy("page", "copy")).cast("long"))


def remove_pages(pages: DataFrame, doc: str, text: str) -> DataFrame:
    """The pages that a range does not select, with ``out_pos`` counted anew in the document."""
    left = pages.join(select_pages(pages.select(doc, "page", "n"), doc, text).select(doc, "page").distinct(), [doc, "page"], "left_anti")
    return left.withColumn("out_pos", F.row_number().over(Window.partitionBy(doc).orderBy("page")).cast("long"))
