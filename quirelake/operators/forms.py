"""Form fields, widgets and annotations as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions.scalars import transform_rectangle

from .trees import walk

BOX = ("llx", "lly", "urx", "ury")

#: Field flags (bit 15, 16 and 17, from 0).
RADIO, PUSH_BUTTON, COMBO = 1 << 15, 1 << 16, 1 << 17


def kind(field_type: Column, flags: Column) -> Column:
    """text, checkbox, radio, pushbutton, combo, list or signature, by type and flags; null for another type."""
    has = lambda bit: flags.bitwiseAND(F.lit(bit)) != 0
    button = F.when(has(PUSH_BUTTON), "pushbutton").when(has(RADIO), "radio").otherwise("checkbox")
    return F.when(field_type == "Tx", "text").when(field_type == "Btn", button).when(field_type == "Ch", F.when(has(COMBO), "combo").otherwise("list")).when(field_type == "Sig", "signature")


def field_infos(fields: DataFrame) -> DataFrame:
    """Fields (doc, id, parent, ordinal, ft, name, flags, value) with the type inherited from above, the dotted full name and their kind."""
    found = walk(fields, carried="ft", named="name").select("doc", "id", F.col("inherited").alias("ft"), "full_name")
    rows = fields.select("doc", "id", "flags", "value").join(found, ["doc", "id"])
    return rows.withColumn("kind", kind(F.col("ft"), F.coalesce("flags", F.lit(0))))


def widgets_of(widgets: DataFrame, infos: DataFrame) -> DataFrame:
    """Each widget (doc, widget, page, field) with its field; a widget of no field keeps nulls."""
    return widgets.join(infos.withColumnRenamed("id", "field"), ["doc", "field"], "left")


def by_name(infos: DataFrame) -> DataFrame:
    """How many fields have a full name, and the first and last of them."""
    return infos.groupBy("doc", "full_name").agg(F.count(F.lit(1)).alias("n_fields"), F.min("id").alias("first_field"), F.max("id").alias("last_field"))


def prune(fields: DataFrame, widgets: DataFrame, pages: DataFrame) -> DataFrame:
    """Fields that keep a widget on one of ``pages`` (doc, page)."""
    live = widgets.join(pages, ["doc", "page"], "left_semi").select("doc", F.col("field").alias("id")).distinct()
    return fields.join(live, ["doc", "id"], "left_semi")


def signatures(infos: DataFrame) -> DataFrame:
    """Signature fields that hold a value."""
    return infos.where((F.col("kind") == "signature") & F.col("value").isNotNull())


def annotations(rows: DataFrame, subtype: str | None = None) -> DataFrame:
    """Annotations (doc, page, annotation, subtype), of one subtype if it is given."""
    return rows if subtype is None else rows.where(F.col("subtype") == subtype)


def strip_signatures(infos: DataFrame) -> DataFrame:
    """Fields with the values of signatures taken away."""
    return infos.withColumn("value", F.when(F.coalesce(F.col("kind") != "signature", F.lit(True)), F.col("value")))


def rename(fields: DataFrame, names: DataFrame) -> DataFrame:
    """Fields with the partial names of ``names`` (doc, id, new_name) in place of their own; a null new name takes the name away."""
    rows = fields.join(names.withColumn("_new", F.lit(True)), ["doc", "id"], "left")
    return rows.withColumn("name", F.when(F.col("_new"), F.col("new_name")).otherwise(F.col("name"))).drop("_new", "new_name")


def text_width(texts: DataFrame, widths: DataFrame, keys: list[str], text: str, size: str) -> DataFrame:
    """Width of each text in a font: the sum of its glyphs' widths (code, width in thousandths) times the size.

    Codes are bytes of the text. There are at most 256 widths, so they are broadcast; a code without one has none.
    """
    codes = F.transform(F.filter(F.split(F.regexp_replace(F.hex(F.col(text).cast("binary")), "(..)", "$1,"), ","), lambda c: c != ""), lambda c: F.conv(c, 16, 10).cast("int"))
    rows = texts.select(*keys, size, F.explode_outer(codes).alias("code"))
    few = F.broadcast(widths.select("code", "width").where("code between 0 and 255").groupBy("code").agg(F.max("width").alias("width")))
    return rows.join(few, "code", "left").groupBy(*keys, size).agg(F.coalesce(F.sum("width"), F.lit(0)).alias("_w")).select(*keys, (F.col("_w") * F.col(size) / 1000).alias("width"))


def copy_annotations(annotations: DataFrame, pairs: DataFrame, matrix: list[Column]) -> DataFrame:
    """Annotations (page, annotation, llx, lly, urx, ury) of each from_page in ``pairs`` on its to_page, their rectangles mapped."""
    rows = annotations.join(pairs, F.col("page") == F.col("from_page"))
    box = transform_rectangle(matrix, *[F.col(c) for c in BOX])
    return rows.select(F.col("to_page").alias("page"), "annotation", *[c.alias(n) for c, n in zip(box, BOX)])
