"""PDF files as tables: one narrow parse of each file, then DataFrame operators.

``read_pdf`` loads files with Spark's binaryFile source and parses each in the task that
holds it; a file is one row, so ``max_bytes`` bounds what a task takes in (larger files are
reported, not parsed). All sections are DataFrames over objects and edges.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelake.functions.codecs import decoded
from quirelake.operators import trees
from quirelake.operators.graph import cut

from . import syntax

MAX_BYTES = 256 << 20
ROW = "doc string, version string, trailer string, kind string, num long, gen int, type string, value string, stream binary, filters array<string>, parms string, offset long, edges array<struct<path:string,num:long,gen:int>>, entry struct<kind:string,offset:long,stream:long,index:int,section:int>, severity string, message string"


def _rows(path: str, data: bytes | None, repair: bool):
    none = dict.fromkeys(("kind", "num", "gen", "type", "value", "stream", "filters", "parms", "offset", "edges", "entry", "severity", "message", "version", "trailer"))
    if data is None:
        yield none | {"doc": path, "kind": "diagnostic", "severity": "error", "message": "the file is too large", "offset": 0}
        return
    try:
        doc = syntax.load(data, repair)
    except Exception as e:  # a damaged file is a row of diagnostics, not a failed job
        yield none | {"doc": path, "kind": "diagnostic", "severity": "error", "message": str(e), "offset": 0}
        return
    yield none | {"doc": path, "kind": "document", "version": doc.version, "trailer": json.dumps(syntax.as_json(doc.trailer)), "edges": [(p, r.num, r.gen) for p, r in syntax.references(doc.trailer)]}
    for (num, gen), s in doc.objects.items():
        named = s.value.get("Type") if isinstance(s.value, dict) else None
        filters, parms = syntax.filters_of(s.value) if s.stream is not None else ([], [])
        kind = "stream" if s.stream is not None else {dict: "dictionary", list: "array", bytes: "string", bool: "boolean", int: "integer", type(None): "null"}.get(type(s.value), type(s.value).__name__.lower())
        e = doc.entries.get((num, gen))
        yield none | {
            "doc": path, "kind": "object", "num": num, "gen": gen, "type": str(named) if named else kind, "value": json.dumps(syntax.as_json(s.value)), "stream": s.stream,
            "filters": filters, "parms": json.dumps(syntax.as_json(parms)), "offset": s.offset, "edges": [(p, r.num, r.gen) for p, r in syntax.references(s.value)],
            "entry": (e.kind, e.offset, e.stream, e.index, e.section) if e else None,
        }
    for severity, message, offset in doc.diagnostics:
        yield none | {"doc": path, "kind": "diagnostic", "severity": severity, "message": message, "offset": offset}


def parse(files: DataFrame, path: str = "path", content: str = "content", repair: bool = True) -> DataFrame:
    """Rows of all tables from a column of bytes, one narrow pass. See ``Pdf`` for the tables."""

    def run(batches):
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                rows = list(_rows(name, None if data is None else bytes(data), repair))
                for at in range(0, len(rows), 2000):
                    yield pd.DataFrame(rows[at : at + 2000], columns=[c.strip().split(" ")[0] for c in _columns()])

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInPandas(run, ROW)


def _columns() -> list[str]:
    return ["doc", "version", "trailer", "kind", "num", "gen", "type", "value", "stream", "filters", "parms", "offset", "edges", "entry", "severity", "message"]


class Pdf:
    """Tables over parsed rows. They are written once to the shared folder, as each table reads them."""

    def __init__(self, rows: DataFrame):
        self.rows = cut(rows)
        own = self.rows.where("kind = 'object'")
        self.documents = self.rows.where("kind = 'document'").select("doc", "version", "trailer")
        self.diagnostics = self.rows.where("kind = 'diagnostic'").select("doc", "severity", "message", "offset")
        self.objects = own.select("doc", "num", "gen", "type", "value", "stream", "filters", "parms", "offset")
        self.xref_entries = own.where("entry is not null").select("doc", "num", "gen", "entry.*")
        self.edges = own.select("doc", F.col("num").alias("src_num"), F.col("gen").alias("src_gen"), F.explode("edges").alias("e")).select("doc", "src_num", "src_gen", F.col("e.path").alias("via"), F.col("e.num").alias("dst_num"), F.col("e.gen").alias("dst_gen"))
        self.trailer_edges = self.rows.where("kind = 'document'").select("doc", F.explode("edges").alias("e")).select("doc", F.col("e.path").alias("via"), F.col("e.num").alias("dst_num"), F.col("e.gen").alias("dst_gen"))

    def value(self, path: str, kind: str):
        """A typed value within an object, null where it is missing or of another type."""
        return F.try_variant_get(F.parse_json("value"), path, kind)

    def page_tree(self) -> DataFrame:
        """(doc, id, depth, path) of the nodes of each document's page tree; a cycle is not entered again."""
        kids = self.edges.where("via rlike '^/Kids/[0-9]+$'").select("doc", F.col("src_num").alias("parent"), F.col("dst_num").alias("id"), F.regexp_extract("via", r"(\d+)$", 1).cast("long").alias("ordinal"))
        first = kids.withColumn("_r", F.row_number().over(Window.partitionBy("doc", "id").orderBy("parent", "ordinal"))).where("_r = 1").drop("_r")
        catalog = self.trailer_edges.where("via = '/Root'").select("doc", F.col("dst_num").alias("src_num"))
        roots = self.edges.where("via = '/Pages'").join(catalog, ["doc", "src_num"]).select("doc", F.col("dst_num").alias("id"), F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("ordinal"))
        below = first.join(roots.select("doc", "id"), ["doc", "id"], "left_anti")
        return trees.walk(roots.unionByName(below.select("doc", "id", "parent", "ordinal")))

    def pages(self) -> DataFrame:
        """Pages in order with inherited boxes and rotation: doc, page_idx, num, media_box, crop_box, rotate."""
        nodes = self.page_tree().select("doc", F.col("id").alias("num"), "parent", "path", "depth")
        attributes = self.objects.select("doc", "num", "type", *[self.value(f"$['/{n}']", k).alias(a) for n, k, a in (("MediaBox", "array<double>", "media"), ("CropBox", "array<double>", "crop"), ("Rotate", "int", "rotate"))])
        rows = nodes.join(attributes, ["doc", "num"], "left")
        # each node's ancestors are the prefixes of its path
        above = rows.select("doc", F.col("path").alias("_p"), F.col("depth").alias("_d"), F.col("media").alias("_m"), F.col("crop").alias("_c"), F.col("rotate").alias("_o"))
        leaves = rows.where("type = 'Page'").select("doc", "num", "path", "depth", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", 1, n))).alias("_p"))
        near = leaves.join(above, ["doc", "_p"]).groupBy("doc", "num", "path").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_d"))).alias(a) for c, a in (("_m", "media_box"), ("_c", "crop_box"), ("_o", "rotate"))])
        index = F.row_number().over(Window.partitionBy("doc").orderBy("path")) - 1
        return near.select("doc", index.cast("int").alias("page_idx"), "num", "media_box", F.coalesce("crop_box", "media_box").alias("crop_box"), F.coalesce("rotate", F.lit(0)).alias("rotate"))

    def page_labels(self) -> DataFrame:
        """Label ranges of all nodes of the number tree: doc, start_idx, style, prefix, start; a node is read once, also in a cycle."""
        catalog = self.trailer_edges.where("via = '/Root'").select("doc", F.col("dst_num").alias("num"))
        own = self.objects.join(catalog, ["doc", "num"]).select("doc", F.col("value"), self.value("$['/PageLabels']", "string").alias("ref"))
        kids = self.edges.where("via rlike '^/Kids/[0-9]+$'").select("doc", F.col("src_num").alias("num"), "dst_num").distinct()
        direct = self.edges.where("via rlike '^/PageLabels/Kids/[0-9]+$'").withColumnRenamed("src_num", "num").join(catalog, ["doc", "num"]).select("doc", F.col("dst_num").alias("num"))
        roots = own.where("ref rlike '^[0-9]+ [0-9]+ R$'").select("doc", F.split("ref", " ")[0].cast("long").alias("num"))
        away = _reached(roots.unionByName(direct), kids).join(self.objects, ["doc", "num"]).select("doc", F.parse_json("value").alias("tree"))
        here = own.where("ref is null or not ref rlike '^[0-9]+ [0-9]+ R$'").select("doc", F.try_variant_get(F.parse_json("value"), "$['/PageLabels']", "variant").alias("tree"))
        nums = away.unionByName(here).select("doc", F.expr("try_variant_get(tree, \"$['/Nums']\", 'array<variant>')").alias("nums")).where("nums is not null")
        pairs = nums.select("doc", F.posexplode("nums").alias("i", "v"), "nums").where("i % 2 = 0")
        label = F.get("nums", F.col("i") + 1)
        get = lambda k, t: F.try_variant_get(label, f"$['/{k}']", t)
        return pairs.select("doc", F.expr("try_variant_get(v, '$', 'long')").alias("start_idx"), F.substr(get("S", "string"), F.lit(2)).alias("style"), F.substr(get("P", "string"), F.lit(3)).alias("prefix"), F.coalesce(get("St", "long"), F.lit(1).cast("long")).alias("start"))

    def streams(self) -> DataFrame:
        """Streams with their decoded bytes, warnings and error."""
        rows = self.objects.where("stream is not null")
        parms = F.regexp_replace("parms", '"/', '"')
        return rows.withColumn("d", decoded(F.col("stream"), F.col("filters"), parms)).select("doc", "num", "gen", "type", "d.*")

    def reachable(self) -> DataFrame:
        """(doc, num) of objects that the trailer reaches, by a frontier that leaves the seen ones."""
        return _reached(self.trailer_edges.select("doc", F.col("dst_num").alias("num")), self.edges.select("doc", F.col("src_num").alias("num"), "dst_num").distinct())


def _reached(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc, num) of ``start`` and of all that edges (doc, num, dst_num) lead to from there."""
    frontier = seen = cut(start.distinct())
    while True:
        found = cut(frontier.join(edges, ["doc", "num"]).select("doc", F.col("dst_num").alias("num")).distinct().join(seen, ["doc", "num"], "left_anti"))
        if found.isEmpty():
            return seen
        seen, frontier = cut(seen.unionAll(found)), found


def read_pdf(spark: SparkSession, path: str, repair: bool = True, max_bytes: int = MAX_BYTES) -> Pdf:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return Pdf(parse(files.select("path", F.when(F.col("length") <= max_bytes, F.col("content")).alias("content")), repair=repair))
