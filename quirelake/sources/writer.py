"""Sinks: a plain rewrite of each document, and the JSON object map.

A body is made object by object in a narrow pass; offsets are a running sum of lengths
within the document; the file is put together by its key, as one file is one row.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ref = re.compile(r"\d+ \d+ R$")
_odd = re.compile(rb"[^!-~]|[#()<>\[\]{}/%]")


def _name(text: str) -> bytes:
    return b"/" + _odd.sub(lambda m: b"#%02x" % m[0][0], text[1:].encode())


def unparse(value) -> bytes:
    """PDF syntax of a value in JSON form; dictionaries in order of their keys."""
    if isinstance(value, dict):
        return b"<< " + b"".join(_name(k) + b" " + unparse(v) + b" " for k, v in sorted(value.items())) + b">>"
    if isinstance(value, list):
        return b"[ " + b"".join(unparse(v) + b" " for v in value) + b"]"
    if isinstance(value, str):
        if _ref.match(value):
            return value.encode()
        if value.startswith("/"):
            return _name(value)
        if value.startswith("b:"):
            return b"<" + value[2:].encode() + b">"
        raw = value.removeprefix("u:")
        data = raw.encode("latin-1") if all(ord(c) < 127 for c in raw) else b"\xfe\xff" + raw.encode("utf-16-be")
        return b"(" + re.sub(rb"[\\()\r]", lambda m: b"\\r" if m[0] == b"\r" else b"\\" + m[0], data) + b")"
    if isinstance(value, bool) or value is None:
        return json.dumps(value).encode()
    return f"{value:.6f}".rstrip("0").rstrip(".").encode() if isinstance(value, float) else str(value).encode()


def bodies(objects: DataFrame) -> DataFrame:
    """(doc, num, gen, body): each object as it stands in a file."""

    @F.pandas_udf("binary")
    def body(nums: pd.Series, gens: pd.Series, values: pd.Series, streams: pd.Series) -> pd.Series:
        out = []
        for n, g, v, s in zip(nums, gens, values, streams, strict=True):
            value = json.loads(v)
            if s is not None:
                value["/Length"] = len(s)
            text = unparse(value) + (b"\nstream\n" + bytes(s) + b"\nendstream" if s is not None else b"")
            out.append(b"%d %d obj\n" % (n, g) + text + b"\nendobj\n")
        return pd.Series(out, dtype=object)

    return objects.select("doc", "num", "gen", body("num", "gen", "value", "stream").alias("body"))


def _joined(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(b""), lambda a, b: F.concat(a, b))


def write_plain(objects: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc, content): a file for each document with a classic cross-reference table. Numbers without object are free."""
    head = F.concat(F.lit("%PDF-"), F.when(F.col("version") == "", "1.3").otherwise(F.col("version")), F.lit("\n"))
    rows = bodies(objects).join(documents.select("doc", head.alias("head")), "doc")
    order = Window.partitionBy("doc").orderBy("num", "gen")
    before = F.coalesce(F.sum(F.length("body")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("offset", F.length("head") + before).withColumn("gap", F.col("num") - F.coalesce(F.lag("num").over(order), F.lit(0)) - 1)
    free = F.repeat(F.lit("0000000000 00000 f \n"), F.greatest(F.col("gap"), F.lit(0)).cast("int"))
    line = F.concat(free, F.lpad(F.col("offset").cast("string"), 10, "0"), F.lit(" "), F.lpad(F.col("gen").cast("string"), 5, "0"), F.lit(" n \n"))
    whole = rows.groupBy("doc", "head").agg(F.array_sort(F.collect_list(F.struct("num", "gen", "body", line.alias("line")))).alias("o"), F.max("num").alias("last"), F.max(F.col("offset") + F.length("body")).alias("start"))
    whole = whole.join(documents.select("doc", "trailer"), "doc")

    @F.pandas_udf("binary")
    def tail(trailers: pd.Series, last: pd.Series) -> pd.Series:
        keep = ("/Root", "/Info", "/ID")
        return pd.Series([unparse({k: v for k, v in json.loads(t).items() if k in keep} | {"/Size": int(n) + 1}) for t, n in zip(trailers, last, strict=True)], dtype=object)

    size = (F.col("last") + 1).cast("string")
    xref = F.concat(F.lit("xref\n0 "), size, F.lit("\n0000000000 65535 f \n"), F.concat_ws("", F.transform("o", lambda x: x["line"])), F.lit("trailer "))
    end = F.concat(F.lit("\nstartxref\n"), F.col("start").cast("string"), F.lit("\n%%EOF\n"))
    return whole.select("doc", F.concat(F.col("head").cast("binary"), _joined(F.transform("o", lambda x: x["body"])), xref.cast("binary"), tail("trailer", "last"), end.cast("binary")).alias("content"))


def json_objects(objects: DataFrame) -> DataFrame:
    """(doc, key, json): the entries ``obj:N G R`` of the JSON object map; streams by their dictionary."""
    key = F.concat(F.lit("obj:"), F.col("num").cast("string"), F.lit(" "), F.col("gen").cast("string"), F.lit(" R"))
    value = F.when(F.col("stream").isNull(), F.concat(F.lit('{"value": '), F.col("value"), F.lit("}"))).otherwise(F.concat(F.lit('{"stream": {"dict": '), F.col("value"), F.lit("}}")))
    return objects.select("doc", key.alias("key"), value.alias("json"))


def save_files(files: DataFrame, folder: str) -> None:
    """One record for each file as Parquet (doc, content): a table that any reader can unpack, on any store."""
    files.write.mode("overwrite").parquet(folder)
