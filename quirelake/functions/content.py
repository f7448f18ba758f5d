"""Content streams: operators with their operands, names in use, and a normal form."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.sources.syntax import Reader, SyntaxProblem, as_json

#: Operators that name a resource, and its category.
RESOURCE_OPERATORS = {"Tf": "Font", "Do": "XObject", "gs": "ExtGState", "cs": "ColorSpace", "CS": "ColorSpace", "sh": "Shading", "scn": "Pattern", "SCN": "Pattern", "BDC": "Properties", "DP": "Properties"}

_word = re.compile(rb"[A-Za-z'\"][A-Za-z0-9*'\"]*")
_constant = (b"true", b"false", b"null")


def operations(data: bytes):
    """(operator, operands as JSON, offset) in order; an inline image is one operation ``BI`` with its bytes' length.

    A damaged token is reported as operator ``?`` and skipped to the next blank.
    """
    reader, operands = Reader(data), []
    while True:
        reader.skip()
        at = reader.at
        if at >= len(data):
            return
        m = _word.match(data, at)
        if m and m[0] not in _constant:
            reader.at = m.end()
            if m[0] == b"BI":
                begin = re.compile(rb"[\s\S]*?\bID[ \r\n\t]").match(data, reader.at)
                end = re.compile(rb"[\s\S]*?\s(EI)(?=[\s]|$)").match(data, begin.end()) if begin else None
                if not end:
                    yield "?", "[]", at
                    return
                yield "BI", json.dumps([end.start(1) - 1 - begin.end()]), at
                reader.at = end.end()
            else:
                yield m[0].decode(), json.dumps(operands), at
            operands = []
            continue
        try:
            operands.append(as_json(reader.value()))
        except SyntaxProblem:
            yield "?", "[]", at
            operands = []
            reader.at = max(at + 1, re.compile(rb"[^\s]*").match(data, at).end())


def content_operations(streams: DataFrame, data: str, *keys: str) -> DataFrame:
    """One row for each operation of each stream: keys, seq, operator, operands (JSON), offset."""

    @F.pandas_udf("array<struct<operator:string,operands:string,offset:long>>")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([[] if x is None else [{"operator": o, "operands": a, "offset": at} for o, a, at in operations(bytes(x))] for x in rows], dtype=object)

    rows = streams.select(*keys, F.posexplode(run(F.col(data))).alias("seq", "op"))
    return rows.select(*keys, F.col("seq").cast("long").alias("seq"), "op.*")


def used_names(operations_: DataFrame, *keys: str) -> DataFrame:
    """Distinct resource names that operations use: keys, category, name."""
    kinds = F.create_map(*[F.lit(x) for pair in RESOURCE_OPERATORS.items() for x in pair])
    rows = operations_.where(F.col("operator").isin(*RESOURCE_OPERATORS)).withColumn("category", kinds[F.col("operator")])
    names = F.filter(F.from_json("operands", "array<string>"), lambda x: x.startswith("/"))
    return rows.select(*keys, "category", F.substring(F.try_element_at(names, F.lit(-1)), 2, 200).alias("name")).where("name is not null").distinct()


def unused_resources(resources: DataFrame, used: DataFrame, *keys: str) -> DataFrame:
    """Resources (keys, category, name) of fonts and XObjects that no operation names."""
    return resources.where(F.col("category").isin("Font", "XObject")).join(used, [*keys, "category", "name"], "left_anti")


def operator_counts(operations_: DataFrame, *keys: str) -> DataFrame:
    return operations_.groupBy(*keys, "operator").agg(F.count(F.lit(1)).alias("n"))


def normal_line_ends(data: Column) -> Column:
    """Text content with each CR LF or CR as LF."""
    return F.regexp_replace(data, "\r\n?", "\n")
