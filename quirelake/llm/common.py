"""Small helpers that the operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
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


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df``: write it as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quirelake/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession, rows: int, per_part: int) -> int:
    """Partitions for ``rows`` rows at ``per_part`` rows each, never fewer than the session asks for."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_part))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or the first ``name_2``, ``name_3`` ... that ``df`` has no column of (any letter case)."""
    have = {c.lower() for c in df.columns}
    return next(x for x in (name, *(f"{name}_{i}" for i in range(2, len(have) + 3))) if x.lower() not in have)


def empty_text(column) -> "F.Column":
    return F.coalesce(column.cast("string"), F.lit(""))


def tidy() -> None:
    """Give what a task no longer uses back to the system: Python workers live on, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim:
        trim(0)


def tidied(work, *args):
    try:
        return work(*args)
    finally:
        tidy()
