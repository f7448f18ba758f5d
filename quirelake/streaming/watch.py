"""Optional: parse files as they arrive. Each micro-batch is parsed and appended as rows of all tables."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from quirelake.sources.pdf import parse


def watch_pdf(spark: SparkSession, folder: str, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append the parsed rows of new files in ``folder`` to the Parquet table ``target``; a file is taken once."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    writer = parse(files).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
