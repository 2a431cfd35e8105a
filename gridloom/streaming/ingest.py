"""Incremental listing of new files: an addition of ours, for sources that grow."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.sources.files import is_image


def ingest_images(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append path, length and hash of images that came since the last run to a Parquet table, then stop; exactly once by the checkpoint."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(source)
    rows = files.filter(is_image(F.col("path"))).select("path", "length", F.sha2("content", 256).alias("sha256"))
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
