"""Intermediate tables in the folder that driver and executors share: they cut lineage and outlive lost executors."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that isn't set (tests, one machine), below the context's own or a temporary one."""
    context, base = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        own = context._jsc.sc().getCheckpointDir()
        if own.isEmpty():
            context.setCheckpointDir(tempfile.mkdtemp(prefix="gridloom-"))
            own = context._jsc.sc().getCheckpointDir()
        base = own.get()
    path = context._jvm.org.apache.hadoop.fs.Path(base)
    whole = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"{re.sub('^file:/+', 'file:///', whole).rstrip('/')}/gridloom/{uuid.uuid4().hex}"


def staged(df: DataFrame, path: str | None = None) -> DataFrame:
    """The table, written once and read back: whatever depended on partitions or order is now fixed."""
    at = path or folder(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder for a job's intermediate tables, deleted when the job is over."""
    path = folder(spark)
    try:
        yield path
    finally:
        delete(spark, path)
