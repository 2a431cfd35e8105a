"""What the operators share: working folders, slices of Arrow batches, and input columns."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

ARROW = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
#: Documents that a Python worker holds as objects at once.
SLICE = 256


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below ``spark.checkpoint.dir``.

    Only where that setting is absent (tests, one machine) the context's checkpoint folder or a temporary one stands in.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if context._jsc.sc().getCheckpointDir().isEmpty():
            context.setCheckpointDir(tempfile.mkdtemp(prefix="gridloom-"))
        base = context._jsc.sc().getCheckpointDir().get()
    at = context._jvm.org.apache.hadoop.fs.Path(base)
    whole = at.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return f"{re.sub('^file:/+', 'file:///', whole).rstrip('/')}/gridloom/{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, root: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, and survives lost executors."""
    path = f"{root or shared_dir(df.sparkSession)}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of what is already written: it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: The lookups of the operator that this Python worker runs now.
_KEPT: dict[Hashable, Any] = {}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """One operator's lookups in a Python worker. Workers are reused by stage after stage, so what another operator kept goes first, and its memory back to the system."""
    if key not in _KEPT:
        _KEPT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only this C library has it
            ctypes.CDLL(None).malloc_trim(0)
        _KEPT[key] = make()
    return _KEPT[key]


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns that an operator reads, so that others neither travel nor clash."""
    return docs.select("doc_id", *more, F.col("text").cast("string").alias("text"))


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo: how the folds of documents are fixed."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % modulus


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a flat DDL string, for what mapInArrow returns; works where there is no session."""

    def kind(name: str) -> pa.DataType:
        return pa.list_(kind(name[6:-1])) if name.startswith("array<") else ARROW[name]

    return pa.schema([pa.field(*(kind(x) if k else x for k, x in enumerate(column.split()))) for column in ddl.split(",")])


def by_slices(fn: Callable[[dict[str, list]], dict[str, list]], schema: pa.Schema, size: int = SLICE) -> Callable:
    """For mapInArrow: ``fn`` sees a few rows at a time as Python lists and returns lists."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, size):
                out = fn(batch.slice(k, size).to_pydict())
                yield pa.RecordBatch.from_arrays([out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return run


def with_text(docs: DataFrame, fn: Callable[[list], tuple[list, ...]], added: str, replaces: bool = False, size: int = SLICE) -> DataFrame:
    """All columns of ``docs``, and those of the DDL string ``added`` that ``fn`` makes from a few texts at a time.

    With ``replaces`` the first list that ``fn`` returns takes the place of ``text``. Input columns named as added ones are dropped.
    """
    more = arrow_schema(added) if added else pa.schema([])
    own = docs.drop(*more.names)
    schema = StructType([StructField(f.name, StringType(), True) if f.name == "text" else f for f in own.schema.fields] + StructType.fromDDL(added).fields)
    names, at = own.columns + more.names, own.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, size):
                batch = whole.slice(k, size)
                columns, out = [*batch.columns], [*fn(batch.column(at).to_pylist())]
                if replaces:
                    columns[at] = pa.array(out.pop(0), pa.string())
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(v, f.type) for v, f in zip(out, more, strict=True))], names=names)

    return own.withColumn("text", F.col("text").cast("string")).mapInArrow(run, schema)
