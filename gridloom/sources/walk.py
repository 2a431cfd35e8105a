"""Files below folders of any store: names, contents and image headers, listed and read in tasks.

A walk lists folders on the driver only until it has met a bounded number of entries; what lies below the folders that are then open is
listed by tasks, a level at a time, and kept as a table, so neither paths nor contents pass through the driver. All names count, those
that begin with ``_`` or ``.`` and empty files too. Contents go from the store into the task that uses them and cross no shuffle.

Stores that tasks can't open themselves (only Spark's readers can) are listed by the driver in bounded portions and read by
Spark's own file source, which leaves hidden names out.
"""

from __future__ import annotations

import fnmatch
import io
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import staging
from gridloom.sources import imageheads

#: Entries that the driver lists itself, or hands over at once; files of a task; files in a batch that comes back.
ENTRIES, TASK_FILES, BATCH = 10_000, 2_000, 64
FOUND = "path string, size long, is_folder boolean"
HEADS = "path string, width int, height int, mode string, sha256 string, error string"


def plain(path: str) -> str:
    """Paths of the local store stand without scheme, as users write them."""
    return re.sub("^file:/+", "/", path)


def opened(path: str) -> tuple[pafs.FileSystem, str, str]:
    """The store of a path, the path within it, and what was left out; raises where tasks can't open such a store."""
    path = plain(path)
    if path.startswith("/"):
        return pafs.LocalFileSystem(), path, ""
    store, inner = pafs.FileSystem.from_uri(path)
    return store, inner, path[: len(path) - len(inner.lstrip("/"))] if path.endswith(inner.lstrip("/")) else ""


def is_open(path: str) -> bool:
    try:
        opened(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError, ImportError):
        return False
    return True


def children(folder: str) -> list[tuple[str, int, bool]]:
    """``path, size, is_folder`` of what lies directly in a folder."""
    store, inner, before = opened(folder)
    return [(before + i.path.lstrip("/") if before else i.path, i.size or 0, i.type == pafs.FileType.Directory) for i in store.get_file_info(pafs.FileSelector(inner, recursive=False))]


def roots(spark: SparkSession, source: str) -> list[tuple[str, int, bool]]:
    """The file or folder at ``source``, or those that it names as a glob; none raises."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [store.getFileStatus(at)] if store.exists(at) else store.globStatus(at)
    if not found:
        raise FileNotFoundError(f"nothing at {source}")
    return [(plain(f.getPath().toString()), f.getLen(), f.isDirectory()) for f in found]


def listing(spark: SparkSession, source: str, pattern: str = "*", entries: int | None = None) -> DataFrame:
    """``path, size`` of all files below ``source``, a file, folder or glob, whose names match ``pattern``."""
    limit = ENTRIES if entries is None else entries
    start = roots(spark, source)
    if not is_open(start[0][0]):
        return _by_driver(spark, start, pattern)
    files, folders = [f for f in start if not f[2]], [f[0] for f in start if f[2]]
    while folders and len(files) + len(folders) <= limit:
        below = children(folders.pop())
        files += [f for f in below if not f[2]]
        folders += [f[0] for f in below if f[2]]
    own = spark.createDataFrame(files, FOUND)
    return _named(_below(own, folders) if folders else own, pattern)


def _named(found: DataFrame, pattern: str) -> DataFrame:
    files = found.filter("not is_folder")
    if pattern != "*":
        whole = "^" + re.sub(r"\\[zZ]$", "$", fnmatch.translate(pattern))
        files = files.filter(F.element_at(F.split("path", "/"), -1).rlike(whole))
    return files.select("path", "size")


def _below(own: DataFrame, folders: list[str]) -> DataFrame:
    """What the driver found, and all that tasks find below folders, level by level."""

    def lists(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                below = children(folder)
                for k in range(0, len(below), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*below[k : k + 10_000], strict=True), (pa.string(), pa.int64(), pa.bool_()), strict=True)], names=["path", "size", "is_folder"])

    spark, root, level = own.sparkSession, staging.folder(own.sparkSession), 0
    found, open_ = own, spark.createDataFrame([(f,) for f in folders], "path string")
    while not open_.isEmpty():
        here = staging.staged(open_.repartition(spark.sparkContext.defaultParallelism * 4).mapInArrow(lists, FOUND), f"{root}/level{level}")
        found, open_, level = found.unionByName(here), here.filter("is_folder").select("path"), level + 1
    return found


def _by_driver(spark: SparkSession, start: list[tuple[str, int, bool]], pattern: str) -> DataFrame:
    """Files of a store that only the driver's file system knows, handed over in portions."""
    context, root = spark.sparkContext, staging.folder(spark)
    portion: list[tuple[str, int, bool]] = [f for f in start if not f[2]]
    spark.createDataFrame(portion, FOUND).write.parquet(root)
    for folder in (f[0] for f in start if f[2]):
        at = context._jvm.org.apache.hadoop.fs.Path(folder)
        below, portion = at.getFileSystem(context._jsc.hadoopConfiguration()).listFiles(at, True), []
        while below.hasNext() or portion:
            while below.hasNext() and len(portion) < ENTRIES:
                f = below.next()
                portion.append((f.getPath().toString(), f.getLen(), False))
            spark.createDataFrame(portion, FOUND).coalesce(1).write.mode("append").parquet(root)
            portion = []
    return _named(spark.read.schema(FOUND).parquet(root), pattern)


def _read(files: DataFrame, use: Callable[[str, int, object], tuple], schema: pa.Schema, ddl: str) -> DataFrame:
    """``use(path, size, open)`` for every file, in tasks of a bounded number of files."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def open_file(path: str) -> pa.NativeFile:
            store, inner, _ = opened(path)
            return store.open_input_file(inner)

        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows.append(use(path, size, open_file))
                held += size
                if len(rows) >= BATCH or held >= imageheads.HELD:
                    yield _batch(rows, schema)
                    rows, held = [], 0
        if rows:
            yield _batch(rows, schema)

    return files.select("path", "size").mapInArrow(run, ddl)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def spread(files: DataFrame) -> DataFrame:
    """Files dealt over tasks by their number, in no order of size."""
    n = files.count()
    return files.repartition(max(1, -(-n // TASK_FILES), min(n, files.sparkSession.sparkContext.defaultParallelism)))


CONTENT = pa.schema([("path", pa.string()), ("content", pa.binary())])
HEAD_SCHEMA = pa.schema([("path", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("mode", pa.string()), ("sha256", pa.string()), ("error", pa.string())])


def _content(path: str, size: int, open_file: Callable) -> tuple:
    with open_file(path) as file:
        return path, file.read()


def contents(spark: SparkSession, source: str, pattern: str = "*") -> DataFrame:
    """``path, content`` of the files of a listing; a file is one row, and an empty one has empty content."""
    if not is_open(roots(spark, source)[0][0]):
        return _by_spark(spark, source, pattern).select("path", "content")
    return _read(spread(listing(spark, source, pattern)), _content, CONTENT, "path string, content binary")


def _by_spark(spark: SparkSession, source: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(source).select("path", F.col("length").alias("size"), "content")


def heads(files: DataFrame, digest: bool = True) -> DataFrame:
    """``path, width, height, mode, sha256, error`` of image files (path, size); sizes are -1 where a file isn't an image.

    Without ``digest`` only headers are read, and ``sha256`` is null.
    """

    def use(path: str, size: int, open_file: Callable) -> tuple:
        with open_file(path) as file:
            return path, *imageheads.inspected(file, size, digest)

    return _read(spread(files), use, HEAD_SCHEMA, HEADS)


def heads_of_contents(files: DataFrame, digest: bool = True) -> DataFrame:
    """The same from ``path, content``, where only Spark can read the store."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                content = content.as_py() or b""
                yield _batch([(path, *imageheads.inspected(io.BytesIO(content), len(content), digest))], HEAD_SCHEMA)

    return files.select("path", "content").mapInArrow(run, HEADS)


def heads_below(spark: SparkSession, source: str, wanted: Callable[[Column], Column], digest: bool = True) -> DataFrame:
    """``heads`` of the files below ``source`` whose path is ``wanted``."""
    if not is_open(roots(spark, source)[0][0]):
        return heads_of_contents(_by_spark(spark, source, "*").filter(wanted(F.col("path"))), digest)
    return heads(listing(spark, source).filter(wanted(F.col("path"))), digest)
