"""Members of ZIP archives as rows, and unpacking by tasks: a task reads the archive's directory, others seek to their members.

The driver sees no member. Files appear whole: they are written beside their place and renamed, so a task that runs twice does no harm.
"""

from __future__ import annotations

import posixpath
import shutil
import uuid
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from gridloom import staging
from gridloom.sources import walk

MEMBERS = "archive string, name string, size long, is_folder boolean, is_inside boolean"


def is_inside(name: str) -> bool:
    """Whether a member stays in the folder that it is unpacked to."""
    at = posixpath.normpath(name.replace("\\", "/"))
    return not (at.startswith("/") or at == ".." or at.startswith("../") or (len(at) > 1 and at[1] == ":"))


def members(spark: SparkSession, archive: str) -> DataFrame:
    """``archive, name, size, is_folder, is_inside`` of a ZIP file's members, from its directory at the end of the file."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, inner, _ = walk.opened(path)
                with store.open_input_file(inner) as file, zipfile.ZipFile(file) as zipped:
                    found = [(path, m.filename, m.file_size, m.is_dir(), is_inside(m.filename)) for m in zipped.infolist()]
                for k in range(0, len(found), 10_000):
                    kinds = (pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.bool_())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found[k : k + 10_000], strict=True), kinds, strict=True)], names=["archive", "name", "size", "is_folder", "is_inside"])

    paths = [(path,) for path, _, folder in walk.roots(spark, archive) if not folder]
    if not paths:
        raise FileNotFoundError(f"no archive at {archive}")
    return spark.createDataFrame(paths, "archive string").mapInArrow(run, MEMBERS)


def put(store: pafs.FileSystem, path: str, write) -> None:
    """A file that appears whole: ``write`` fills one beside its place, which is then renamed."""
    beside = f"{posixpath.dirname(path)}/.{posixpath.basename(path)}.{uuid.uuid4().hex}"
    try:
        with store.open_output_stream(beside) as file:
            write(file)
        store.move(beside, path)
    except BaseException:
        if store.get_file_info(beside).type == pafs.FileType.File:
            store.delete_file(beside)
        raise


def unpack(spark: SparkSession, archive: str, target: str, overwrite: bool = False) -> str:
    """All members below ``target``; one that would leave it raises before anything is written, and existing files stay unless told."""
    with staging.scratch(spark) as held:
        found = staging.staged(members(spark, archive), f"{held}/members")
        if outside := found.filter("not is_inside").first():
            raise ValueError(f"archive member outside the target: {outside.name}")

        def write(part: Iterable[Row]) -> None:
            store, root, _ = walk.opened(target)
            opened: dict[str, zipfile.ZipFile] = {}
            for r in part:
                at = f"{root.rstrip('/')}/{posixpath.normpath(r.name.replace(chr(92), '/'))}"
                store.create_dir(at if r.is_folder else posixpath.dirname(at), recursive=True)
                if r.is_folder or (not overwrite and store.get_file_info(at).type != pafs.FileType.NotFound):
                    continue
                if r.archive not in opened:
                    source, inner, _ = walk.opened(r.archive)
                    opened[r.archive] = zipfile.ZipFile(source.open_input_file(inner))
                with opened[r.archive].open(r.name) as member:
                    put(store, at, lambda file, member=member: shutil.copyfileobj(member, file, 1 << 20))

        n = found.count()
        found.repartition(max(1, min(n, spark.sparkContext.defaultParallelism, -(-n // 16))), F.col("name")).foreachPartition(write)
    return target
