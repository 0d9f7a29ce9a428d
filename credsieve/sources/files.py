"""File trees as tables.

Spark's own file source skips names that begin with a dot or an underscore, and
those are the files that matter most here, so names are listed and bytes are
read through Arrow's file systems, inside tasks.  Local and mounted paths, and
the object stores Arrow knows, all work.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from math import ceil
from pathlib import PurePosixPath

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credsieve import fixed_values as fixed
from credsieve import session
from credsieve.functions import text

ENTRY = "path string, file_path string, is_dir boolean, size bigint, reason string"
BYTES_PER_TASK = 32 * 1024 * 1024
FILES_PER_TASK = 2_000
DIRECTORIES_PER_TASK = 32
_ROWS_AT_ONCE = 10_000
_MISSING, _DENIED = "not found", "permission denied"


class FileTreeError(RuntimeError):
    """The path cannot be scanned."""


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow file system and path for a path as Hadoop writes it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    elif path.startswith("s3a://"):
        path = "s3://" + path.removeprefix("s3a://")
    return pafs.FileSystem.from_uri(path)


def normalised(path: str) -> str:
    """A path as it labels findings, the same however it was typed."""
    return path.rstrip("/") or path if ":/" in path else str(PurePosixPath(path))


def _absolute(path: str) -> str:
    return path if ":/" in path else os.path.abspath(path)


def _pruned(name: str) -> bool:
    return name in fixed.PRUNED_DIRECTORIES or name.endswith(fixed.PRUNED_DIRECTORY_SUFFIX)


def _children(fs: pafs.FileSystem, place: str) -> Iterator[tuple[str, bool, int | None]]:
    """(name, whether it is a directory, size) of the entries to visit, one by one where the system allows it.

    Links to directories are not followed.  Object stores are listed by Arrow,
    which returns a prefix as a whole.
    """
    if fs.type_name == "local":
        with os.scandir(place) as entries:
            for entry in entries:
                if entry.is_dir(follow_symlinks=False):
                    yield entry.name, True, None
                elif entry.is_file():
                    try:
                        size = entry.stat().st_size
                    except FileNotFoundError:
                        size = None  # gone meanwhile; reading it will say so
                    yield entry.name, False, size
        return
    for info in fs.get_file_info(pafs.FileSelector(place)):
        if info.type in (pafs.FileType.Directory, pafs.FileType.File):
            yield info.base_name, info.type == pafs.FileType.Directory, info.size


def _reason(problem: OSError) -> str:
    """Why something was skipped; anything but missing or forbidden is an error of the job."""
    if isinstance(problem, FileNotFoundError):
        return _MISSING
    if isinstance(problem, PermissionError):
        return _DENIED
    raise problem


def _list_children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One output row per entry of each directory, pruned directories left out.

    A directory that is gone or may not be listed is a row with the reason.
    """
    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            fs, place = open_path(row["path"])
            prefix = row["file_path"] + "/" if row["file_path"] else ""
            base = row["path"].rstrip("/")
            try:
                for name, is_dir, size in _children(fs, place):
                    if is_dir and _pruned(name):
                        continue
                    rows.append({"path": f"{base}/{name}", "file_path": prefix + name, "is_dir": is_dir, "size": size})
                    if len(rows) >= _ROWS_AT_ONCE:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ENTRY_ARROW)
                        rows = []
            except OSError as problem:
                rows.append({**row, "is_dir": False, "reason": _reason(problem)})
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_ENTRY_ARROW)


_ENTRY_ARROW = pa.schema(
    [("path", pa.string()), ("file_path", pa.string()), ("is_dir", pa.bool_()), ("size", pa.int64()), ("reason", pa.string())]
)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, file_path, size, reason`` of every file under ``root``.

    ``reason`` is set for a directory that could not be listed.

    The tree is listed level by level: all directories of a level are listed by
    tasks in parallel and the result is written to the shared work folder, from
    which the next level is read.  Only the number of directories per level ever
    reaches the driver.
    """
    root = _absolute(root)
    fs, place = open_path(root)
    info = fs.get_file_info(place)
    if info.type == pafs.FileType.NotFound:
        raise FileTreeError(f"path does not exist: {root}")
    if info.type == pafs.FileType.File:
        return spark.createDataFrame(
            [(root, info.base_name, info.size, None)], "path string, file_path string, size bigint, reason string"
        )

    folder = session.work_folder(spark, "listing")
    frontier = spark.createDataFrame([(root, "")], "path string, file_path string")
    level, pending = 0, 1
    while pending:
        target = f"{folder}/level={level}"
        frontier.repartition(ceil(pending / DIRECTORIES_PER_TASK)).mapInArrow(
            _list_children, ENTRY
        ).write.parquet(target)
        frontier = spark.read.parquet(target).where("is_dir").select("path", "file_path")
        pending = frontier.count()
        level += 1
    return (
        spark.read.schema(ENTRY + ", level int")
        .parquet(folder)
        .where(~F.col("is_dir"))
        .select("path", "file_path", "size", "reason")
    )


_FILE_ARROW = pa.schema([("file_path", pa.string()), ("size", pa.int64()), ("data", pa.binary()), ("reason", pa.string())])
FILE = "file_path string, size bigint, data binary, reason string"
_BYTES_AT_ONCE = 8 * 1024 * 1024


def opened(rows: Iterable[dict]) -> Iterator[pa.RecordBatch]:
    """Read each file (path, file_path, size) once; one that is gone or forbidden has a reason instead of data.

    Output batches stay small.
    """
    held, size = [], 0
    for row in rows:
        found = {"file_path": row["file_path"], "size": row["size"], "data": None, "reason": None}
        try:
            fs, place = open_path(row["path"])
            with fs.open_input_file(place) as stream:
                found["data"] = stream.read()
        except OSError as problem:
            found["reason"] = _reason(problem)
        held.append(found)
        size += len(found["data"] or b"")
        if size > _BYTES_AT_ONCE or len(held) >= 4096:
            yield pa.RecordBatch.from_pylist(held, schema=_FILE_ARROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=_FILE_ARROW)


def _read_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from opened(row for batch in batches for row in batch.to_pylist())


def decoded(data: Column) -> Column:
    """Text of a file, NULL when it is not valid UTF-8."""
    value = data.cast("string")
    return F.when(F.is_valid_utf8(value), text.universal_newlines(value))


def read_once(files: DataFrame) -> DataFrame:
    """``file_path, size, content, reason``: every listed file is opened once, and has a text or a reason or neither.

    A file without both is not valid UTF-8.  The names are dealt out at random,
    with enough tasks for the total size, so neither a huge directory nor a run
    of large files lands in one task.
    """
    listed = files.where("reason is null")
    totals = listed.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("s")).head()
    tasks = 1 + max(totals.s // BYTES_PER_TASK, totals.n // FILES_PER_TASK)
    dealt = listed.select("path", "file_path", "size").repartition(int(tasks))
    read = dealt.mapInArrow(_read_bytes, FILE).select("file_path", "size", decoded(F.col("data")).alias("content"), "reason")
    unlisted = files.where("reason is not null").select("file_path", "size", F.lit(None).cast("string").alias("content"), "reason")
    return read.unionByName(unlisted)


def read_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``file_path, size, content`` of the files that are valid UTF-8, and ``file_path, reason`` of those skipped.

    Each of the two tables reads the files; ``read_once`` has both in one.
    """
    rows = read_once(files)
    return (
        rows.where("content is not null").select("file_path", "size", "content"),
        rows.where("reason is not null").select("file_path", "reason"),
    )


def read_texts(files: DataFrame) -> DataFrame:
    """The texts of ``read_files``."""
    return read_files(files)[0]
