"""A directory tree as a Spark data source: ``spark.read.format("filetree").load(root)``.

One row per file: its path, its path below the root, its size and its bytes, or
the reason why it could not be read.  Conditions on ``file_path`` and ``size``
are pushed into the source if ``spark.sql.python.filterPushdown.enabled`` is
set: directories that no wanted path lies in are not listed, and files that are
not wanted are not opened.  Pruned directories (``fixed_values``) are never
entered.

The driver lists directories only until there are enough for the tasks, and
never more than ``MOST_LISTED``; each task walks the directories it is dealt,
one listing at a time.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan,
    LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith,
)

from credsieve.sources import files

SCHEMA = "path string, file_path string, size bigint, data binary, reason string"
#: Partitions that are aimed at, and directories that the driver lists to find them at most.
PARTITIONS = 64
MOST_LISTED = 1000
_ARROW = pa.schema([("path", pa.string()), *((f.name, f.type) for f in files._FILE_ARROW)])
_TESTS: dict[type, Callable] = {
    EqualTo: lambda x, v: x == v, In: lambda x, v: x in v,
    LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v,
    GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v,
    StringStartsWith: lambda x, v: x.startswith(v), StringEndsWith: lambda x, v: x.endswith(v), StringContains: lambda x, v: v in x,
}


@dataclass
class Work(InputPartition):
    """Entries (path, file_path, size) of one task: directories have no size, and are walked."""

    entries: list[tuple[str, str, int | None, bool]]


class FileTreeReader(DataSourceReader):
    def __init__(self, root: str, partitions: int):
        self.root, self.wanted_partitions = root, partitions
        self.conditions: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for condition in filters:
            column = getattr(condition, "attribute", None)
            texts = (StringStartsWith, StringEndsWith, StringContains, EqualTo, In)
            if column == ("file_path",) and isinstance(condition, texts) or column == ("size",) and type(condition) in _TESTS:
                self.conditions.append(condition)
            else:
                yield condition

    def _wanted(self, file_path: str, size: int | None) -> bool:
        values = {("file_path",): file_path, ("size",): size}
        tests = ((values[c.attribute], c) for c in self.conditions)
        return all(x is not None and _TESTS[type(c)](x, c.value) for x, c in tests)

    def _may_hold(self, directory: str) -> bool:
        """Some wanted path may lie below a directory."""
        inside = directory + "/"
        for c in self.conditions:
            starts = c.value if isinstance(c, In) else (c.value,)
            if isinstance(c, (EqualTo, In)) and c.attribute == ("file_path",) and not any(v.startswith(inside) for v in starts):
                return False
            if isinstance(c, StringStartsWith) and not (c.value.startswith(inside) or inside.startswith(c.value)):
                return False
        return True

    def _listed(self, path: str, file_path: str) -> Iterator[tuple[str, str, int | None, bool, str | None]]:
        """Entries of a directory that matter: (path, file_path, size, whether it is a directory, reason)."""
        fs, place = files.open_path(path)
        prefix, base = file_path + "/" if file_path else "", path.rstrip("/")
        try:
            for name, is_dir, size in files._children(fs, place):
                below = prefix + name
                if is_dir and not files._pruned(name) and self._may_hold(below):
                    yield f"{base}/{name}", below, None, True, None
                elif not is_dir and self._wanted(below, size):
                    yield f"{base}/{name}", below, size, False, None
        except OSError as problem:
            yield path, file_path, None, False, files._reason(problem)

    def partitions(self) -> list[Work]:
        fs, place = files.open_path(self.root)
        info = fs.get_file_info(place)
        if info.type == pafs.FileType.NotFound:
            raise files.FileTreeError(f"path does not exist: {self.root}")
        if info.type == pafs.FileType.File:
            wanted = self._wanted(info.base_name, info.size)
            return [Work([(self.root, info.base_name, info.size, False)] if wanted else [])]
        ahead, loose, listed = deque([(self.root, "", None, True)]), [], 0
        while ahead and len(ahead) < self.wanted_partitions and listed < MOST_LISTED:
            directory = ahead.popleft()
            listed += 1
            inside = []
            for entry in self._listed(*directory[:2]):
                if len(inside) >= files._ROWS_AT_ONCE or entry[4]:  # left to a task, with all that it holds
                    loose.append(directory)
                    break
                inside.append(entry[:4])
            else:
                ahead.extend(e for e in inside if e[3])
                loose.extend(e for e in inside if not e[3])
        # directories in turn, so that large neighbours part; single files by number
        entries = [*ahead, *loose]
        return [Work(entries[i :: self.wanted_partitions]) for i in range(min(self.wanted_partitions, len(entries)))] or [Work([])]

    def _walked(self, entries: list) -> Iterator[dict]:
        todo = list(entries)
        while todo:
            path, file_path, size, is_dir = todo.pop()
            if not is_dir:
                yield {"path": path, "file_path": file_path, "size": size, "reason": None}
                continue
            for below, name, own, nested, reason in self._listed(path, file_path):
                if nested:
                    todo.append((below, name, None, True))
                else:
                    yield {"path": below, "file_path": name, "size": own, "reason": reason}

    def read(self, partition: Work) -> Iterator[pa.RecordBatch]:
        for row in self._walked(partition.entries):
            batches = files.opened([row]) if row["reason"] is None else [pa.RecordBatch.from_pylist([row], schema=files._FILE_ARROW)]
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([row["path"]]), *batch.columns], schema=_ARROW)


class FileTreeSource(DataSource):
    """Options: ``path`` (what ``load`` is given) and ``partitions``."""

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FileTreeReader:  # noqa: ANN001
        if "path" not in self.options:
            raise files.FileTreeError("load a path")
        return FileTreeReader(files._absolute(self.options["path"]), int(self.options.get("partitions", PARTITIONS)))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let conditions reach it."""
    spark.dataSource.register(FileTreeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
