"""Object stores, listed in ranges of keys.

Arrow returns a prefix of a store as a whole.  The stores themselves answer with
pages in key order, from a start marker on, and that is what a *lister* wraps:

    lister(prefix, after, limit) -> [(key, size), ...]

the first keys that begin with ``prefix`` and lie after ``after`` in the byte
order of UTF-8, at most ``limit`` of them, none only if there are no more.  It
is called inside tasks, so it can be pickled and opens its own client.

A range is a prefix and a marker.  A task lists the first pages of its range;
what is left is cut at the next character that differs, which is found by
probing for one key at a time, and the parts are dealt out again.  So neither a
task nor the driver ever holds more than a page, however flat the store is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credsieve import session
from credsieve.functions import paths

Lister = Callable[[str, str, int], list[tuple[str, int]]]
PAGE = 1_000
PAGES_PER_RANGE = 8
# Ranges that are listed at once; more of them wait for their turn.
MOST_TASKS = 1_000
_ROW = pa.schema([("prefix", pa.string()), ("after", pa.string()), ("key", pa.string()), ("size", pa.int64())])
_SCHEMA = "prefix string, after string, key string, size bigint"
# Sorts after everything that a key goes on with.
_LAST = "\U0010ffff"


class ListingError(RuntimeError):
    """A lister broke its promise."""


def _page(lister: Lister, prefix: str, after: str, limit: int) -> list[tuple[str, int]]:
    page = lister(prefix, after, limit)
    last = after
    for key, _ in page:
        # code points sort as the bytes of UTF-8 do
        if not key.startswith(prefix) or key <= last:
            raise ListingError(f"the lister returned {key!r} for the prefix {prefix!r} after {last!r}")
        last = key
    return page


def _file(key: str, size: int) -> dict:
    return {"prefix": None, "after": None, "key": key, "size": size}


def cut(lister: Lister, prefix: str, after: str) -> Iterator[dict]:
    """The keys of a prefix after a marker, as a range for each character that comes next.

    Where all of them go on alike, the prefix grows until they part.  The key
    that is the prefix itself belongs to no part and is a file.
    """
    while True:
        parts: list[str] = []
        marker = after
        while page := _page(lister, prefix, marker, 1):
            key, size = page[0]
            if key == prefix:
                yield _file(key, size)
                marker = after = key
                continue
            part = key[: len(prefix) + 1]
            if not parts or parts[-1] != part:
                parts.append(part)
                if len(parts) > 1:
                    yield {"prefix": parts[-2], "after": after, "key": None, "size": None}
                    del parts[:-2]
            marker = max(key, part + _LAST)
        if len(parts) != 1:
            if parts:
                yield {"prefix": parts[-1], "after": after, "key": None, "size": None}
            return
        prefix = parts[0]


def list_range(lister: Lister, prefix: str, after: str) -> Iterator[dict]:
    """The files of the first pages of a range, then the ranges of what is left."""
    for _ in range(PAGES_PER_RANGE):
        page = _page(lister, prefix, after, PAGE)
        if not page:
            return
        for key, size in page:
            yield _file(key, size)
        after = page[-1][0]
    yield from cut(lister, prefix, after)


def _tasks(lister: Lister) -> Callable:
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                for found in list_range(lister, row["prefix"], row["after"]):
                    held.append(found)
                    if len(held) >= 10 * PAGE:
                        yield pa.RecordBatch.from_pylist(held, schema=_ROW)
                        held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=_ROW)

    return of_batches


def list_keys(spark: SparkSession, lister: Lister, prefix: str = "", base: str = "") -> DataFrame:
    """``path, file_path, size, reason`` of all objects below ``prefix``, as ``files.list_files`` returns them.

    ``base`` goes ahead of a key to make it a path that Arrow opens; the prefix
    is left out of ``file_path``.  Markers of folders (keys that end with a
    slash) and objects in pruned directories are left out.  An error of the
    lister fails the job, so that Spark tries again.  Rounds run when this is
    called; only the number of ranges reaches the driver.
    """
    folder = session.work_folder(spark, "keys")
    ranges = spark.createDataFrame([(prefix, "")], "prefix string, after string")
    rounds, pending = 0, 1
    while pending:
        target = f"{folder}/round={rounds}"
        ranges.repartition(min(pending, MOST_TASKS)).mapInArrow(_tasks(lister), _SCHEMA).write.parquet(target)
        ranges = spark.read.schema(_SCHEMA).parquet(target).where("key is null").select("prefix", "after")
        pending = ranges.count()
        rounds += 1
    keys = spark.read.schema(_SCHEMA + ", round int").parquet(folder).where("key is not null and not endswith(key, '/')")
    inside = F.substring("key", F.lit(len(prefix) + 1), F.char_length("key"))
    rows = keys.select(
        F.concat(F.lit(base), "key").alias("path"), F.ltrim(inside, F.lit("/")).alias("file_path"), "size",
        F.lit(None).cast("string").alias("reason"),
    )
    return rows.where(~paths.in_pruned_directory(F.col("file_path")))
