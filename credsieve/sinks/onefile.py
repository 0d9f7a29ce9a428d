"""One ordered file, written by many tasks and published at the end.

Every row knows the byte at which it begins, so tasks write to their own places
of one unpublished file.  A task that runs again writes the same bytes to the
same places.  Only a job that ends well gives the file its name; a job that
fails removes what it wrote, and a report that was there before stays.

Places inside a file need a file system that has them: a local or mounted path.
Object stores have none; ``reports.write_report`` writes parts there.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from credsieve import session
from credsieve.sources.files import open_path

_BYTES_AT_ONCE = 8 * 1024 * 1024


class OneFileError(RuntimeError):
    """The file cannot be written or is not whole."""


@dataclass
class Written(WriterCommitMessage):
    size: int


class OneFileWriter(DataSourceArrowWriter):
    """Rows ``at, data`` to their places in ``staged``, which becomes ``target``."""

    def __init__(self, staged: str, target: str, size: int):
        self.staged, self.target, self.size = staged, target, size

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        written, start, held = 0, 0, bytearray()
        place = os.open(self.staged, os.O_CREAT | os.O_WRONLY, 0o644)
        try:
            for batch in iterator:
                for at, data in zip(batch.column("at"), batch.column("data"), strict=True):
                    at, data = at.as_py(), data.as_py()
                    if held and (at != start + len(held) or len(held) > _BYTES_AT_ONCE):
                        written += _put(place, held, start)
                        held = bytearray()
                    if not held:
                        start = at
                    held += data
            written += _put(place, held, start)
            os.fsync(place)
        finally:
            os.close(place)
        return Written(written)

    def commit(self, messages: list[Written | None]) -> None:
        open(self.staged, "ab").close()  # nothing to write may mean no task that writes
        size = sum(m.size for m in messages if m is not None)
        if size != self.size or os.path.getsize(self.staged) != size:
            self.abort(messages)
            raise OneFileError(f"{self.target}: {size} of {self.size} bytes were written")
        os.replace(self.staged, self.target)

    def abort(self, messages: list[Written | None]) -> None:
        if os.path.exists(self.staged):
            os.remove(self.staged)


def _put(place: int, data: bytearray, at: int) -> int:
    done = 0
    while done < len(data):
        done += os.pwrite(place, memoryview(data)[done:], at + done)
    return done


class OneFileSource(DataSource):
    """Options: ``staged``, ``target`` and ``size``, the bytes of the whole file."""

    @classmethod
    def name(cls) -> str:
        return "onefile"

    def writer(self, schema, overwrite: bool) -> OneFileWriter:  # noqa: ANN001
        return OneFileWriter(self.options["staged"], self.options["target"], int(self.options["size"]))


def placed(rows: DataFrame) -> tuple[DataFrame, int]:
    """``at, data`` of ordered rows ``place, fragment``, each ended by a line feed, and the bytes of all.

    The sorted ranges are written once; the bytes of each say where the next begins.
    """
    spark = rows.sparkSession
    ranges = session.keep(
        rows.orderBy("place").select(
            "place", F.concat("fragment", F.lit("\n")).cast("binary").alias("data"), F.spark_partition_id().alias("range")
        ),
        "fragments",
    )
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy("range").agg(F.sum(F.octet_length("data")).alias("n"))
    # one row for each range; there are as many as shuffle partitions
    starts = sizes.select("range", "n", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start")).collect()
    bounded = spark.createDataFrame([(r.range, r.start) for r in starts], "range int, start bigint")
    within = Window.partitionBy("range").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("start") + F.coalesce(F.sum(F.octet_length("data")).over(within), F.lit(0))
    return ranges.join(F.broadcast(bounded), "range").select(at.alias("at"), "data"), sum(r.n for r in starts)


def write_one(rows: DataFrame, path: str) -> None:
    """Write the texts of ``place, fragment`` in the order of their places, as the lines of one file.

    A file of that name is replaced when all is written, and not before.
    """
    fs, target = open_path(path if ":/" in path else os.path.abspath(path))
    if fs.type_name != "local":
        raise OneFileError(f"{path}: one file is written to a local or mounted path only")
    if os.path.isdir(target):
        raise OneFileError(f"{path} is a folder")
    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(OneFileSource)
    os.makedirs(os.path.dirname(target), exist_ok=True)
    places, size = placed(rows)
    staged = os.path.join(os.path.dirname(target), f".{os.path.basename(target)}.{uuid.uuid4().hex}")
    writer = places.write.format("onefile").mode("append")
    writer.options(staged=staged, target=target, size=str(size)).save()
