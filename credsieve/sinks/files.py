"""Write rows as files of their own, for tools that read folders."""

from __future__ import annotations

from collections.abc import Iterator
from posixpath import dirname

import pyarrow as pa
from pyspark.sql import DataFrame

from credsieve.sources.files import open_path


def write_files(files: DataFrame, folder: str) -> None:
    """Write ``data`` to ``file_path`` below ``folder``, one file per row.

    A retried task writes the same bytes to the same names again.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_path(folder)
        made = set()
        for batch in batches:
            for row in batch.to_pylist():
                target = f"{root}/{row['file_path']}"
                if dirname(target) not in made:
                    fs.create_dir(dirname(target), recursive=True)
                    made.add(dirname(target))
                with fs.open_output_stream(target) as stream:
                    stream.write(row["data"])
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    rows = files.select("file_path", "data").mapInArrow(write, "n bigint")
    rows.write.format("noop").mode("overwrite").save()
