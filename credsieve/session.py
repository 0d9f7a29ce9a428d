"""Session helpers: the shared work folder, what is kept there, and dealing out unsplittable inputs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
_LOCAL_FOLDERS: dict[str, str] = {}
_MADE: list[str] = []


class WorkFolderError(RuntimeError):
    """There is no folder that all executors share."""


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new path inside the shared folder that the cluster names.

    Only with a local master, where driver and executors are one process, is a
    temporary folder used if the session names none.
    """
    root = spark.conf.get(CHECKPOINT_SETTING, None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise WorkFolderError(f"set {CHECKPOINT_SETTING} to a folder that all executors share")
        application = spark.conf.get("spark.app.id", "")
        if application not in _LOCAL_FOLDERS:
            _LOCAL_FOLDERS[application] = tempfile.mkdtemp(prefix="credsieve-")
        root = _LOCAL_FOLDERS[application]
    folder = f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    _MADE.append(folder)
    return folder


def discard(spark: SparkSession, folders: list[str]) -> None:
    """Delete work folders; tables that were read from them can no longer be used."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end all work folders that are made inside the block."""
    start = len(_MADE)
    try:
        yield
    finally:
        discard(spark, _MADE[start:])
        del _MADE[start:]


def spread(table: DataFrame, partitions: int) -> DataFrame:
    """Deal a table out to a number of tasks, for inputs that are stored in too few splits.

    Detection is bound by CPU, and one file without splits is one task.  All
    texts are shuffled, so a job that reads a splittable table does not ask for it.
    """
    return table.repartition(partitions)


def keep(rows: DataFrame, purpose: str) -> DataFrame:
    """Write rows once to the shared work folder and go on from there.

    For small results that several later steps read: nothing upstream runs
    twice, and a lost executor costs no more than reading the files again.
    """
    folder = work_folder(rows.sparkSession, purpose)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def is_columnar(table: DataFrame) -> bool:
    """The table is files of which each pass reads the columns it needs; nothing is computed from them."""
    plan = table._jdf.queryExecution().optimizedPlan()
    return plan.nodeName() == "LogicalRelation" and plan.relation().toString() in ("parquet", "orc")
