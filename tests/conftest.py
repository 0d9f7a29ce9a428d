import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("credsieve-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def units(spark):
    """Scan units from contents or (path, content) pairs."""

    def build(*items):
        rows = []
        for i, item in enumerate(items):
            path, content = item if isinstance(item, tuple) else (f"f{i}.txt", item)
            rows.append(("o/r", path, "c0", content))
        return spark.createDataFrame(
            rows, "repo string, file_path string, commit_sha string, content string"
        )

    return build
