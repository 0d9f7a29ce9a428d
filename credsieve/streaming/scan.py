"""The same detection on a stream of texts.

Detection is row-local, so a stream of scan units needs no state and no
watermark; a stored baseline joins it as a static table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from credsieve.plans.jobs import ScanOptions, finish, scan_units


def scan_stream(
    units: DataFrame,
    options: ScanOptions = ScanOptions(),
    baseline: DataFrame | None = None,
    severity: str | None = None,
) -> DataFrame:
    """Streaming findings of a streaming DataFrame of scan units."""
    return finish(scan_units(units, options), baseline, severity)


def write_findings(
    findings: DataFrame, path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Append findings as parquet files, exactly once."""
    writer = findings.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.outputMode("append").start(path)
