"""Accepted findings: taking a snapshot of them and suppressing them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.operators.findings import with_fingerprint


def snapshot(findings: DataFrame) -> DataFrame:
    """One row per fingerprint, the content of a baseline.

    The other columns follow from the fingerprint, so any row of a group serves
    and the groups are reduced before they are shuffled.
    """
    return (
        with_fingerprint(findings)
        .groupBy("fingerprint")
        .agg(
            F.min("repo").alias("repo"),
            F.min("file_path").alias("file_path"),
            F.min("pattern_name").alias("pattern_name"),
        )
    )


def unaccepted(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Drop the findings whose fingerprint the baseline holds.

    No broadcast hint: a baseline has no size bound.  Below the session's
    broadcast threshold Spark broadcasts it, above it both sides are shuffled.
    """
    accepted = baseline.select("fingerprint").where(F.col("fingerprint").isNotNull()).distinct()
    return with_fingerprint(findings).join(accepted, "fingerprint", "left_anti")
