"""Operators on findings: fingerprints, severity, counts, gate, order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credsieve import fixed_values as fixed
from credsieve import session
from credsieve.functions import paths, text
from credsieve.operators.detect import ORDER_COLUMNS, PLACE_COLUMNS


def literal_case(key: Column, table: dict) -> Column:
    """Look a short fixed table up with a CASE expression."""
    items = list(table.items())
    chosen = F.when(key == items[0][0], items[0][1])
    for name, value in items[1:]:
        chosen = chosen.when(key == name, value)
    return chosen


def confidence_rank(confidence: Column) -> Column:
    return literal_case(confidence, fixed.CONFIDENCE_RANK)


def confidence_level(confidence: Column) -> Column:
    return literal_case(confidence, fixed.CONFIDENCE_LEVEL)


def with_fingerprint(findings: DataFrame) -> DataFrame:
    key = text.fingerprint(
        F.col("repo"),
        F.col("file_path"),
        F.col("line_number"),
        F.col("detection_method"),
        F.col("pattern_name"),
        F.col("matched_text"),
    )
    return findings.withColumn("fingerprint", key)


def at_least(findings: DataFrame, severity: str | None) -> DataFrame:
    """Keep findings of at least this confidence; None keeps all."""
    if severity is None:
        return findings
    if severity not in fixed.CONFIDENCE_RANK:
        raise ValueError(f"unsupported severity: {severity}")
    return findings.where(
        confidence_rank(F.col("confidence")) >= fixed.CONFIDENCE_RANK[severity]
    )


def summary(findings: DataFrame) -> DataFrame:
    """One row: the number of findings and the sentence that reports it."""
    count = F.col("n_findings")
    sentence = (
        F.when(count == 0, fixed.EMPTY_REPORT_TEXT)
        .when(count == 1, "1 potential secret found.")
        .otherwise(F.concat(count.cast("string"), F.lit(" potential secrets found.")))
    )
    return findings.agg(F.count("*").alias("n_findings")).withColumn("summary", sentence)


def gate_status(
    findings: DataFrame, failures: DataFrame | None = None, fail_on_findings: bool = False
) -> DataFrame:
    """One row with both counts and the status: 2 for failures, then 3, then 0.

    Both inputs are reduced to a single row before they meet.
    """
    counts = findings.agg(
        F.count("*").alias("n_findings"), F.lit(0).cast("bigint").alias("n_failures")
    )
    if failures is not None:
        counts = counts.unionByName(
            failures.agg(
                F.lit(0).cast("bigint").alias("n_findings"), F.count("*").alias("n_failures")
            )
        ).agg(F.sum("n_findings").alias("n_findings"), F.sum("n_failures").alias("n_failures"))
    found = F.lit(fail_on_findings) & (F.col("n_findings") > 0)
    return counts.withColumn(
        "status", F.when(F.col("n_failures") > 0, 2).when(found, 3).otherwise(0)
    )


def finding_order(findings: DataFrame) -> Column:
    """The one order of findings, as a value to sort or compare by.

    Repositories as they were listed, then the newest commit first, then files
    as in the tree or commit (else as a walk visits them), then detector,
    pattern, match.  What a scan does not know is ordered by name.
    """
    known = {
        c: F.coalesce(F.col(c).cast("bigint"), F.lit(1 << 62)) if c in findings.columns else F.lit(1 << 62)
        for c in PLACE_COLUMNS
    }
    repo_pos, commit_pos, unit_ord = (column.alias(c) for c, column in known.items())
    walk = paths.walk_order(F.col("file_path")).alias("walk")
    return F.struct(repo_pos, "repo", commit_pos, unit_ord, walk, "commit_sha", *ORDER_COLUMNS)


def ordered(findings: DataFrame, unit: Sequence[str | Column] | None = None) -> DataFrame:
    """Sort for an ordered sink: by ``unit`` and then the match, or in finding order."""
    order = [finding_order(findings)] if unit is None else [*unit, *ORDER_COLUMNS]
    return findings.orderBy(*order)


def numbered(findings: DataFrame, unit: Sequence[str | Column] | None = None) -> DataFrame:
    """Findings with ``place``, their number in finding order from 1 on.

    The findings are written first, since a sort reads what it sorts twice, for
    the bounds of its ranges as well, and the scan behind them is far more than
    they are.  The sorted ranges are written once, counted, and each is numbered
    from where the ranges before it end, so no task sees more than its own range.
    """
    spark = findings.sparkSession
    ranges = session.keep(
        ordered(session.keep(findings, "findings"), unit)
        .withColumn("range", F.spark_partition_id())
        .withColumn("row", F.monotonically_increasing_id()),
        "ordered",
    )
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy("range").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    # one row for each range; there are as many as shuffle partitions
    starts = sizes.select("range", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    bounded = spark.createDataFrame(starts.collect(), starts.schema)
    place = F.col("row") - F.col("first") + F.col("start") + 1
    return ranges.join(F.broadcast(bounded), "range").withColumn("place", place).drop("range", "row", "first", "start")
