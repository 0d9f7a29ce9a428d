"""Reports: JSON lines, SARIF, HTML, failures, baselines.

A SARIF or HTML report is one document for all findings, made of ordered
fragments: an opening, one row per finding, a closing.  The fragments are
written in order and joined by line feeds they are the document, so no row holds
more than one finding whatever the size of the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credsieve import fixed_values as fixed
from credsieve.functions import text
from credsieve.operators import baseline as accepted
from credsieve.operators.detect import FINDING_COLUMNS
from credsieve.operators.findings import confidence_level, finding_order, numbered, with_fingerprint
from credsieve.sinks import onefile

TOOL_NAME = "credsieve"
REPORT_TITLE = "Credential exposure report"
#: Columns of the HTML table, in order; the names of their headings.
HTML_COLUMNS = {
    "confidence": "Confidence",
    "detection_method": "Method",
    "pattern_name": "Pattern",
    "repo": "Repository",
    "file_path": "File",
    "line_number": "Line",
    "entropy_score": "Entropy",
    "matched_text": "Match",
    "commit_sha": "Commit",
}
_CODE = ("matched_text", "commit_sha")


# --- rows -------------------------------------------------------------------


def json_rows(findings: DataFrame) -> DataFrame:
    """One JSON object per finding, fields in alphabetical order."""
    return findings.select(F.to_json(F.struct(*sorted(FINDING_COLUMNS))).alias("finding"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """The scalar content of SARIF results, one row per finding."""
    place = ["place"] if "place" in findings.columns else []
    return with_fingerprint(findings).select(
        *place,
        "repo",
        text.rule_slug(F.col("pattern_name"), F.col("detection_method")).alias("rule_id"),
        confidence_level(F.col("confidence")).alias("level"),
        F.concat(
            "pattern_name", F.lit(" detected via "), "detection_method", F.lit(" in "), "repo",
            F.lit("."),
        ).alias("message"),
        F.col("file_path").alias("uri"),
        F.col("line_number").alias("start_line"),
        "fingerprint",
    )


def sarif_rules(findings: DataFrame) -> DataFrame:
    """Distinct rules; the first finding of a rule decides its name and level."""
    first = F.min_by(F.struct("pattern_name", "confidence"), finding_order(findings))
    return (
        findings.groupBy(
            text.rule_slug(F.col("pattern_name"), F.col("detection_method")).alias("rule_id")
        )
        .agg(first.alias("first"))
        .select(
            "rule_id",
            F.col("first.pattern_name").alias("name"),
            confidence_level(F.col("first.confidence")).alias("level"),
        )
    )


def html_row() -> Column:
    """One finding as a table row, every text escaped."""

    def cell(name: str) -> Column:
        if name == "entropy_score":
            shown = text.two_decimals(F.col(name))
        elif name == "line_number":
            shown = F.col(name).cast("string")
        else:
            shown = text.html_escape(F.col(name))
        tags = ("<td><code>", "</code></td>") if name in _CODE else ("<td>", "</td>")
        return F.concat(F.lit(tags[0]), shown, F.lit(tags[1]))

    return F.concat(F.lit("<tr>"), *map(cell, HTML_COLUMNS), F.lit("</tr>"))


def html_rows(findings: DataFrame) -> DataFrame:
    return findings.select("repo", html_row().alias("html"))


def failure_rows(failures: DataFrame) -> DataFrame:
    message = F.concat(
        F.lit("Warning: skipped "), "repo", F.lit("@"), "branch", F.lit(": "), "error"
    )
    return failures.select("repo", "branch", "error", message.alias("message"))


# --- documents ----------------------------------------------------------------


def _framed(rows: DataFrame, opening: DataFrame, closing: str) -> DataFrame:
    """``place, fragment``: the rows between an opening (one row) and a closing."""
    last = rows.agg(F.coalesce(F.max("place"), F.lit(0)) + 1).toDF("place").withColumn("fragment", F.lit(closing))
    return opening.select(F.lit(0).cast("bigint").alias("place"), "fragment").unionByName(rows).unionByName(last)


def json_fragments(places: DataFrame) -> DataFrame:
    """Numbered findings as JSON objects, rows ``place, fragment``."""
    return places.select("place", F.to_json(F.struct(*sorted(FINDING_COLUMNS))).alias("fragment"))


def sarif_fragments(places: DataFrame) -> DataFrame:
    """The SARIF document of numbered findings, as rows ``place, fragment``.

    Without findings it is a document without results, as for a clean scan.
    """
    results = sarif_results(places)
    location = F.struct(
        F.struct(
            F.struct("uri").alias("artifactLocation"), F.struct(F.col("start_line").alias("startLine")).alias("region")
        ).alias("physicalLocation")
    )
    result = F.struct(
        F.array(location).alias("locations"),
        "level",
        F.struct(F.col("message").alias("text")).alias("message"),
        F.struct(F.col("fingerprint").alias(fixed.SARIF_FINGERPRINT_KEY)).alias("partialFingerprints"),
        F.col("rule_id").alias("ruleId"),
    )
    comma = F.when(F.col("place") > 1, ",").otherwise("")
    rows = results.select("place", F.concat(comma, F.to_json(result)).alias("fragment"))
    rule = F.struct(
        F.col("rule_id").alias("id"),
        "name",
        F.struct(F.col("name").alias("text")).alias("shortDescription"),
        F.struct("level").alias("defaultConfiguration"),
    )
    # there are never more rules than signatures
    rules = sarif_rules(places).agg(F.to_json(F.array_sort(F.collect_list(rule))).alias("rules"))
    before = f'{{"$schema":"{fixed.SARIF_SCHEMA}","version":"{fixed.SARIF_VERSION}","runs":[{{"tool":{{"driver":{{"name":"{TOOL_NAME}","rules":'
    opening = rules.select(F.concat(F.lit(before), "rules", F.lit('}},"results":[')).alias("fragment"))
    return _framed(rows, opening, "]}]}")


def html_fragments(places: DataFrame) -> DataFrame:
    """The HTML page of numbered findings, as rows ``place, fragment``; it says so if there are none."""
    headings = "".join(f"<th>{heading}</th>" for heading in HTML_COLUMNS.values())
    start = (
        f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{REPORT_TITLE}</title></head>'
        f"<body><h1>{REPORT_TITLE}</h1><table><thead><tr>{headings}</tr></thead><tbody>"
    )
    nothing = f'<tr><td colspan="{len(HTML_COLUMNS)}">{fixed.EMPTY_REPORT_TEXT}</td></tr>'
    count = places.limit(1).agg(F.count("*").alias("n"))
    opening = count.select(F.concat(F.lit(start), F.when(F.col("n") == 0, nothing).otherwise("")).alias("fragment"))
    return _framed(places.select("place", html_row().alias("fragment")), opening, "</tbody></table></body></html>")


# --- writers -------------------------------------------------------------------


def write_report(findings: DataFrame, output_format: str, path: str) -> None:
    """Write findings as ``json``, ``sarif`` or ``html`` files under ``path``.

    The files of a SARIF or HTML report, in the order of their names, are one
    document.  The scan behind the findings runs once, when they are numbered.
    """
    if output_format == "json":
        findings.select(*sorted(FINDING_COLUMNS)).write.json(path)
        return
    _fragments(findings, output_format).orderBy("place").select("fragment").write.text(path)


def write_report_file(findings: DataFrame, output_format: str, path: str) -> None:
    """Write findings as one ``json`` (lines), ``sarif`` or ``html`` file, in finding order.

    The file appears when it is whole; a job that fails leaves nothing, and what
    was there before as it was.  The path is a local or mounted one (see
    ``onefile``).
    """
    onefile.write_one(_fragments(findings, output_format), path)


def _fragments(findings: DataFrame, output_format: str) -> DataFrame:
    shapes = {"json": json_fragments, "sarif": sarif_fragments, "html": html_fragments}
    if output_format not in shapes:
        raise ValueError(f"there is no report format {output_format!r}; choose json, sarif or html")
    return shapes[output_format](numbered(findings))


def write_baseline(findings: DataFrame, path: str) -> None:
    """Accept all findings: one JSON entry per line, sorted within each file."""
    entries = accepted.snapshot(findings).select(
        "file_path", "fingerprint", "pattern_name", "repo"
    )
    entries.sortWithinPartitions("fingerprint").write.json(path)


def write_failures(failures: DataFrame, path: str) -> None:
    failure_rows(failures).write.json(path)

