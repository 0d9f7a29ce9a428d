"""Stored tables as inputs: scan units, baselines."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class BaselineError(ValueError):
    """The baseline cannot be used."""


def _column(value: str | Column, empty: str = "") -> Column:
    return F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(empty))


def as_scan_units(
    table: DataFrame,
    content: str | Column,
    repo: str | Column = "",
    file_path: str | Column = "",
    commit_sha: str | Column = "",
) -> DataFrame:
    """Label any text column for scanning; an empty label stands for ``''``."""

    def label(value: str | Column) -> Column:
        return F.lit("") if isinstance(value, str) and value == "" else _column(value)

    text = F.col(content) if isinstance(content, str) else content
    return table.select(
        label(repo).cast("string").alias("repo"),
        label(file_path).cast("string").alias("file_path"),
        label(commit_sha).cast("string").alias("commit_sha"),
        text.alias("content"),
    )


BASELINE_FORMS = ("lines", "document")
_OPTIONS = {"maxStringLen": "2147483647"}


def load_baseline(spark: SparkSession, path: str, form: str = "lines") -> DataFrame:
    """Distinct accepted fingerprints of a baseline.

    ``lines`` is what ``sinks.reports`` writes: a folder or file with one JSON
    entry per line, of any number.  ``document`` is a single JSON document
    ``{"accepted": [entries]}``.  Entries that are no objects, or without a text
    as fingerprint, accept nothing and are ignored; a document that is no JSON
    or has no such list is an error.
    """
    if form not in BASELINE_FORMS:
        raise ValueError(f"a baseline is one of {', '.join(BASELINE_FORMS)}, not {form!r}")
    try:
        if form == "lines":
            entries = spark.read.text(path).select(F.from_json("value", "variant", _OPTIONS).alias("entry"))
        else:
            entries = _accepted(spark, path)
    except AnalysisException as problem:
        raise BaselineError(f"there is no baseline at {path}") from problem
    is_text = F.expr("schema_of_variant(try_variant_get(entry, '$.fingerprint', 'variant'))") == "STRING"
    fingerprint = F.when(is_text, F.expr("try_variant_get(entry, '$.fingerprint', 'string')"))
    return entries.select(fingerprint.alias("fingerprint")).where("fingerprint is not null").distinct()


def _accepted(spark: SparkSession, path: str) -> DataFrame:
    document = spark.read.options(multiLine=True, columnNameOfCorruptRecord="broken", **_OPTIONS).schema(
        "accepted variant, broken string"
    ).json(path)
    listed = document.select("broken", F.expr("try_variant_get(accepted, '$', 'array<variant>')").alias("accepted"))
    state = listed.agg(F.count("*").alias("n"), F.count("broken").alias("bad"), F.count("accepted").alias("lists")).head()
    if state.bad or not state.n:
        raise BaselineError(f"the baseline is no JSON document: {path}")
    if state.lists < state.n:
        raise BaselineError(f"the baseline has no list of accepted findings: {path}")
    return listed.select(F.explode("accepted").alias("entry"))
