"""End-to-end jobs: whole scans and what follows them.

All jobs work on complete tables at once; there is no loop over repositories.
Texts are scanned where they lie.  Only findings, which are few, are shuffled to
meet the paths and labels they belong to.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credsieve import fixed_values as fixed
from credsieve import session
from credsieve.functions import paths
from credsieve.operators import baseline as accepted
from credsieve.operators import findings as found
from credsieve.operators import history, policy, tree
from credsieve.operators.detect import (
    FINDING_COLUMNS,
    ORDER_COLUMNS,
    PLACE_COLUMNS,
    UNIT_KEYS,
    DetectOptions,
    detect,
)
from credsieve.sources import files as file_source
from credsieve.sources import landed, listing


@dataclass(frozen=True)
class ScanOptions:
    """Options shared by all scans; user excludes add to the built-in ones."""

    branch: str | None = None
    excludes: str | Iterable[str] | None = None
    max_file_size_bytes: int = fixed.MAX_FILE_SIZE_BYTES
    max_commits: int = fixed.MAX_HISTORY_COMMITS
    detect: DetectOptions = field(default_factory=DetectOptions)

    def all_excludes(self) -> tuple[str, ...]:
        return fixed.DEFAULT_EXCLUDES + paths.glob_list(self.excludes)


@dataclass(frozen=True)
class ScanResult:
    """Findings, and one row for every repository that could not be scanned."""

    findings: DataFrame
    failures: DataFrame

    def kept(self) -> ScanResult:
        """The same tables, computed once and read from the shared work folder.

        Call it before findings go to several reports or into a baseline as well.
        """
        return ScanResult(
            session.keep(self.findings, "findings"), session.keep(self.failures, "failures")
        )

    def union(self, other: ScanResult) -> ScanResult:
        """Put two scans together; nothing is merged or dropped."""
        return ScanResult(
            self.findings.unionByName(other.findings),
            self.failures.unionByName(other.failures),
        )


def _entropy_excluded(options: ScanOptions) -> Column:
    entropy = options.detect.entropy
    globs = entropy.excluded_globs if entropy else ()
    return (F.col("detection_method") == "entropy") & paths.entropy_excluded(
        F.col("file_path"), globs
    )


def _once(hits: DataFrame, *unit: str) -> DataFrame:
    """Findings of units that may have been landed more than once: crawlers retry."""
    return hits.dropDuplicates([*unit, "line_number", "matched_text", *ORDER_COLUMNS])


def scan_units(units: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Scan a table of texts: ``repo, file_path, commit_sha, content``; ``unsearched`` tells what could not be."""
    return detect(units, options.detect).select(*FINDING_COLUMNS, *ORDER_COLUMNS)


def unsearched(units: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """``repo, file_path, commit_sha, error`` of the texts that could not be searched completely."""
    rows = detect(units, options.detect, errors=True).where(F.col("error").isNotNull())
    return rows.select(*UNIT_KEYS, "error").distinct()


def _searched(units: DataFrame, options: ScanOptions, keys: tuple[str, ...], path: str | None = "file_path") -> tuple[DataFrame, DataFrame]:
    """Findings, and the keys and ``error`` of units that could not be searched; both from one search, stored."""
    rows = session.keep(detect(units, options.detect, keys, path, errors=True), "hits")
    hits = rows.where(F.col("error").isNull()).drop("error")
    return hits, rows.where(F.col("error").isNotNull()).select(*keys, "error").distinct()


def _wanted(
    texts: DataFrame, keys: DataFrame, on: list[str], parse: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """The rows of ``texts`` that some key may ask for; landed payloads are parsed after that.

    Scans store them, because they read keys and contents in separate passes:
    nothing is parsed or decoded twice, neither for two passes nor for a
    condition that the planner moves ahead of what it is computed from.
    """
    rows = tree.only_wanted(texts, keys, on)
    return landed.parsed_late(rows, parse, on) if "payload" in texts.columns else rows


def _each_text_once(texts: DataFrame, on: list[str]) -> DataFrame:
    """Texts without repetitions; they are moved only if a key is there twice."""
    repeated = texts.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1")
    return texts if repeated.isEmpty() else texts.dropDuplicates()


def scan_trees(
    repos: DataFrame,
    branches: DataFrame,
    trees: DataFrame,
    blobs: DataFrame,
    options: ScanOptions = ScanOptions(),
    policies: DataFrame | None = None,
) -> ScanResult:
    """Scan the current tree of every repository of ``repos``.

    ``trees`` and ``blobs`` are parsed, or payloads as they were landed: of
    these, only what some head or path may want is parsed and decoded, and the
    items of a tree become rows without an array of them.

    Only blobs that some path wants are scanned, each once, whatever the number
    of its paths or of the times it was landed; its findings then join the
    paths.  Rules that depend on a path are applied after that.

    The texts of wanted blobs are stored, unless they are parsed and read as
    they lie from Parquet or ORC files.  The listing and the checks for lost
    and repeated blobs run when this is called, and so
    does the search if the catalogue has signatures whose search may fail; the
    repository of a text that cannot be searched fails.  ``policies`` exclude
    files of single repositories, see ``policy``.
    """
    heads = tree.with_heads(tree.targets(repos, options.branch), branches)
    rules = (options.all_excludes(), options.max_file_size_bytes)
    # Policies join while each repository is one row, so that one with very many
    # files is no hot key.
    ruled = lambda rows: policy.with_policy(rows, policies) if policies is not None else rows
    if "payload" in trees.columns:
        heads = session.keep(heads, "heads")
        asked = tree.only_wanted(trees, heads.where("commit_sha is not null"), ["repo", "commit_sha"])
        listed = session.keep(tree.with_tree_states(heads, landed.tree_states(asked)), "listed")
        chosen = tree.files_of_items(ruled(listed), landed.tree_items(asked), *rules)
    else:
        listed = tree.with_trees(heads, trees)
        chosen = tree.tree_files(ruled(listed), *rules)
    files = session.keep(chosen, "files")
    if policies is not None:
        files = session.keep(policy.unexcluded(files, policies), "files")
    known = _wanted(blobs, files, ["repo", "sha"], landed.parse_blobs)
    if "payload" in blobs.columns or not session.is_columnar(blobs):
        known = session.keep(known, "wanted")
    sound = known.where(tree.valid_rows(known))
    lost = session.keep(tree.missing(files, sound, ["repo", "sha"], tree.BLOB_ERROR), "lost")
    wanted = files.join(lost.select("repo"), "repo", "left_anti")
    scanned = _each_text_once(sound.select("repo", "sha", "content"), ["repo", "sha"])
    if options.detect.deep:
        hits, unfit = _searched(scanned, options, ("repo", "sha"), None)
        odd = session.keep(wanted.join(unfit, ["repo", "sha"]).select("repo", "branch", "error").distinct(), "unfit")
        lost = lost.unionByName(odd)
        wanted = wanted.join(odd.select("repo").distinct(), "repo", "left_anti")
    else:
        hits = detect(scanned, options.detect, ("repo", "sha"), None)
    findings = (
        _once(hits, "repo", "sha")
        .join(wanted, ["repo", "sha"])
        .where(~_entropy_excluded(options))
        .withColumn("commit_pos", F.lit(None).cast("int"))
        .select(*FINDING_COLUMNS, *PLACE_COLUMNS, *ORDER_COLUMNS)
    )
    return ScanResult(findings, tree.failures_of(listed).unionByName(lost))


def scan_histories(
    repos: DataFrame,
    commits: DataFrame,
    commit_files: DataFrame,
    options: ScanOptions = ScanOptions(),
) -> ScanResult:
    """Scan the lines added by the newest commits of every target branch.

    ``commit_files`` are parsed records, or payloads as they were landed: of
    these, only commits that some branch may want are parsed.

    A branch whose listing was landed and is empty has no findings; one without
    a listing fails, and so does one of which a page or a commit cannot be read
    or is missing.  A commit with a patch that cannot be searched completely
    (hunks too far apart for a match or a line number) fails its branch.

    The commit files that some branch may want are stored when this is called,
    and read twice: their keys, to find lost ones, and their patches, to be
    searched; findings are stored.
    """
    pages = commits.groupBy("repo", "branch").agg(F.bool_and(tree.valid_rows(commits)).alias("sound"))
    problem = F.when(F.col("sound").isNull(), tree.COMMITS_ERROR).when(~F.col("sound"), tree.COMMITS_PAGE_ERROR)
    listed = tree.targets(repos, options.branch).join(pages, ["repo", "branch"], "left").withColumn(
        "error", F.coalesce("error", problem)
    )
    newest = session.keep(history.newest_commits(commits, options.max_commits), "newest")
    gapped = history.gapped_listings(commits, newest).withColumn("gap", F.lit(tree.COMMITS_GAP_ERROR))
    listed = session.keep(
        listed.join(gapped, ["repo", "branch"], "left").withColumn("error", F.coalesce("error", "gap")).drop("gap"), "listed"
    )
    wanted = session.keep(
        listed.where(F.col("error").isNull())
        .select("repo", "branch", "repo_pos")
        .join(newest.drop("listed_at"), ["repo", "branch"])
        .withColumnRenamed("pos", "commit_pos"),
        "commits",
    )
    # Nothing of a commit is parsed that no branch has among its newest.
    records = session.keep(_wanted(commit_files, wanted, ["repo", "commit_sha"], landed.parse_commit_files), "wanted")
    sound = records.where(tree.valid_rows(records))
    changed = sound.select(
        "repo", "commit_sha", F.posexplode_outer("files").alias("file_ord", "file")
    ).select(
        "repo",
        "commit_sha",
        "file_ord",
        F.col("file.filename").alias("file_path"),
        F.col("file.patch").alias("patch"),
    )
    units = history.history_units(changed, options.all_excludes())
    keys = ("repo", "commit_sha", "file_path", "file_ord")
    hits, unfit = _searched(units, options, keys)
    lost = session.keep(
        tree.missing(wanted, sound, ["repo", "commit_sha"], tree.COMMIT_FILES_ERROR).unionByName(
            wanted.join(unfit.select("repo", "commit_sha", "error").distinct(), ["repo", "commit_sha"])
            .select("repo", "branch", "error")
            .distinct()
        ),
        "lost",
    )
    hits = _once(hits, *keys)
    complete = wanted.join(lost.select("repo"), "repo", "left_anti").drop("branch")
    findings = (
        hits.join(complete, ["repo", "commit_sha"])
        .withColumn("unit_ord", F.col("file_ord"))
        .select(*FINDING_COLUMNS, *PLACE_COLUMNS, *ORDER_COLUMNS)
    )
    return ScanResult(findings, tree.failures_of(listed).unionByName(lost))


def scan_folder(
    spark: SparkSession, root: str, options: ScanOptions = ScanOptions()
) -> DataFrame:
    """Findings of a file or directory; see ``scan_tree_of_files``."""
    return scan_tree_of_files(spark, root, options).findings


def scan_tree_of_files(
    spark: SparkSession, root: str, options: ScanOptions = ScanOptions(), lister: listing.Lister | None = None
) -> ScanResult:
    """Scan a file or directory, whose normalised path is the repository label.

    With a ``lister``, ``root`` is the place of an object store whose keys it
    lists in pages (see ``sources.listing``).

    A file that is gone or may not be read is a row of ``failures``, with its
    path in ``branch``; any other error of the file system fails the job.  Files
    are listed and read when this is called, each once.
    """
    if options.max_file_size_bytes < 0:
        raise ValueError("a file size limit below 0 leaves nothing to scan")
    label = file_source.normalised(root)
    if lister is None:
        files = file_source.list_files(spark, root)
    else:
        files = listing.list_keys(spark, lister, base=root.rstrip("/") + "/")
    kept = files.where(
        ~paths.matches_any_glob(F.col("file_path"), options.all_excludes())
        & (F.coalesce("size", F.lit(0)) <= options.max_file_size_bytes)
    )
    # a file without a text has a reason, or is no text and has nothing to find
    units = file_source.read_once(kept).select(
        F.lit(label).alias("repo"), "file_path", F.lit("").alias("commit_sha"), "content", F.col("reason").alias("problem")
    )
    hits, unfit = _searched(units, options, UNIT_KEYS)
    failures = unfit.select("repo", F.col("file_path").alias("branch"), "error")
    return ScanResult(hits.select(*FINDING_COLUMNS, *ORDER_COLUMNS), failures)


def finish(
    findings: DataFrame, baseline: DataFrame | None = None, severity: str | None = None
) -> DataFrame:
    """What is reported: not in the baseline and confident enough."""
    kept = accepted.unaccepted(findings, baseline) if baseline is not None else findings
    return found.at_least(kept, severity)


def take_snapshot(findings: DataFrame) -> DataFrame:
    """Baseline of a scan: all its findings, whatever their severity."""
    return accepted.snapshot(findings)
