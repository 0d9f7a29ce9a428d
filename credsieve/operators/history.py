"""Lines added by commits, as sparse texts that keep their line numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credsieve import fixed_values as fixed
from credsieve.functions import paths, text

HUNK_ERROR = "patch with an unreadable line number"
_ADDED_LINE = "array<struct<line_number:bigint,pos:int,line:string>>"
# More digits than a 64-bit number has, leading zeros aside.
_UNREADABLE_HUNK = r"(?m)^@@ [^+\n]*\+0*[1-9][0-9]{18,}[, ]"


def newest_commits(
    commits: DataFrame, max_commits: int = fixed.MAX_HISTORY_COMMITS
) -> DataFrame:
    """The newest commits of every branch; position 0 is the newest.

    A listing is read page by page, and what is pushed meanwhile moves commits
    to later pages: one that is on two pages counts once, at its least position,
    and positions are numbered anew without it.  ``listed_at`` is the position
    in the listing.  Spark keeps at most ``max_commits`` rows per branch and
    task before the window, so a branch with very many commits costs no more
    than others.
    """
    if max_commits < 1:
        raise ValueError("max_commits must be >= 1")
    newest = Window.partitionBy("repo", "branch").orderBy("listed_at", "commit_sha")
    once = commits.where("commit_sha is not null").groupBy("repo", "branch", "commit_sha").agg(F.min("pos").alias("listed_at"))
    return (
        once.withColumn("rank", F.row_number().over(newest))
        .where(F.col("rank") <= max_commits)
        .select("repo", "branch", (F.col("rank") - 1).alias("pos"), "commit_sha", "listed_at")
    )


def gapped_listings(commits: DataFrame, newest: DataFrame) -> DataFrame:
    """``repo, branch`` of the listings of which a page is missing ahead of some of the newest commits."""
    last = newest.groupBy("repo", "branch").agg(F.max("listed_at").alias("last"))
    seen = commits.join(last, ["repo", "branch"]).where(F.col("pos") <= F.col("last"))
    counted = seen.groupBy("repo", "branch", "last").agg(F.count_distinct("pos").alias("n"))
    return counted.where(F.col("n") <= F.col("last")).select("repo", "branch")


def _hunk_lines(hunk: Column, hunk_index: Column) -> Column:
    """Added lines of one hunk.

    The position of a line among those that exist in the new file is its offset
    from the start named in the header; all other lines are dropped first.  A
    start that no 64-bit number holds places nothing: see ``unreadable``.
    """
    start = F.regexp_extract(hunk, fixed.HUNK_HEADER_FORMAT, 1).try_cast("bigint")
    body = F.slice(F.split(hunk, "\n", -1), 2, F.char_length(hunk))
    in_new_file = F.filter(
        body, lambda line: ~line.startswith("-") & ~line.startswith("\\") & ~line.startswith("+++")
    )
    numbered = F.transform(
        in_new_file,
        lambda line, offset: F.struct(
            (start + offset).alias("line_number"),
            hunk_index.alias("pos"),
            line.alias("line"),
        ),
    )
    # A malformed header may place a line ahead of line 1; no file has it.
    return F.filter(
        numbered, lambda row: row["line"].startswith("+") & (row["line_number"] >= 1)
    )


def added_lines(patches: DataFrame, patch: str = "patch") -> DataFrame:
    """Replace ``patch`` by ``content`` and ``line_nos``, the lines it adds.

    ``content`` holds only the added lines, ``line_nos`` their numbers in the
    new file.  The work stays inside the row.  Patches that add nothing vanish,
    unless they have a ``problem``: then they stay, without a text.
    """
    others = [c for c in patches.columns if c != patch]
    problem = F.col("problem") if "problem" in others else F.lit(None)
    header = f"(?md)(?={fixed.HUNK_HEADER_FORMAT})"
    unified = F.when(
        F.col(patch).rlike(text.ODD_BREAKS),
        F.regexp_replace(F.col(patch), text.LINE_BREAK, "\n"),
    ).otherwise(F.col(patch))
    hunks = F.filter(
        F.split(unified, header, -1), lambda h: h.rlike(r"\A" + fixed.HUNK_HEADER_FORMAT[1:])
    )
    rows = (
        patches.withColumn("hunks", hunks)
        .withColumn("added", F.flatten(F.transform("hunks", _hunk_lines)).cast(_ADDED_LINE))
        # Sorted by line, then hunk: where hunks overlap, the later one wins.
        .withColumn("added", F.sort_array("added"))
        .withColumn(
            "added",
            F.filter(
                "added",
                lambda row, i: F.coalesce(
                    F.get(F.col("added"), i + 1)["line_number"] != row["line_number"],
                    F.lit(True),
                ),
            ),
        )
    )
    lines = F.transform(
        "added", lambda row: F.substring(row["line"], 2, F.char_length(row["line"]))
    )
    sound = problem.isNull()
    unit = F.struct(
        F.when(sound, F.array_join(lines, "\n")).alias("content"),
        F.when(sound, F.col("added.line_number")).otherwise(F.array().cast("array<bigint>")).alias("line_nos"),
    )
    # A filter on ``added`` would be pushed down and compute it a second time;
    # a filter on the output of a generator is not.
    return rows.select(
        *others, F.inline_outer(F.when(~sound | (F.size("added") > 0), F.array(unit)))
    ).where(F.col("line_nos").isNotNull())


def unreadable(patch: Column) -> Column:
    """Some hunk of the patch starts at a line number that is too long to be read."""
    return F.coalesce(patch.rlike(_UNREADABLE_HUNK), F.lit(False))


def history_units(
    commit_files: DataFrame, excludes: tuple[str, ...] = fixed.DEFAULT_EXCLUDES
) -> DataFrame:
    """Commit files to scan units: no null patches, no excluded paths.

    One with a line number that cannot be read is a unit without a text, and
    with a ``problem``.
    """
    kept = commit_files.where(
        F.col("patch").isNotNull() & ~paths.matches_any_glob(F.col("file_path"), excludes)
    )
    return added_lines(kept.withColumn("problem", F.when(unreadable(F.col("patch")), F.lit(HUNK_ERROR))))
