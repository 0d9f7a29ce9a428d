"""Column functions on paths and repository names."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from credsieve import fixed_values as fixed
from credsieve.functions.pyregex import to_java
from credsieve.functions.text import strip_space


def normalise(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    """Last component, ignoring trailing slashes and '.' components."""
    trimmed = F.regexp_replace(path, r"(?:/\.?)+\z|\A\.\z", "")
    return F.regexp_extract(trimmed, r"[^/]*\z", 0)


def suffix(path: Column) -> Column:
    return F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1)


def glob_pattern(globs: Iterable[str]) -> str:
    """One anchored JVM pattern that matches when any of the globs does."""
    bodies = [to_java(fnmatch.translate(g)) for g in globs]
    return r"\A(?:" + "|".join(bodies) + ")" if bodies else ""


def matches_any_glob(path: Column, globs: Iterable[str]) -> Column:
    """Any glob matches the whole path or its last component."""
    pattern = glob_pattern(globs)
    if not pattern:
        return F.lit(False)
    clean = normalise(path)
    return clean.rlike(pattern) | basename(clean).rlike(pattern)


def parse_globs(raw: Column) -> Column:
    """Comma-separated text to an array of trimmed, non-empty globs."""
    pieces = F.transform(F.split(F.coalesce(raw, F.lit("")), ","), strip_space)
    return F.filter(pieces, lambda p: p != "")


def glob_list(raw: str | Iterable[str] | None) -> tuple[str, ...]:
    """The same rule for an option given on the driver."""
    if raw is None:
        return ()
    pieces = raw.split(",") if isinstance(raw, str) else raw
    return tuple(p.strip() for p in pieces if p.strip())


@F.pandas_udf(StringType())
def policy_pattern(globs: pd.Series) -> pd.Series:
    """Glob arrays of a policy table to one JVM pattern per policy row."""
    return globs.map(lambda g: glob_pattern(g) if g is not None and len(g) else None)


def entropy_excluded(
    path: Column, globs: Iterable[str] = fixed.ENTROPY_EXCLUDED_GLOBS
) -> Column:
    clean = normalise(path)
    by_suffix = F.lower(suffix(clean)).isin(*fixed.ENTROPY_EXCLUDED_SUFFIXES)
    return by_suffix | matches_any_glob(path, globs)


def in_pruned_directory(path: Column) -> Column:
    """Any directory above the file is one of the always-pruned ones."""
    parts = F.split(path, "/")
    parents = F.slice(parts, 1, F.size(parts) - 1)
    return F.exists(
        parents,
        lambda d: d.isin(*fixed.PRUNED_DIRECTORIES)
        | d.endswith(fixed.PRUNED_DIRECTORY_SUFFIX),
    )


def walk_order(path: Column) -> Column:
    """Sort key: the files of a directory before its sub-directories."""
    parts = F.split(path, "/")
    return F.transform(
        parts,
        lambda p, i: F.concat(F.when(i == F.size(parts) - 1, "0").otherwise("1"), p),
    )


def within_size(size: Column, limit: int = fixed.MAX_FILE_SIZE_BYTES) -> Column:
    """Unknown sizes pass; the limit itself is still allowed."""
    if limit < 0:
        raise ValueError("a file size limit below 0 leaves nothing to scan")
    return size.isNull() | (size <= F.lit(limit))


def repo_parts(full_name: Column) -> Column:
    return F.transform(F.split(full_name, "/"), strip_space)


def valid_repo_name(full_name: Column) -> Column:
    parts = repo_parts(full_name)
    ok = (F.size(parts) == 2) & F.forall(parts, lambda p: p != "")
    return F.coalesce(ok, F.lit(False))


def repo_label(full_name: Column) -> Column:
    """``owner/repo`` with the blanks around both parts removed."""
    return F.array_join(repo_parts(full_name), "/")


def target_branch(default_branch: Column, branch: str | None = None) -> Column:
    """The explicit branch, else the repository's default, else the fallback."""
    chosen = F.lit(branch or None).cast("string")
    return F.coalesce(
        chosen, F.nullif(default_branch, F.lit("")), F.lit(fixed.FALLBACK_BRANCH)
    )
