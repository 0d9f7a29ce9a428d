"""Exclusion by tables of globs, against a plain loop over fnmatch."""

import fnmatch
import posixpath
import random

import pytest

from credsieve.operators import policy

FILES = "repo string, file_path string"


def base(path):
    parts = [p for p in path.split("/") if p not in ("", ".")]
    return parts[-1] if parts else ""


def fits(path, glob):
    clean = path.replace("\\", "/")
    return any(fnmatch.fnmatchcase(p, glob) for p in (clean, base(clean)))


def remaining(rows, globs):
    return sorted(
        ((r, p) for r, p in rows if p is None or not any(g and fits(p, g) for q, g in globs if q == r and r is not None)),
        key=str,
    )


def applied(spark, rows, globs):
    left = policy.apply_policy(
        spark.createDataFrame(rows, FILES), spark.createDataFrame(globs, "repo string, glob string")
    )
    assert left.columns == ["repo", "file_path"]
    return sorted(((r.repo, r.file_path) for r in left.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_random_globs(spark, seed):
    rng = random.Random(seed)
    some = lambda letters, most: "".join(rng.choice(letters) for _ in range(rng.randint(1, most)))
    rows = [(f"o/{rng.randint(0, 3)}", some("aab./\\é[]\n", 7)) for _ in range(300)]
    globs = [(f"o/{rng.randint(0, 4)}", some("aab./é*?[]!", 5)) for _ in range(60)]
    assert applied(spark, rows, globs) == remaining(rows, globs)


def test_kinds(spark):
    globs = ["a.py", "*.js", "**.js", "*", "**", "src/*", "src/**", "s*c", "a?", "[ab]", "x]", "a[", "a*\n"]
    table = spark.createDataFrame([("o/r", g) for g in globs] * 2, "repo string, glob string")
    found = {(r.kind, r.literal) for r in policy.classified(table).collect()}
    assert found == {
        ("name", "a.py"), ("tail", ".js"), ("tail", ""), ("head", "src/"), ("rest", "s*c"), ("rest", "a?"),
        ("rest", "[ab]"), ("name", "x]"), ("rest", "a["), ("rest", "a*\n"),
    }


def test_odd_rows(spark):
    """No repository, path, glob or policy; repeated rows; a very long path; everything excluded; empty tables."""
    long = "d/" * 50_000 + "x.lock"
    rows = [("o/a", None), (None, "a.py"), ("o/a", "a.py"), ("o/a", "a.py"), ("o/b", "a.py"), ("o/b", "b.py"), ("o/b", "b.py"),
            ("o/c", "a.py"), ("o/d", long), ("o/d", ""), ("o/d", "c\\win.lock")]
    globs = [("o/a", "a.py"), ("o/a", "a.py"), (None, "a.py"), ("o/b", None), ("o/b", ""), ("o/b", "a*"),
             ("o/c", "*"), ("o/d", "*.lock")]
    assert applied(spark, rows, globs) == remaining(rows, globs)
    assert ("o/d", long) not in remaining(rows, globs)
    assert applied(spark, rows, []) == sorted(rows, key=str)
    assert applied(spark, [], globs) == []


def test_lists_and_other_columns(spark):
    files = spark.createDataFrame([("o/a", "x.md", 1), ("o/a", "y.py", 2)], FILES + ", kind int")
    lists = spark.createDataFrame([("o/a", " *.md ,, docs/* ", "kept")], "repo string, excludes string, literal string")
    assert [tuple(r) for r in policy.apply_policy(files, lists).collect()] == [("o/a", "y.py", 2)]


def test_many_globs_are_joined_not_searched(spark):
    rows = [("o/big", f"pkg/m{i}/file_{i}.{'js' if i % 2 else 'py'}") for i in range(2000)]
    globs = [("o/big", g) for i in range(1000) for g in (f"file_{3 * i}.js", f"*_{7 * i}.py", f"pkg/m{11 * i}/*")]
    kept = policy.apply_policy(spark.createDataFrame(rows, FILES), spark.createDataFrame(globs, "repo string, glob string"))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in plan and "Join LeftAnti" in plan and "NestedLoop" not in kept._jdf.queryExecution().executedPlan().toString()
    numbers = {int(posixpath.basename(r.file_path).split("_")[1].split(".")[0]) for r in kept.collect()}
    assert numbers == {
        i for i in range(2000) if not (i % 2 and i % 3 == 0) and not (i % 2 == 0 and i % 7 == 0) and i % 11
    }


def test_wide_policies_are_not_broadcast(spark):
    """The patterns of all repositories together have no bound, however small the planner takes them for."""
    globs = spark.createDataFrame([("o/a", "s*c"), ("o/b", "*.py")], "repo string, glob string")
    files = spark.createDataFrame([("o/a", "src"), ("o/b", "x.py"), ("o/b", "x.js")], FILES)
    joined = policy.with_policy(files, globs)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert [tuple(r) for r in policy.apply_policy(files, globs).collect()] == [("o/b", "x.js")]
