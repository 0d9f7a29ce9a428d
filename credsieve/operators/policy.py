"""Exclusion of files by each repository's own globs, as joins.

A glob that is a plain name, a tail after ``*`` or a head before ``*`` is a key:
a file looks its own names, tails and heads up, tails and heads in the lengths
that its repository's globs have.  Only what is left of the globs becomes a
pattern.  So the work for a file grows with the number of lengths, not with the
number of globs.

``policies`` is a table with ``repo`` and either ``excludes``, a comma-separated
glob list, or ``glob``, one glob a row.  Rows without a repository or a glob
exclude nothing; rows that are there twice count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credsieve import session
from credsieve.functions import paths
from credsieve.operators import tree

NAME, TAIL, HEAD, REST = "name", "tail", "head", "rest"
_KEY = ["repo", "kind", "literal"]
# Keys such as a tail ".js" may be those of most files of a large repository.
_SALTS = 16


def classified(policies: DataFrame) -> DataFrame:
    """``repo, kind, literal`` of every glob, each once; of a REST, the literal is the glob.

    A table that has just these columns is classified already.
    """
    if policies.columns == _KEY:
        return policies
    if "glob" in policies.columns:
        rows = policies.select("repo", "glob")
    else:
        rows = policies.select("repo", F.explode(paths.parse_globs(F.col("excludes"))).alias("glob"))
    glob = F.col("glob")
    kind = (
        F.when(~glob.rlike(r"[*?\[]"), NAME)
        .when(glob.rlike(r"\A\*+[^*?\[]*\z"), TAIL)
        .when(glob.rlike(r"\A[^*?\[]*\*+\z"), HEAD)
        .otherwise(REST)
    )
    literal = F.when(F.col("kind") == REST, glob).otherwise(F.replace(glob, F.lit("*"), F.lit("")))
    sound = rows.where(F.col("repo").isNotNull() & (glob != ""))
    return sound.withColumn("kind", kind).select("repo", "kind", literal.alias("literal")).distinct()


def with_policy(rows: DataFrame, policies: DataFrame) -> DataFrame:
    """Attach the ``policy`` of each repository: what its files have to look up, and the pattern of its other globs.

    Join it while a repository is one row.  The globs that are no keys are one
    pattern, so they have to fit into a row.  The planner takes such rows for
    small ones and would broadcast all of them, so the join is hinted.
    """
    kind, length = F.col("kind"), F.char_length("literal")
    mine = classified(policies).groupBy("repo").agg(
        F.bool_or(kind == NAME).alias("named"),
        F.collect_set(F.when(kind == TAIL, length)).alias("tails"),
        F.collect_set(F.when(kind == HEAD, length)).alias("heads"),
        F.sort_array(F.collect_set(F.when(kind == REST, F.col("literal")))).alias("rest"),
    )
    fields = F.struct("named", "tails", "heads", paths.policy_pattern(F.col("rest")).alias("pattern"))
    return rows.join(mine.select("repo", fields.alias("policy")).hint("merge"), "repo", "left")


def _fits(pattern: Column, path: Column) -> Column:
    clean = paths.normalise(path)
    hit = F.rlike(clean, pattern) | F.rlike(paths.basename(clean), pattern)
    return F.coalesce(hit, F.lit(False))


def _asked(path: Column, policy: Column) -> Column:
    """All keys that would exclude a path, as an array of (kind, literal)."""
    clean = paths.normalise(path)
    forms = F.array_distinct(F.array(clean, paths.basename(clean)))

    def key(kind: str, literal: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), literal.alias("literal"))

    def cut(kind: str, lengths: Column, of: str) -> Column:
        return F.flatten(
            F.transform(
                forms,
                lambda form: F.transform(
                    F.filter(lengths, lambda n: n <= F.char_length(form)),
                    lambda n: key(kind, F.call_function(of, form, n)),
                ),
            )
        )

    names = F.when(policy["named"], F.transform(forms, lambda form: key(NAME, form))).otherwise(
        F.array().cast("array<struct<kind:string,literal:string>>")
    )
    keys = F.concat(names, cut(TAIL, policy["tails"], "right"), cut(HEAD, policy["heads"], "left"))
    return F.array_distinct(F.when(policy.isNotNull(), keys))


def unexcluded(files: DataFrame, policies: DataFrame) -> DataFrame:
    """The files that no glob of their repository's ``policy`` (see ``with_policy``) excludes, without that column.

    ``files`` are read twice, for their keys and for what stays, so store costly
    ones before.  Keys that no glob has are dropped by a bit table where they
    are made; it is filled, and the other keys are stored, when this is called.
    Only globs that some key asks for are copied for each salt.  A file without a
    path stays.
    """
    path, policy = F.col("file_path"), F.col("policy")
    left = files.where(~_fits(policy["pattern"], path))
    globs = classified(policies).where(F.col("kind") != REST)
    asked = (
        left.select("repo", "file_path", F.explode_outer(_asked(path, policy)).alias("key"))
        .where(F.col("key").isNotNull())
        .select("repo", "file_path", "key.kind", "key.literal")
    )
    likely = session.keep(tree.only_wanted(asked, globs, _KEY), "asked")
    met = globs.join(likely.select(*_KEY).distinct(), _KEY, "left_semi")
    salted = likely.withColumn("salt", F.pmod(F.xxhash64("file_path"), F.lit(_SALTS)).cast("int"))
    copies = met.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))).hint("merge")
    excluded = salted.join(copies, [*_KEY, "salt"], "left_semi").select("repo", "file_path").distinct()
    return left.drop("policy").join(excluded, ["repo", "file_path"], "left_anti")


def apply_policy(files: DataFrame, policies: DataFrame) -> DataFrame:
    """Drop files excluded by their repository's own policy, for files that are a table already."""
    globs = session.keep(classified(policies), "globs")
    return unexcluded(with_policy(files, globs), globs)
