"""From repositories to the files to scan, with failures as rows.

Every step keeps one row per repository until the tree is exploded, so a
repository that cannot be scanned completely turns into a row of ``failures``
and none of its files is scanned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credsieve import fixed_values as fixed
from credsieve import session
from credsieve.functions import paths

BRANCH_ERROR = "branch head not found"
BRANCH_RECORD_ERROR = "branch record not valid"
TREE_ERROR = "tree listing not found or not valid"
BLOB_ERROR = "blob not found or not valid"
COMMITS_ERROR = "commit listing not found"
COMMITS_PAGE_ERROR = "commit listing not valid"
COMMITS_GAP_ERROR = "commit listing with a gap"
COMMIT_FILES_ERROR = "commit record not found or not valid"


def targets(repos: DataFrame, branch: str | None = None) -> DataFrame:
    """One row per repository: ``repo``, ``branch`` and an ``error`` or NULL.

    ``repo`` is the cleaned ``owner/repo`` label for valid names and the name as
    listed for others; a record that could not be read has an empty one.
    ``repo_pos`` is the place in the listing, where that is known.  A repository
    that was listed twice counts once, as it was landed last if that is known.
    """
    name = F.coalesce("full_name", F.lit(""))
    valid = paths.valid_repo_name(name)
    given = F.col("error") if "error" in repos.columns else F.lit(None).cast("string")
    place = F.col("listed_at") if "listed_at" in repos.columns else F.lit(None)
    rows = repos.select(
        F.when(valid, paths.repo_label(name)).otherwise(name).alias("repo"),
        paths.target_branch(F.col("default_branch"), branch).alias("branch"),
        F.coalesce(given, F.when(~valid, fixed.BAD_REPO_NAME_ERROR)).alias("error"),
        place.cast("bigint").alias("repo_pos"),
        _landed(repos).alias("landed_at"),
    )
    sound = rows.where("error is null")
    if "landed_at" in repos.columns:
        last = F.max_by(F.struct("branch", "error"), F.struct("landed_at", "branch")).alias("last")
        once = sound.groupBy("repo").agg(last, F.min("repo_pos").alias("repo_pos")).select("repo", "last.*", "repo_pos")
    else:
        once = sound.groupBy("repo", "branch", "error").agg(F.min("repo_pos").alias("repo_pos"))
    return once.unionByName(rows.where("error is not null").drop("landed_at"))


def _landed(table: DataFrame) -> Column:
    """When a record was landed; tables from elsewhere may not know."""
    return F.col("landed_at") if "landed_at" in table.columns else F.lit(None).cast("timestamp")


def valid_rows(table: DataFrame) -> Column:
    """The ``valid`` flag of a parsed table; tables from elsewhere may lack it."""
    return F.coalesce("valid", F.lit(False)) if "valid" in table.columns else F.lit(True)


def one_repo(repos: DataFrame, full_name: str) -> DataFrame:
    """The repository named ``owner/repo``, blanks around the parts ignored."""
    parts = [part.strip() for part in full_name.split("/")]
    if len(parts) != 2 or "" in parts:
        raise ValueError(fixed.BAD_REPO_NAME_ERROR)
    return repos.where(paths.repo_label(F.col("full_name")) == "/".join(parts))


def with_heads(chosen: DataFrame, branches: DataFrame) -> DataFrame:
    """Resolve the head commit of every target branch.

    Of a branch that was landed more than once, the newest record that can be
    read counts; without ``landed_at``, or within one landing, that with the greatest hash.
    """
    state = F.struct(valid_rows(branches).alias("ok"), _landed(branches).alias("landed_at"), "commit_sha")
    heads = branches.groupBy("repo", "branch").agg(F.max(state).alias("head"))
    problem = F.when(F.col("head").isNull(), BRANCH_ERROR).when(
        ~F.col("head.ok") | F.col("head.commit_sha").isNull(), BRANCH_RECORD_ERROR
    )
    joined = chosen.join(heads, ["repo", "branch"], "left").withColumn("commit_sha", F.col("head.commit_sha"))
    return joined.withColumn("error", F.coalesce("error", problem)).drop("head")


def with_tree_states(resolved: DataFrame, states: DataFrame) -> DataFrame:
    """Whether the tree of each head commit can be scanned; ``states`` has ``valid`` and ``truncated``.

    Of a listing that was landed more than once, the best copy counts.
    """
    best = states.groupBy("repo", "commit_sha").agg(F.min(F.struct(~F.col("valid"), "truncated").alias("state")).alias("state"))
    flags = best.select("repo", "commit_sha", (~F.col("state.col1")).alias("valid"), F.col("state.truncated").alias("truncated"))
    problem = F.when(~F.coalesce("valid", F.lit(False)), TREE_ERROR).when(F.col("truncated"), fixed.TRUNCATED_TREE_ERROR)
    joined = resolved.join(flags, ["repo", "commit_sha"], "left")
    return joined.withColumn("error", F.coalesce("error", problem)).drop("valid", "truncated")


_SALTS = 16
_PLACES = ("repo", "repo_pos", "branch", "commit_sha")


def files_of_items(
    listed: DataFrame,
    items: DataFrame,
    excludes: tuple[str, ...] = fixed.DEFAULT_EXCLUDES,
    max_bytes: int = fixed.MAX_FILE_SIZE_BYTES,
) -> DataFrame:
    """The files to scan of sound repositories, from tree items that are rows already.

    Items are chosen where they lie.  A tree with very many of them is dealt to
    several tasks by their number; what was landed twice counts once.  The
    ``policy`` of a repository, if there is one, goes with its files.
    """
    places = [*_PLACES, *(c for c in listed.columns if c == "policy")]
    sound = listed.where(F.col("error").isNull()).select(*places)
    chosen = items.where(wanted_item(F.col("type"), F.col("size"), F.col("path"), excludes, max_bytes))
    once = chosen.select("repo", "commit_sha", "unit_ord", F.col("path").alias("file_path"), "sha").distinct()
    dealt = once.withColumn("salt", (F.col("unit_ord") % _SALTS).cast("int"))
    copies = sound.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return dealt.join(copies, ["repo", "commit_sha", "salt"]).select(*places, "file_path", "sha", "unit_ord")


def with_trees(resolved: DataFrame, trees: DataFrame) -> DataFrame:
    """Attach the tree of the head commit; truncated listings are refused."""
    best = Window.partitionBy("repo", "commit_sha").orderBy(F.col("valid").desc(), "truncated")
    once = trees.withColumn("copy", F.row_number().over(best)).where("copy = 1")
    listed = once.select("repo", "commit_sha", "valid", "truncated", "tree")
    problem = F.when(~F.coalesce("valid", F.lit(False)), TREE_ERROR).when(
        F.col("truncated"), fixed.TRUNCATED_TREE_ERROR
    )
    return (
        resolved.join(listed, ["repo", "commit_sha"], "left")
        .withColumn("error", F.coalesce("error", problem))
        .withColumn("tree", F.when(F.col("error").isNull(), F.col("tree")))
    )


def wanted_item(
    kind: Column,
    size: Column,
    path: Column,
    excludes: tuple[str, ...] = fixed.DEFAULT_EXCLUDES,
    max_bytes: int = fixed.MAX_FILE_SIZE_BYTES,
) -> Column:
    """A tree item to scan: a blob, not too large, not excluded."""
    return (
        (kind == "blob")
        & paths.within_size(size, max_bytes)
        & ~paths.matches_any_glob(path, excludes)
    )


def tree_files(
    listed: DataFrame,
    excludes: tuple[str, ...] = fixed.DEFAULT_EXCLUDES,
    max_bytes: int = fixed.MAX_FILE_SIZE_BYTES,
) -> DataFrame:
    """Explode the trees of sound repositories to the files to scan.

    The ``policy`` of a repository, if there is one, goes with its files.
    """
    places = [*_PLACES, *(c for c in listed.columns if c == "policy")]
    items = listed.where(F.col("error").isNull()).select(
        *places, F.posexplode_outer("tree").alias("unit_ord", "item")
    )
    chosen = wanted_item(F.col("item.type"), F.col("item.size"), F.col("item.path"), excludes, max_bytes)
    return items.where(chosen).select(
        *places,
        F.col("item.path").alias("file_path"),
        F.col("item.sha").alias("sha"),
        "unit_ord",
    )


def unscanned_blobs(blobs: DataFrame) -> DataFrame:
    """How many blobs of each repository have no text that could be scanned."""
    return blobs.groupBy("repo").agg(
        F.count("*").alias("n_blobs"),
        F.count_if(F.col("content").isNull()).alias("n_unscanned"),
    )


#: Bits for each wanted key, and in all: what is sent to the tasks has a bound, whatever the number of keys.
BITS_A_KEY = 16
MOST_BITS = 1 << 26


def only_wanted(texts: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows of a table of texts that some key may ask for, without moving texts.

    The hashes of the keys are gathered as a bit table, 64 bits a row, which is
    broadcast; a row of ``texts`` stays if the bit of its key is set, and only
    then are its costly columns computed.  All wanted rows stay.  Others stay by
    chance, about one in BITS_A_KEY, and more the more keys share MOST_BITS: the
    join of what is found with the keys decides.
    """
    keys = keys.select(*on).distinct()
    bits, n = 1 << 10, keys.count()
    while bits < min(n * BITS_A_KEY, MOST_BITS):
        bits *= 2
    bit = F.pmod(F.xxhash64(*(F.col(c).cast("string") for c in on)), F.lit(bits))
    set_bits = session.keep(
        keys.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("held")
        ),
        "bits",
    )
    own = F.pmod(F.xxhash64(*(texts[c].cast("string") for c in on)), F.lit(bits))
    # the place of a bit varies by row, which the function for a constant shift does not take
    is_set = F.call_function("shiftright", F.col("held"), own.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1
    return texts.join(F.broadcast(set_bits), (F.shiftright(own, 6) == F.col("word")) & is_set, "left_semi")


def failures_of(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("error").isNotNull()).select("repo", "branch", "error")


def missing(wanted: DataFrame, present: DataFrame, on: list[str], error: str) -> DataFrame:
    """Failure rows of the repositories that want a key that is not present.

    Only the keys take part; no content is read or moved.  Copies of a key are
    merged before the join, so a blob with very many paths is one row of it.
    """
    return (
        wanted.select("repo", "branch", *[c for c in on if c != "repo"])
        .distinct()
        .join(present.select(*on), on, "left_anti")
        .select("repo", "branch")
        .distinct()
        .withColumn("error", F.lit(error))
    )
