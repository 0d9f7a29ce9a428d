"""One bad text, pattern, listing or key must not spoil a job."""

import re

import pytest
from pyspark.sql import functions as F

from credsieve.functions.pyregex import repeats_groups
from credsieve.operators import deepsearch, history, tree
from credsieve.operators.catalogue import DEFAULT_CATALOGUE, Signature
from credsieve.operators.detect import GAP_ERROR, LONGEST_MATCH, MATCH_ERROR, DetectOptions, detect
from credsieve.plans import jobs
from credsieve.sources import landed

AWS = "AKIA" + "ABCDEFGHIJKLMNOP"
FILES = "repo string, commit_sha string, valid boolean, files array<struct<filename:string,status:string,patch:string>>"


def options(*signatures, **more):
    return DetectOptions(catalogue=signatures, entropy=None, **more)


@pytest.mark.parametrize(
    "pattern, deep",
    [
        (r"x (?:a|b)+ END", True), (r"(a)*", True), (r"(ab){3,}", True), (r"(ab){501}", True), (r"((ab){30}c){30}", True),
        (r"(?:a|b)++ END", False), (r"[ab()]+\)+", False), (r"(ab){3,40}", False), (r"(ab)?", False), (r"\(a\)+", False),
        (r"[])]+(a)", False), (r"(a){}", False), (r"(?:(?:a+b){2,9}c){9}", False), (r"(?:a(?:b|c)*)?d", True),
    ],
)
def test_which_patterns_need_a_deep_stack(pattern, deep):
    assert repeats_groups(pattern) is deep


def test_the_catalogue_needs_none():
    assert not any(s.deep for s in DEFAULT_CATALOGUE)


def test_repeated_groups_over_a_million_characters(spark, units):
    hostile = Signature("hostile", r"x (?:a|b)+ END", "high", "x a END")
    narrowed = Signature("narrowed", r"k=(?P<secret>(?:ab|c)+);(?:d|e)*", "low", "k=ab;")
    long = "one\nx " + "ab" * 500_000 + " END and x b END\nk=abc;de k=c; # " + "￾"
    rows = units(("a", long), ("b", "x c END"), ("c", AWS))
    found = detect(rows, options(hostile, narrowed, *DEFAULT_CATALOGUE))
    got = sorted((r.file_path, r.line_number, r.pattern_name, len(r.matched_text)) for r in found.collect())
    assert got == [
        ("a", 2, "hostile", 7), ("a", 2, "hostile", 1_000_006), ("a", 3, "narrowed", 1), ("a", 3, "narrowed", 3),
        ("c", 1, "AWS access key", 20),
    ]


def test_searches_agree_with_the_other_engine(spark, units):
    """The same signature, once with a repeated group and once with a class."""
    texts = ["ab-ab-c", "\n\nxab-\n ab-", "", "ab-" * 50 + "\n" + "ab", "é ab-ab￿ab-ab-"]
    deep = Signature("same", r"(?:ab-)+(?:a|b)?", "high", "ab-")
    flat = Signature("same", r"(?:ab-){1,90}[ab]?", "high", "ab-")
    assert deep.deep and not flat.deep
    shown = [sorted(map(tuple, detect(units(*texts), options(s)).collect())) for s in (deep, flat)]
    assert shown[0] == shown[1] and shown[0]


def test_a_search_that_takes_too_long_is_an_error_of_its_text(spark, units):
    slow = Signature("slow", r"(x+x+)+y", "high", "xxy")
    rows = units(("a", "x" * 40), ("b", "xxy"), ("c", "none"))
    chosen = options(slow, search_seconds=1)
    assert [r.file_path for r in detect(rows, chosen).collect()] == ["b"]
    lost = jobs.unsearched(rows, jobs.ScanOptions(detect=chosen)).collect()
    assert [(r.file_path, r.error) for r in lost] == [("a", deepsearch.TIME_ERROR)]


def test_search_gives_pieces_between_matches():
    found = deepsearch.search(re.compile("(a|(b))+"), 2, "xaby", 5)
    assert found == {"matches": ["ab"], "gaps": ["x", "y"], "narrowed": ["b"]}


def histories(spark, patches, chosen=DetectOptions()):
    """One repository for each patch, with one commit."""
    names = [f"o/r{i}" for i in range(len(patches))]
    repos = spark.createDataFrame([(n, "") for n in names], "full_name string, default_branch string")
    commits = spark.createDataFrame([(n, "main", 0, f"c{n}") for n in names], "repo string, branch string, pos int, commit_sha string")
    files = spark.createDataFrame([(n, f"c{n}", True, [("f", "m", p)]) for n, p in zip(names, patches, strict=True)], FILES)
    return jobs.scan_histories(repos, commits, files, jobs.ScanOptions(detect=chosen))


def key_in_two_hunks(last):
    return f"@@ -1 +1 @@\n+-----BEGIN RSA PRIVATE KEY-----\n@@ -9 +{last} @@\n+-----END RSA PRIVATE KEY-----\n+{AWS}"


def test_a_key_over_three_billion_lines_fails_its_repository_alone(spark):
    result = histories(
        spark,
        [
            key_in_two_hunks(3_000_000_000), f"@@ -1 +4000000000 @@\n+{AWS}", key_in_two_hunks(1002),
            f"@@ -1 +12345678901234567890123 @@\n+q\n@@ -2 +1 @@\n+{AWS}",
        ],
    )
    failures = {(r.repo, r.branch, r.error) for r in result.failures.collect()}
    assert failures == {("o/r0", "main", MATCH_ERROR), ("o/r3", "main", history.HUNK_ERROR)}
    found = {(r.repo, r.line_number, r.pattern_name): r.matched_text for r in result.findings.collect()}
    assert {k[:2] for k in found} == {("o/r1", 4_000_000_000), ("o/r2", 1), ("o/r2", 1003)}
    whole = "-----BEGIN RSA PRIVATE KEY-----" + "\n" * 1001 + "-----END RSA PRIVATE KEY-----"
    kept = len(whole) // 5
    assert found["o/r2", 1, "PEM private key"] == whole[:kept] + "*" * (len(whole) - 2 * kept) + whole[-kept:]


def test_blank_lines_that_a_signature_counts(spark):
    counting = Signature("counting", r"a\n{5}b", "high", "a\n\n\n\n\nb")
    assert not counting.elastic
    result = histories(
        spark, ["@@ -1 +1 @@\n+a\n@@ -2 +6 @@\n+b", f"@@ -1 +1 @@\n+a\n@@ -2 +{LONGEST_MATCH * 60} @@\n+b"], options(counting)
    )
    assert [(r.repo, r.line_number) for r in result.findings.collect()] == [("o/r0", 1)]
    assert [(r.repo, r.error) for r in result.failures.collect()] == [("o/r1", GAP_ERROR)]


def test_a_slow_blob_fails_every_repository_that_wants_it(spark):
    slow = Signature("slow", r"(x+x+)+y", "high", "xxy")
    names = ["o/a", "o/b"]
    repos = spark.createDataFrame([(n, "") for n in names], "full_name string, default_branch string")
    heads = spark.createDataFrame([(n, "main", f"h{n}") for n in names], "repo string, branch string, commit_sha string")
    item = "path string, mode string, type string, sha string, size bigint, url string"
    trees = spark.createDataFrame(
        [(n, f"h{n}", f"h{n}", False, True, [("f", "", "blob", "s1" if n == "o/a" else "s2", 9, "")]) for n in names],
        f"repo string, commit_sha string, sha string, truncated boolean, valid boolean, tree array<struct<{item.replace(' string', ':string').replace(' bigint', ':bigint')}>>",
    )
    blobs = spark.createDataFrame([("o/a", "s1", "x" * 40), ("o/b", "s2", "xxy")], "repo string, sha string, content string")
    result = jobs.scan_trees(repos, heads, trees, blobs, jobs.ScanOptions(detect=options(slow, search_seconds=1)))
    assert [r.repo for r in result.findings.collect()] == ["o/b"]
    assert [(r.repo, r.error) for r in result.failures.collect()] == [("o/a", deepsearch.TIME_ERROR)]


# --- listings that move, landings that repeat ---


def listing(spark, *positions):
    return spark.createDataFrame([("r", "main", p, c) for p, c in positions], "repo string, branch string, pos int, commit_sha string")


def newest(commits, n):
    return [(r.pos, r.commit_sha) for r in history.newest_commits(commits, n).orderBy("pos").collect()]


def test_a_commit_on_two_pages_counts_once(spark):
    commits = listing(spark, (0, "c3"), (1, "c2"), (2, "c2"), (3, "c1"), (None, None))
    assert newest(commits, 3) == [(0, "c3"), (1, "c2"), (2, "c1")]
    assert newest(commits, 2) == [(0, "c3"), (1, "c2")]
    assert history.gapped_listings(commits, history.newest_commits(commits, 3)).collect() == []


def test_a_missing_page_matters_where_commits_behind_it_are_wanted(spark):
    commits = listing(spark, (0, "c5"), (1, "c4"), (4, "c1"))
    gaps = lambda n: history.gapped_listings(commits, history.newest_commits(commits, n)).count()
    assert [gaps(n) for n in (1, 2, 3, 9)] == [0, 0, 1, 1]


def test_items_that_are_no_objects_keep_their_place(spark):
    pages = spark.createDataFrame([("r", "main", 4, '[{"sha":"a"}, 7, {"sha":"b"}]')], "repo string, branch string, page_start int, payload string")
    assert [(r.pos, r.commit_sha) for r in landed.parse_commits(pages).orderBy("pos").collect()] == [(4, "a"), (6, "b")]


def test_the_newest_landing_of_a_branch_and_a_repository_counts(spark):
    at = "timestamp_seconds(t) AS landed_at"
    branches = spark.createDataFrame(
        [("r", "main", "f_old", True, 1), ("r", "main", "a_new", True, 2), ("r", "main", None, False, 3)],
        "repo string, branch string, commit_sha string, valid boolean, t int",
    ).selectExpr("repo", "branch", "commit_sha", "valid", at)
    chosen = spark.createDataFrame([("r", "main", None)], "repo string, branch string, error string")
    assert [r.commit_sha for r in tree.with_heads(chosen, branches).collect()] == ["a_new"]
    repos = spark.createDataFrame([("o/r", "zz", 1), ("o/r", "dev", 2)], "full_name string, default_branch string, t int").selectExpr(
        "full_name", "default_branch", at
    )
    assert [r.branch for r in tree.targets(repos).collect()] == ["dev"]


def test_files_say_when_they_were_landed(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"repo": "r", "branch": "b", "payload": "{}"}\n')
    rows = landed.read_payloads(spark, str(tmp_path), "repo string, branch string")
    assert rows.columns == ["repo", "branch", "payload", "landed_at"]
    assert landed.parse_branches(rows).first().landed_at is not None


# --- pruning ---


def test_pruning_has_no_limit_of_keys(spark):
    sha = F.md5(F.col("id").cast("string")).alias("sha")
    keys = spark.range(600_000).select(F.lit("r").alias("repo"), sha)
    texts = spark.range(1_500_000).select(F.lit("r").alias("repo"), sha, "id")
    kept = tree.only_wanted(texts, keys, ["repo", "sha"])
    counts = kept.agg(F.count_if(F.col("id") < 600_000).alias("wanted"), F.count("*").alias("n")).first()
    assert counts.wanted == 600_000 and counts.n < 600_000 + 0.1 * 900_000
    none = tree.only_wanted(texts.limit(1000), keys.limit(0), ["repo", "sha"])
    assert none.count() == 0


def test_payloads_that_nothing_wants_are_not_decoded(spark, tmp_path):
    spark.range(2000).select(
        F.lit("r").alias("repo"), F.col("id").cast("string").alias("sha"), F.lit('{"encoding":"base64","content":"YWJj"}').alias("payload")
    ).write.parquet(str(tmp_path / "blobs"))
    payloads = spark.read.parquet(str(tmp_path / "blobs"))
    keys = spark.range(20).select(F.lit("r").alias("repo"), F.col("id").cast("string").alias("sha"))
    known = jobs._wanted(payloads, keys, ["repo", "sha"], landed.parse_blobs).where("valid")
    plan = known._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("from_json") < plan.index("Join LeftSemi") and "from_json" not in plan[plan.index("Join LeftSemi") :]
    assert {r.content for r in known.collect()} == {"abc"} and 20 <= known.count() < 300


# --- large trees ---


def test_a_tree_of_very_many_items_is_no_array(spark, tmp_path):
    n = 300_000
    item = """concat('{"path":"d/f', i, '","type":"', if(i % 3 = 0, 'tree', 'blob'), '","sha":"s', i % 10, '","size":5}')"""
    listing = F.expr(f"""concat('{{"truncated":false,"tree":[7,', array_join(transform(sequence(1, {n}), i -> {item}), ','), ']}}')""")
    spark.range(1).select(F.lit("o/r").alias("repo"), F.lit("h").alias("commit_sha"), listing.alias("payload")).write.parquet(str(tmp_path / "t"))
    trees = spark.read.parquet(str(tmp_path / "t"))
    items = landed.tree_items(trees)
    plan = items._jdf.queryExecution().optimizedPlan().toString()
    assert "variant_explode" in plan and "transform(" not in plan and "array<" not in items.schema.simpleString()
    counted = items.agg(F.count("*").alias("n"), F.min("unit_ord").alias("first"), F.max("unit_ord").alias("last")).first()
    assert tuple(counted) == (n, 1, n)
    repos = spark.createDataFrame([("o/r", "")], "full_name string, default_branch string")
    heads = spark.createDataFrame([("o/r", "main", "h")], "repo string, branch string, commit_sha string")
    blobs = spark.createDataFrame([("o/r", f"s{i}", AWS if i == 4 else "none") for i in range(10)], "repo string, sha string, content string")
    result = jobs.scan_trees(repos, heads, trees.union(trees), blobs)
    assert result.failures.count() == 0
    assert result.findings.where("pattern_name = 'AWS access key'").count() == sum(i % 10 == 4 and i % 3 > 0 for i in range(1, n + 1))


def test_tree_payloads_that_cannot_be_scanned(spark):
    repos = spark.createDataFrame([(f"o/r{i}", "") for i in range(5)], "full_name string, default_branch string")
    heads = spark.createDataFrame([(f"o/r{i}", "main", "h") for i in range(5)], "repo string, branch string, commit_sha string")
    whole = '{"tree":[{"path":"f","type":"blob","sha":"s"}]}'
    rows = [("o/r0", whole), ("o/r0", '{"truncated":true,"tree":[]}'), ("o/r1", '{"truncated":true,"tree":[]}'), ("o/r2", "{"), ("o/r3", "{}")]
    trees = spark.createDataFrame([(r, "h", p) for r, p in rows], "repo string, commit_sha string, payload string")
    blobs = spark.createDataFrame([("o/r0", "s", AWS)], "repo string, sha string, content string")
    result = jobs.scan_trees(repos, heads, trees, blobs)
    assert [(r.repo, r.file_path) for r in result.findings.collect()] == [("o/r0", "f")]
    failed = {r.repo: r.error for r in result.failures.collect()}
    assert set(failed) == {"o/r1", "o/r2", "o/r4"} and failed["o/r2"] == failed["o/r4"] == tree.TREE_ERROR
